"""The pipeline against a plain version of each stage, on its own input."""

import hashlib

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import byte_bpe, compress_langid
from test_exact_and_language import brute_groups
from test_near_dup import brute as brute_near
from test_scans import brute_overlap

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = [(9001, None, "en", "s", 0), (9002, "123 --", "en", "s", 6), (9003, docs.first().text, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    columns, items = docs.columns, [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        if name == "language":
            model = compress_langid.fit(docs.filter(corpus_pipeline.fold(4) != 2))
            want = {r.id for r in compress_langid.predict(docs, model).filter("not rejected").collect()}
            assert not {9001, 9002} & want and len(want) > 0.97 * len(before)
        elif name == "exact":
            want = {r[0] for r in brute_groups(before.items()) if r[3]}
        elif name == "near":
            want = {r[0] for r in brute_near(list(before.items()), 5, 80) if r[3]}
        elif name == "benchmark":
            want = {r[0] for r in brute_overlap(before.items(), items) if not (r[2] and 20 * r[2] >= r[1])}
        else:
            want = set(before)
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == {i: before[i] for i in want}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY)), special_tokens={})
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == want
    for i, text in before.items():
        ids = enc.encode_ordinary(text)
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids) and got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_run(spark):
    out = corpus_pipeline.run(spark, DIR)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.filter(F.col("n_tokens") == 0).count() == 0
    assert 0.8 * 200 < out.count() <= 200


def test_odd_tables(spark, tmp_path):
    """Repeated rows, clashing and null ids, null and empty texts, a very long text, columns of clashing names; and an empty table."""
    base = spark.read.parquet(f"{DIR}/documents.parquet").filter("lang is not null").orderBy("doc_id").limit(40)
    first = base.first()
    # (id, text): the stages leave one of repeated rows, and rows of one id and other texts alone
    texts = [r.text for r in base.collect()]
    odd = [tuple(first), (first.doc_id, texts[5] + " " + texts[6] + " " + texts[7], "en", "s", 0), (None, texts[1], "en", "s", 0), (None, texts[8] + " " + texts[9] + " " + texts[10], "en", "s", 0), (None, None, "en", "s", 0), (-5, "", None, None, None)]
    odd.append((-6, " ".join(texts[11:20]) * 20, "en", "s", 0))
    docs = base.unionByName(spark.createDataFrame(odd, base.schema)).withColumns({c: F.lit("clash") for c in ("id", "norm", "items", "ids", "__norm", "row")})
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        assert stage(spark, empty, DIR).count() == 0
        after = spark.read.parquet(str(tmp_path / name))
        if name == "tokens":
            assert after.count() == len(before)
            continue
        assert after.columns == docs.columns
        rows = after.collect()
        assert len({(r.doc_id, r.text) for r in rows}) == (len(rows) if name != "language" else len(rows) - 1)
        docs, empty = after, after.limit(0)
    kept = {(r.doc_id, r.text) for r in rows}
    assert (first.doc_id, odd[1][1]) in kept and (None, texts[1]) not in kept and (None, odd[3][1]) in kept and (-6, odd[6][1]) in kept
