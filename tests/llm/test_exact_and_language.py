import hashlib
import random
import re
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import compress_langid, exact_dedup, queries

DIR = "/root/testdata/sf0.001"


def brute_groups(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    by = defaultdict(list)
    for i, t in rows:
        by[norm(t)].append(i)
    out = []
    for t, ids in by.items():
        real = [i for i in ids if i is not None]
        keep = min(real) if real else None
        out += [(i, keep, len(ids), i is not None and i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_kept(rows):
    """Of each text the row with the smallest id, null ids last, once."""
    by = defaultdict(list)
    for i, t in rows:
        by[normal(t)].append(i)
    return sorted(((min((i for i in ids if i is not None), default=None), t) for t, ids in by.items()), key=str)


CASES = [
    [],
    [(1, None), (2, ""), (3, " "), (4, "\t\n"), (5, " a"), (6, "a")],
    [(k, "same  text") for k in range(300, 0, -1)] + [(k + 1000, f"other {k % 7}") for k in range(50)],
    [(7, "x\ty"), (7, "x y"), (None, "x y"), (None, "z")],
    [(1, "x y"), (None, "x y"), (None, "x  y"), (2, "a"), (2, "a"), (2, "b"), (None, None), (None, "")],
    [(k % 40, "p" * 150 + f" {k % 7} tail") for k in range(400)] + [(k, "p" * 150) for k in range(40, 60)],
    [(1, "long " * 50000), (2, "long " * 50000), (3, "long " * 49999 + "end "), (4, "NBSP  is no space"), (5, "NBSP \x0bis no space")],
]


@pytest.mark.parametrize("rows", CASES)
def test_groups(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("norm", F.lit(1)).repartition(3)
    assert sorted(map(tuple, exact_dedup.groups(df).collect()), key=str) == brute_groups(rows)
    kept = exact_dedup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, normal(r.text)) for r in kept.collect()), key=str) == brute_kept(rows)


def test_hot_group_spans_partitions(spark):
    """Runs that go on over many ranges are joined again."""
    rows = [(k, "hot text") for k in range(5000)] + [(k + 10_000, f"text {k}") for k in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = exact_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
        assert got.filter("group_size = 5000 and keep_id = 0").count() == 5000 and got.filter("kept").count() == 301
        kept = exact_dedup.deduplicate(spark.createDataFrame(rows + rows[:50], "doc_id long, text string").repartition(5))
        assert sorted(r.doc_id for r in kept.collect()) == [0, *range(10_000, 10_300)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = queries.op4_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out")
    n, right = got.count(), got.filter("lang = lang_pred").count()
    assert n > 200 and right / n > 0.97
    assert got.filter("score < 0 or score > 1").count() == 0 and got.filter("rejected").count() <= 0.02 * n


def test_language_cases(spark):
    train = spark.createDataFrame([(k, "der die und nicht mit einer" if k % 2 else "the and with not one of", "de" if k % 2 else "en") for k in range(40)], "doc_id long, text string, lang string")
    model = compress_langid.fit(train.unionByName(train.limit(3).withColumn("lang", F.lit(None).cast("string"))))
    assert set(model) == {"de", "en"} and model == compress_langid.fit(train.repartition(5))
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "THE AND!! WITH!! ONE OF"), (5, "nicht mit einer und " * 20000), (6, "q"), (7, "\u00b2"), (8, "\u00bd \u2460"), (9, "\u2167"), (None, "the and with"), (4, "THE AND!! WITH!! ONE OF"), (10, "\u0301\u20dd")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang_pred", F.lit("clash"))
    got = {r.id: r for r in compress_langid.predict(df, model).collect()}
    assert [got[k].lang_pred for k in range(1, 6)] == ["und", "und", "und", "en", "de"]
    assert all(tuple(got[k])[1:] == ("und", 0.0, True, 0) for k in (1, 2, 3, 7, 8, 9, 10)) and got[None].lang_pred == "en"
    same = compress_langid.predict(train.limit(4), {"a": model["de"], "b": model["de"]}).collect()  # ties
    assert {(r.lang_pred, r.score, r.rejected) for r in same} == {("a", 0.5, True)}
    assert [got[k].rejected for k in range(1, 6)] == [True, True, True, False, False] and got[1].score == 0
    kept = compress_langid.keep_known(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if not r.rejected}
    assert kept.filter("doc_id = 4").count() == 2
    assert {r.lang_pred for r in compress_langid.predict(df, {}).collect()} == {"und"}
    assert compress_langid.predict(df.limit(0), model).count() == 0 and compress_langid.fit(train.limit(0)) == {}


def test_language_letters():
    """Letters are Unicode's class L, over all code points."""
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            assert bool(compress_langid.letters(chr(c))) == (unicodedata.category(chr(c))[0] == "L"), hex(c)


def test_many_languages(spark):
    """Every labelled language is learned, however many there are."""
    train = spark.range(900).selectExpr("id AS doc_id", "concat('wort', id % 300, ' andere', id % 300) AS text", "concat('l', id % 300) AS lang")
    assert len(compress_langid.fit(train)) == 300
    with pytest.raises(ValueError, match="languages need"):
        compress_langid.fit(train, size=1 << 28)


def test_dictionaries(spark):
    """The most frequent words of the whole texts of the sample, the most frequent last, up to the size."""
    train = spark.createDataFrame([(1, "Ab ab, c " + "x " * 3000 + "tail tail tail"), (2, "c c 12 ab")], "doc_id long, text string").withColumn("lang", F.lit("q"))
    assert compress_langid.fit(train) == {"q": b"tail c ab x"}
    assert compress_langid.fit(train, size=9) == {"q": b"c ab x"}


def test_language_junk(spark):
    """Letters of no language are rejected, the longer the surer; labelled documents that the model has not seen stay."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang is not null")
    model = compress_langid.fit(docs.filter(queries.fold(4) != 2))
    sizes = {10: 0.3, 20: 0.12, 50: 0.12, 100: 0.05, 500: 0.0, 3000: 0.0}
    rows = [(1000 * k + j, " ".join(word() for _ in range(n))) for k, n in enumerate(sizes) for j in range(60 if n < 3000 else 12)]
    got = compress_langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    for k, (n, most) in enumerate(sizes.items()):
        own = [r for r in got if r.id // 1000 == k]
        assert sum(not r.rejected for r in own) <= most * len(own), n
        assert all(r.rejected == (r.score < 0.75) for r in own)
    held = compress_langid.predict(docs.filter(queries.fold(4) == 2), model)
    assert held.filter("rejected").count() <= 0.01 * held.count()
