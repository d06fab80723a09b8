import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import katz, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_discounts(n):
    """d(1..5) of the counts of counts n by Katz's formula on counts (r + 1) S(r + 1) / S(r), S(r) = exp(a) r^b fitted to r up to 12."""
    rs = sorted(r for r in n if r <= 12)
    x, y = [math.log(r) for r in rs], []
    for k, r in enumerate(rs):
        before, after = rs[k - 1] if k else 0, rs[k + 1] if k + 1 < len(rs) else 2 * r - (rs[k - 1] if k else 0)
        y.append(math.log(n[r] * 2 / (after - before)))
    out = {0: 0.0, 6: 1 - katz.TAIL}
    b = np.polyfit(x, y, 1)[0] if len(rs) > 1 and 1 in n else 0
    if b < -1:
        smooth = lambda r: r**b
        common = 6 * smooth(6) / smooth(1)
        return out | {r: ((r + 1) * smooth(r + 1) / smooth(r) / r - common) / (1 - common) for r in range(1, 6)}
    less = min(n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5, 0.999)
    return out | {r: (r - less) / r for r in range(1, 6)}


def brute(rows, order):
    """Recursive Katz model on dictionaries."""
    docs = [(i, [*WORD.findall((t or "").translate({k: k + 32 for k in range(65, 91)})), None], train) for i, t, train in rows]
    count = [None] + [Counter() for _ in range(order)]
    for _, words, train in docs:
        line = ["<s>"] * (order - 1) + words
        for j in range(order - 1, len(line)) if train else ():
            for m in range(1, order + 1):
                count[m][tuple(line[j - m + 1 : j + 1])] += 1
    total = sum(count[1].values())
    d = {m: plain_discounts(Counter(count[m].values())) for m in range(1, order + 1)}
    unknown = 1 - sum(d[1][min(c, 6)] * c for c in count[1].values()) / total if total else 1.0
    after, heads = [defaultdict(list) for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
    for m in range(2, order + 1):
        for g, c in count[m].items():
            after[m][g[:-1]].append(g[-1])
            heads[m][g[:-1]] += c
    alpha = {}

    def p(m, g):
        c = count[m][g]
        if m == 1:
            return d[1][min(c, katz.K + 1)] * c / total if c else unknown
        h = g[:-1]
        if c:
            return d[m][min(c, katz.K + 1)] * c / heads[m][h]
        if not heads[m][h]:
            return p(m - 1, g[1:])
        if (m, h) not in alpha:
            alpha[m, h] = (1 - sum(p(m, (*h, w)) for w in after[m][h])) / (1 - sum(p(m - 1, (*h[1:], w)) for w in after[m][h]))
        return alpha[m, h] * p(m - 1, g[1:])

    out = {}
    for i, words, train in docs:
        line = ["<s>"] * (order - 1) + words
        base = sum(math.log10((count[1][(w,)] + 0.5) / (total + 0.5 * (len(count[1]) + 1))) for w in words)
        out[i] = (train, len(words), sum(count[1][(w,)] > 0 for w in words), base, sum(math.log10(p(order, tuple(line[j - order + 1 : j + 1]))) for j in range(order - 1, len(line))), total)
    return out, p, [g[0] for g in count[1]], list(heads[order])


def check(spark, rows, order, chunk):
    df = spark.createDataFrame(rows, "doc_id long, text string, t boolean").withColumn("train", F.lit("clash"))
    found = katz.score(df, F.col("t"), order=order, chunk=chunk, range_bytes=50_000).collect()
    got = {r.id: tuple(r)[1:] for r in found}
    want, p, words, heads = brute(rows, order)
    assert set(got) == set(want)
    for i, w in want.items():
        assert got[i][:3] == w[:3] and got[i][5] == w[5] and got[i][3] == pytest.approx(w[3]) and got[i][4] == pytest.approx(w[4], rel=1e-6, abs=1e-9)
    for h in heads[:8]:  # the probabilities of all words and the unknown class add up
        assert sum(p(order, (*h, w)) for w in words) + p(order, (*h, "\0unknown")) == pytest.approx(1, abs=1e-9)


def test_good_turing(spark):
    """On documents every order has smoothed Good-Turing discounts, which rise with the count and equal a plain version's."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = katz.fit(docs, queries.fold(5) != 1, order=3)
    lines = [[None, None] + WORD.findall((r.text or "").translate({k: k + 32 for k in range(65, 91)})) + [1] for r in docs.filter(queries.fold(5) != 1).select("text").collect()]
    for m in (1, 2, 3):
        count = Counter(tuple(w[j - m + 1 : j + 1]) for w in lines for j in range(2, len(w)))
        n = Counter(count.values())
        assert model.sizes.seen[m] == (0, *(n[r] for r in range(1, katz.FIT + 1))) and model.sizes.distinct[m] == len(count)
        want, got = plain_discounts(n), model.sizes.discounts(m)
        assert all(got[r] == pytest.approx(want[r]) for r in want) and 0 < got[1] < got[2] < got[3] < got[4] < got[5] < 1
    assert model.sizes.smoothing(3) == "good-turing,good-turing,good-turing"
    assert {r.smoothing for r in queries.op1_katz(spark, "/root/testdata/sf0.001").select("smoothing").distinct().collect()} == {"good-turing,good-turing"}
    assert katz.Sizes({1: (0, 3) + (0,) * 11}, {1: 3}, 3).smoothing(1) == "absolute" and katz.Sizes({1: (0,) * 12 + (9,)}, {1: 9}, 108).smoothing(1) == "absolute"


@pytest.mark.parametrize("order, chunk", [(2, 10**6), (2, 2000), (3, 3000)])
def test_documents(spark, order, chunk):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check(spark, [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 5 != 1) for r in docs], order, chunk)


def test_cases(spark):
    check(spark, [(1, None, True), (2, "", True), (3, "a b a b c", True), (4, "A  b\tq", False), (5, "a " * 20000, True), (6, None, False), (7, "b b", True)], 2, 100)
    check(spark, [(1, "a b", False), (2, None, False)], 2, 100)
    empty = spark.createDataFrame([], "doc_id long, text string, t boolean")
    assert katz.score(empty, F.col("t")).count() == 0
    none = spark.createDataFrame([(None, "a b", True), (None, "c", None)], "doc_id long, text string, t boolean")
    assert sorted(r.n_tokens for r in katz.score(none, F.col("t")).filter("id is null").collect()) == [2, 3]


def test_held_out_beats_words(spark):
    got = queries.op1_katz(spark, "/root/testdata/sf0.001").filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert got[2] > 20 and got[0] > got[1]


@pytest.mark.parametrize("order", [2, 3])
def test_saved_model(spark, tmp_path, order):
    """Saved tables score the training corpus as fitting does, and texts that were not there by the same recursion."""
    rows = [(r.doc_id, r.text, r.doc_id % 3 > 0) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()][:60]
    rows += [(-1, None, True), (-2, "", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t boolean")
    model = katz.fit(df, F.col("t"), order=order, chunk=3000, range_bytes=50_000)
    katz.save(model, str(tmp_path / "m"))
    saved = spark.read.parquet(str(tmp_path / "m"))
    assert {(r.kind, r.m) for r in saved.filter("kind <> 'model'").select("kind", "m").distinct().collect()} == {("table", m) for m in range(1, order + 1)} | {("weights", m) for m in range(2, order + 1)}
    want = {r.id: r for r in katz.score(df, F.col("t"), order=order).collect()}
    for chunk in (2000, 10**6):
        got = {r.id: r for r in katz.evaluate(df.select("doc_id", "text"), str(tmp_path / "m"), chunk=chunk).collect()}
        assert set(got) == set(want)
        for i, r in got.items():
            w = want[i]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (w.n_tokens, w.n_known, w.train_tokens) and (r.base_score, r.score) == pytest.approx((w.base_score, w.score))
    new = [(1, "never seen words"), (2, rows[0][1][:300] + " unheardof " + rows[1][1][:300]), (2, "a"), (None, "a")]
    got = katz.evaluate(spark.createDataFrame(new, "doc_id long, text string").withColumn("kind", F.lit("clash")), str(tmp_path / "m")).collect()
    _, p, words, _ = brute(rows, order)
    for i, text in new[:2]:
        line = ["<s>"] * (order - 1) + WORD.findall(text.lower()) + [None]
        total = sum(math.log10(p(order, tuple(line[j - order + 1 : j + 1]))) for j in range(order - 1, len(line)))
        assert any(r.id == i and r.score == pytest.approx(total) for r in got)
    assert len(got) == 4 and katz.evaluate(df.limit(0), str(tmp_path / "m")).count() == 0


@pytest.mark.parametrize("ranges", [22, 28, 39, 40])
def test_saved_model_with_empty_ranges(spark, tmp_path, ranges):
    """Few n-grams over many ranges: the last ones hold no row, and are looked up all the same."""
    texts = ["a b c a b d", "a b e", "b c a"]
    texts[2] += " " * (100 * ranges - sum(map(len, texts)))
    df = spark.createDataFrame([(k, t, k < 2) for k, t in enumerate(texts)], "doc_id long, text string, t boolean")
    model = katz.fit(df, F.col("t"), range_bytes=100)
    katz.save(model, str(tmp_path / "m"))
    assert model.ranges == ranges
    want = {r.id: (r.n_known, r.score) for r in katz.score(df, F.col("t"), range_bytes=100).collect()}
    got = {r.id: (r.n_known, r.score) for r in katz.evaluate(df.select("doc_id", "text"), str(tmp_path / "m")).collect()}
    assert {i: n for i, (n, _) in got.items()} == {i: n for i, (n, _) in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1]) for i in want)


def test_counts_beyond_32_bits():
    """Totals of an n-gram over all chunks are kept whole, where they travel and where they are used."""
    import pandas as pd

    keys, some = np.array([5, 9], np.uint64), np.array([2_000_000_000, 1], np.uint32)
    rows = [{"kind": "ask", "m": 1, "bucket": 0, "chunk": k, "a": katz.pack_keys(keys), "b": katz.pack(some)} for k in range(3)]
    out = katz._tell(pd.DataFrame(rows, columns=katz._COLS))
    assert [katz.unpack(x).tolist() for x in out["a"][1:]] == [[6_000_000_000, 3]] * 3
    assert katz.unpack(out["b"][0]).tolist() == [6_000_000_000, 3]
    total, _ = katz._told(1, out[out["kind"] == "tell"].iloc[:1], keys)
    assert katz._narrow(total, np.int32, np.int64).tolist() == [6_000_000_000, 3] and katz._narrow(total[1:], np.int32, np.int64).dtype == np.int32
