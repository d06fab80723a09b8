"""The n-gram join against all pairs, the search against counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import graph, overlap_join, skew

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def plain(rows, percent=80, n=5):
    """(id, n, component) of each row; rows are nodes of their own."""
    sets = [shingle_set(t, n) for _, t in rows]
    top = list(range(len(rows)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                top[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted((str(i), len(sets[k]), str(least.get(root(k)) if sets[k] else i)) for k, (i, _) in enumerate(rows))


def collected(df):
    return sorted((str(r["id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, unit string, n int, grp string").repartition(parts)


def corpus(seed, n=90):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            words = list(rng.choice(texts))
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                k = rng.randrange(len(words) + 1)
                words[k : k + rng.randint(0, 2)] = [rng.choice(vocabulary) for _ in range(rng.randint(0, 2))]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 8, 40, 60, 100]))]
            if rng.random() < 0.4:
                k = rng.randrange(len(words) + 1)
                words[k:k] = passage
        texts.append(words or ["w0"])
    return [(k + 1, " ".join(w)) for k, w in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_pairs(spark, seed):
    rows = corpus(seed)
    got = collected(overlap_join.groups(frame(spark, rows)))
    assert got == plain(rows)
    assert 1 < len({c for _, _, c in got}) < len(rows)


def test_hot_keys_in_parts(spark, monkeypatch):
    """Every bound so low that all groups, lists and labels are dealt, and common n-grams are told apart."""
    for name, value in (("PART", 2),):
        monkeypatch.setattr(skew, name, value)
    monkeypatch.setattr(overlap_join, "GROUP", 60)
    monkeypatch.setattr(overlap_join, "CHUNK", 500)
    monkeypatch.setattr(overlap_join, "RANGE", 200)
    monkeypatch.setattr(overlap_join, "FEW", 3)
    rng = random.Random(9)
    base = [f"b{k}" for k in range(60)]
    rows = corpus(4, 50)
    for k in range(60):  # near copies of one text, and of these a chain away from it
        words = list(base)
        for _ in range(k % 6):
            words[rng.randrange(60)] = f"z{rng.randrange(20)}"
        rows.append((1000 + k, " ".join(words)))
    got = collected(overlap_join.groups(frame(spark, rows, 7), common=20))
    assert got == plain(rows)


@pytest.mark.parametrize(("percent", "n"), [(50, 2), (95, 3), (100, 5)])
def test_other_thresholds(spark, percent, n):
    rows = corpus(7, 60)
    assert collected(overlap_join.groups(frame(spark, rows), shingle=n, percent=percent)) == plain(rows, percent, n)


def test_at_the_threshold(spark):
    """Pairs with just 80 in 100, and just less."""
    words = [f"a{k}" for k in range(94)]
    rows = []
    for k in range(20):
        tag = [f"t{k}-{w}" for w in words]
        rows.append((10 * k, " ".join(tag)))
        rows.append((10 * k + 1, " ".join(tag[: 94 - 11 + k % 3] + [f"x{k}-{j}" for j in range(11 - k % 3)])))
    got = collected(overlap_join.groups(frame(spark, rows)))
    assert got == plain(rows)
    assert len({c for _, _, c in got}) not in (20, 40)


def test_odd_rows(spark):
    text = " ".join(f"v{k}" for k in range(30))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One TWO"), (6, "one  two\t"), (None, text), (9, text), (9, text), (9, "other words of nine here too"), (None, None), (None, "x y"), (None, "x y")]
    rows += [(7, text + " more"), (8, "w " * 40_000), (11, "w " * 50_000), (12, " ".join(str(k) for k in range(60_000))), (13, " ".join(str(k) for k in range(61_000)))]
    assert collected(overlap_join.groups(frame(spark, rows))) == plain(rows)
    assert overlap_join.groups(frame(spark, rows).limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), max_size=20), max_size=12), st.integers(1, 6))
def test_merge_skip(lists, need):
    got = dict(overlap_join.merge_skip([sorted(x) for x in lists], need))
    want = Counter(x for y in lists for x in y)
    assert {x for x, k in want.items() if k >= need} == set(got)
    assert all(got[x] == want[x] for x in got)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=1, max_size=15), st.sets(st.integers(0, 40), min_size=1, max_size=30), st.sampled_from([30, 60, 80, 100]), st.sampled_from([0.001, 0.01, 1.0]))
def test_search(sets, query, percent, mu):
    arrays = [np.array(sorted(x), np.uint64) for x in sets]
    lists = overlap_join.Lists(arrays, percent, mu)
    q = np.array(sorted(query), np.uint64)
    want = {k for k, x in enumerate(sets) if 100 * len(x & query) >= percent * len(x | query)}
    assert set(lists.search(q, False)) == want
    assert len(list(lists.search(q, True))) == min(1, len(want))


@pytest.mark.parametrize("part", [2, 256])
def test_components(spark, monkeypatch, part):
    monkeypatch.setattr(skew, "PART", part)
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    top = {x: x for link in links for x in link}
    for _ in range(100):
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    del top[5]
    got = graph.components(spark.createDataFrame(links, "a long, b long"))
    assert {r["id"]: r["component"] for r in got.collect()} == top


def test_few_tables(spark, monkeypatch):
    """Components without a hot id, whose labels do not change, write no table that is the one before, and sum no rows."""
    written = []
    for module in (graph, skew):
        monkeypatch.setattr(module, "settled", lambda df, keep=module.settled: written.append(df.columns) or keep(df))
    links = spark.createDataFrame([(1, k) for k in range(2, 9)] + [(20, 21)], "a long, b long")
    got = {r["id"]: r["component"] for r in graph.components(links).collect()}
    assert got == {k: 1 for k in range(1, 9)} | {20: 20, 21: 20}
    assert written == [["x", "y"], ["y", "k"], ["id", "c", "parts"], ["id", "parts", "was", "c"]]


def test_many_hot_keys(spark, monkeypatch):
    """With more hot keys than may be sent only those with a part in that many of the rows are told."""
    monkeypatch.setattr(skew, "FEW", 3)
    monkeypatch.setattr(skew, "PART", 2)
    rows = spark.createDataFrame([(k, j) for k, n in enumerate([3, 3, 3, 3, 20]) for j in range(n)], "key int, v int")
    assert [tuple(r) for r in skew.often(rows, ["key"]).collect()] == [(4, 20)]
    assert skew.often(rows.filter("v < 2"), ["key"]) is None
