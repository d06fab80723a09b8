import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import graph, near_dup, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def brute(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets.setdefault(i, set()).update({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else ())
    ids, top = sorted(sets), {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(ids[a]), find(ids[b])
                top[max(p, q)] = min(p, q)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def random_rows(seed, groups=12, copies=14):
    """Groups of copies of a base with a growing number of edits, and copies of copies."""
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 4, 30, 90, 200]))]
        for _ in range(rng.randrange(1, copies)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(words).upper() if rng.random() < 0.2 else "\n".join(words))
            if rng.random() < 0.3:
                base = words
    rng.shuffle(rows)
    return list(enumerate(rows, 5))


@pytest.mark.parametrize("seed, n, percent", [(1, 3, 85), (2, 3, 85), (3, 5, 80)])
def test_random_groups(spark, seed, n, percent):
    rows = random_rows(seed)
    got = near_dup.groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle=n, percent=percent)
    assert sorted(map(tuple, got.collect())) == brute(rows, n, percent)


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE "), (6, "one two"), (7, "a b c " * 30000), (8, "a b c " * 29999), (9, "One")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(0)).withColumn("id", F.lit("clash"))
    assert sorted(map(tuple, near_dup.groups(df, shingle=3, percent=85).collect())) == brute(rows, 3, 85)
    kept = near_dup.deduplicate(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7]
    assert near_dup.groups(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "x y z"), (1, "x y z"), (2, "x y z")], "doc_id long, text string")
    assert sorted(r.component_id for r in near_dup.groups(twice).collect()) == [1, 1, 1]
    assert [r.doc_id for r in near_dup.deduplicate(twice).collect()] == [1]


def test_ids_that_clash(spark):
    """Rows of one id and different texts do not touch each other; repeated rows leave one; null ids give way."""
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "a b c d e f"), (1, long), (2, long + " end"), (2, "g h i j k l"), (3, "a b c d e f"), (None, "g h i j k l"), (None, "m n o p q"), (None, "m n o p q"), (4, None), (4, None), (None, ""), (5, "r s t u v"), (5, "r s t u v")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__n", F.lit("clash")).repartition(3)
    kept = near_dup.deduplicate(df)
    want = [(1, "a b c d e f"), (1, long), (2, "g h i j k l"), (None, "m n o p q"), (4, None), (4, None), (None, ""), (5, "r s t u v")]
    assert kept.columns == df.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    got = sorted(((r.id, r.n_shingles, r.component_id, r.kept) for r in near_dup.groups(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 56, 1, True), (2, 57, 1, False), (2, 2, 2, True), (3, 2, 1, False), (None, 2, 2, False), *[(None, 1, None, True)] * 2, *[(4, 0, 4, True)] * 2, (None, 0, None, True), *[(5, 1, 5, True)] * 2], key=str)


def test_parts(spark, monkeypatch):
    """Stars and lists dealt in parts of two rows find what whole ones find."""
    monkeypatch.setattr(near_dup, "PART", 2)
    rows = random_rows(7, groups=6, copies=30)
    got = near_dup.groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 85)


def test_shared_passages(spark):
    """Texts that share a long passage but are not near each other, in many components of several sizes."""
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = []
    for k in range(60):
        own = " ".join(f"q{rng.randrange(9999)}" for _ in range(rng.choice([4, 6, 8, 12, 40])))
        rows += [passage + " " + own, passage + " " + own + " x"][: 1 + k % 2]
    rows = list(enumerate(rows))
    got = near_dup.groups(spark.createDataFrame(rows + rows[::2], "doc_id long, text string"), shingle=3, percent=85).collect()
    assert len(got) == 1.5 * len(rows) and sorted(set(map(tuple, got))) == brute(rows, 3, 85)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = queries.op2_near_dup(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, 3, 85)


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 200)] + [(500, 400), (400, 450), (7, 7)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got[k] == 0 for k in range(201)) and {got[k] for k in (400, 450, 500)} == {400}


def test_bands():
    for percent in (80, 85, 95):
        m = near_dup.bands(percent)
        assert 1 - (1 - (1 - (percent / 100) ** 2) ** m) ** 2 <= near_dup.MISS


def test_shared_bands(spark):
    """Bands that only one unit has go; keys that two units share stay, all of them."""
    rng = random.Random(9)
    rows = [(k, [rng.randrange(12) for _ in range(4)], [100 + rng.randrange(12) for _ in range(4)]) for k in range(20)]
    df = spark.createDataFrame(rows, "id long, left array<long>, right array<long>")
    got = {r.id: {(x.x, y.x) for x in r.left for y in r.right} for r in near_dup.shared_bands(df, 4).collect()}
    keys = {i: {(x, y) for x in a for y in b} for i, a, b in rows}
    for i in keys:
        assert {key for key in keys[i] if any(key in keys[j] for j in keys if j != i)} <= got.get(i, set()) <= keys[i]
    alone = spark.createDataFrame([(1, [1, 2], [3, 4]), (2, [1, 5], [6, 7]), (3, [8, 9], [10, 11])], df.schema)
    assert near_dup.shared_bands(alone, 2).count() == 0


def test_no_name_of_a_column_is_taken(spark):
    """Each helper name of the dedup operators as a column: values of the rows that stay are as they were."""
    from quarry.llm import exact_dedup

    names = ["row", "norm", "place", "part", "head", "tail", "edge", "id", "stays", "__id", "__hash", "__rank", "__norm", "__place", "__lead", "__whole", "__part", "__head", "__tail"]
    text = " ".join(f"w{k}" for k in range(40))
    texts = [text, text + " ", text + " more", "other words " * 9, "other words " * 9, None, None, text]
    df = spark.createDataFrame([(k, t, *[f"{n}-{k}" for n in names]) for k, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)).repartition(3)
    want = {r.doc_id: r for r in df.collect()}
    for call, stay in ((exact_dedup.deduplicate, [0, 1, 2, 3, 5]), (near_dup.deduplicate, [0, 3, 5, 6])):
        got = {r.doc_id: r for r in call(df).collect()}
        assert sorted(got) == stay and all(got[k] == want[k] for k in stay), call
