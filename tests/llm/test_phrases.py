"""Collocations against a plain count."""

import random
import re
from collections import Counter

import pytest

from quarry.llm import phrases, skew

SEP, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, longest=4, least=30, cover=80, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in SEP.split((text or "").translate(LOWER)):
            words = WORD.findall(piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    cands = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    around = Counter()
    for (lang, w), a in cands.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                around[lang, w[i : i + m]] = max(around[lang, w[i : i + m]], a)
    out = {}
    for (lang, w), a in cands.items():
        if around[lang, w] and 100 * around[lang, w] >= cover * a:
            continue
        score, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


def texts(seed, n=150):
    rng = random.Random(seed)
    words = ["the", "of", "New", "York", "déjà", "vu", "a", "b", "c", "x-y", "😀"]
    passage = "the quick brown fox jumps over the lazy dog"
    for _ in range(n):
        out = []
        for _ in range(rng.randint(0, 80)):
            out.append(rng.choice([*words, "New York", "déjà vu", passage, "as well as", "no, stop.", "end\n", "tab\tbed", "x\x0by"]))
        yield rng.choice(["en", "fr", None, "und"]), " ".join(out)


def collected(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, gram string, k int")


@pytest.mark.parametrize(("seed", "trigger", "long", "least", "top"), [(1, 3, 256, 30, 2000), (2, 16, 256, 10, 25), (3, 1, 256, 5, 2000), (4, 10**9, 5, 5, 7)])
def test_equals_plain_count(spark, seed, trigger, long, least, top):
    rows = list(texts(seed))
    rows += rows[:40] + [("en", None), (None, ""), ("fr", ".,;"), ("de", "a b " * 200), ("de", "one"), (None, None)]
    got = phrases.collocations(frame(spark, rows), trigger=trigger, long=long, least=least, top=top)
    want = plain(rows, least=least, top=top)
    assert len(want) > 5
    assert collected(got) == want


class Bits:
    value = __import__("numpy").full(1, 2**64 - 1, "uint64")  # every pair is frequent


def test_blocks_of_a_long_text(spark, monkeypatch):
    rng = random.Random(5)
    rows = [("en", " ".join(rng.choice(["a", "b", "c.", "d\n", "e é"]) for _ in range(3000))), ("en", "no end here " * 300), ("fr", "x " * 500 + ". y z" * 100)]
    batch = __import__("pyarrow").record_batch({"lang": [r[0] for r in rows], "text": [r[1] for r in rows]})
    for size in (50, 700, 1 << 20):
        monkeypatch.setattr(phrases, "SLICE", size)
        chunks = [b for b in phrases._chunks(4, 5, 20, Bits())(iter([batch]))]
        grams = Counter()
        for b in chunks:
            for w in phrases._windows(4)(iter([b])):
                for lang, g, k in zip(*(w.column(c).to_pylist() for c in ("lang", "gram", "k"))):
                    grams[lang, g] += k
        want = Counter()
        for lang, text in rows:
            for piece in SEP.split(text):
                words = WORD.findall(piece)
                want.update((lang, " ".join(words[i : i + 4])) for i in range(len(words)))
        assert grams == want


def test_copies_are_counted_not_read(spark):
    text = "alpha beta gamma delta. " * 3 + "one two three four five six seven eight nine ten"
    rows = frame(spark, [("en", text)] * 500)
    assert phrases.dictionary(rows).count() < 10
    assert collected(phrases.collocations(rows)) == plain([("en", text)] * 500)


def test_scores_beyond_64_bits(spark):
    big = 4 * 10**15
    found = spark.createDataFrame([("en", "", 0, 9 * big), ("en", "a", 1, big), ("en", "b", 1, 2 * big), ("en", "a b", 2, big - 1)], "lang string, gram string, size int, f long")
    (row,) = phrases.scored(found).collect()
    assert (row["a"], row["l"], row["r"], row["score"]) == (big - 1, big, 2 * big, 2000000 * (big - 1) // (3 * big))
    assert phrases.uncovered(phrases.scored(found), found).count() == 1


def test_hot_keys_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "PART", 3)
    many = spark.createDataFrame([("a" if k % 2 else str(k), k) for k in range(60)], "key string, v int")
    one = spark.createDataFrame([("a", 1), *((str(k), k) for k in range(0, 60, 4))], "key string, x int")
    got = sorted(tuple(r) for r in skew.dealt(many, one, ["key"]).select("key", "v", "x").collect())
    assert got == sorted([("a", k, 1) for k in range(1, 60, 2)] + [(str(k), k, k) for k in range(0, 60, 4)])


def test_empty(spark):
    assert phrases.collocations(frame(spark, [("en", "x")]).limit(0)).count() == 0
    assert phrases.collocations(frame(spark, [("en", None)])).count() == 0
