"""Collocations: phrases of several words that are much more frequent than their parts suggest, by prefix-free parsing.

Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and these into words at blanks and tabs.

1. Pairs. Neighbouring words are counted by hashes; a phrase that occurs ``LEAST`` times has only pairs that do. Bits of these hashes,
   32 MB at most, go to all tasks. Texts with more such pairs than bits are cut less often in the next step; counts stay the same.
2. Parsing. A piece ends between words that are no frequent pair, as no phrase goes over it. It is also cut where a window of LONGEST - 1 words has a hash that the trigger divides, so equal passages are cut at
   equal places wherever they stand. Each chunk goes on over the window that begins the next one; no n-gram is lost at
   a cut, and one that begins in the window belongs to the next chunk alone. A chunk without a trigger ends after
   ``LONG`` words. The dictionary is the distinct chunks, with the words at their end that belong to the next and their
   frequency in the parse; copies are counted there and read no more.
3. Counting. For each word of a dictionary chunk that it owns, the window of LONGEST words that begins there (shorter
   at a piece's end) has the chunk's frequency. Sums of windows give the phrases of LONGEST words, sums of those
   by their leading words the phrases one word shorter, and so on: each level is made of the one before, aggregated
   before every shuffle.
4. Scores. A phrase is looked up by both parts of every cut; keys that many phrases share ("the") are found by counting
   and sent to all tasks, with a bound on their number (skew.py). Arithmetic is in decimals. The first rows of each
   language come from a tree of row numbers, so no task sees all phrases of a language.

Cases: a null text is empty, a null language is ``und``. Repeated rows count each. Ids and other columns are not read. A very
long text is read in blocks that end at a piece's end. An empty table, or one without frequent phrases, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import settled, settled_texts
from .skew import dealt
from .words import grams, hashes, mix, offsets, slices, split_bytes

LONGEST = 4
LEAST = 30
COVER = 80
TOP = 2000
TRIGGER = 16
LONG = 256
SLICE = 1 << 20
MOST_BITS = 1 << 28
UNKNOWN = "und"
_TREE = (256, 32, 4, 1)

_END = np.zeros(256, bool)
_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_END
_WORD[[0x20, 0x09]] = False


def _blocks(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each text, offsets, bytes); one long text comes in blocks that end where a piece does."""
    offs, data = offsets(part.column("text"))
    if len(data) <= SLICE:
        yield np.arange(len(offs) - 1), offs, data
        return
    at = 0
    while at < len(data):
        to = min(at + SLICE, len(data))
        ends = np.flatnonzero(_END[data[at:to]])
        while to < len(data) and not len(ends):  # a piece longer than a slice
            ends = np.flatnonzero(_END[data[to : to + SLICE]]) + (to - at)
            to = min(to + SLICE, len(data))
        if to < len(data):
            to = at + int(ends[-1]) + 1
        yield np.zeros(1, np.int64), np.array([0, to - at]), data[at:to]
        at = to


def _cuts(first: np.ndarray, windows: np.ndarray, trigger: int, long: int) -> np.ndarray:
    """Words at which chunks begin: those that begin a piece (first), triggers, and every ``long`` words without either."""
    cut = first.copy()
    cut[: len(windows)] |= windows % np.uint64(trigger) == 0
    at = np.flatnonzero(cut)
    size = np.diff(np.append(at, len(first)))
    more = (size - 1) // long
    for k in np.flatnonzero(more):
        cut[at[k] + long * np.arange(1, more[k] + 1)] = True
    return np.flatnonzero(cut)


def _slice_strings(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """Strings data[start[i]:stop[i]]."""
    size = stop - start
    offs = np.concatenate(([0], np.cumsum(size)))
    take = np.arange(offs[-1]) + np.repeat(start - offs[:-1], size)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data[take]))


def _summed(lang: pa.Array, cols: dict[str, pa.Array], k: np.ndarray) -> pa.RecordBatch:
    """One row of (lang, cols) with the sum of k."""
    keys = ["lang", *cols]
    rows = pa.table([lang, *cols.values(), pa.array(k)], [*keys, "k"]).group_by(keys).aggregate([("k", "sum")])
    return rows.rename_columns([*keys, "k"]).combine_chunks().to_batches()[0]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(languages, lower-cased bytes, starts and ends of words, row of each, whether it begins a piece, its hash, hash of it with the next and the language)."""
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            langs = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in part.column("lang").to_pylist()], np.uint64)
            for rows, offs, data in _blocks(part):
                low, starts, ends, per = split_bytes(offs, data, _WORD)
                if not len(starts):
                    continue
                row = np.repeat(rows, per)
                seps = np.concatenate(([0], np.cumsum(_END[low])))
                first = np.ones(len(starts), bool)
                first[1:] = seps[starts[1:]] != seps[ends[:-1]]
                heads = np.cumsum(per) - per
                first[heads[per > 0]] = True
                words = hashes(low, starts, ends)
                yield part.column("lang"), low, starts, ends, row, first, words, mix(grams(words, 2) ^ langs[row[:-1]])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, k) of the pairs of neighbouring words."""
    for *_, first, _, pair in _parsed(batches):
        h, k = np.unique(pair[~first[1:]], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k)], ["h", "k"])


def _chunks(longest: int, trigger: int, long: int, bits: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for langs, low, starts, ends, row, first, words, pair in _parsed(batches):
            place = pair % np.uint64(64 * len(known))
            first[1:] |= (known[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 0
            piece = np.append(np.flatnonzero(first), len(starts))
            at = _cuts(first, grams(words, longest - 1), trigger, long)
            nxt = np.append(at[1:], len(starts))
            stop = np.minimum(nxt + longest - 1, piece[np.searchsorted(piece, at, "right")])
            # words in a row, each with one space after it
            size = ends - starts
            begin = np.concatenate(([0], np.cumsum(size + 1)))
            text = np.full(begin[-1], 0x20, np.uint8)
            text[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = low[_WORD[low]]
            chunk = _slice_strings(text, begin[at], begin[stop] - 1)
            yield _summed(langs.take(pa.array(row[at])), {"chunk": chunk, "tail": pa.array((stop - nxt).clip(0))}, np.ones(len(at), np.int64))

    return run


def _windows(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "chunk", SLICE):
                offs, data = offsets(part.column("chunk"))
                space = np.flatnonzero(data == 0x20)
                starts = np.sort(np.concatenate((offs[:-1], space + 1)))
                per = np.diff(np.searchsorted(starts, offs))
                last = np.cumsum(per)  # word after the last of each chunk
                ends = np.append(starts[1:] - 1, offs[-1])
                ends[last - 1] = offs[1:]
                row = np.repeat(np.arange(len(per)), per)
                word = np.arange(len(starts))
                own = word < (last - part.column("tail").to_numpy())[row]
                word, row = word[own], row[own]
                text = _slice_strings(data, starts[word], ends[np.minimum(word + longest, last[row]) - 1])
                yield _summed(part.column("lang").take(pa.array(row)), {"gram": text}, part.column("k").to_numpy()[row])

    return run


def frequent_pairs(rows: DataFrame, least: int) -> np.ndarray:
    """Bits of the hashes of word pairs of (lang, text) that occur ``least`` times or more: 16 a pair, 32 MB at most."""
    pairs = settled_texts(rows.mapInArrow(_pairs, "h long, k long").groupBy("h").agg(F.sum("k").alias("k")).filter(F.col("k") >= least).select("h"))
    size = 64
    while size < min(16 * pairs.count(), MOST_BITS):
        size *= 2
    place = F.col("h").bitwiseAND(F.lit(size - 1))  # the rest by size, a power of two
    words = pairs.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, trigger: int = TRIGGER, long: int = LONG, least: int = LEAST) -> DataFrame:
    """(lang, chunk, tail, k): distinct chunks, how many words at their end belong to the next chunk, and how often each is in the parse."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text")).filter("text is not null")
    bits = docs.sparkSession.sparkContext.broadcast(frequent_pairs(rows, least))
    parsed = rows.mapInArrow(_chunks(longest, trigger, long, bits), "lang string, chunk string, tail long, k long")
    return parsed.groupBy("lang", "chunk", "tail").agg(F.sum("k").alias("k"))


def frequencies(chunks: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, gram, size, f), a table: phrases of 1 to ``longest`` words that occur ``least`` times or more; size 0 has the number of words."""
    level = chunks.mapInArrow(_windows(longest), "lang string, gram string, k long").groupBy("lang", "gram").agg(F.sum("k").alias("f"))
    out = []
    for size in range(longest, 0, -1):
        out.append(level.filter(F.col("f") >= least).select("lang", "gram", F.lit(size).alias("size"), "f"))
        if size > 1:
            level = level.groupBy("lang", F.substring_index("gram", " ", size - 1).alias("gram")).agg(F.sum("f").alias("f"))
    out.append(level.groupBy("lang").agg(F.sum("f").alias("f")).select("lang", F.lit("").alias("gram"), F.lit(0).alias("size"), "f"))
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    # a window cut short by a piece's end is no phrase of its level's size
    words = F.length("gram") - F.length(F.replace("gram", F.lit(" "))) + 1
    return settled_texts(found).filter((F.col("size") == 0) | (words == F.col("size")))


def _exact(c: str) -> str:
    return f"cast({c} as decimal(20,0))"


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of phrases of two words or more: the cut with the lowest score, of these the first."""
    known = found.filter("size > 0").select("lang", "gram", "f")
    each = found.filter("size > 1").select("lang", F.col("gram").alias("phrase"), "size", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    each = each.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    both = dealt(each, known.select("lang", F.col("gram").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    both = dealt(settled(both), known.select("lang", F.col("gram").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    both = both.withColumn("score", F.expr(f"{_exact('a')} * 2000000 div ({_exact('l')} + {_exact('r')})"))
    best = both.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "size", "a", "best.l", "best.r", "best.score")


def uncovered(phrases: DataFrame, found: DataFrame, cover: int = COVER) -> DataFrame:
    """phrases without those that mostly stand inside a longer one: 100 * its count >= cover * their own."""
    inner = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(split(gram, ' '), i, m), ' '))))")
    around = found.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    rows = phrases.join(around, ["lang", "phrase"], "left")
    return rows.filter(F.expr(f"around is null or 100 * {_exact('around')} < {cover} * {_exact('a')}")).drop("around")


def first(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` rows of each language, with their rank."""
    for parts in _TREE:
        by = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(F.desc("score"), F.desc("a"), "phrase")
        phrases = phrases.withColumn("rank", F.row_number().over(by).cast("long")).filter(F.col("rank") <= top)
    return phrases


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, cover: int = COVER, top: int = TOP, trigger: int = TRIGGER, long: int = LONG
) -> DataFrame:
    """The first phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    a, l and r are the counts of the phrase and of the parts of its lowest cut, n the language's words.
    """
    found = frequencies(dictionary(docs, text_col, lang_col, longest, trigger, long, least), longest, least)
    best = first(uncovered(scored(found), found, cover), top)
    words = found.filter("size = 0").select("lang", F.col("f").alias("n"))
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
