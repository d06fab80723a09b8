"""Benchmark decontamination: a set join with prefix filter, checked over windows of the items.

A window is a run of WINDOW consecutive words of an item (all of a shorter one). As sets of short
shingles, a window can only occur in a document that has all of them; so of each window one shingle is
necessary to look up, and the rarest in the documents is taken (the prefix of a containment of 1).
Where a document has that shingle, the window's place in the text follows from the shingle's offset;
places that would leave the document are bounded away, and at the rest all words are compared.

The index of the benchmark is the build side of the join. It is sent to the tasks in blocks of at most
BLOCK_WORDS words, whose size is counted first; a larger benchmark takes several passes over each
document, one after the other in the same plan, so nothing about documents is ever shuffled.

Cases: a null text, or one without words, has no words, hits or items. An item without words has no
window; repeated items count each. Documents with the same id are separate rows. Rows of the
benchmark with the same id count as one item. The words of benchmark rows without an id are hits like others, and
only name no item. Either table may be empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import ALNUM, grams, hashes, slices, split

WINDOW = 13
SHINGLE = 3
BLOCK_WORDS = 1_000_000
_BITS = 20


class Index:
    """Windows of one block of benchmark items and their shingles, as flat arrays."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int = WINDOW, shingle: int = SHINGLE):
        low, starts, ends, per = split(pa.array(texts, pa.large_string()), ALNUM)
        words = hashes(low, starts, ends)
        self.words, self.names = words, sorted(set(ids) - {None})
        name = {x: k for k, x in enumerate(self.names)} | {None: -1}
        where, size, item, at = [], [], [], 0
        for k, n in enumerate(per.tolist()):
            if n:
                count = max(1, n - window + 1)
                where.append(at + np.arange(count))
                size.append(np.full(count, min(n, window)))
                item.append(np.full(count, name[ids[k]]))
            at += n
        none = np.zeros(0, np.int64)
        where, size, item = (np.concatenate(x) if x else none for x in (where, size, item))
        whole = np.zeros(len(where), np.uint64)
        for n in np.unique(size).tolist():
            whole[size == n] = grams(words, n)[where[size == n]]
        _, first, same = np.unique(whole, return_index=True, return_inverse=True)
        self.start, self.size = where[first], size[first]  # of the distinct windows
        pairs = np.unique(np.stack([same, item], 1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
        pairs = pairs[pairs[:, 1] >= 0]  # windows of rows without an id name no item
        self.items, self.items_at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        self.text = [low[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]  # of each word
        # each window's shingles: hash, window, offset, width
        got = {k: grams(words, k) for k in range(1, shingle + 1)}
        rows = [(np.zeros(0, np.uint64), none, none, none)]
        for n in np.unique(self.size).tolist():
            k, w = min(shingle, n), np.flatnonzero(self.size == n)
            step = np.arange(n - k + 1)
            at = self.start[w][:, None] + step
            rows.append((got[k][at].reshape(-1), np.repeat(w, len(step)), np.tile(step, len(w)), np.full(at.size, k)))
        self.shingle, self.window, self.offset, self.width = (np.concatenate(x) for x in zip(*rows))
        self.keys = np.unique(self.shingle)
        self.sizes = sorted(set(self.width.tolist()))

    def rarest(self, counts: np.ndarray) -> None:
        """Keep of each window the shingle that the documents have least often (counts go with keys)."""
        often = counts[np.searchsorted(self.keys, self.shingle)] if len(self.keys) else np.zeros(0, np.int64)
        order = np.lexsort((self.shingle, often, self.window))
        first = np.ones(len(order), bool)
        first[1:] = self.window[order][1:] != self.window[order][:-1]
        keep = order[first]
        keep = keep[np.argsort(self.shingle[keep], kind="stable")]
        self.shingle, self.window, self.offset, self.width = (x[keep] for x in (self.shingle, self.window, self.offset, self.width))
        self.keys, self.keys_at = np.unique(self.shingle, return_index=True)
        self.keys_at = np.append(self.keys_at, len(self.shingle))


class _Lookup:
    """Membership of hashes in a small sorted set, through a bitmap first."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.map = np.zeros(1 << _BITS, bool)
        self.map[(keys & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in values, indexes into keys) of the members."""
        maybe = np.flatnonzero(self.map[(values & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        if not len(maybe) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, values[maybe]), len(self.keys) - 1)
        ok = self.keys[at] == values[maybe]
        return maybe[ok], at[ok]


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes = shared.value
        look, counts = _Lookup(keys), np.zeros(len(keys), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                low, starts, ends, _ = split(part.column("text"), ALNUM)
                words = hashes(low, starts, ends)
                for k in sizes:  # a shingle across two texts may count: this only orders
                    _, at = look.find(grams(words, k))
                    counts += np.bincount(at, minlength=len(keys))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["k", "n"])

    return run


def _scan(shared, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        look = _Lookup(index.keys)
        for batch in batches:
            for part in slices(batch, "text"):
                yield _scan_part(part, index, look, last)

    return run


def _scan_part(part: pa.RecordBatch, index: Index, look: _Lookup, last: bool) -> pa.RecordBatch:
    low, starts, ends, per = split(part.column("text"), ALNUM)
    words = hashes(low, starts, ends)
    row_at = np.concatenate(([0], np.cumsum(per)))
    found_at, found_w = [], []
    for k in index.sizes:
        pos, key = look.find(grams(words, k))
        if not len(pos):
            continue
        reps = index.keys_at[key + 1] - index.keys_at[key]
        entry = np.repeat(index.keys_at[key], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        pos = np.repeat(pos, reps)
        ok = index.width[entry] == k
        pos, entry = pos[ok], entry[ok]
        row = np.searchsorted(row_at, pos, "right") - 1
        w = index.window[entry]
        at = pos - index.offset[entry]
        ok = (at >= row_at[row]) & (at + index.size[w] <= row_at[row + 1])  # length and positional bounds
        at, w = at[ok], w[ok]
        for n in np.unique(index.size[w]):
            one = index.size[w] == n
            a, v = at[one], w[one]
            step = np.arange(n)
            ok = (words[a[:, None] + step] == index.words[index.start[v][:, None] + step]).all(1)
            found_at.append(a[ok])
            found_w.append(v[ok])
    cover, items = np.zeros(len(words) + 1, np.int64), [set() for _ in range(part.num_rows)]
    if found_at:
        at, w = np.concatenate(found_at), np.concatenate(found_w)
        for a, v, r in zip(at.tolist(), w.tolist(), (np.searchsorted(row_at, at, "right") - 1).tolist()):
            n = int(index.size[v])
            if all(low[starts[a + j] : ends[a + j]].tobytes() == x for j, x in enumerate(index.text[index.start[v] : index.start[v] + n])):
                cover[a] += 1
                cover[a + n] -= 1
                items[r].update(index.names[k] for k in index.items[index.items_at[v] : index.items_at[v + 1]])
    hit = np.cumsum(cover[:-1]) > 0
    for k, before in enumerate(part.column("items").to_pylist()):
        items[k].update(before or ())
    # hit words as a bitmap per row, joined with what earlier blocks found
    masks, before = [], part.column("hits")
    for k in range(part.num_rows):
        own = hit[row_at[k] : row_at[k + 1]]
        if (old := before[k].as_py()) is not None:
            own = own | np.unpackbits(np.frombuffer(old, np.uint8), count=len(own)).astype(bool)
        masks.append(own)
    names = [sorted(x) for x in items]
    kept = [part.column("id"), pa.array(names, pa.list_(pa.string()))]
    if not last:
        return pa.RecordBatch.from_arrays([*kept, part.column("text"), pa.array([np.packbits(x).tobytes() if x.any() else None for x in masks], pa.binary())], ["id", "items", "text", "hits"])
    n_hit = np.array([int(x.sum()) for x in masks], np.int64)
    spans = [[[int(a), int(b)] for a, b in np.flatnonzero(np.diff(np.concatenate(([0], x.astype(np.int8), [0])))).reshape(-1, 2)] if n else [] for x, n in zip(masks, n_hit)]
    sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
    flat = [pa.array(per.astype(np.int64)), pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()), pa.array(sha, pa.string())]
    return pa.RecordBatch.from_arrays([*kept, pa.array(spans, pa.list_(pa.list_(pa.int64()))), *flat], ["id", "items", "spans", "n_words", "n_hit", "n_items", "items_sha256"])


def overlaps(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of docs: (id, items array<string>, spans array<array<long>>, n_words, n_hit, n_items, items_sha256).

    spans are runs of hit words, as word positions from 0, end exclusive.
    """
    sc = docs.sparkSession.sparkContext
    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = bench.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).filter("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // (2 * block_words)) or 1  # a word and what parts it from the next take two characters at least
    kind = cols.schema["id"]
    first = T.StructType([kind, T.StructField("items", T.ArrayType(T.StringType()))])
    flat = {n: T.LongType() for n in ("n_words", "n_hit", "n_items")} | {"items_sha256": T.StringType()}
    ends = {"spans": T.ArrayType(T.ArrayType(T.LongType())), **flat}, {"text": T.StringType(), "hits": T.BinaryType()}
    out = cols.select("id", F.lit(None).cast("array<string>").alias("items"), "text", F.lit(None).cast("binary").alias("hits"))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64(F.coalesce("item", "text")), F.lit(blocks)) == b).collect()
        index = Index([r["item"] for r in rows], [r["text"] for r in rows], window, shingle)
        seen = sc.broadcast((index.keys, index.sizes))
        counts = np.zeros(len(index.keys), np.int64)
        if len(index.keys):
            for r in cols.select("text").mapInArrow(_count(seen), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
                counts[r["k"]] = r["n"]
        seen.destroy()
        index.rarest(counts)
        last = b == blocks - 1
        schema = T.StructType([*first, *(T.StructField(n, t) for n, t in ends[0 if last else 1].items())])
        out = out.mapInArrow(_scan(sc.broadcast(index), last), schema)
    return out


def contaminated(n_hit, n_words, share: int = 20):
    """Column: some word is hit, and of ``share`` words at least one."""
    return (n_hit > 0) & (share * n_hit >= n_words)


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated rows; all columns stay. Each row goes by its own text: ids decide nothing, nothing is shuffled."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].alias("text"))
    found = overlaps(rows, bench, "row", "text")
    return found.filter(~contaminated(F.col("n_hit"), F.col("n_words"))).select("id.*")
