"""Katz backoff language model: training counts, exactly normalised backoff weights, scores of texts.

P(w | h) of an n-gram seen c times is d(c) c / c(h); otherwise it is alpha(h) P(w | shorter h), down to words
and one class for unknown words. d is the Good-Turing discount for counts up to K: of each order the counts of counts
are smoothed by a line through their logarithms, so that discounts fall into place however uneven the counts of counts
of a corpus of copies are. Larger counts keep all but TAIL, so that every history has something left to hand down;
alpha(h) is what is left, over the shorter model's mass of the words not seen after h. Unknown words get what the
discounts leave of words. Where no falling line fits (a handful of n-grams, or none seen once) an order has one
absolute discount instead, and the result says so.

How it runs. Each task turns its rows into chunks of at most CHUNK tokens and aggregates before any shuffle:
a chunk has each n-gram once. The n-gram tables are partitioned by ranges of the n-gram's hash, as many as the size of
the corpus asks for, so that a range stays as large as it is. Chunks send their n-grams with training counts to the
tables and get the totals back; sums over histories go the same way, and of each chunk only histories that a text has
to back off from are asked for. No key collects rows of texts: a word that is a third of all tokens is one entry a
chunk. Tables travel as sorted, compressed arrays, and a partition of a shuffle is one range or one chunk. Only counts
of counts and the sizes of the corpus reach the driver.

``score`` fits and scores in one go, as the corpus that is scored holds the training texts: its n-grams are asked for once.
``save`` writes the model as tables by kind, order and range, and ``evaluate`` looks any texts up in saved tables.

Cases: a null text is empty and has the end token alone. Without training rows every word is unknown, with
probability 1. N-grams are told apart by 64-bit hashes: of 10^12 distinct ones some 27,000 share theirs with another. Rows
with equal ids and repeated rows are separate rows; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import settled_texts
from .words import SPACED, grams, hashes, mix, slices, split

ORDER = 2
K = 5
FIT = 2 * (K + 1)
TAIL = 1e-6
CHUNK = 4_500_000
RANGE_BYTES = 16 << 20
BOS, END = np.uint64(0x5354415254), np.uint64(0x454E44)

_ROW = "kind string, m int, bucket int, chunk long, a binary, b binary, c binary, d binary, e binary, f binary"
_COLS = ["kind", "m", "bucket", "chunk", "a", "b", "c", "d", "e", "f"]


def pack(x: np.ndarray) -> bytes:
    """An array as its type and compressed byte planes."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T
    return x.dtype.str.encode().ljust(4) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(x: bytes) -> np.ndarray:
    kind = np.dtype(x[:4].decode().strip())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(x[4:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def pack_keys(x: np.ndarray) -> bytes:
    """Sorted keys, as steps from one to the next."""
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_keys(x: bytes) -> np.ndarray:
    return np.cumsum(unpack(x), dtype=np.uint64)


def _ranges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ends of the slices of sorted keys that belong to each of equal ranges of hashes."""
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)])).astype(np.int64)


class _Chunk:
    """Texts of one chunk: n-grams of every order that end at each token, and their distinct keys."""

    def __init__(self, flat: np.ndarray, per: np.ndarray, order: int):
        pads = order - 1
        sizes = per + 1 + pads
        at = np.concatenate(([0], np.cumsum(sizes)))
        line = np.full(at[-1], BOS, np.uint64)
        real = np.zeros(at[-1], bool)
        spot = np.arange(len(flat)) + np.repeat(at[:-1] + pads - (np.cumsum(per) - per), per)
        line[spot] = flat
        real[spot] = True
        last = at[1:] - 1
        line[last] = END
        real[last] = True
        self.tokens = np.flatnonzero(real).astype(np.int32)
        self.row = np.repeat(np.arange(len(per), dtype=np.int32), per + 1)
        first = np.zeros(at[-1] + 1, bool)
        first[at[:-1] + pads] = True
        self.first = first[self.tokens]
        self.line, self.order = line, order

    def ending(self, m: int, back: int = 0) -> np.ndarray:
        """Key of the m words that end at each token, or ``back`` words before it."""
        key = grams(self.line, m)
        return mix(key[self.tokens - back - (m - 1)] ^ np.uint64(m))


def _chunks(batches: Iterator[pa.RecordBatch], limit: int):
    """(chunk number, ids, train flags, hashes of words, words per text) of the rows (id, text, train) of one task, in their order."""
    ids, train, words, per, n, number = [], [], [], [], 0, 0

    def close():
        return number, np.concatenate(ids), np.concatenate(train), np.concatenate(words), np.concatenate(per)

    for batch in batches:
        for part in slices(batch, "text"):
            low, starts, ends, count = split(part.column("text"), SPACED)
            ids.append(part.column("id").to_numpy(zero_copy_only=False))
            train.append(part.column("train").to_numpy(zero_copy_only=False).astype(bool))
            words.append(hashes(low, starts, ends))
            per.append(count)
            n += len(starts) + len(count)
            if n >= limit:
                yield close()
                ids, train, words, per, n, number = [], [], [], [], 0, number + 1
    if ids:
        yield close()


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 6
    cols = list(zip(*(r + (None,) * (10 - len(r)) for r in rows)))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], _COLS)


def _chunk_id(number: int) -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 20 | number


def _ask(order: int, buckets: int, limit: int):
    """Step 1, of each chunk: its distinct n-grams with their counts in training texts, by range of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, train, words, per in _chunks(batches, limit):
            chunk = _Chunk(words, per, order)
            del words
            trained = train[chunk.row]
            for m in range(1, order + 1):
                keys, same = np.unique(chunk.ending(m), return_inverse=True)
                counts = np.bincount(same[trained], minlength=len(keys)).astype(np.uint32)
                cut = _ranges(keys, buckets)
                yield _record([("ask", m, b, _chunk_id(number), pack_keys(keys[x:y]), pack(counts[x:y])) for b, (x, y) in enumerate(zip(cut, cut[1:])) if y > x])

    return run


def _tell(group: pd.DataFrame) -> pd.DataFrame:
    """Step 2, of one range: the table of training n-grams, and each chunk's totals. Of an n-gram's chunks the first owns it."""
    group = group.sort_values("chunk")
    keys = [unpack_keys(x) for x in group["a"]]
    counts = np.concatenate([unpack(x) for x in group["b"]]).astype(np.int64)
    ends = np.cumsum([len(x) for x in keys])
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    head = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    which = np.empty(len(every), np.int64)
    which[order] = np.cumsum(head) - 1
    distinct = ranked[head]
    total = np.bincount(which, counts, len(distinct)).astype(np.int64)
    using = np.flatnonzero(counts)
    owner = np.full(len(distinct), len(every))
    np.minimum.at(owner, which[using], using)
    owns = np.zeros(len(every), bool)
    owns[owner[total > 0]] = True
    told, m, bucket, at = total[which], int(group["m"].iloc[0]), int(group["bucket"].iloc[0]), 0
    seen = total > 0
    small = np.bincount(np.minimum(total[seen], FIT + 1), minlength=FIT + 2).astype(np.int64)
    asked = group["chunk"].to_numpy()
    places = np.array([(asked >> 20).max(), (asked & 0xFFFFF).max()], np.int64)
    rows = [("table", m, bucket, -1, pack_keys(distinct[seen]), pack(_narrow(total[seen], np.uint32, np.uint64)), pack(np.append(small, total.sum())), pack(places))]
    for chunk, end in zip(group["chunk"], ends):
        digest = int(every[at:end].sum(dtype=np.uint64)).to_bytes(8, "little")
        rows.append(("tell", m, bucket, int(chunk), pack(_narrow(told[at:end], np.uint32, np.uint64)), pack(np.packbits(owns[at:end])), digest))
        at = end
    return _frame(rows)


def _narrow(total: np.ndarray, small: type, large: type) -> np.ndarray:
    """total as small, or as large where one of it does not fit."""
    return total.astype(small if not len(total) or total.max() <= np.iinfo(small).max else large)


@dataclass(frozen=True)
class Sizes:
    """What the driver knows of the model: per order, n-grams seen 0..FIT times, distinct n-grams; tokens; chunks."""

    seen: dict[int, tuple[int, ...]]
    distinct: dict[int, int]
    tokens: int
    width: int = 1  # tasks that made chunks, and chunks a task at most
    depth: int = 1

    def slope(self, m: int) -> float | None:
        """Of the line through the logarithms of the counts of counts, each spread over its gap; None if it does not fall."""
        n = self.seen.get(m, ())
        some = [r for r in range(1, len(n)) if n[r]]
        if len(some) < 2 or not n[1]:
            return None
        gap = [(nxt - prv) / 2 for prv, nxt in zip([0, *some[:-1]], [*some[1:], 2 * some[-1] - some[-2]])]
        x, y = np.log(some), np.log([n[r] / g for r, g in zip(some, gap)])
        fall = float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())
        return fall if fall < -1 else None

    def lost(self, m: int) -> np.ndarray:
        """1 - d(c) for c of 0..K + 1; the last holds for all larger counts."""
        n, fall = self.seen.get(m, (0,) * (FIT + 1)), self.slope(m)
        out = np.full(K + 2, TAIL)
        out[0] = 1.0
        r = np.arange(1, K + 1)
        if fall is not None:  # the smoothed count of r is r (1 + 1/r)^(fall + 1); Katz's discounts leave counts above K alone
            out[1 : K + 1] = (1 - (1 + 1 / r) ** (fall + 1)) / (1 - (K + 1.0) ** (fall + 1))
        else:
            out[1 : K + 1] = min(n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5, 0.999) / r
        return out

    def discounts(self, m: int) -> np.ndarray:
        return 1.0 - self.lost(m)

    def smoothing(self, order: int) -> str:
        return ",".join("absolute" if self.slope(m) is None else "good-turing" for m in range(1, order + 1))

    @property
    def unknown(self) -> float:
        """Mass of the class of unknown words."""
        if not self.tokens:
            return 1.0
        n, lost = self.seen[1], self.lost(1)
        small = sum(r * n[r] for r in range(1, K + 1))
        return (sum(lost[r] * r * n[r] for r in range(1, K + 1)) + TAIL * (self.tokens - small)) / self.tokens


def _told(m: int, tells: pd.DataFrame, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Totals and ownership of all n-grams of a chunk, from the ranges in order; an error if they are for others."""
    mine = tells[tells["m"] == m].sort_values("bucket")
    totals = [unpack(x) for x in mine["a"]]
    owns = [np.unpackbits(unpack(x), count=len(t)) for x, t in zip(mine["b"], totals)]
    total = np.concatenate(totals).astype(np.int64)
    digest = sum(int.from_bytes(x, "little") for x in mine["c"]) % 2**64
    if len(total) != len(keys) or digest != int(keys.sum(dtype=np.uint64)):
        raise ValueError("a chunk has changed between two readings of its rows")
    return total, np.concatenate(owns).astype(bool)


def _weigh(sizes: Sizes, order: int, buckets: int, n_train: int):
    """Step 3, of each chunk: scores without backoff weights, the weights they lack, and sums over histories of owned n-grams."""
    disc = {m: sizes.discounts(m) for m in range(1, order + 1)}
    lost = {m: sizes.lost(m) for m in disc}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        r, tells = group[group["kind"] == "texts"].iloc[0], group[group["kind"] == "tell"]
        ident = int(r["chunk"])
        per, ids, train = unpack(r["c"]), r["d"], r["e"]
        words = unpack_keys(r["a"])[_by_count(unpack(r["f"]))]
        chunk, n_rows = _Chunk(words[unpack(r["b"])], per, order), len(per)
        del words
        per_text = lambda x=None: np.bincount(chunk.row, x, n_rows)
        rows, lower, ctx, doc = [], None, None, [per_text()]
        for m in range(1, order + 1):
            keys, same = np.unique(chunk.ending(m), return_inverse=True)
            same = same.astype(np.int32)
            total, owns = _told(m, tells, keys)
            at = np.zeros(len(keys), np.int32)
            at[same[::-1]] = np.arange(len(same) - 1, -1, -1, dtype=np.int32)  # where each n-gram is first
            count = _narrow(total, np.int32, np.int64)[same]
            del keys, same
            seen = count > 0
            p = disc[m][np.minimum(count, K + 1)]
            p *= count
            if m == 1:
                doc += [per_text(seen), per_text(np.log10((count + 0.5) / (sizes.tokens + 0.5 * (sizes.distinct.get(1, 0) + 1))))]
                p /= max(1, sizes.tokens)
                p[~seen] = sizes.unknown
                score = np.log10(p)
            else:
                # how often the history was seen: the count of the shorter n-gram one token before
                history = np.empty(len(ctx), np.result_type(ctx, np.min_scalar_type(n_train)))
                history[1:] = ctx[:-1]
                history[chunk.first] = n_train
                p /= np.maximum(history, 1)
                lack = np.flatnonzero(~seen & (history > 0))
                del history
                context = chunk.ending(m - 1, 1)
                mine = at[owns]
                if len(mine):
                    h, pos = np.unique(context[mine], return_inverse=True)
                    c = total[owns]
                    sums = [np.bincount(pos, x, len(h)) for x in (c, lost[m][np.minimum(c, K + 1)] * c, lower[mine])]
                    cut = _ranges(h, buckets)
                    rows += [("sum", m, b, ident, pack_keys(h[x:y]), *(pack(s[x:y]) for s in sums)) for b, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
                    del pos, sums, c
                h, pos = np.unique(context[lack], return_inverse=True)
                cut = _ranges(h, buckets)
                rows += [("need", m, b, ident, pack_keys(h[x:y])) for b, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
                rows.append((f"lack{m}", m, -1, ident, pack(chunk.row[lack].astype(np.uint32)), pack(pos.astype(np.uint32))))
                del context, lack, h, pos
                score[seen] = np.log10(p[seen])
            lower, ctx = p, count
            del at, total, owns, seen, p
        doc.append(per_text(score))
        rows.append(("docs", 0, -1, ident, ids, train, *(pack(x) for x in doc)))
        return _frame(rows)

    return run


def _histories(sums: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one range: histories, how often each was seen, and its backoff weight (log10)."""
    sums = sums.sort_values("chunk")
    if sums.empty:
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    h, pos = np.unique(np.concatenate([unpack_keys(x) for x in sums["a"]]), return_inverse=True)
    seen, left, lower = (np.bincount(pos, np.concatenate([unpack(x) for x in sums[c]]), len(h)) for c in "bcd")
    return h, seen, np.log10(left / seen) - np.log10(np.maximum(1.0 - lower, 1e-15))


def _alphas(group: pd.DataFrame) -> pd.DataFrame:
    """Step 4, of one range of histories: backoff weights for the chunks that lack them."""
    need = group[group["kind"] == "need"]
    h, _, alpha = _histories(group[group["kind"] == "sum"])
    return _frame([("alpha", int(m), int(bucket), int(chunk), pack(alpha[np.searchsorted(h, unpack_keys(a))])) for m, bucket, chunk, a in zip(need["m"], need["bucket"], need["chunk"], need["a"])])


def _weights(group: pd.DataFrame) -> pd.DataFrame:
    """Of one range of histories, the table of backoff weights."""
    h, seen, alpha = _histories(group)
    return _frame([("weights", int(group["m"].iloc[0]), int(group["bucket"].iloc[0]), -1, pack_keys(h), pack(seen.astype(np.int64)), pack(alpha))])


_SCORES = "id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def _finish(group: pd.DataFrame) -> pd.DataFrame:
    """Step 5, of each chunk: the weights join the scores."""
    parts, alphas = group[group["kind"] != "alpha"], group[group["kind"] == "alpha"]
    docs = parts[parts["kind"] == "docs"].iloc[0]
    score = unpack(docs["f"]).copy()
    for m in sorted(set(alphas["m"])):
        weight = np.concatenate([unpack(x) for x in alphas[alphas["m"] == m].sort_values("bucket")["a"]])
        lack = parts[parts["kind"] == f"lack{m}"].iloc[0]
        row, pos = unpack(lack["a"]), unpack(lack["b"])
        score += np.bincount(row, weight[pos], len(score))
    return _result(docs, score)


def _result(docs, score: np.ndarray) -> pd.DataFrame:
    counts = {n: unpack(docs[c]) for n, c in (("n_tokens", "c"), ("n_known", "d"))}
    return pd.DataFrame({"id": unpack(docs["a"]), "train": unpack(docs["b"]).astype(bool), **{n: x.astype(np.int64) for n, x in counts.items()}, "base_score": unpack(docs["e"]), "score": score})


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([r + (None,) * (10 - len(r)) for r in rows], columns=_COLS)


def _whole(work, by: list[str]):
    """work on each group of a partition, which holds all rows of its groups and as a rule one group."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = pd.concat([pd.DataFrame([], columns=_COLS), *frames], ignore_index=True)
        keys = every[by].drop_duplicates()
        for key in keys.itertuples(index=False):
            if len(keys) > 1:
                group = every[(every[by] == list(key)).all(axis=1)]
            else:
                group, every = every, None
            yield work(group)
            del group

    return run


def _by_range(df: DataFrame, work, least: int, order: int, ranges: int) -> DataFrame:
    """work on the rows of each order, from least on, and range of hashes: one partition each."""
    slot = (F.col("m") - least) * ranges + F.col("bucket")
    return df.repartitionById(max(1, (order - least + 1) * ranges), slot).mapInPandas(_whole(work, ["m", "bucket"]), _ROW)


def _by_chunk(df: DataFrame, work, schema: str, sizes: Sizes) -> DataFrame:
    """work on the rows of each chunk: one partition each."""
    slot = (F.col("chunk").bitwiseAND(0xFFFFF) * sizes.width + F.shiftright("chunk", 20)).cast("int")
    return df.repartitionById(sizes.width * sizes.depth, slot).mapInPandas(_whole(work, ["chunk"]), schema)


def _by_count(often: np.ndarray) -> np.ndarray:
    """Order of words by count: small numbers for frequent words make a text's numbers short."""
    return np.argsort(-often.astype(np.int64), kind="stable")


def _texts(limit: int):
    """Of each chunk: its distinct words and the texts as their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, train, flat, per in _chunks(batches, limit):
            words, same, often = np.unique(flat, return_inverse=True, return_counts=True)
            rank = np.empty(len(words), np.uint32)
            rank[_by_count(often)] = np.arange(len(words), dtype=np.uint32)
            cols = [pack(rank[same]), pack(per.astype(np.int64)), pack(ids.astype(np.int64)), pack(train.astype(np.uint8)), pack(often.astype(np.uint32))]
            yield _record([("texts", 0, -1, _chunk_id(number), pack_keys(words), *cols)])

    return run


NO_ID = np.iinfo(np.int64).min


def _input(docs: DataFrame, train, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))


@dataclass(frozen=True)
class Model:
    """A fitted model: counts holds tables of n-grams and what each chunk was told, sums those over histories."""

    counts: DataFrame
    parts: DataFrame
    sizes: Sizes
    order: int
    ranges: int

    def tables(self) -> DataFrame:
        """(kind, m, bucket, a, b, c), a row for each kind, order and range: of ``table`` the sorted keys of n-grams, their
        training counts and counts of counts; of ``weights`` the keys of histories, how often each was seen, log10 alpha."""
        weights = _by_range(self.parts.filter("kind = 'sum'"), _weights, 2, self.order, self.ranges)
        return self.counts.filter("kind = 'table'").union(weights).select("kind", "m", "bucket", "a", "b", "c")


def fit(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, chunk: int = CHUNK, range_bytes: int = RANGE_BYTES) -> Model:
    """The model of the rows of docs where train, a boolean column, holds. The other rows' n-grams are looked up on the way.

    docs is read more than once and has to be a table that reads the same each time (files, a checkpoint); a
    chunk that comes out differently is an error.
    """
    rows = _input(docs, train, id_col, text_col)
    size, n_train = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if("train")).first()
    ranges = max(1, -(-size // range_bytes))
    counts = settled_texts(_by_range(rows.mapInArrow(_ask(order, ranges, chunk), _ROW), _tell, 1, order, ranges))
    known = sizes(counts)
    texts = rows.mapInArrow(_texts(chunk), _ROW)
    parts = settled_texts(_by_chunk(texts.union(counts.filter("kind = 'tell'")), _weigh(known, order, ranges, n_train), _ROW, known))
    return Model(counts, parts, known, order, ranges)


def _totals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(m, k, n): counts of counts of a partition's tables, number k of order m; of order 0 the largest places of chunks."""
    total: dict[int, np.ndarray] = {}
    for frame in frames:
        for m, c, d in frame[["m", "c", "d"]].itertuples(index=False):
            total[m] = total.get(m, 0) + unpack(c).astype(np.int64)
            if d is not None:
                total[0] = np.maximum(total.get(0, 0), unpack(d).astype(np.int64))
    for m, x in total.items():
        yield pd.DataFrame({"m": np.full(len(x), m, np.int32), "k": np.arange(len(x), dtype=np.int32), "n": x})


def sizes(counts: DataFrame) -> Sizes:
    """Counts of counts of all tables, summed in Spark: a few numbers for each order come to the driver."""
    tables = counts.filter("kind = 'table'").select("m", "c", "d" if "d" in counts.columns else F.lit(None).cast("binary").alias("d"))
    told = tables.mapInPandas(_totals, "m int, k int, n long").groupBy("m", "k").agg(F.sum("n").alias("sum"), F.max("n").alias("most")).collect()
    total = {m: [r["sum"] for r in sorted(told, key=lambda r: r["k"]) if r["m"] == m] for m in {r["m"] for r in told if r["m"]}}
    places = [r["most"] for r in sorted(told, key=lambda r: r["k"]) if r["m"] == 0] or [0, 0]
    return Sizes({m: tuple(x[: FIT + 1]) for m, x in total.items()}, {m: int(sum(x[:-1])) for m, x in total.items()}, total[1][-1] if 1 in total else 0, *(int(x) + 1 for x in places))


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, chunk: int = CHUNK, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fit on the rows where train holds, score all: (id, train, n_tokens, n_known, base_score, score, train_tokens, smoothing).

    score is the log10 probability of the text and its end token; base_score that of single words, each
    with half a count more; smoothing tells the discounts of each order. docs as in ``fit``.
    """
    model = fit(docs, train, id_col, text_col, order, chunk, range_bytes)
    alphas = _by_range(model.parts.filter("kind in ('sum', 'need')"), _alphas, 2, order, model.ranges)
    out = _by_chunk(model.parts.filter("kind not in ('sum', 'need')").union(alphas), _finish, _SCORES, model.sizes)
    return _named(out, model.sizes, order)


def _named(out: DataFrame, known: Sizes, order: int) -> DataFrame:
    return out.withColumns({"id": F.nullif("id", F.lit(NO_ID)), "train_tokens": F.lit(known.tokens), "smoothing": F.lit(known.smoothing(order))})


def save(model: Model, path: str) -> None:
    """Write the model's tables as Parquet, partitioned by kind, order and range of hashes, and a row ``model`` of how they were made."""
    made = f"{model.order} {model.ranges} {K} {FIT}".encode()
    told = [("model", 0, 0, made, None, None)]
    row = model.counts.sparkSession.createDataFrame(told, "kind string, m int, bucket int, a binary, b binary, c binary")
    model.tables().unionByName(row).write.partitionBy("kind", "m", "bucket").parquet(path)


def evaluate(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """The columns of ``score`` but train for any docs, by the saved model at path, whose tables are read and not changed.

    Each chunk asks the tables for its n-grams and their histories, a range at a time, and backs off token by token. A model
    that was saved without what tells how it was made, or with other discounts than this library's, is an error.
    """
    every = docs.sparkSession.read.parquet(path)
    made = every.filter("kind = 'model'").select("a").collect()
    if len(made) != 1:
        raise ValueError(f"{path} does not tell how the model was made: save it again")
    order, ranges, *discounts = map(int, bytes(made[0]["a"]).split())
    if discounts != [K, FIT]:
        raise ValueError(f"{path} was made with other discounts: {discounts}, not {[K, FIT]}")
    saved = every.filter("kind <> 'model'")
    known = sizes(saved)
    rows = _input(docs, F.lit(False), id_col, text_col)
    asks = rows.mapInArrow(_ask_saved(order, ranges, chunk), _ROW)
    tables = saved.select("kind", "m", "bucket", F.lit(-1).cast("long").alias("chunk"), "a", "b", "c", *[F.lit(None).cast("binary").alias(x) for x in "def"])
    told = settled_texts(_by_range(asks.union(tables), _look_up, 1, order, ranges))
    most = told.agg(F.coalesce(F.max(F.shiftright("chunk", 20)), F.lit(0)), F.coalesce(F.max(F.col("chunk").bitwiseAND(0xFFFFF)), F.lit(0))).first()
    known = replace(known, width=int(most[0]) + 1, depth=int(most[1]) + 1)
    out = _by_chunk(rows.mapInArrow(_texts(chunk), _ROW).union(told), _evaluate(known, order), _SCORES, known)
    return _named(out, known, order).drop("train")


def _ask_saved(order: int, ranges: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, _, words, per in _chunks(batches, limit):
            chunk = _Chunk(words, per, order)
            for m in range(1, order + 1):
                for kind, keys in (("ngrams", chunk.ending(m)), ("histories", chunk.ending(m - 1, 1) if m > 1 else words[:0])):
                    keys = np.unique(keys)
                    cut = _ranges(keys, ranges)
                    if len(keys):
                        yield _record([(kind, m, b, _chunk_id(number), pack_keys(keys[x:y])) for b, (x, y) in enumerate(zip(cut, cut[1:])) if y > x])

    return run


def _look_up(group: pd.DataFrame) -> pd.DataFrame:
    """Of one range, what the saved tables have for the keys that chunks ask for; 0 where they have none."""
    rows = []
    for asked, kind in (("ngrams", "table"), ("histories", "weights")):
        held = group[group["kind"] == kind]
        keys = unpack_keys(held["a"].iloc[0]) if len(held) else np.zeros(0, np.uint64)
        values = [unpack(held[c].iloc[0]) for c in ("b", "c")[: 1 if kind == "table" else 2]] if len(held) else []
        for m, bucket, chunk, a in group[group["kind"] == asked][["m", "bucket", "chunk", "a"]].itertuples(index=False):
            want = unpack_keys(a)
            at = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
            there = keys[at] == want if len(keys) else np.zeros(len(want), bool)
            got = [np.where(there, v[at], 0) if len(keys) else np.zeros(len(want)) for v in values] or [np.zeros(len(want), np.int64)] * 2
            rows.append((asked, int(m), int(bucket), int(chunk), *map(pack, got)))
    return _frame(rows)


def _evaluate(sizes: Sizes, order: int):
    """Of each chunk: P of every token, from words up to the longest n-gram, by what the tables told."""
    disc = {m: sizes.discounts(m) for m in range(1, order + 1)}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        r = group[group["kind"] == "texts"].iloc[0]
        per, words = unpack(r["c"]), unpack_keys(r["a"])[_by_count(unpack(r["f"]))]
        chunk, n_rows = _Chunk(words[unpack(r["b"])], per, order), len(per)

        def told(kind: str, m: int, column: str, same: np.ndarray) -> np.ndarray:
            mine = group[(group["kind"] == kind) & (group["m"] == m)].sort_values("bucket")
            return np.concatenate([unpack(x) for x in mine[column]])[same]

        for m in range(1, order + 1):
            same = np.unique(chunk.ending(m), return_inverse=True)[1]
            count = told("ngrams", m, "a", same).astype(np.int64)
            if m == 1:
                known = count > 0
                base = np.log10((count + 0.5) / (sizes.tokens + 0.5 * (sizes.distinct.get(1, 0) + 1)))
                score = np.log10(np.where(known, disc[1][np.minimum(count, K + 1)] * count / max(1, sizes.tokens), sizes.unknown))
                continue
            same = np.unique(chunk.ending(m - 1, 1), return_inverse=True)[1]
            history, alpha = told("histories", m, "a", same), told("histories", m, "b", same)
            seen = count > 0
            p = disc[m][np.minimum(count, K + 1)] * count / np.maximum(history, 1)
            score = np.where(seen, np.log10(np.where(seen, p, 1.0)), np.where(history > 0, alpha + score, score))
        doc = [np.bincount(chunk.row, x, n_rows) for x in (np.ones(len(chunk.row)), known, base, score)]
        return _result({"a": r["d"], "b": r["e"], "c": pack(doc[0]), "d": pack(doc[1]), "e": pack(doc[2])}, doc[3])

    return run
