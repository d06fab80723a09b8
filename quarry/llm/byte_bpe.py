"""Byte-level BPE encoding and decoding with a public rank file.

Pre-tokenisation of texts uses no regex. Every code point of a batch gets a class (letter, number, white space, as
the tiktoken library has them: it is asked once a worker for the members of each); each class is a function
on the states of a small automaton, and functions compose associatively, so the state after every
character comes from a blocked prefix scan over all texts of the batch at once. A table over three
neighbouring states then tells where pre-tokens begin. The slices between go through pair merging,
whose results are cached; byte offsets of the tokens are kept, and decoding uses them.

The pattern is the one of the public tokenizers package: contractions 's 't 're 've 'm 'll 'd; letters,
digits or other signs with one leading space; white space, whose last character goes to what follows
if it is a space. No special tokens: their strings are ordinary text.

Cases: null and empty texts give no tokens. Nothing is shuffled: rows are independent (repeated rows, rows without
an id and rows of one id each have their result), other columns are not read whatever their names, an empty table
gives an empty result, whole texts are read, and a task holds one batch of rows and a cache of bounded size.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

CACHE = 25_000  # entries of each of two generations
SLICE = 1 << 19  # bytes of text at a time
_L, _N, _P, _S, _SP, _Q, _A, _B, _E, _K = range(10)
START, L, N, P, S, SP, Q, QB, QK, C = range(10)


def _step(state: int, kind: int) -> int:
    """Next state. Q: an apostrophe that begins a pre-token; QB, QK: after it r or v, or l; C: contraction done."""
    if kind in (_N, _P, _S, _SP):
        return {_N: N, _P: P, _S: S, _SP: SP}[kind]
    if kind == _Q:
        return P if state in (P, SP, Q) else Q
    if state == Q and kind in (_A, _B, _K):
        return {_A: C, _B: QB, _K: QK}[kind]
    if state == QB and kind == _E or state == QK and kind == _K:
        return C
    return L


def _begins(before: int, here: int, after: int) -> bool:
    """Whether a pre-token begins at a character, from the states of it and its neighbours; START stands for none."""
    if before == START or before == C:
        return True
    if here in (C, START):
        return False
    if here in (QB, QK):
        return after != C
    if here in (S, SP):
        return before not in (S, SP) or after not in (START, S, SP)
    if here == Q:
        return True
    joins = {L: (L, QB, QK, SP), N: (N, SP), P: (P, Q, SP)}[here]
    return before not in joins


def _members(name: str) -> np.ndarray:
    """Code points of a character class of the pattern language, by the Unicode version that tiktoken has."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    own = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([k]): k for k in range(256)}, special_tokens={})
    return np.frombuffer(bytes(own.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)


@cache
def _machine():
    """(class of each code point, element of each class, element of each class at a text's start, composition table, state of each element)."""
    kinds = np.full(0x110000, _P, np.uint8)
    for name, kind in ((r"\p{L}", _L), (r"\p{N}", _N), (r"\s", _S)):
        kinds[_members(name)] = kind
    kinds[0x20] = _SP
    for text, kind in (("'", _Q), ("stmd", _A), ("rv", _B), ("e", _E), ("l", _K)):
        kinds[[ord(x) for x in text]] = kind
    unit = tuple(range(10))
    gens = [tuple(_step(s, k) for s in range(10)) for k in range(10)]
    firsts = [(_step(START, k),) * 10 for k in range(10)]
    known = list(dict.fromkeys([unit, *gens, *firsts]))
    index = {f: i for i, f in enumerate(known)}
    at = 0
    while at < len(known):  # all that compositions reach
        for g in [*gens, *firsts]:
            h = tuple(g[x] for x in known[at])
            if h not in index:
                index[h] = len(known)
                known.append(h)
        at += 1
    assert len(known) < 256
    table = np.array([[index[tuple(g[x] for x in f)] for g in known] for f in known], np.uint8)
    begins = np.array([[[_begins(a, b, c) for c in range(10)] for b in range(10)] for a in range(10)])
    return kinds, np.array([index[f] for f in gens], np.uint8), np.array([index[f] for f in firsts], np.uint8), table, np.array([f[0] for f in known], np.uint8), begins.reshape(-1)


def _scan(ids: np.ndarray, table: np.ndarray, block: int = 64) -> np.ndarray:
    """Inclusive prefix compositions: within blocks for all blocks at once, then over the blocks."""
    n = len(ids)
    if n <= block:
        out = ids.copy()
        for k in range(1, n):
            out[k] = table[out[k - 1], ids[k]]
        return out
    rows = -(-n // block)
    grid = np.zeros(rows * block, np.uint8)  # element 0 is the identity
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    for k in range(1, block):
        grid[k] = table[grid[k - 1], grid[k]]
    before = _scan(grid[-1], table, block)[:-1]
    grid[:, 1:] = table[before[None, :], grid[:, 1:]]
    return grid.T.reshape(-1)[:n]


def boundaries(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Positions where pre-tokens begin, in texts laid end to end; firsts: where the (non-empty) texts begin."""
    if not len(codes):
        return np.zeros(0, np.int64)
    kinds, gens, starts, table, state, begins = _machine()
    kind = kinds[codes]
    ids = gens[kind]
    ids[firsts] = starts[kind[firsts]]
    here = state[_scan(ids, table)].astype(np.int16)
    before, after = np.zeros_like(here), np.zeros_like(here)
    before[1:], after[:-1] = here[:-1], here[1:]
    before[firsts] = START
    after[firsts[1:] - 1] = START
    return np.flatnonzero(begins[before * 100 + here * 10 + after])


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, rank: dict[bytes, int]) -> tuple[int, ...]:
    """Token ids of one pre-token: the adjacent pair of lowest rank, leftmost first, is joined until none is known."""
    if piece in rank:
        return (rank[piece],)
    n = len(piece)
    if n <= 48:
        parts = [piece[k : k + 1] for k in range(n)]
        scores = [rank.get(piece[k : k + 2], 1 << 30) for k in range(n - 1)]
        while scores:
            low = min(scores)
            if low == 1 << 30:
                break
            k = scores.index(low)
            parts[k] += parts.pop(k + 1)
            scores.pop(k)
            if k < len(scores):
                scores[k] = rank.get(parts[k] + parts[k + 1], 1 << 30)
            if k:
                scores[k - 1] = rank.get(parts[k - 1] + parts[k], 1 << 30)
        return tuple(rank[x] for x in parts)
    end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(rank[piece[k : k + 2]], k, k + 2) for k in range(n - 1) if piece[k : k + 2] in rank]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, k, to = heapq.heappop(heap)
        if not alive[k] or right[k] >= n or end[right[k]] != to:
            continue
        other = right[k]
        alive[other] = False
        end[k], right[k] = to, right[other]
        if right[k] < n:
            left[right[k]] = k
            if (r := rank.get(piece[k : end[right[k]]])) is not None:
                heapq.heappush(heap, (r, k, end[right[k]]))
        if left[k] >= 0 and (r := rank.get(piece[left[k] : to])) is not None:
            heapq.heappush(heap, (r, left[k], to))
    return tuple(rank[piece[k : end[k]]] for k in range(n) if alive[k])


_NONE = np.int32(2**31 - 1)
SHORT = 32


@cache
def _pairs(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of the single bytes, sorted keys of the pairs of tokens that join to a token, that token)."""
    rank = ranks(path)
    keys, joined = [], []
    for token, k in rank.items():
        for cut in range(1, len(token)):
            a, b = rank.get(token[:cut]), rank.get(token[cut:])
            if a is not None and b is not None:
                keys.append(a << 32 | b)
                joined.append(k)
    order = np.argsort(np.array(keys, np.int64))
    return np.array([rank[bytes([x])] for x in range(256)], np.int32), np.array(keys, np.int64)[order], np.array(joined, np.int32)[order]


def _join(left: np.ndarray, right: np.ndarray, keys: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """The token, that is the rank, of each pair; _NONE where there is none or a side is missing (-1)."""
    key = left.astype(np.int64) << 32 | right.astype(np.int64)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where((keys[at] == key) & (right >= 0) & (left >= 0), joined[at], _NONE)


def merge_many(pieces: list[bytes], path: str) -> list[bytes]:
    """merge() of many short pre-tokens, as 32-bit ids: each round joins one pair of every piece that still has one."""
    byte_ids, keys, joined = _pairs(path)
    sizes = np.array([len(x) for x in pieces])
    tokens = np.full((len(pieces), int(sizes.max()) + 1), -1, np.int32)
    inside = np.arange(tokens.shape[1])[None, :] < sizes[:, None]
    tokens[inside] = byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    ranked = _join(tokens[:, :-1], tokens[:, 1:], keys, joined)
    out: list = [None] * len(pieces)
    rows = np.arange(len(pieces))
    while len(rows):
        at = ranked.argmin(axis=1)
        best = ranked[np.arange(len(rows)), at]
        over = best == _NONE
        if over.any():
            ready = np.ascontiguousarray(tokens[over])
            flat, step = ready.tobytes(), 4 * ready.shape[1]
            for k, (r, n) in enumerate(zip(rows[over].tolist(), (4 * (ready >= 0).sum(1)).tolist())):
                out[r] = flat[k * step : k * step + n]
        go = ~over
        rows, at, best, tokens, ranked = rows[go], at[go], best[go], tokens[go], ranked[go]
        if not len(rows):
            break
        here = np.arange(len(rows))
        tokens[here, at] = best
        cols = np.arange(tokens.shape[1] - 1)[None, :]
        tokens = np.take_along_axis(tokens, cols + (cols > at[:, None]), 1)  # the last column was -1 throughout
        cols = cols[:, :-1]
        ranked = np.take_along_axis(ranked, cols + (cols > at[:, None]), 1)
        # the pairs on both sides of the new token
        if tokens.shape[1] > 1:
            k = np.minimum(at, ranked.shape[1] - 1)
            ranked[here, k] = np.where(at < tokens.shape[1] - 1, _join(tokens[here, k], tokens[here, k + 1], keys, joined), _NONE)
            prev = np.maximum(at - 1, 0)
            ranked[here, prev] = np.where(at > 0, _join(tokens[here, prev], tokens[here, prev + 1], keys, joined), ranked[here, prev])
        else:
            ranked = np.full((len(rows), 1), _NONE, np.int32)
        tokens = np.concatenate([tokens, np.full((len(rows), 1), -1, np.int32)], 1) if (tokens[:, -1] >= 0).any() else tokens
        if ranked.shape[1] < tokens.shape[1] - 1:
            ranked = np.concatenate([ranked, np.full((len(rows), 1), _NONE, np.int32)], 1)
    return out


class _Cache:
    """Pre-token to its 32-bit ids, in two generations of CACHE entries: what is used again stays."""

    def __init__(self, path: str):
        self.path, self.young, self.old = path, {}, {}

    def of(self, pieces: list[str]) -> list[bytes]:
        young, short = self.young, []
        for piece in set(pieces).difference(young):
            if (got := self.old.get(piece)) is not None:
                young[piece] = got
            elif len(raw := piece.encode()) <= SHORT:
                short.append((piece, raw))
            else:
                young[piece] = np.array(merge(raw, ranks(self.path)), np.int32).tobytes()
        for at in range(0, len(short), 8192):
            part = short[at : at + 8192]
            young.update(zip([x for x, _ in part], merge_many([x for _, x in part], self.path)))
        out = list(map(young.__getitem__, pieces))
        if len(young) > CACHE:
            self.young, self.old = {}, young
        return out


def _lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(flat, kind))


_CACHES: dict[str, _Cache] = {}


class _Codec:
    """Encoder and decoder of one rank file, in a task."""

    def __init__(self, path: str):
        rank = ranks(path)
        self.memo = _CACHES.setdefault(path, _Cache(path))
        token = [b""] * (max(rank.values()) + 1)
        for x, k in rank.items():
            token[k] = x
        self.width = np.array([len(x) for x in token], np.int64)
        self.place = np.cumsum(self.width) - self.width
        self.bytes = np.frombuffer(b"".join(token), np.uint8)

    def encode(self, part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or "" for x in part.column("text").to_pylist()]
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(x) for x in texts], np.int64)
        ends = np.cumsum(sizes)
        cuts = boundaries(codes, (ends - sizes)[sizes > 0])
        edges = [*cuts.tolist(), len(joined)]
        upto = np.searchsorted(cuts, ends).tolist()
        got = self.memo.of([joined[a:b] for a, b in zip(edges, edges[1:])]) if joined else []
        ids = np.frombuffer(b"".join(got), np.int32)
        through = np.concatenate(([0], np.cumsum(np.fromiter(map(len, got), np.int64, len(got)) // 4)))
        counts = np.diff(through[[0, *upto]])
        over = np.concatenate(([0], np.cumsum(self.width[ids])))
        offs = over[:-1] - np.repeat(over[through[[0, *upto[:-1]]]], counts)
        return pa.RecordBatch.from_arrays([part.column("id"), _lists(ids, counts, pa.int32()), _lists(offs.astype(np.int32), counts, pa.int32())], ["id", "ids", "offsets"])

    def decode(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """Each id's bytes go where its offset says, counted from the first byte of its row."""
        out = []
        for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
            lists = part.column("ids")
            ids, offs = (part.column(c).flatten().to_numpy() for c in ("ids", "offsets"))
            counts = np.diff(lists.offsets.to_numpy())
            rows = np.repeat(np.arange(len(counts)), counts)
            wide = self.width[ids]
            size = np.bincount(rows, wide, len(counts)).astype(np.int64)
            base = np.cumsum(size) - size
            at = base[rows] + offs
            if not np.array_equal(at, np.cumsum(wide) - wide):
                raise ValueError("offsets and ids do not belong together")
            data = self.bytes[np.repeat(self.place[ids] - at, wide) + np.arange(wide.sum())]
            ends = pa.py_buffer(np.append(base, size.sum()).astype(np.int32))
            out.append(pa.Array.from_buffers(pa.binary(), len(counts), [None, ends, pa.py_buffer(data)]))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "ids", "offsets")), pa.concat_arrays(out) if out else pa.array([], pa.binary())], ["id", "ids", "offsets", "decoded"])


def _run(path: str, encode: bool, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _Codec(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE) if encode else [batch]:
                part = codec.encode(part) if encode else part
                yield codec.decode(part) if decode else part

    return run


_IDS = "ids array<int>, offsets array<int>"


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per row of docs: (id, ids array<int>, offsets array<int>: where each token begins in the text's UTF-8).

    vocabulary is the path of a rank file that every machine has. With ``decoded``, the ids of each slice are
    decoded in the same task, as ``decode`` does, into one more column.
    """
    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return cols.mapInArrow(_run(vocabulary, True, decoded), f"id {cols.schema['id'].dataType.simpleString()}, {_IDS}" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """The rows of ``encode`` with a column decoded: the bytes of the text, rebuilt from the ids alone."""
    return encoded.select("id", "ids", "offsets").mapInArrow(_run(vocabulary, False, True), f"id {encoded.schema['id'].dataType.simpleString()}, {_IDS}, decoded binary")
