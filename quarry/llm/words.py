"""Vectorised word splitting and hashing over Arrow string columns.

Used inside Spark tasks: a batch of whole texts becomes flat numpy arrays (word starts, word ends,
words per row, 64-bit word hashes), so no per-word Python objects are made. Every hash is a fixed
function of the bytes: equal on every executor and in every run.

Null texts have no words. A text of any length is handled whole; hashing works through blocks of
``BLOCK`` bytes, so memory beside the text itself stays bounded unless one word is longer than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 - 2  # 3 mod 8: powers differ in low bits
_INV = pow(_BASE, -1, 2**64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that belong to a word: all but 0x20 and 0x09-0x0D.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Letters a-z, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for positions below n (the common size is kept)."""
    if n <= BLOCK:
        if BLOCK not in _POW:
            _POW[BLOCK] = _powers(_BASE, BLOCK), _powers(_INV, BLOCK)
        return _POW[BLOCK]
    return _powers(_BASE, n), _powers(_INV, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows of about ``limit`` bytes of text; a longer text comes alone."""
    offs = offsets(batch.column(column))[0]
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def offsets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1, from 0) and bytes of a string or binary column; null counts as empty."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offs, data = col.buffers()
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offs = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return offs - offs[0], data


def split(col: pa.Array, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, words per row) of a text column."""
    return split_bytes(*offsets(col), word_bytes)


def split_bytes(offs: np.ndarray, data: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """split() of texts from offs[i] to offs[i + 1] of data."""
    low = LOWER[data]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = word_bytes[low]
    edge = np.zeros(len(low) + 1, bool)  # a text begins here, so no word goes on
    edge[offs] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    per_row = np.diff(np.searchsorted(starts, offs))
    return low, starts, ends, per_row


def hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        a, b = int(starts[at]), int(ends[to - 1])
        pw, inv = _tables(b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[low[a:b]] * pw[: b - a], out=sums[1:])
        s, e = starts[at:to] - a, ends[at:to] - a
        out[at:to] = (sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


_STEP = np.uint64(0xD6E8FEB86659FD93)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words that begin at each of the first len(words) - n + 1 words."""
    if n > len(words):
        return np.zeros(0, np.uint64)
    size = len(words) - n + 1
    out = np.full(size, n, np.uint64)
    for k in range(n):
        out = mix(out * _STEP + words[k : k + size])
    return out


def shingles(words: np.ndarray, per_row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows in row order, number of them per row).

    A row with fewer than n words, but not none, has its whole sequence as one shingle.
    """
    all_, out, counts, at = grams(words, n), [], np.zeros(len(per_row), np.int64), 0
    for k, size in enumerate(per_row):
        if size:
            got = grams(words[at : at + size], int(size)) if size < n else np.sort(all_[at : at + size - n + 1])
            if len(got) > 1:
                got = got[np.concatenate(([True], got[1:] != got[:-1]))]
            out.append(got)
            counts[k] = len(got)
        at += size
    return np.concatenate(out) if out else np.zeros(0, np.uint64), counts
