"""Fill-in-the-middle: a text is cut in prefix, middle and suffix at two ranks of its units, and put together in another order.

Units are runs of ASCII letters, and every other code point alone. The cuts are found in an indexable skip list of the
units: each express lane holds about one of ``FAN`` nodes of the lane below and knows, for each step, how many units and how
many code points it passes. A search descends from the top lane and adds widths up, so that a rank turns into a place
in code points exactly, without a look at the units in between. The lowest lane is the text itself: a search ends with the
few units between two nodes of the first express lane. One list serves all texts of a slice of about 1 MB, or one
longer text, which is read in blocks: beside the text itself 1/FAN of its units are held, 24 bytes each.

Work in Python is by row, nothing is shuffled; hashes, forms, outputs and the way back are Spark expressions.

Cases: a null text is the empty text, which is plain. A text that holds one of the marks is plain, as it could not be taken apart
again; in all other outputs the marks are unambiguous, as none of them overlaps another or itself. Draws come from
the decimal id; a null id counts as no digits. Repeated rows and ids give a row each. Other columns of docs, whatever their
names, are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import mix, offsets, slices

FAN = 8
BLOCK = 1 << 20
MARKS = ("<P>", "<S>", "<M>")
RATE = 90
SPM = 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _starts(data: np.ndarray, edge: bool) -> tuple[np.ndarray, np.ndarray]:
    """(where units begin, where code points begin) in bytes; edge: the byte before is no letter of the same text."""
    letter = _LETTER[data]
    point = (data & 0xC0) != 0x80
    inner = letter.copy()
    inner[1:] &= letter[:-1]
    inner[:1] &= not edge
    return point & ~inner, point


class SkipList:
    """The units of texts, offs[i] to offs[i + 1] of data, one list for all of them."""

    def __init__(self, offs: np.ndarray, data: np.ndarray) -> None:
        self.data, self.offs = data, offs
        ranks, chars, places = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        self.head_rank, self.head_char = np.zeros(len(offs), np.int64), np.zeros(len(offs), np.int64)
        units = points = 0
        for a in range(0, len(data), BLOCK):
            b = min(a + BLOCK, len(data))
            start, point = _starts(data[a:b], a == 0 or not _LETTER[data[a - 1]])
            first, last = np.searchsorted(offs, [a, b])
            heads = offs[first:last] - a  # texts begin here, and so do units
            start[heads] = True
            at = np.flatnonzero(start)
            before = np.cumsum(point) - point
            self.head_rank[first:last] = units + np.searchsorted(at, heads)
            self.head_char[first:last] = points + before[heads]
            rank = units + np.arange(len(at), dtype=np.int64)
            tall = (mix(rank.astype(np.uint64)) % np.uint64(FAN) == 0) & (rank > 0)
            ranks.append(rank[tall])
            chars.append(points + before[at[tall]])
            places.append(a + at[tall])
            units, points = units + len(at), points + int(point.sum())
        end = np.searchsorted(offs, len(data))
        self.head_rank[end:], self.head_char[end:] = units, points
        rank = np.concatenate([*ranks, [units]]).astype(np.int64)
        char = np.concatenate([*chars, [points]]).astype(np.int64)
        self.place = np.concatenate([*places, [len(data)]]).astype(np.int64)
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # from the first express lane up: widths in units and code points, the node below
        below = np.arange(len(rank))
        level = FAN
        while True:
            self.lanes.append((np.append(np.diff(rank), np.iinfo(np.int64).max), np.append(np.diff(char), 0), below))
            if len(rank) <= 2 * FAN:
                break
            level *= FAN
            below = np.flatnonzero(mix(rank.astype(np.uint64)) % np.uint64(level) == 0)
            below = np.unique(np.concatenate(([0], below, [len(rank) - 1])))
            if len(below) == len(rank):
                break
            rank, char = rank[below], char[below]

    def sizes(self) -> np.ndarray:
        """Units of each text."""
        return np.diff(self.head_rank)

    def code_points(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Code points before the unit of that rank, of each text named; the rank after the last is the text's end."""
        left = self.head_rank[text] + rank
        chars = np.zeros(len(left), np.int64)
        at = np.zeros(len(left), np.int64)
        for lane, (units, points, below) in reversed(list(enumerate(self.lanes))):
            move = np.flatnonzero(units[at] <= left)
            while len(move):
                left[move] -= units[at[move]]
                chars[move] += points[at[move]]
                at[move] += 1
                move = move[units[at[move]] <= left[move]]
            if lane:
                at = below[at]
        for k in np.flatnonzero(left):
            chars[k] += self._walk(int(at[k]), int(left[k]))
        return chars - self.head_char[text]

    def _walk(self, node: int, steps: int) -> int:
        """Code points of so many units from a node of the first express lane on."""
        a, b = int(self.place[node]), int(self.place[node + 1])
        start, point = _starts(self.data[a:b], True)
        first, last = np.searchsorted(self.offs, [a, b])
        start[self.offs[first:last] - a] = True
        return int(point[: np.flatnonzero(start)[steps]].sum())


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            units = SkipList(*offsets(part.column("text")))
            n = units.sizes()
            one, two = (part.column(c).to_numpy(zero_copy_only=False) % (n + 1) for c in ("one", "two"))
            rows = np.arange(len(n))
            a, b = units.code_points(rows, np.minimum(one, two)), units.code_points(rows, np.maximum(one, two))
            cols = [part.column("id"), part.column("text"), part.column("form"), pa.array(n), pa.array(a), pa.array(b - a)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "text", "form", "n", "prefix", "middle"])


def draws(id_col: Column, salt: int = 1) -> list[Column]:
    """Four numbers below 2**32 of a row, from its id."""
    hexes = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexes, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, spm: int = SPM, salt: int = 1) -> DataFrame:
    """One row per row of docs: (id, text, n, form, prefix_chars, middle_chars, output).

    ``rate`` per cent of the texts that can be cut are, ``spm`` per cent of these with the suffix first.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = draws(F.col(id_col), salt)
    uncut = (text == "") | (h[2] % 100 >= rate)
    for mark in MARKS:
        uncut = uncut | F.contains(text, F.lit(mark))
    form = F.when(uncut, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), form.alias("form"), h[0].alias("one"), h[1].alias("two"))
    kind = rows.schema["id"].dataType.simpleString()
    cut = rows.mapInArrow(_cut, f"id {kind}, text string, form string, n long, prefix long, middle long")
    a, b = F.col("prefix").cast("int"), F.col("middle").cast("int")
    prefix, middle = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b)
    suffix = F.substring("text", a + b + 1, F.length("text"))
    p, s, m = (F.lit(x) for x in MARKS)
    psm = F.concat(p, prefix, s, suffix, m, middle)
    out = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    whole = F.col("form") == "plain"
    return cut.select("id", "text", "n", "form", F.when(~whole, F.col("prefix")).alias("prefix_chars"), F.when(~whole, F.col("middle")).alias("middle_chars"), out.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    p, s, m = (F.lit(x) for x in MARKS)
    part = lambda col, mark, k: F.split_part(col, mark, F.lit(k))
    psm = F.concat(part(part(output, s, 1), p, 2), part(output, m, 2), part(part(output, m, 1), s, 2))
    spm = F.concat(part(part(output, m, 1), p, 2), part(output, m, 2), part(part(output, p, 1), s, 2))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
