"""Licence scans: normalised segments of a text against licence templates by Dice over word bigrams.

A text is normalised to lower-case words (letters, digits, anything beyond ASCII). Its segments are its
lines, its paragraphs (runs of lines that are not blank) and the whole text. A segment matches a template if
the Dice coefficient of their sets of word bigrams, 2 |A and B| / (|A| + |B|), reaches PERCENT / 100. As the
shared part is at most the smaller set, only templates whose size is within PERCENT / (200 - PERCENT) of
the segment's, either way, are candidates; the others are pruned by size alone. A segment that has no bigram
of any template is passed over. Of the templates that a segment matches the best counts, ties by name.

A notice may also share its line or be parted by blank lines. So windows are compared as well: runs of words
across line and paragraph ends that begin and end with a bigram of the template, with at most (200 - PERCENT) /
PERCENT times its word pairs. Only windows with enough distinct bigrams of the template are looked at; of each
start the best end counts. Of windows that overlap, the one that shares most bigrams stays, then the best
coefficient, the first and the name. A window that lies to a half or more in a segment's match of the same
licence, or of at least its coefficient, is not listed again. Full texts of long licences are told by their titles
and by the notices within them.

Cases: null and empty texts match nothing, like segments of one word. Repeated lines count each, and so do repeated
rows; ids are passed on as they are, null or not; other columns, whatever their names, are not read; an empty table
gives an empty result. Nothing is shuffled; templates are a fixed list, or a table whose size is counted. Whole texts
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, grams, hashes, slices, split

PERCENT = 80

_GPL = (
    "This {0} is free software; you can redistribute it and/or modify it under the terms of the {1} Public License as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version. "
    "This {3} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {4} Public License for more details."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {0}"
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Notices and texts of common licences, by SPDX name.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", _BSD.format("") + _BSD_END),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", _BSD.format(_BSD_THIRD) + _BSD_END),
    ("BSD-3-Clause", _BSD.format(_BSD_THIRD)),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", _GPL.format("program", "GNU General", "2", "program", "GNU General")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", _GPL.format("library", "GNU Lesser General", "2.1", "library", "GNU Lesser General")),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", _GPL.format("program", "GNU Lesser General", "3", "program", "GNU Lesser General")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def _bigrams(text: str) -> tuple[np.ndarray, int]:
    """Distinct bigrams and the number of word pairs."""
    low, starts, ends, _ = split(pa.array([text]), ALNUM)
    pairs = grams(hashes(low, starts, ends), 2)
    return np.unique(pairs), len(pairs)


def within(size: int, other: int, percent: int) -> bool:
    """Whether sets of these sizes can reach the coefficient at all."""
    return 200 * min(size, other) >= percent * (size + other)


def _scan(templates: tuple[tuple[str, str], ...], percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [(name, *_bigrams(text)) for name, text in templates]
        known = [(name, set(pairs.tolist())) for name, pairs, _ in both]
        windows = _Windows([b for b in both if len(b[1])], percent)
        every = np.unique(np.array([x for _, s in known for x in s], np.uint64))
        mask = np.zeros(1 << 20, bool)
        mask[(every & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        memo: dict[bytes, tuple[str, float] | None] = {}

        def best(pairs: np.ndarray) -> tuple[str, float] | None:
            mine = set(pairs.tolist())
            if (key := pairs.tobytes()) in memo:
                return memo[key]
            found = None
            for name, theirs in known:
                if within(len(mine), len(theirs), percent):
                    common = len(mine & theirs)
                    if 200 * common >= percent * (len(mine) + len(theirs)):
                        dice = 2 * common / (len(mine) + len(theirs))
                        if found is None or (-dice, name) < (-found[1], found[0]):
                            found = name, dice
            if len(memo) < 10_000 and len(key) < 4096:
                memo[key] = found
            return found

        least = min((len(s) for _, s in known), default=1) * percent / (200 - percent)
        for batch in batches:
            for part in slices(batch, "text"):
                low, starts, ends, per = split(part.column("text"), ALNUM)
                pairs = grams(hashes(low, starts, ends), 2)
                row = np.repeat(np.arange(len(per)), per)
                line = np.searchsorted(np.flatnonzero(low == 10), starts)  # line breaks before each word
                first = np.cumsum(per) - per
                near = np.zeros(len(pairs), bool)
                maybe = np.flatnonzero(mask[(pairs & np.uint64((1 << 20) - 1)).astype(np.int64)])
                near[maybe] = np.isin(pairs[maybe], every)
                rows: dict[int, set] = {}
                for step in (1, 2, None):  # lines, paragraphs, whole texts
                    new = row[1:] != row[:-1]
                    if step:
                        new |= np.diff(line) >= step
                    for x, y in _likely(pairs, near, np.concatenate(([0], np.cumsum(new))), least, percent):
                        if hit := best(np.unique(pairs[x : y - 1])):
                            r = int(row[x])
                            rows.setdefault(r, set()).add((int(x - first[r]), int(y - first[r]), *hit))
                for r, found in windows.find(pairs, row, maybe[near[maybe]]).items():
                    held = list(rows.get(r, ()))
                    for x, y, name, dice in found:
                        x, y = x - int(first[r]), y - int(first[r])
                        if not any(2 * (min(y, b) - max(x, a)) >= y - x and (n == name or d >= dice) for a, b, n, d in held):
                            rows.setdefault(r, set()).add((x, y, name, dice))
                found = [[{"start": x, "end": y, "licence": n, "dice": d} for x, y, n, d in sorted(rows.get(r, ()))] for r in range(part.num_rows)]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("licence", pa.string()), ("dice", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(per.astype(np.int64)), pa.array(found, kind)], ["id", "n_words", "matches"])

    return run


class _Windows:
    """Runs of words that match a template wherever they begin and end."""

    def __init__(self, known: list[tuple[str, np.ndarray, int]], percent: int):
        self.names, self.own, self.percent = [k[0] for k in known], [k[1] for k in known], percent
        self.size = np.array([len(k[1]) for k in known], np.int64)
        self.room = np.array([k[2] * (200 - percent) // percent for k in known], np.int64)  # word pairs of a window
        self.need = -(-percent * self.size // (200 - percent))  # shared bigrams of a match at least
        bigram = np.concatenate([k[1] for k in known] or [np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(known)), self.size)
        order = np.argsort(bigram, kind="stable")
        self.keys, self.at = np.unique(bigram[order], return_index=True)
        self.owner, self.at = owner[order], np.append(self.at, len(order))

    def find(self, pairs: np.ndarray, row: np.ndarray, near: np.ndarray) -> dict[int, list[tuple[int, int, str, float]]]:
        """(first word, end, name, coefficient) of the windows that stay, by row; near are the pairs that a template has."""
        near = near[row[near] == row[near + 1]]
        if not len(near):
            return {}
        key = np.searchsorted(self.keys, pairs[near])
        reps = self.at[key + 1] - self.at[key]
        entry = np.repeat(self.at[key], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        tpl, pos, key = self.owner[entry], np.repeat(near, reps), np.repeat(key, reps)
        order = np.lexsort((pos, tpl))
        tpl, pos, key = tpl[order], pos[order], key[order]
        # one axis for all: rows and templates lie further apart than any window reaches
        apart = int(self.room.max()) + 2
        axis = pos + row[pos] * apart + tpl * (len(pairs) + (int(row[-1]) + 2) * apart)
        room = self.room[tpl]
        same = np.lexsort((axis, key, tpl))
        a, b = same[:-1], same[1:]
        again = (tpl[a] == tpl[b]) & (key[a] == key[b]) & (axis[b] - axis[a] < room[b])
        a, b = a[again], b[again]
        # distinct bigrams in the window of full room at each hit: hits, less those that repeat an earlier one in it
        hits = np.searchsorted(axis, axis + room) - np.arange(len(axis))
        twice = np.searchsorted(np.sort(axis[b] - room[b] + 1), axis, "right") - np.searchsorted(np.sort(axis[a]), axis)
        starts = np.flatnonzero(hits - twice >= self.need[tpl])
        got: dict[int, list] = {}
        k = 0
        while k < len(starts):  # starts close together are compared at once
            t = int(tpl[starts[k]])
            to = min(int(np.searchsorted(axis[starts], axis[starts[k]] + room[starts[k]])), k + 64)
            begin, k = pos[starts[k:to]], to
            r = int(row[begin[0]])
            stop = min(int(begin[-1]) + int(self.room[t]), int(np.searchsorted(row, r, "right")) - 1)
            got.setdefault(r, []).extend(self._best(pairs[begin[0] : stop], begin, t))
        out = {}
        for r, found in got.items():
            kept: list[tuple[int, int, str, float]] = []
            for _, dice, x, y, name in sorted(found):
                if all(y <= a or b <= x for a, b, _, _ in kept):
                    kept.append((x, y, name, -dice))
            if kept:
                out[r] = kept
        return out

    def _best(self, pairs: np.ndarray, begin: np.ndarray, t: int) -> list[tuple[int, float, int, int, str]]:
        """Of each start the best end, if it matches; pairs begin at the first start."""
        mine = np.isin(pairs, self.own[t])
        _, inverse = np.unique(pairs, return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        last = np.full(len(pairs), -1)
        twin = inverse[order][1:] == inverse[order][:-1]
        last[order[1:][twin]] = order[:-1][twin]
        at, step = (begin - begin[0])[:, None], np.arange(len(pairs))
        new = (step >= at) & (last < at)
        size, shared = np.cumsum(new, 1), np.cumsum(new & mine, 1)
        total = size + int(self.size[t])
        ok = (200 * shared >= self.percent * total) & (step >= at) & (step < at + self.room[t])
        dice = np.where(ok, 2 * shared / total, 0.0)
        end = dice.argmax(1)
        return [(-int(shared[i, e]), -float(dice[i, e]), int(begin[i]), int(begin[0]) + int(e) + 2, self.names[t]) for i, e in enumerate(end.tolist()) if dice[i, e]]


def _likely(pairs: np.ndarray, near: np.ndarray, segment: np.ndarray, least: float, percent: int) -> list[tuple[int, int]]:
    """Word ranges of segments that can match: enough bigrams of templates, and a large enough share of them.

    A match shares at least percent / (200 - percent) of the distinct bigrams of either side.
    """
    if not len(pairs):
        return []
    inside = segment[1:] == segment[:-1]
    hits = np.bincount(segment[:-1][inside & near], minlength=int(segment[-1]) + 1)
    some = hits >= least
    at = np.flatnonzero(inside & some[segment[:-1]])
    if not len(at):
        return []
    order = at[np.lexsort((pairs[at], segment[at]))]
    seg, pair = segment[order], pairs[order]
    distinct = np.ones(len(order), bool)
    distinct[1:] = (seg[1:] != seg[:-1]) | (pair[1:] != pair[:-1])
    size = np.bincount(seg[distinct])
    good = np.bincount(seg[distinct & near[order]], minlength=len(size))
    pick = np.flatnonzero((size > 0) & ((200 - percent) * good >= percent * size))
    return list(zip(np.searchsorted(segment, pick).tolist(), np.searchsorted(segment, pick, "right").tolist()))


TEMPLATE_CHARS = 64 << 20


def templates_from(table: DataFrame, name_col: str = "name", text_col: str = "text") -> tuple[tuple[str, str], ...]:
    """Templates from a table (name, text), in order; rows that lack either are passed over. All tasks get them, so their size is counted first."""
    rows = table.select(F.col(name_col).alias("name"), F.col(text_col).alias("text")).filter("name is not null and text is not null")
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if chars > TEMPLATE_CHARS:
        raise ValueError(f"templates of {chars} characters, more than {TEMPLATE_CHARS}")
    return tuple((r["name"], r["text"]) for r in rows.orderBy("name", "text").collect())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] | DataFrame = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: (id, n_words, matches array<struct<start, end, licence, dice>>); start and end count words.

    templates are pairs of name and text, or a table of them: full texts of licences, notices, in any number.
    """
    templates = templates_from(templates) if isinstance(templates, DataFrame) else templates
    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = cols.schema["id"].dataType.simpleString()
    return cols.mapInArrow(_scan(templates, percent), f"id {kind}, n_words long, matches array<struct<start:long,end:long,licence:string,dice:double>>")
