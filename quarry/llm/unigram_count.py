"""Token counts of a unigram tokenizer, by dynamic programming shared in a trie of pre-tokens.

A pre-token is a run of other than ASCII white space, with a mark in front that stands for the space. Its
best segmentation into vocabulary pieces has the largest sum of scores; the forward score at a character
depends only on the characters before it. So the distinct pre-tokens of a task go into a trie: a node holds the forward
score of its prefix, which is computed once whatever pre-tokens share it, and the node where a pre-token ends (a
terminal) tells its count of tokens. A task's trie has NODES nodes at most; then a new one is begun, which changes no count.
The pieces that end at a character come from an Aho-Corasick automaton of the vocabulary, whose state a node keeps too: only these
are tried, not every substring.

A character that no piece covers is spelled in its UTF-8 bytes, each one token, at BYTE_SCORE a byte. Of
segmentations with equal scores the one with fewer tokens counts.

Nothing is shuffled: every task counts its own rows, whose distinct pre-tokens are far fewer than their
tokens, and a global table of pre-tokens would have to be joined back with every token.

Cases: null and empty texts have no pre-tokens and no tokens. A pre-token of any length is counted whole. Rows are
independent: repeated rows, rows of one id and rows without an id each have their result; other columns, whatever their
names, are not read; an empty table gives an empty result.

The vocabulary is a given one, as tokenizers are not trained here, and its file ranks pieces without scores of a unigram
model; so the scores follow Zipf's law on the rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

MARK = "▁"
BYTE_SCORE = -16.0
KEEP = 100_000
NODES = 300_000


@cache
def vocabulary(path: str) -> tuple[dict[str, float], int]:
    """(score of each ordinary piece, length of the longest). The file ranks pieces; a score is the log of the
    share that a rank has under Zipf's law, ln(1 / (rank + 2.7)) less the log of the sum of all shares."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
    ids.sort(key=lambda k: (-model.get_score(k), k))
    total = math.log(sum(1.0 / (r + 2.7) for r in range(len(ids))))
    scores = {model.id_to_piece(k): -math.log(r + 2.7) - total for r, k in enumerate(ids)}
    return scores, max(map(len, scores))


class Pieces:
    """Aho-Corasick automaton of the pieces of up to ``longest`` characters: states are their prefixes, 0 the empty one."""

    def __init__(self, scores: dict[str, float], longest: int):
        self.next: list[dict[str, int]] = [{}]
        self.fail = [0]
        self.ends: list[tuple[tuple[int, float], ...]] = [()]  # (length, score) of the pieces that end in a state
        for piece, score in scores.items():
            if 0 < len(piece) <= longest:
                state = 0
                for char in piece:
                    if char not in self.next[state]:
                        self.next[state][char] = len(self.next)
                        self.next.append({})
                        self.fail.append(0)
                        self.ends.append(())
                    state = self.next[state][char]
                self.ends[state] = ((len(piece), score),)
        level = list(self.next[0].values())
        while level:  # shorter prefixes first
            for state in level:
                self.ends[state] += self.ends[self.fail[state]]
                for char, below in self.next[state].items():
                    self.fail[below] = self.step(self.fail[state], char)
            level = [x for state in level for x in self.next[state].values()]

    def step(self, state: int, char: str) -> int:
        """The longest prefix of a piece that ends with char, after that of state."""
        while (to := self.next[state].get(char)) is None:
            if not state:
                return 0
            state = self.fail[state]
        return to


@cache
def automaton(path: str) -> Pieces:
    return Pieces(*vocabulary(path))


class Trie:
    """Prefixes of pre-tokens with their forward scores: a node is [score, minus tokens, children by character, state]."""

    def __init__(self, scores: dict[str, float], longest: int, pieces: Pieces | None = None):
        self.pieces, self.root, self.size = pieces or Pieces(scores, longest), [0.0, 0, None, 0], 0

    def count(self, word: str) -> int:
        """Tokens of a pre-token; only the nodes that its prefixes lack are computed."""
        node, path, step, after, ends = self.root, [self.root], self.pieces.step, self.pieces.next, self.pieces.ends
        for char in word:
            if node[2] is None:
                node[2] = {}
            below = node[2].get(char)
            if below is None:
                n = 1 if char < "\x80" else len(char.encode())
                top_s, top_t = node[0] + BYTE_SCORE * n, node[1] - n
                if (state := after[node[3]].get(char)) is None:
                    state = step(node[3], char)
                for length, x in ends[state]:
                    before = path[-length]
                    s, t = before[0] + x, before[1] - 1
                    if s > top_s or s == top_s and t > top_t:
                        top_s, top_t = s, t
                below = node[2][char] = [top_s, top_t, None, state]
                self.size += 1
            node = below
            path.append(node)
        return -node[1]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, longest = vocabulary(path)
        pieces = automaton(path)
        trie, terminals = Trie(scores, longest, pieces), {}
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [(x.encode() if x else b"").split() for x in part.column("text").to_pylist()]
                fresh = {w for row in rows for w in row}.difference(terminals)
                if trie.size > NODES or len(terminals) + len(fresh) > KEEP:
                    trie, known = Trie(scores, longest, pieces), {w: terminals[w] for row in rows for w in row if w in terminals}
                    terminals = known
                for w in sorted(fresh):  # prefixes shared are met together
                    terminals[w] = trie.count(MARK + w.decode())
                tokens = [sum(map(terminals.__getitem__, row)) for row in rows]
                cols = [part.column("id"), pa.array([len(r) for r in rows], pa.int64()), pa.array([len(set(r)) for r in rows], pa.int64()), pa.array(np.array(tokens, np.int64))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n_pretokens", "n_distinct", "n_tokens"])

    return run


def counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id, n_pretokens, n_distinct, n_tokens). The vocabulary file is on every machine."""
    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return cols.mapInArrow(_count(vocabulary_path), f"id {cols.schema['id'].dataType.simpleString()}, n_pretokens long, n_distinct long, n_tokens long")
