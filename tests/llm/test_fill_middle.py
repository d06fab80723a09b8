"""Fill-in-the-middle against a plain version, and the skip list against counting."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import fill_middle
from quarry.llm.queries import op12_fill_middle
from quarry.llm.words import offsets

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abZ 1é\n€😀-"), max_size=60), max_size=12))
def test_skip_list(texts):
    units = fill_middle.SkipList(*offsets(pa.array(texts, pa.string())))
    want = [[0, *np.cumsum([len(u) for u in UNIT.findall(t)])] for t in texts]
    assert list(units.sizes()) == [len(w) - 1 for w in want]
    rows = np.array([k for k, w in enumerate(want) for _ in w], np.int64)
    ranks = np.array([r for w in want for r in range(len(w))], np.int64)
    assert list(units.code_points(rows, ranks)) == [c for w in want for c in w]


def test_long_text_in_blocks(monkeypatch):
    monkeypatch.setattr(fill_middle, "BLOCK", 64)
    text = "word déjà — vu! 😀x " * 500 + "y" * 300
    units = fill_middle.SkipList(*offsets(pa.array([text, "ab", ""], pa.string())))
    want = [0, *np.cumsum([len(u) for u in UNIT.findall(text)])]
    assert list(units.sizes()) == [len(want) - 1, 1, 0]
    got = units.code_points(np.zeros(len(want), np.int64), np.arange(len(want)))
    assert list(got) == list(want)
    assert len(units.lanes) > 2 and len(units.place) < len(want) / 4


ROWS = [
    *((k, f"Text {k}: one two-three, déjà vu 😀 <x> " * (k % 7 + 1)) for k in range(60)),
    (100, None), (101, ""), (102, "a <P> mark"), (103, "<M>"), (104, "<<S"), (105, "P>"), (106, "<"), (None, "no id here"), (None, None),
    (107, "x" * 300_000 + " long " * 50_000), (5, "another text of an id"), (5, "another text of an id"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "p", 7, "q") for i, t in ROWS], "doc_id long, text string, form string, n int, output string")


def test_rows(docs):
    got = fill_middle.transform(docs).collect()
    want = sorted((str(i), *map(str, plain(i, t))) for i, t in ROWS)
    assert sorted((str(r["id"]), *map(str, (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]))) for r in got) == want


def test_way_back(docs):
    rows = fill_middle.transform(docs, spm=50)
    got = rows.select("text", "form", fill_middle.restore(rows["output"], rows["form"]).alias("back")).collect()
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert all(r["text"] == r["back"] for r in got)


def test_empty(docs):
    assert fill_middle.transform(docs.limit(0)).count() == 0


def test_query(spark):
    rows = op12_fill_middle(spark, "/root/testdata/sf0.001")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in rows.collect():
        n, form, a, b, out = plain(r["doc_id"], docs[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == (n, form, a, b, sha(out), sha(docs[r["doc_id"]]))
