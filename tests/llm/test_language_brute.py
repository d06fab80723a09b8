"""The compression classifier written a second time: dictionaries by counting in Python, one plain zstandard call a block."""

import zlib
from collections import Counter, defaultdict

import regex
import zstandard
from pyspark.sql import functions as F

from quarry.llm import compress_langid as L
from quarry.llm.queries import op4_language_id

DIR = "/root/testdata/sf0.001"


def contents(rows, size):
    """Dictionary bytes by language: the most frequent words, the rarest of them first."""
    count = defaultdict(Counter)
    for text, lang in rows:
        count[lang].update(w for w in regex.split(r"\P{L}+", text.lower()) if w)
    out = {}
    for lang, words in count.items():
        chosen, used = [], 0
        for n, w in sorted((-n, w.encode()) for w, n in words.items()):
            used += len(w) + 1
            if used > size:
                break
            chosen.append(w)
        out[lang] = b" ".join(reversed(chosen))
    return out


def cost(content, raw):
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(L.LEVEL, dict_size=len(content), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    size = lambda x: len(zstandard.ZstdCompressor(dict_data=data, compression_params=how).compress(x))
    lead = content[-L.LEAD_IN :] + b" "
    return sum(size(lead + raw[a : a + L.BLOCK]) - size(lead) for a in range(0, len(raw), L.BLOCK))


def classified(model, text):
    raw = " ".join(regex.findall(r"\p{L}+", text or "")).lower().encode()
    if not raw:
        return "und", True
    sizes = sorted((cost(content, raw), lang) for lang, content in model.items())
    gap = sizes[1][0] - sizes[0][0]
    return sizes[0][1], gap == 0 or gap < L.MIN_SHARE * sizes[0][0]


def test_query_equals_a_plain_loop(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    train = docs.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    counts = Counter(r.lang for r in rows if fold(r.doc_id) != 2 and r.lang is not None and r.text is not None)
    assert max(counts.values()) <= L.SAMPLE_ROWS  # so all labelled rows are in the sample
    model = contents([(r.text, r.lang) for r in rows if fold(r.doc_id) != 2 and r.lang is not None and r.text is not None], L.DICT_BYTES)
    assert L.fit(train) == model
    want = {r.doc_id: classified(model, r.text) for r in rows}
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in op4_language_id(spark, DIR).collect()}
    assert got == want
