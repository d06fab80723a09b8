"""Language identification by compression.

Each language has a zstandard raw-content dictionary. A text is cut into blocks (all of it), every block is compressed
once with every dictionary, and the language with the smallest sum of bytes wins. A block comes after the last LEAD_IN
bytes of the dictionary, whose own size is taken off again: so short texts are told by their matches too, and all
texts are treated alike. The score grows with the margin to the runner-up, as a share of the winner's bytes; a text is
rejected when that share is below MIN_SHARE. A share holds at every length: letters of no learned language differ by
chance, by a share that shrinks with the text.

A dictionary holds the most frequent words of its language, the most frequent last. They are counted by Spark over the
whole texts of a bounded sample of labelled rows, taken in the order of a hash of the id: SAMPLE_ROWS rows of each
language at most (the documented bound). Every language with a labelled row is learned. The dictionaries are the whole
model and go to every task; their size is counted first, and one beyond MODEL_BYTES is an error.

Cases: a null text, or one without any letter (a character of Unicode's class L), is ``und`` with score 0 and rejected.
Without labelled rows everything is ``und``. Ties go to the language that sorts first, with a score of 0.5, rejected.
Rows are independent: repeated rows and null ids get their own result, an empty table none. Of a few words alone the
winner has some twenty bytes at most, so junk of under ten words may pass by chance (README).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DICT_BYTES = 48 << 10
SAMPLE_ROWS = 400
MODEL_BYTES = 1 << 30
BLOCK = 2 << 10
LEVEL = 6
LEAD_IN = 256
MIN_SHARE = 0.03
UND = "und"
_OTHER = re.compile(r"[\W\d_]+")
#: Word characters that are neither letters nor decimal digits: fractions, Roman numerals, numbers in circles.
_NUMBERS = re.compile("[ " + "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) in ("Nl", "No")) + "]+")


def letters(text: str) -> str:
    """What is encoded: lower-case letter runs joined by one space; marks, digits and symbols tell no language."""
    out = _OTHER.sub(" ", text)
    if not out.replace(" ", "").isalpha():  # rarely: the class of these numbers is slow to match
        out = _NUMBERS.sub(" ", out)
    return out.lower().strip()


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, size: int = DICT_BYTES) -> dict[str, bytes]:
    """Raw dictionary contents by language, from the labelled rows of docs.

    Of each language, ``rows`` rows at most are read, whole, those whose id hashes lowest; ids decide, so a rerun is the
    same. One number a language and then the words of the dictionaries come to the driver.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = known.groupBy(lang_col).agg(F.count("*").alias("n")).collect()
    if not counts:
        return {}
    if len(counts) * size > MODEL_BYTES:
        raise ValueError(f"{len(counts)} languages need up to {len(counts) * size} bytes of dictionaries, more than {MODEL_BYTES}")
    at = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[x for r in counts for x in (F.lit(r[0]), F.lit(min(1.0, 4.0 * rows / r["n"])))])
    few = known.filter(at < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), at.alias("at"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("at", "id", "text"))
    sample = few.withColumn("rank", rank).filter(F.col("rank") <= rows)
    each = sample.select("lang", F.explode(F.split(F.lower("text"), r"\P{L}+")).alias("word")).filter("word <> ''")
    often = each.groupBy("lang", "word").agg(F.count("*").alias("n"))
    # the bytes of a word and of the space after it, up to and with this one
    upto = F.sum(F.octet_length("word") + 1).over(Window.partitionBy("lang").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    best = often.withColumn("upto", upto).filter(F.col("upto") <= size).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("upto", "word")), asc=False).alias("words"))
    return {r["lang"]: r["words"].encode() for r in best.select("lang", F.array_join("words.word", " ").alias("words")).collect()}


def _predict(model: dict[str, bytes], level: int, block: int, min_share: float):
    langs = sorted(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = []  # one of each language for the whole task
        for lang in langs:
            d = zstandard.ZstdCompressionDict(model[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(model[lang]), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
            pack, lead = zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress, model[lang][-LEAD_IN:] + b" "
            packers.append((pack, lead, len(pack(lead))))
        for batch in batches:
            preds, scores, rejected, gaps = [], [], [], []
            for value in batch.column("text"):
                text = value.as_py()
                raw = letters(text).encode() if text and langs else b""
                if not raw:
                    preds.append(UND), scores.append(0.0), rejected.append(True), gaps.append(0)
                    continue
                sizes = [0] * len(langs)
                for a in range(0, len(raw), block):
                    part = raw[a : a + block]
                    for k, (pack, lead, own) in enumerate(packers):
                        sizes[k] += len(pack(lead + part)) - own
                best = min(range(len(langs)), key=sizes.__getitem__)
                size = max(1, sizes[best])
                gap = min((s for k, s in enumerate(sizes) if k != best), default=2 * size) - sizes[best]
                preds.append(langs[best])
                scores.append(0.5 + 0.5 * (1.0 - 0.5 ** (gap / size / MIN_SHARE)))
                rejected.append(not gap or gap < min_share * size)
                gaps.append(gap)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(preds, pa.string()), pa.array(np.array(scores, float)), pa.array(rejected, pa.bool_()), pa.array(gaps, pa.int64())],
                ["id", "lang_pred", "score", "rejected", "margin_bytes"],
            )

    return run


def predict(docs: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", level: int = LEVEL, block: int = BLOCK, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per row of docs: (id, lang_pred, score, rejected, margin_bytes). Whole texts are compressed."""
    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = cols.schema["id"].dataType.simpleString()
    return cols.mapInArrow(_predict(model, level, block, min_share), f"id {kind}, lang_pred string, score double, rejected boolean, margin_bytes long")


def keep_known(docs: DataFrame, model: dict[str, bytes], text_col: str = "text", level: int = LEVEL, block: int = BLOCK, min_share: float = MIN_SHARE) -> DataFrame:
    """docs without the rows that are rejected; all columns stay and nothing is shuffled."""
    run = _predict(model, level, block, min_share)
    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = []

        def asked() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                waiting.append(batch)
                yield pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], ["id", "text"])

        for found in run(asked()):
            yield waiting.pop(0).filter(pc.invert(found.column("rejected")))

    return docs.mapInArrow(kept, docs.schema)
