"""Registered queries of the llm operators: each reads the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, compress_langid, decontaminate, exact_dedup, fill_middle, katz, license_scan, near_dup, oracles, overlap_join, phrases, quote_chat, secret_scan, unigram_count
from .runtime import table


def fold(n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = katz.score(docs, fold(5) != 1)
    return found.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.col("train_tokens").cast("long").alias("train_tokens"), F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"), "smoothing")


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.groups(table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return found.withColumnRenamed("id", "doc_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (t)
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(4) == 2
    model = compress_langid.fit(docs.filter(~held).select("doc_id", "text", "lang"))
    found = compress_langid.predict(docs.select("doc_id", "text"), model)
    found = found.withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected", "margin_bytes")


def op5_unigram_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = unigram_count.counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.col("matches.licence")))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(names, ",").alias("licences"),
        F.round(F.array_max("matches.dice"), 6).alias("best_dice"),
        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["licence"], m["start"].cast("string"), m["end"].cast("string"))), ",").alias("spans"),
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = byte_bpe.encode(table(spark, sf_dir, "documents"), path, decoded=True)
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_quote_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_chat.conversations(table(spark, sf_dir, "conversations"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = decontaminate.contaminated(F.col("n_hit"), F.col("n_words"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", hit.alias("contaminated"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come in two loads, half of them and then all: the second scan reads only what the first has not seen."""
    rows = secret_scan.versions(table(spark, sf_dir, "documents"))
    half = rows.filter(F.pmod(F.xxhash64("path"), F.lit(2)) == 0)
    findings = secret_scan.scan_loads([half, rows])
    found = F.coalesce("found", F.expr("cast(array() as array<struct<start: bigint, place: int, kind: string, end: bigint>>)"))
    out = secret_scan.to_paths(rows, findings).select(F.col("path").alias("doc_id"), found.alias("found"))
    base = F.filter("found", lambda x: x["kind"].isin(*secret_scan.BASE))
    as_text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in secret_scan.BASE]
    return out.select("doc_id", *counts, F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("found")).alias("spans"))


def op11_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_join.groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.transform(table(spark, sf_dir, "documents"))
    back = fill_middle.restore(F.col("output"), F.col("form"))
    return found.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_katz": op1_katz,
    "op2_near_dup": op2_near_dup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_language_id": op4_language_id,
    "op5_unigram_count": op5_unigram_count,
    "op6_license_scan": op6_license_scan,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_quote_chat": op8_quote_chat,
    "op9_decontaminate": op9_decontaminate,
    "op10_secret_scan": op10_secret_scan,
    "op11_overlap_join": op11_overlap_join,
    "op12_fill_middle": op12_fill_middle,
    "op13_phrases": op13_phrases,
}
SQL: dict[str, str] = {
    "op1_katz": oracles.KATZ,
    "op2_near_dup": oracles.NEAR_DUP,
    "op3_exact_dedup": OP3_SQL,
    "op9_decontaminate": oracles.DECONTAMINATE,
    "op10_secret_scan": oracles.SECRET_SCAN,
    "op11_overlap_join": oracles.OVERLAP_JOIN,
    "op12_fill_middle": oracles.FILL_MIDDLE,
    "op13_phrases": oracles.PHRASES,
}
