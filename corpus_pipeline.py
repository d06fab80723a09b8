"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the docs of the next one. All but the last return the columns of documents, and each drops what
its operator decides against:

1. language: rejected documents go (no letter, or no language compresses them clearly better than the next).
2. exact: of equal texts the smallest id stays.
3. near: of each group of near duplicates (five-word shingles, similarity 0.8 or more) the smallest id stays.
4. benchmark: contaminated documents go.
5. tokens: byte-level BPE ids with offsets, and digests of the ids and of what they decode to.

Every stage decides row by row: repeated rows leave one in the dedup stages, rows of one id and other texts do not
touch each other, a row without an id goes only before one that has an id. Null texts go with the first stage. Columns
beside those of documents are carried to the last stage, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import byte_bpe, compress_langid, decontaminate, exact_dedup, near_dup
from quarry.llm.queries import fold
from quarry.llm.runtime import shared_folder, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Dictionaries are filled from the labelled rows of docs whose id is not in the held-out fold."""
    model = compress_langid.fit(docs.filter(fold(4) != 2))
    return compress_langid.keep_known(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    found = byte_bpe.encode(docs, path, decoded=True)
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
        "offsets",
    )


STAGES = [("language", language), ("exact", exact), ("near", near), ("benchmark", benchmark), ("tokens", tokens)]

#: No SQL: compression, merges of byte pairs and components cannot be written in it. Tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the tables between them go to the shared checkpoint folder."""
    base = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = f"{base.rstrip('/')}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
