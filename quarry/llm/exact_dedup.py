"""Exact duplicates by content sort.

Texts are normalised (each run of ASCII white space becomes one space), range-partitioned at sampled splitters and
sorted, so equal texts become neighbours; each row is then compared in full with the one before it. The sort key is
(leading characters, hash of the whole text, text, id): splitters are drawn from the short columns and the id, so they
stay small however long texts are; texts that begin alike for more than LEAD characters are in order of their hash.
A group of copies that holds a third of all rows spreads over as many ranges as its size asks for, in order of id. Of
such a group only the first and last run of each range go on: one row with its text each, grouped by the text itself.

Cases: a null text counts as empty; all empty texts are one group. Rows with the same id are separate rows of their
group; of repeated rows ``deduplicate`` leaves one. Null ids sort last and are never kept before a real id. An empty
table gives an empty result. Other columns, whatever their names, are carried by ``deduplicate`` and ignored by
``groups``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import settled, settled_texts

SPACE = r"[\x20\x09-\x0D]+"
NO_ID = np.iinfo(np.int64).max
LEAD = 100

#: run: null inside a range, 0 for its first run, 1 for another that is its last; edge: the text, once for each of these.
_RUNS = "id long, text_sha256 string, run_keep long, run_size long, part int, run int, edge string"


def normalised(text: Column) -> Column:
    """Column expression: the text that decides equality."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _ranged(rows: DataFrame, norm: str, place: str) -> DataFrame:
    """rows in ranges of the text in column norm, sorted within each, equal texts by the number in column place."""
    lead, whole = F.substring(norm, 1, LEAD).alias("__lead"), F.xxhash64(norm).alias("__whole")
    keyed = rows.select("*", lead, whole)
    return keyed.repartitionByRange("__lead", "__whole", place).sortWithinPartitions("__lead", "__whole", norm, place).drop("__lead", "__whole")


def _number(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID)))


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _same(text: pa.Array, last: str | None) -> np.ndarray:
    """Whether each text equals the one before it; last is the one before the first."""
    same = np.zeros(len(text), bool)
    same[1:] = pc.equal(text.slice(1), text.slice(0, len(text) - 1)).to_numpy(zero_copy_only=False)
    same[0] = last is not None and text[0].as_py() == last
    return same


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted range: each run of equal texts gets its smallest id and its length.

    Only the ids, digest and text of the run that is still open are held from one batch to the next.
    """
    part, last, open_ids, open_sha, first_run = _part(), None, [], None, True

    def out(ids: np.ndarray, sha, keep, size, run: pa.Array, edge: pa.Array) -> pa.RecordBatch:
        columns = [pa.array(ids, mask=ids == NO_ID), sha, pa.array(keep, pa.int64()), pa.array(size, pa.int64()), pa.array(np.full(len(ids), part, np.int32)), run, edge]
        return pa.RecordBatch.from_arrays(columns, ["id", "text_sha256", "run_keep", "run_size", "part", "run", "edge"])

    def closed(run: int | None) -> pa.RecordBatch:
        ids = np.concatenate(open_ids)
        n = len(ids)
        edge = pa.array([last if run is not None else None] + [None] * (n - 1), pa.string())
        return out(ids, pa.array([open_sha] * n, pa.string()), np.full(n, ids.min()), np.full(n, n), pa.array([run] * n, pa.int32()), edge)

    for batch in batches:
        if not batch.num_rows:
            continue
        text, ids, sha = batch.column("norm"), batch.column("id").to_numpy(), batch.column("text_sha256")
        heads = np.flatnonzero(~_same(text, last))
        upto = heads[0] if len(heads) else batch.num_rows
        if upto:
            open_ids.append(ids[:upto])
        if len(heads):
            if open_ids:
                yield closed(0 if first_run else None)
                first_run = False
            tail = heads[-1]
            if tail > heads[0]:
                size, n = np.diff(heads), int(tail - heads[0])
                inner = ids[heads[0] : tail]
                keep = np.repeat(np.minimum.reduceat(inner, heads[:-1] - heads[0]), size)
                run, edge = pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())
                if first_run:
                    head = int(size[0])
                    run = pa.array([0] * head + [None] * (n - head), pa.int32())
                    edge = pa.array([text[int(heads[0])].as_py()] + [None] * (n - 1), pa.string())
                    first_run = False
                yield out(inner, sha.slice(heads[0], n), keep, np.repeat(size, size), run, edge)
            open_ids, open_sha = [ids[tail:]], sha[int(tail)].as_py()
            last = text[int(tail)].as_py()
    if open_ids:
        yield closed(0 if first_run else 1)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id, keep_id, group_size, kept, text_sha256).

    kept marks the row whose id is keep_id, the smallest id of its group of equal texts.
    """
    norm = docs.select(_number(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    runs = settled_texts(_ranged(norm, "norm", "id").select("id", "norm", F.sha2("norm", 256).alias("text_sha256")).mapInArrow(_runs, _RUNS))
    # a first or last run may be a part of a group that goes on in the ranges beside it
    edges = runs.filter("edge is not null").select("part", "run", "edge", "run_keep", "run_size")
    meet = edges.groupBy("edge").agg(F.min("run_keep").alias("all_keep"), F.sum("run_size").alias("all_size"), F.count("*").alias("ranges")).filter("ranges > 1")
    back = edges.join(meet, "edge").select("part", "run", "all_keep", "all_size")
    inner = runs.filter("run is null").withColumns({"all_keep": F.lit(None).cast("long"), "all_size": F.lit(None).cast("long")})
    whole = inner.unionByName(runs.filter("run is not null").join(back, ["part", "run"], "left"))
    keep = F.nullif(F.coalesce("all_keep", "run_keep"), F.lit(int(NO_ID)))
    return whole.select("id", keep.alias("keep_id"), F.coalesce("all_size", "run_size").alias("group_size"), F.coalesce(F.col("id") == keep, F.lit(False)).alias("kept"), "text_sha256")


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run of one sorted range the first row, whole; head and tail mark those of the first and the last run."""
    part, last, held, at_head = _part(), None, None, True

    def out(rows: pa.RecordBatch, tail: bool) -> pa.RecordBatch:
        nonlocal at_head
        n = rows.num_rows
        head = np.zeros(n, bool)
        head[0], at_head = at_head, False
        marks = [pa.array(np.full(n, part, np.int32)), pa.array(head), pa.array(np.full(n, tail))]
        return pa.RecordBatch.from_arrays([rows.column("row"), *marks], ["row", "part", "head", "tail"])

    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("norm")
        heads = np.flatnonzero(~_same(text, last))
        if len(heads):
            if held is not None:
                yield out(held, False)
            firsts = batch.take(pa.array(heads))
            if len(heads) > 1:
                yield out(firsts.slice(0, len(heads) - 1), False)
            held, last = firsts.slice(len(heads) - 1), text[int(heads[-1])].as_py()
    if held is not None:
        yield out(held, True)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, the one with the smallest id; all columns stay.

    Rows are told by their place in the sort, not by their ids: of rows of one id and text one stays, rows of one id
    and different texts do not touch each other, and a row without an id stays only if no row of its group has one.
    """
    # a row goes in one column, so that no name of its columns meets one of these
    rows = docs.select(F.struct(*docs.columns).alias("row"), normalised(F.col(text_col)).alias("norm"), _number(id_col).alias("place"))
    schema = rows.limit(0).select("row", F.lit(0).alias("part"), F.lit(True).alias("head"), F.lit(True).alias("tail")).schema
    firsts = settled_texts(_ranged(rows, "norm", "place").drop("place").mapInArrow(_firsts, schema))
    # the first run of a range is dropped where its text has begun in an earlier one
    edges = firsts.filter("head or tail").select("part", "head", normalised(F.col("row").getField(text_col)).alias("edge"))
    began = edges.groupBy("edge").agg(F.min("part").alias("began"), F.max("part").alias("ended")).filter("began < ended")
    again = edges.filter("head").join(began, "edge").filter("part > began").select("part")
    heads = firsts.filter("head").join(again, "part", "left_anti")
    return firsts.filter("not head").unionByName(heads).select("row.*")
