"""Near duplicates by MinHash with tensored banding, confirmed on the full shingle sets.

Two small collections of M band hashes (ROWS minhashes each) are made for every text; the table keys are
all M x M pairs of one from each collection. That is M x M tables of 2 x ROWS minhashes, for the work of
only 2 x M x ROWS of them. M follows from the threshold and the wanted chance of a miss.

1. Texts with the same shingle set are one unit from the start, so copies never meet in a table.
2. Bands that one unit alone has are left out, as no table key with such a band is shared; the keys are made of the
   others. Within each table key every unit is paired with the smallest id there (a star, not all pairs); the
   pairs are confirmed on full sets, and links make components.
3. Units whose star crosses components may still be linked to others. For all of them an exact prefix join
   follows: shingles are ordered by rarity, the necessary prefix of each set is indexed, and only units of
   different components meet, within length and positional bounds. In each list only units outside the
   list's largest component look for partners. What remains is confirmed on full sets.

So of units that share a table key no link between components is lost, and nothing is capped; links within a
component change no result and are not listed. Work in Python is per row; Spark does every shuffle. What many rows
would meet in is dealt in parts of about PART rows: the set of a hub goes with parts of its star, and a list of a
shingle is parted by size of set (only neighbouring sizes can match) and by unit.

Cases: a null text or one without words has no set and is linked with nothing. A text with fewer words than a
shingle has its whole sequence as one shingle. Rows of one id are rows of their own: those of one text are one unit
(``deduplicate`` leaves one row of them), those of different texts are linked only if their texts are. A row without
an id is kept by ``deduplicate`` if no row of its component has one; its component_id is null then. Other columns,
whatever their names, are carried by ``deduplicate``. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .runtime import settled, settled_texts
from .words import SPACED, hashes, mix, shingles, slices, split

SHINGLE = 5
PERCENT = 80
ROWS = 2
MISS = 2e-4
PART = 256
FEW = 500_000  # rows of two numbers: 8 MB
NO_ID = np.iinfo(np.int64).max


def bands(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands of each collection, so that a pair at the threshold shares no key with a chance of ``miss`` at most."""
    return max(1, math.ceil(math.log(miss / 2) / math.log(1 - min(0.999, percent / 100) ** rows)))


def _sets(part: pa.RecordBatch, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    low, starts, ends, per = split(part.column("text"), SPACED)
    return shingles(hashes(low, starts, ends), per, shingle)


def _signatures(shingle: int, m: int, rows: int):
    rng = np.random.Generator(np.random.PCG64(7))
    flips = rng.integers(0, 2**64, 2 * m * rows, dtype=np.uint64)
    spreads = rng.integers(0, 2**64, 2 * m * rows, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                flat, counts = _sets(part, shingle)
                some = np.flatnonzero(counts)
                at = np.concatenate(([0], np.cumsum(counts)))[:-1][some]
                coll = np.zeros((2 * m, len(some)), np.uint64)
                digest = np.zeros((2, len(counts)), np.uint64)
                if len(some):
                    digest[0, some] = np.add.reduceat(mix(flat), at)
                    digest[1, some] = np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                    for band in range(2 * m):
                        for k in range(band * rows, (band + 1) * rows):
                            least = np.minimum.reduceat((flat ^ flips[k]) * spreads[k], at)
                            coll[band] = mix(coll[band] * np.uint64(31) + least)
                width = np.zeros(len(counts), np.int64)
                width[some] = m
                offs = pa.array(np.concatenate(([0], np.cumsum(width))).astype(np.int32))
                sides = [pa.ListArray.from_arrays(offs, pa.array(np.ascontiguousarray(x.T).reshape(-1).view(np.int64))) for x in (coll[:m], coll[m:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(counts), *(pa.array(x.view(np.int64)) for x in digest), *sides], ["id", "n", "s1", "s2", "left", "right"]
                )

    return run


def _shingle_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                flat, counts = _sets(part, shingle)
                offs = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts), pa.ListArray.from_arrays(offs, pa.array(flat.view(np.int64)))], ["id", "n", "set"])

    return run


def shared_bands(units: DataFrame, m: int) -> DataFrame:
    """(id, left, right), a table, of units (id, left, right): lists of (i, x), the bands that another unit has too.

    Units share a table key only if they share both of its bands, so bands of one unit alone are left out before
    the m x m keys are made.
    """
    each = units.select("id", F.posexplode(F.concat("left", "right")).alias("i", "x"))
    met = each.groupBy("x").agg(F.count("*").alias("k")).filter("k > 1").select("x")
    # 2 x m bands of a unit at most
    side = lambda on: F.collect_list(F.when(on, F.struct("i", "x")))
    lists = each.join(met, "x").groupBy("id").agg(side(F.col("i") < m).alias("left"), side(F.col("i") >= m).alias("right"))
    return settled(lists.filter((F.size("left") > 0) & (F.size("right") > 0)))


def _parts(n) -> F.Column:
    """Into how many parts n rows are dealt; one where n is null."""
    return F.coalesce(F.ceil(n / PART), F.lit(1)).cast("int")


def _often(pairs: DataFrame, side: str) -> DataFrame:
    """(side, often) of the units that stand on one side of more than PART pairs; sent to all tasks if they are counted to be few."""
    often = settled(pairs.groupBy(side).agg(F.count("*").alias("often")).filter(F.col("often") > PART))
    return F.broadcast(often) if often.count() <= FEW else often


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a table, whose full sets have a similarity of percent or more.

    The set of a unit of many pairs goes once to each part of them.
    """
    both = pairs
    for side, other in ("ab", "ba"):
        often = _often(pairs, side)
        both = both.join(often, side, "left").withColumn(f"{side}part", F.pmod(F.xxhash64(other), _parts(F.col("often")))).drop("often")
        held = sets.select(F.col("id").alias(side), F.col("n").alias(f"{side}n"), F.col("set").alias(f"{side}set")).join(often, side, "left")
        held = held.withColumn(f"{side}part", F.explode(F.sequence(F.lit(0), _parts(F.col("often")) - 1))).drop("often")
        both = both.join(held, [side, f"{side}part"])
    both = both.filter(100 * F.least("an", "bn") >= percent * F.greatest("an", "bn"))
    common = F.size(F.array_intersect("aset", "bset"))
    return both.filter((100 + percent) * common >= percent * (F.col("an") + F.col("bn"))).select("a", "b")


def across(units: DataFrame, percent: int) -> DataFrame:
    """Exact candidates (a, b) between different components of units (id, n, set, component)."""
    each = units.select("id", "n", "component", F.explode("set").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    # a shingle of one unit alone comes first in the order and joins nothing: it is counted, not listed
    shared = each.join(often, "s")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "s"))
    alone = F.col("n") - F.count("*").over(Window.partitionBy("id"))
    placed = shared.select("id", "n", "component", "s", (rank - 1 + alone).alias("pos"))
    prefix = settled(placed.filter(100 * (F.col("n") - F.col("pos")) >= percent * F.col("n")))
    per = prefix.groupBy("s", "component").agg(F.count("*").alias("k"))
    lists = per.groupBy("s").agg(F.max(F.struct("k", "component")).alias("top"), F.count("*").alias("kinds"), F.sum("k").alias("rows")).filter("kinds > 1")
    lists = settled(lists.select("s", F.col("top.component").alias("main"), _parts(F.col("rows")).alias("parts")))
    # sets that can match differ by this factor at most, so they are of one step of sizes or of neighbouring ones
    step = F.floor(F.log("n") / (math.log(100 / min(percent, 99)) * 1.0001))
    rows = prefix.join(lists, "s").withColumn("step", step)
    one = rows.filter("component <> main").select("s", "main", F.explode(F.array(*[F.col("step") + k for k in (-1, 0, 1)])).alias("step"), "parts", *(F.col(c).alias(f"a_{c}") for c in ("id", "n", "component", "pos")))
    one = one.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    two = rows.select("s", "step", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), *(F.col(c).alias(f"b_{c}") for c in ("id", "n", "component", "pos")))
    room = (100 + percent) * F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    meet = one.join(two, ["s", "step", "part"]).filter(
        (F.col("a_component") != F.col("b_component")) & (room >= percent * (F.col("a_n") + F.col("b_n"))) & ((F.col("b_component") == F.col("main")) | (F.col("a_id") < F.col("b_id")))
    )
    return meet.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()


def _decided(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, rows: int, miss: float) -> DataFrame:
    """(id, text_hash, n, node, component_id) of every row of docs, in the shared folder; node is one of each component, null without a set."""
    m = bands(percent, rows, miss)
    cols = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    packed = cols.select(F.struct("id", "text_hash").alias("id"), "text")
    signed = settled_texts(packed.mapInArrow(_signatures(shingle, m, rows), "id struct<id:long,text_hash:long>, n long, s1 long, s2 long, left array<long>, right array<long>"))
    signed = signed.select("id.id", "id.text_hash", "n", "s1", "s2", "left", "right")
    # a unit goes by the smallest id of its rows; by a hash where other texts may have that id
    clash = signed.groupBy("id").agg(F.count("*").alias("k")).filter("k > 1 or id is null").select(F.col("id").alias("clash"))
    units = signed.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("id").alias("least"), F.first("left").alias("left"), F.first("right").alias("right"))
    named = units.join(clash, units["least"].eqNullSafe(clash["clash"]), "left").withColumn("own", F.col("clash").isNull() & F.col("least").isNotNull())
    units = settled(named.select("s1", "s2", "n", "least", "left", "right", F.when(F.col("own"), F.col("least")).otherwise(F.xxhash64("s1", "s2", "n", F.lit(1))).alias("id")))
    shared = shared_bands(units, m)
    keys = shared.select("id", "right", F.explode("left").alias("l")).select("id", "l", F.explode("right").alias("r")).select("id", F.xxhash64("l.x", "r.x", "l.i", "r.i").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("k")).filter("k > 1").select("key", "hub")
    stars = settled(keys.join(hubs, "key").filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    # one text of each unit that is in a star gives its set
    wanted = stars.select(F.col("a").alias("id")).union(stars.select("b")).distinct()
    texts = units.join(wanted, "id", "left_semi").select("s1", "s2", "n", F.col("id").alias("unit"))
    texts = signed.join(texts, ["s1", "s2", "n"]).groupBy("unit").agg(F.min(F.struct("id", "text_hash")).alias("of")).select("unit", "of.id", "of.text_hash")
    chosen = cols.join(texts.select(F.coalesce("id", F.lit(int(NO_ID))).alias("__id"), F.col("text_hash").alias("__hash"), "unit"), (F.coalesce(cols["id"], F.lit(int(NO_ID))) == F.col("__id")) & (cols["text_hash"] == F.col("__hash")))
    sets = settled_texts(chosen.select(F.col("unit").alias("id"), "text").mapInArrow(_shingle_sets(shingle), "id long, n long, set array<long>"))
    near = components(confirmed(stars, sets, percent))
    # stars that cross components: all units under such a hub go on to the exact join
    part = lambda df, on, name: df.join(near.select(F.col("id").alias(on), F.col("component").alias(name)), on, "left").withColumn(name, F.coalesce(name, on))
    open_hubs = part(part(stars, "a", "ca"), "b", "cb").filter("ca <> cb").select("a").distinct()
    open_ids = stars.join(open_hubs, "a", "left_semi").select(F.col("b").alias("id")).union(open_hubs).distinct()
    rest = part(sets.join(open_ids, "id", "left_semi").dropDuplicates(["id"]), "id", "component")  # repeated rows give a set twice
    more = confirmed(settled(across(rest, percent)), sets, percent)
    final = components(near.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    tops = units.select("s1", "s2", "n", "least", F.col("id").alias("unit")).join(final.withColumnRenamed("id", "unit"), "unit", "left")
    tops = tops.select("s1", "s2", "n", "least", F.coalesce("component", "unit").alias("node"))
    ids = tops.groupBy("node").agg(F.min("least").alias("component_id"))
    tops = tops.drop("least").join(ids, "node")
    whole = signed.select("id", "text_hash", "n", "s1", "s2").join(tops, ["s1", "s2", "n"], "left")
    return settled(whole.select("id", "text_hash", "n", "node", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """One row per row of docs: (id, n_shingles, component_id, kept); component_id is the smallest id reachable by links."""
    found = _decided(docs, id_col, text_col, shingle, percent, rows, miss)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
    return found.select("id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """docs with one row of each group of near duplicates, the one with the smallest id; all columns stay.

    Rows are told by id and text, so that rows of one id and other texts are not touched; of repeated rows one stays, but
    rows without a set, which are linked with nothing, all stay.
    Only the rows that go, and those that repeat, are joined with docs.
    """
    found = _decided(docs, id_col, text_col, shingle, percent, rows, miss).filter("n > 0").select(F.coalesce("id", F.lit(int(NO_ID))).alias("__id"), F.col("text_hash").alias("__hash"), "node")
    first = found.groupBy("node").agg(F.min(F.struct("__id", "__hash")).alias("first"))
    each = found.groupBy("__id", "__hash", "node").agg(F.count("*").alias("k")).join(first, "node").withColumn("stays", F.struct("__id", "__hash") == F.col("first"))
    marked = settled(each.filter("not stays or k > 1").select("__id", "__hash", "stays"))
    # counted first: where they are few the texts need no shuffle
    lost, twice = marked.select("__id", "__hash"), marked.filter("stays").select("__id", "__hash")
    lost = F.broadcast(lost) if marked.count() <= FEW else lost
    # a row goes in one column, so that no name of its columns meets one of these
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("__id"), F.xxhash64(text_col).alias("__hash"))
    out = keyed.join(lost, ["__id", "__hash"], "left_anti").select("row.*")
    if twice.isEmpty():
        return out
    rank = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy("__id"))
    again = keyed.join(twice, ["__id", "__hash"], "left_semi").withColumn("__rank", rank).filter("__rank = 1")
    return out.unionByName(again.select("row.*"))
