"""Self-join of texts by the Jaccard similarity of their word n-grams, exact, by T-occurrence search with DivideSkip.

An inverted list holds the texts of an n-gram. Two sets of n and m n-grams are similar enough if they have
T = percent * (n + m) / (100 + percent) in common, so a partner of a set occurs in T of its lists at least.

1. Texts with the same set are one unit. The same pass finds the n-grams that are so frequent that their lists would burden
   a task: each task reports what has a part in ``SHARE`` of a chunk of its n-grams, and the sums decide. There are
   fewer than SHARE of them, whatever the table, and they count as most frequent.
2. The other n-grams are packed by ranges of their hash; a task sorts one range at a time and has its lists whole. Only n-grams of
   two units or more go back, with the length of their list. A unit with fewer than percent of its n-grams in such lists has
   no partner, and is done.
3. What remains is ordered by the length of the lists, and the n - T + 1 shortest are kept of each set, those of one unit
   alone counted first: partners meet in one of them. In each list all units go with the smallest one there, not in pairs;
   links so found make components.
4. Then only units outside a list's largest component look for partners, and only in other components: a component
   in a list is one row, however many units of it are there, and lists of the same components are one.
5. Every search is of sets in a group (partners of one unit, or a part of one component), brought together by a shuffle. The task
   builds the inverted lists of the group, and a query divides its lists: the L longest are left, the short ones are
   merged by a heap, which skips by bisection what cannot occur T - L times, and the long ones are probed by bisection for what
   is left (L as the published rule of DivideSkip has it). What reaches T is linked.

No pair of a group is listed, nothing is capped, and no link between components is lost; links within a component change no
result. What many rows would meet in is dealt in parts, by counts (skew.py). Texts are read three times; what is shuffled of them
are hashes.

Cases: a null text or one without words has no set and is linked with nothing. A text with fewer words than n has its whole sequence
as its one n-gram. Rows of one id are rows of their own, and so are those without an id, whose component_id is that of
the smallest id of the component, or null if there is none. Other columns, whatever their names, are not read. An empty table gives an
empty result. A set is held whole by the task that handles it.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .runtime import partitions, settled, settled_texts
from .skew import FEW, dealt, parted
from .words import SPACED, hashes, mix, shingles, slices, split

SHINGLE = 5
PERCENT = 80
CHUNK = 1 << 19  # n-grams packed at once
RANGE = 1 << 20  # n-grams of a range of hashes
SHARE = 1 << 18
COMMON = 1024  # shorter lists are never called frequent
GROUP = 1 << 18  # n-grams of a group in one task
MU = 0.01
MOST = np.iinfo(np.int64).max


def _sets(part: pa.RecordBatch, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    low, starts, ends, per = split(part.column("text"), SPACED)
    return shingles(hashes(low, starts, ends), per, shingle)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


_SIGNED = "row struct<id:long,text_hash:long>, n long, s1 long, s2 long, s long, k long"


def _digests(shingle: int, share: int):
    """For each text the size and two sums of its set; besides rows (s, k) of n-grams frequent in a chunk."""
    names = [x.split()[0] for x in _SIGNED.split(", ")]

    def report(held: list[np.ndarray], like: pa.DataType) -> pa.RecordBatch:
        s, k = np.unique(np.concatenate(held), return_counts=True)
        few = k >= max(16, k.sum() // share)
        none = [pa.nulls(int(few.sum()), t) for t in (like, pa.int64(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([*none, _long(s[few]), pa.array(k[few])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, like = [], 0, None
        for batch in batches:
            like = batch.schema.field("row").type
            for part in slices(batch, "text", 1 << 20):
                flat, counts = _sets(part, shingle)
                some = np.flatnonzero(counts)
                at = np.concatenate(([0], np.cumsum(counts)))[:-1][some]
                digest = np.zeros((2, len(counts)), np.uint64)
                if len(some):
                    digest[0, some] = np.add.reduceat(mix(flat), at)
                    digest[1, some] = np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                none = pa.nulls(len(counts), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(counts), _long(digest[0]), _long(digest[1]), none, none], names)
                held.append(flat)
                size += len(flat)
                if size >= CHUNK:
                    yield report(held, like)
                    held, size = [], 0
        if size:
            yield report(held, like)

    return run


def _packed(shingle: int, common: np.ndarray, ranges: int):
    """Rows (range, common, s, unit): the n-grams of a chunk of texts that are in one range; frequent ones apart, dealt by unit."""

    def pack(s: np.ndarray, unit: np.ndarray) -> Iterator[pa.RecordBatch]:
        known = np.isin(s, common)
        for mark, rows in ((False, np.flatnonzero(~known)), (True, np.flatnonzero(known))):
            if len(rows):
                place = mix(unit[rows].view(np.uint64)) if mark else s[rows]
                place = ((place >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                order = np.argsort(place, kind="stable")  # a unit's n-grams stay together
                rows, place = rows[order], place[order]
                first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
                offs = pa.array(np.append(first, len(rows)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offs, _long(x[rows])) for x in (s, unit)]
                yield pa.RecordBatch.from_arrays([pa.array(place[first].astype(np.int32)), pa.array(np.full(len(first), mark)), *lists], ["range", "common", "s", "unit"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                flat, counts = _sets(part, shingle)
                held.append((flat, np.repeat(part.column("unit").to_numpy(), counts)))
                size += len(flat)
                if size >= CHUNK:
                    yield from pack(*(np.concatenate(x) for x in zip(*held)))
                    held, size = [], 0
        if size:
            yield from pack(*(np.concatenate(x) for x in zip(*held)))

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, s, df) of all n-grams of two rows or more, from packed rows in the order of their range."""

    def out(unit: np.ndarray, s: np.ndarray, df: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(s), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(unit[k : k + (1 << 16)]), pa.array(s[k : k + (1 << 16)]), pa.array(df[k : k + (1 << 16)])], ["unit", "s", "df"])

    def whole(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        s, unit = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(s, kind="stable")
        s, unit = s[order], unit[order]
        edge = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
        df = np.repeat(np.diff(edge), np.diff(edge))
        many = df > 1
        yield from out(unit[many], s[many], df[many])

    now, held = None, []
    for batch in batches:
        for k in range(batch.num_rows):
            at, common = batch.column("range")[k].as_py(), batch.column("common")[k].as_py()
            s, unit = (batch.column(c)[k].values.to_numpy() for c in ("s", "unit"))
            if common:
                yield from out(unit, s, np.full(len(s), MOST))
                continue
            if at != now and held:
                yield from whole(held)
                held = []
            now = at
            held.append((s, unit))
    if held:
        yield from whole(held)


def _unit_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                flat, counts = _sets(part, shingle)
                offs = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("unit"), pa.ListArray.from_arrays(offs, _long(flat))], ["unit", "set"])

    return run


def merge_skip(lists: list[list[int]], need: int) -> Iterator[tuple[int, int]]:
    """(x, in how many lists) of what is in ``need`` of the ascending lists at least."""
    place = [0] * len(lists)
    heap = [(x[0], k) for k, x in enumerate(lists) if x]
    heapify(heap)
    while len(heap) >= need:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heappop(heap)[1])
        if len(popped) >= need:
            yield top, len(popped)
            for k in popped:
                place[k] += 1
        else:
            while heap and len(popped) < need - 1:
                popped.append(heappop(heap)[1])
            if not heap:
                return  # fewer than need lists are left
            for k in popped:
                place[k] = bisect_left(lists[k], heap[0][0], place[k])
        for k in popped:
            if place[k] < len(lists[k]):
                heappush(heap, (lists[k][place[k]], k))


class Lists:
    """Inverted lists of some sets (sorted, distinct)."""

    def __init__(self, sets: list[np.ndarray], percent: int, mu: float = MU) -> None:
        self.sizes = np.array([len(x) for x in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.keys, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        self.percent, self.mu = percent, mu

    def search(self, query: np.ndarray, one: bool) -> Iterator[int]:
        """The sets that are similar to the query; the first found if only one is asked for."""
        p, n = self.percent, len(query)
        fits = 100 * np.minimum(self.sizes, n) >= p * np.maximum(self.sizes, n)
        if not fits.any():
            return
        least = -(-p * (n + self.sizes) // (100 + p))
        need = int(least[fits].min())
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        at = at[self.keys[at] == query]
        if len(at) < need:
            return
        length = self.first[at + 1] - self.first[at]
        at = at[np.argsort(length, kind="stable")]
        long = min(need - 1, int(need / (self.mu * math.log2(max(int(length.max()), 2)) + 1)))
        held = [self.owners[self.first[k] : self.first[k + 1]] for k in at]
        short, probed = [x.tolist() for x in held[: len(held) - long]], held[len(held) - long :]
        for x, count in merge_skip(short, need - long):
            for k, owners in enumerate(probed):
                if count + len(probed) - k < least[x]:
                    break
                place = owners.searchsorted(x)
                count += bool(place < len(owners) and owners[place] == x)
            if fits[x] and count >= least[x]:
                yield x
                if one:
                    return


def _searched(percent: int, one: bool):
    """(a, b): names of query and match, of rows (grp, query, name, set) in the order of group, what is searched before the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, sets, lists = None, [], [], None
        for batch in batches:
            a, b = [], []
            for k in range(batch.num_rows):
                grp, query, name = (batch.column(c)[k].as_py() for c in ("grp", "query", "name"))
                row = batch.column("set")[k].values.to_numpy()
                if grp != now:
                    now, names, sets, lists = grp, [], [], None
                if not query:
                    names.append(name)
                    sets.append(row.view(np.uint64).copy())
                elif names:
                    lists = Lists(sets, percent) if lists is None else lists
                    for x in lists.search(row.view(np.uint64), one):
                        a.append(name)
                        b.append(names[x])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def found(members: DataFrame, queries: DataFrame, sets: DataFrame, percent: int, one: bool) -> DataFrame:
    """Links (a, b), a table, of the names of queries (grp, unit, name) with those of members (grp, unit, name) of the same group."""
    rows = members.select("grp", "unit", "name", F.lit(False).alias("query")).union(queries.select("grp", "unit", "name", F.lit(True).alias("query"))).join(sets, "unit")
    rows = rows.select("grp", "query", "name", "set").repartition(partitions(sets.sparkSession), "grp").sortWithinPartitions("grp", "query")
    return settled_texts(rows.mapInArrow(_searched(percent, one), "a long, b long"))


def _few(df: DataFrame) -> DataFrame:
    """df, a table, sent to all tasks if it is counted to be small."""
    return F.broadcast(df) if df.count() <= FEW else df


def _stars(prefix: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of units with the smallest unit of a list that both are in."""
    hubs = prefix.groupBy("s").agg(F.min(F.struct("unit", "n")).alias("hub"), F.count("*").alias("k")).filter("k > 1")
    stars = dealt(prefix, hubs.select("s", F.col("hub.unit").alias("hub"), F.col("hub.n").alias("hub_n")), ["s"])
    fits = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    stars = settled(stars.filter((F.col("unit") != F.col("hub")) & fits).select("hub", "unit", "n").distinct())
    stars = parted(stars, ["hub"], "unit", "part", "n", GROUP).withColumn("grp", F.concat_ws(":", "hub", "part"))
    hub = F.col("hub")
    return found(stars.withColumn("name", F.col("unit")), stars.select("grp", hub.alias("unit"), hub.alias("name")).distinct(), sets, percent, False)


def _across(prefix: DataFrame, near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of components of near: for each unit and each part of another component that share a list, one if there is any."""
    own = prefix.select("unit", "n").distinct().join(near.withColumnRenamed("id", "unit"), "unit", "left").withColumn("component", F.coalesce("component", "unit"))
    own = parted(settled(own), ["component"], "unit", "part", "n", GROUP)
    # sets that can match differ by this factor at most, so they are of one step of sizes or of neighbouring ones
    step = F.floor(F.log("n") / (math.log(100 / min(percent, 99)) * 1.0001))
    rows = settled(prefix.join(own.drop("n"), "unit").withColumn("step", step))
    rows = rows.withColumn("group", F.concat_ws(":", "component", "part"))
    per = rows.groupBy("s", "component").agg(F.count("*").alias("k"))
    tops = per.groupBy("s").agg(F.max(F.struct("k", "component")).alias("top"), F.count("*").alias("kinds")).filter("kinds > 1")
    # lists with the same groups are of one class, which is searched once
    marks = [F.bit_xor(F.xxhash64("step", "group", F.lit(k))) for k in (1, 2)]
    held = rows.select("s", "step", "group").distinct().groupBy("s").agg(F.xxhash64(*marks, F.count("*")).alias("held"))
    lists = tops.join(held, "s").select("s", F.col("top.component").alias("main"), F.xxhash64("top.component", "held").alias("class"))
    rows = settled(dealt(rows, settled(lists), ["s"]).select("unit", "step", "component", "group", "main", "class"))
    classes = settled(rows.select("class", "step", "group", "component", "main").distinct())
    classes = parted(classes, ["class"], "group", "deal")
    ask = settled(rows.filter("component <> main").select("class", "unit", "step", F.col("component").alias("own")).distinct())
    ask = dealt(ask, classes.groupBy("class").agg(F.max("deals").alias("deals")), ["class"])
    ask = ask.withColumn("step", F.explode(F.array(*[F.col("step") + k for k in (-1, 0, 1)]))).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")
    routes = ask.join(classes.drop("deals"), ["class", "step", "deal"]).filter((F.col("own") != F.col("component")) & ((F.col("component") == F.col("main")) | (F.col("own") < F.col("component"))))
    routes = settled(routes.select("unit", "group").distinct().join(own.select("unit", "n", F.col("component").alias("name")), "unit"))
    routes = parted(routes, ["group"], "unit", "turn", "n", GROUP)
    # a group with many queries is searched in several tasks, each with its lists
    asked = routes.groupBy("group").agg(F.max("turns").alias("turns"))
    members = own.select("unit", F.col("component").alias("name"), F.concat_ws(":", "component", "part").alias("group")).join(asked, "group")
    members = members.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    grp = F.concat_ws(":", "group", "turn").alias("grp")
    return found(members.select(grp, "unit", "name"), routes.select(grp, "unit", "name"), sets, percent, True)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, share: int = SHARE, common: int = COMMON) -> DataFrame:
    """One row per row of docs: (id, n_shingles, component_id); component_id is the smallest id reachable by links."""
    spark = docs.sparkSession
    cols = docs.select(F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash")).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    every = settled_texts(cols.mapInArrow(_digests(shingle, share), _SIGNED))
    signed = every.filter("n is not null").select("row", "n", "s1", "s2")
    total = signed.agg(F.sum("n")).first()[0] or 0
    # fewer than share of them, as each has a part in share of all
    frequent = every.filter("k is not null").groupBy("s").agg(F.sum("k").alias("k")).filter(F.col("k") >= max(common, total // share))
    frequent = np.sort(np.array([r["s"] for r in frequent.select("s").collect()], np.int64).view(np.uint64))
    # a unit goes by the smallest id of its rows, by a hash where other rows may have that id
    clash = signed.groupBy("row.id").agg(F.count("*").alias("k")).filter("k > 1 or id is null").select(F.col("id").alias("clash"))
    units = signed.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("row").alias("of"), F.min("row.id").alias("least"))
    units = units.join(clash, units["of.id"].eqNullSafe(clash["clash"]), "left")
    units = settled(units.withColumn("unit", F.when(F.col("clash").isNull() & F.col("of.id").isNotNull(), F.col("of.id")).otherwise(F.xxhash64("s1", "s2", "n", F.lit(1)))).drop("clash"))
    # rows to leave out as copies (name null), and those with another name than their id
    whole = settled(dealt(signed.filter("n > 0"), units, ["s1", "s2", "n"]))
    name = F.when(F.col("row") == F.col("of"), F.col("unit"))
    special = settled(whole.select(F.coalesce("row.id", F.lit(MOST)).alias("row_id"), F.col("row.text_hash").alias("row_hash"), F.col("row.id").alias("id"), name.alias("name"), F.lit(True).alias("odd")).filter("name is null or not (name <=> id)").drop("id").distinct())
    keyed = cols.select(F.coalesce("row.id", F.lit(MOST)).alias("row_id"), F.col("row.text_hash").alias("row_hash"), "text")
    keyed = keyed.join(_few(special), ["row_id", "row_hash"], "left").filter("odd is null or name is not null").select(F.coalesce("name", "row_id").alias("unit"), "text")
    ranges = max(partitions(spark), math.ceil(total / RANGE))
    packed = keyed.mapInArrow(_packed(shingle, frequent, ranges), "range int, common boolean, s array<long>, unit array<long>")
    packed = packed.repartition(partitions(spark), "range").sortWithinPartitions("range")
    met = packed.mapInArrow(_lists, "unit long, s long, df long").groupBy("unit").agg(F.array_sort(F.collect_set(F.struct("df", "s"))).alias("held"))
    met = met.join(units.select("unit", "n"), "unit").filter(100 * F.size("held") >= percent * F.col("n"))
    kept = F.expr(f"cast(size(held) - ceil({percent} * n / 100) + 1 as int)")
    prefix = settled_texts(met.select("unit", "n", F.explode(F.slice("held", F.lit(1), kept)).alias("x")).select("unit", "n", "x.s"))
    wanted = _few(settled(prefix.select("unit").distinct()))
    sets = settled_texts(keyed.join(wanted, "unit", "left_semi").mapInArrow(_unit_sets(shingle), "unit long, set array<long>")).dropDuplicates(["unit"])
    near = components(_stars(prefix, sets, percent))
    more = _across(prefix, near, sets, percent)
    tops = settled(units.select("unit", "least").join(near.withColumnRenamed("id", "unit"), "unit", "left").select("unit", "least", F.coalesce("component", "unit").alias("node")))
    ids = tops.groupBy("node").agg(F.min("least").alias("component_id"))
    if not more.isEmpty():
        joined = components(more).withColumnRenamed("id", "node")
        ids = settled(ids.join(joined, "node", "left").select("node", F.col("component_id").alias("least"), F.coalesce("component", "node").alias("top")))
        ids = dealt(ids.select("node", "top"), ids.groupBy("top").agg(F.min("least").alias("component_id")), ["top"]).select("node", "component_id")
    named = dealt(tops.drop("least"), ids, ["node"]).select("unit", "component_id")
    out = dealt(whole.select("row", "n", "unit"), named, ["unit"]).select("row", "n", "component_id")
    out = out.union(signed.filter("n = 0").select("row", "n", F.col("row.id").alias("component_id")))
    return out.select("row.id", F.col("n").alias("n_shingles"), "component_id")
