"""Connected components of a link table, by iterated minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import settled
from .skew import parted

#: Members of one label are dealt in so many parts when they look up the label of their label.
SPREAD = 32


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in links: component is the smallest id reachable.

    Each round takes the smallest label of all neighbours, aggregated before the shuffle, and then the
    label of that label, so chains halve; labels are written out after each round. Where no neighbour has a lower label, all labels
    of a component are the same and the rounds end. The links of an id with many, counted once, are dealt in parts, to each of which
    its label goes; so are the members of a label.
    """
    ways = F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y")), F.struct(F.col(b).alias("x"), F.col(a).alias("y")))
    both = settled(links.filter(F.col(a) != F.col(b)).select(F.inline(ways)).distinct())
    both = parted(both, ["y"], "x", "part")
    first = both.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("m"))
    parts = both.groupBy(F.col("y").alias("id")).agg(F.max("parts").alias("parts"))
    labels = settled(first.join(parts, "id").select("id", F.least("id", "m").alias("c"), "parts"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    while True:
        told = labels.select(F.col("id").alias("y"), "c", every(F.col("parts")).alias("part"))
        near = both.select("x", "y", "part").join(told, ["y", "part"]).groupBy(F.col("x").alias("id")).agg(F.min("c").alias("near"))
        lower = settled(labels.join(near, "id").select("id", "parts", F.col("c").alias("was"), F.least("c", "near").alias("c")))
        if lower.filter("c <> was").isEmpty():
            return lower.select("id", F.col("c").alias("component"))
        used = lower.select(F.col("c").alias("id")).distinct()
        tops = lower.join(used, "id").select(F.col("id").alias("c"), F.col("c").alias("top"), every(F.lit(SPREAD)).alias("deal"))
        dealt = lower.withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int"))
        labels = settled(dealt.join(tops, ["c", "deal"]).select("id", F.least("c", "top").alias("c"), "parts"))
