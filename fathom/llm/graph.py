"""Joins that deal hot keys out, and connected components without any component in one task or the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def spread_join(rows: DataFrame, one_each: DataFrame, key: str, salt: Column, how: str = "inner", total: int | None = None) -> DataFrame:
    """Join with a table that has one row per key and the number ``n`` of rows that have it.

    A key with more than its part of all rows is dealt over as many places as it has parts; a part is a
    half of what a shuffle partition has on average. Hot keys are twice the shuffle partitions at most, so they
    are broadcast. ``salt`` tells the rows of a key apart. The result has no column n.
    """
    if total is None:
        total = one_each.agg(F.sum("n")).first()[0] or 0
    part = max(1, total // (2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    pieces = F.ceil(F.col("n") / F.lit(part)).cast("int")
    hot = one_each.where(F.col("n") > part).select(key, pieces.alias("__pieces"))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("__salt", F.pmod(salt, F.coalesce("__pieces", F.lit(1))).cast("int")).drop("__pieces")
    right = one_each.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1))).drop("n")
    return left.join(right, [key, "__salt"], how).drop("__salt")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _stars(rows: DataFrame, smallest: DataFrame, total: int) -> DataFrame:
    """(v, m) for the rows (u, v), m being u's smallest neighbour or itself."""
    joined = spread_join(rows, smallest, "u", F.xxhash64("v"), total=total)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node that has a link: rows (u, v) to rows (node, root).

    Large-star and small-star steps alternate until nothing changes: each keeps the components, and the
    links of a node move to its smallest neighbour. Every step is a minimum by key, combined map-side,
    and a join that deals out nodes of many links; every round is cut off with a written table, whose
    shuffle files go at once.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "links")
    state = F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = now.agg(*state).first()
    for _ in range(most_rounds):
        if not before[0]:
            break
        ways = _both_ways(now)
        smallest = ways.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _stars(ways.where("v > u"), smallest, 2 * before[0]).where("u != v").distinct()
        large = written(large, "large-star")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        smallest = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _stars(down, smallest, before[0]).union(smallest.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        now = written(small, "small-star")
        after = now.agg(*state).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
