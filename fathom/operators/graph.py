"""Connected components by contraction to stars, in a number of rounds that grows with the logarithm of their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.shared import Tables


def dealt_join(rows: DataFrame, one_each: DataFrame, key: str, salt: Column, total: int) -> DataFrame:
    """Inner join with a table of one row a key and the number ``n`` of rows that have it, of ``total`` in all.

    A key with over half of what a shuffle partition has on average is dealt over several places. There are at most twice as many such
keys as partitions, so that they may be broadcast; the table itself never is, as a small file may be large in memory.    """
    part = max(1, total // (2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    pieces = F.ceil(F.col("n") / F.lit(part)).cast("int")
    hot = F.broadcast(one_each.where(F.col("n") > part).select(key, pieces.alias("pieces")))
    left = rows.join(hot, key, "left").withColumn("place", F.pmod(salt, F.coalesce("pieces", F.lit(1))).cast("int")).drop("pieces")
    right = one_each.withColumn("place", F.explode(F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1))).drop("n")
    return left.join(right.hint("merge"), [key, "place"]).drop("place")


def _to_least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Links (u, v) from v to the smallest that u knows."""
    return dealt_join(rows, least, "u", F.xxhash64("v"), total).select(F.col("v").alias("u"), F.col("least").alias("v"))


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) of every node that has a link (u, v) to another: the smallest node of its component.

    Two steps take turns until nothing changes. In the large one every node links its larger neighbours to its smallest one, in the small one its
    smaller neighbours and itself to the smallest of them.
    """
    measure = F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    with Tables(links.sparkSession) as tables:
        now = tables.written(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        before = now.agg(*measure).first()
        for _ in range(most_rounds if before[0] else 0):
            ways = now.union(now.select("v", "u"))
            least = ways.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("least"), "n")
            large = tables.written(_to_least(ways.where("v > u"), least, 2 * before[0]).where("u != v").distinct(), "large-star")
            down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            least = down.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("n"))
            small = _to_least(down, least, before[0]).union(least.select("u", F.col("least").alias("v")))
            now = tables.written(small.where("u != v").distinct(), "small-star")
            after = now.agg(*measure).first()
            if after == before:
                break
            before = after
        else:
            if before[0]:
                raise RuntimeError("the components did not settle")
        rooted = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        return tables.kept(rooted.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components")
