"""Aggregations, de-duplication, set operations and top-k over soundings, classes and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def coordinate_median(soundings: DataFrame, digits: int = 7) -> DataFrame:
    """Median depth and count at every rounded coordinate."""
    return soundings.groupBy(F.bround("lon", digits).alias("lon"), F.bround("lat", digits).alias("lat")).agg(F.bround(F.median("depth"), 3).alias("depth_m"), F.count(F.lit(1)).alias("n"))


def last_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """The carried columns of the last row of each key, by an explicit order."""
    return df.groupBy(*keys).agg(*(F.max_by(c, F.struct(*order)).alias(c) for c in carried))


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], carried: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.min_by(c, F.struct(*order)).alias(c) for c in carried))


def bin_thinning(points: DataFrame, x: Column, y: Column, size: float = 30.0) -> DataFrame:
    """Median position and depth in each square bin."""
    return points.groupBy(F.floor(x / size).alias("bx"), F.floor(y / size).alias("by")).agg(F.median("lon").alias("lon"), F.median("lat").alias("lat"), F.median("depth").alias("depth"), F.count(F.lit(1)).alias("n"))


def class_histogram(cells: DataFrame, k: str = "k", classes: int = 8) -> DataFrame:
    """Cells of every class, zeros included."""
    spark = cells.sparkSession
    every = spark.range(classes).select(F.col("id").cast("int").alias(k))
    return every.join(cells.groupBy(k).agg(F.count(F.lit(1)).alias("cells")), k, "left").select(k, F.coalesce("cells", F.lit(0).cast("long")).alias("cells"))


def class_mean(k: Column) -> Column:
    """Mean of the classes' middles."""
    return F.avg(k + 0.5)


def agreement(a: Column, b: Column) -> list[Column]:
    """n, exact and within-one shares, mean absolute and signed difference of two classes."""
    d = (a - b).cast("double")
    return [F.count(F.lit(1)).alias("n"), F.avg((d == 0).cast("double")).alias("exact"), F.avg((F.abs(d) <= 1).cast("double")).alias("within1"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias")]


def overlap(a: Column, b: Column) -> list[Column]:
    """Intersection over union, and area ratio, of two masks; NULL where there is no area."""
    both, either, left, right = (F.count_if(c) for c in (a & b, a | b, a, b))
    return [both.alias("both"), either.alias("either"), F.try_divide(both.cast("double"), either.cast("double")).alias("iou"), F.try_divide(left.cast("double"), right.cast("double")).alias("area_ratio")]


def mask_report(water: Column, keep: Column) -> list[Column]:
    """Cells before and after a mask, removed, and the removed share."""
    before, after = F.count_if(water), F.count_if(water & keep)
    return [before.alias("before"), after.alias("after"), (before - after).alias("removed"), ((before - after) / F.greatest(before, F.lit(1))).alias("removed_fraction"), F.count_if(~keep).alias("masked_cells")]


def counter(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def top_counts(df: DataFrame, key: str, most: int = 20) -> DataFrame:
    return counter(df, key).orderBy(F.desc("n"), key).limit(most)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= most)


def robust_objective(error: Column, valid: Column, penalty: float = 0.7, weight: Column | None = None) -> Column:
    """Mean of errors, squared when small and linear beyond, and a penalty for places without a class; a row of a weight counts as so many."""
    huber = F.when(error < 0.5, error * error).otherwise(F.lit(0.25) + (error - 0.5) * 0.5)
    w = F.lit(1) if weight is None else weight
    share = F.sum(F.when(valid, w).otherwise(0)) / F.sum(w)
    return F.sum(F.when(valid, huber * w)) / F.sum(F.when(valid, w)) + F.lit(penalty) * (F.lit(1.0) - share)


def percentiles(c: Column, shares: Sequence[float]) -> list[Column]:
    return [F.percentile(c, F.lit(p)).alias(f"p{round(p * 100)}") for p in shares]


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).unionAll(b.exceptAll(a))
