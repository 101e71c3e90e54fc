"""Rasters as long tables (y, x, k): packing, overlays, neighbours, morphology; NULL or a missing row is land."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unpack_strings(rows: DataFrame, text: str = "rows", ny: int | None = None) -> DataFrame:
    """Cells of a grid whose rows are strings of class digits, '.' for land; with ny, row 0 changes sides."""
    lines = rows.select(F.posexplode(text).alias("y", "line"))
    cells = lines.select("y", F.posexplode(F.split("line", "")).alias("x", "c")).where("c != ''")
    y = F.lit(ny - 1) - F.col("y") if ny is not None else F.col("y")
    return cells.select(y.alias("y"), "x", F.when(F.col("c") != ".", F.col("c").cast("int")).alias("k"))


def unpack_numbers(rows: DataFrame, values: str = "rows") -> DataFrame:
    """Cells of a nested array of numbers."""
    return rows.select(F.posexplode(values).alias("y", "row")).select("y", F.posexplode("row").alias("x", "z"))


def check_size(rows: DataFrame, text: str, nx: int, ny: int) -> DataFrame:
    """rows, or an error where the grid isn't ny strings of nx."""
    fits = (F.size(text) == ny) & F.forall(F.col(text), lambda r: F.length(r) == nx)
    return rows.where(F.when(fits, F.lit(True)).otherwise(F.raise_error(F.lit("the grid has other dimensions"))))


def pack_rows(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One string for each row y: class digits in the order of x, '.' for land."""
    c = F.coalesce(F.col("k").cast("string"), F.lit("."))
    keys = [*(by or []), "y"]
    return cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x", c.alias("c")))).alias("cs")).select(*keys, F.array_join(F.transform("cs", lambda s: s["c"]), "").alias("line"))


def overlay(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join of two rasters: y, x, a, b."""
    return a.select("y", "x", F.col("k").alias("a")).join(b.select("y", "x", F.col("k").alias("b")), ["y", "x"], "full_outer")


def boundary(cells: DataFrame) -> DataFrame:
    """Cells with a direct neighbour of another class; no wrap at the border, land doesn't count."""
    row, column = Window.partitionBy("y").orderBy("x"), Window.partitionBy("x").orderBy("y")
    differs = lambda w, along: sum(((F.coalesce((f("k").over(w) != F.col("k")) & (F.abs(f(along).over(w) - F.col(along)) == 1), F.lit(False))).cast("int") for f in (F.lag, F.lead)), F.lit(0))
    return cells.where("k is not null").withColumn("__r", differs(row, "x")).withColumn("__c", differs(column, "y")).where("__r + __c > 0").select("y", "x", "k")


def _offsets(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets))
    return cells.select("y", "x", F.explode(steps).alias("d")).select((F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))


def square(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]


CROSS = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]


def dilate(mask: DataFrame, ny: int, nx: int, offsets: list[tuple[int, int]] | None = None) -> DataFrame:
    """Mask cells (y, x) and their neighbours, within the grid."""
    return _offsets(mask, offsets or CROSS).where(F.col("y").between(0, ny - 1) & F.col("x").between(0, nx - 1)).distinct()


def erode(mask: DataFrame, ny: int, nx: int, offsets: list[tuple[int, int]]) -> DataFrame:
    """Mask cells all of whose neighbours are in the mask; beyond the grid counts as outside."""
    return _offsets(mask, [(-dy, -dx) for dy, dx in offsets]).groupBy("y", "x").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == len(offsets)).where(F.col("y").between(0, ny - 1) & F.col("x").between(0, nx - 1)).select("y", "x")


def close(mask: DataFrame, ny: int, nx: int, radius: int = 1) -> DataFrame:
    return erode(dilate(mask, ny, nx, square(radius)), ny, nx, square(radius))


def open_(mask: DataFrame, ny: int, nx: int, offsets: list[tuple[int, int]]) -> DataFrame:
    return dilate(erode(mask, ny, nx, offsets), ny, nx, [(-dy, -dx) for dy, dx in offsets])


def thresholds(cells: DataFrame, classes: int = 8) -> DataFrame:
    """Cumulative masks: (t, y, x) for every t up to the cell's class."""
    return cells.where("k is not null").select("y", "x", F.explode(F.sequence(F.lit(0), F.least("k", F.lit(classes - 1)))).alias("t"))


def nesting_faults(masks: DataFrame) -> DataFrame:
    """Cells of a threshold that the one below lacks, by threshold."""
    below = masks.select((F.col("t") + 1).alias("t"), "y", "x")
    return masks.where("t > 0").join(below, ["t", "y", "x"], "left_anti").groupBy("t").agg(F.count(F.lit(1)).alias("faults"))


def parent_clip(masks: DataFrame) -> DataFrame:
    """Masks (t, y, x) cut by all thresholds below: those without a gap from 0 on."""
    w = Window.partitionBy("y", "x").orderBy("t")
    return masks.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == F.col("t") + 1).select("t", "y", "x")


def top_class(masks: DataFrame) -> DataFrame:
    """The highest threshold that holds at each cell."""
    return masks.groupBy("y", "x").agg(F.max("t").alias("k"))


def stripes(strips: DataFrame) -> DataFrame:
    """Rows of strips (strip, y0, rows array) on one canvas; where they overlap the later strip wins."""
    lines = strips.select("strip", "y0", F.posexplode("rows").alias("i", "line")).select("strip", (F.col("y0") + F.col("i")).alias("y"), "line")
    return lines.groupBy("y").agg(F.max_by("line", "strip").alias("line"), F.max("strip").alias("strip"))


def occupancy(cells: DataFrame, sigma: float, value: Column, truncate: float = 4.0) -> DataFrame:
    """A separable Gaussian blur of a value, zero beyond the cells: two weighted sums over neighbours."""
    import math

    radius = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    total = sum(weights)
    steps = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(w / total).alias("w")) for d, w in zip(range(-radius, radius + 1), weights, strict=True)))

    def along(df: DataFrame, axis: str, other: str) -> DataFrame:
        spread = df.select(F.col(other), F.col(axis), "v", F.explode(steps).alias("s"))
        return spread.select(other, (F.col(axis) + F.col("s.d")).alias(axis), (F.col("v") * F.col("s.w")).alias("v")).groupBy(axis, other).agg(F.sum("v").alias("v"))

    return along(along(cells.select("y", "x", value.cast("double").alias("v")), "y", "x"), "x", "y").select("y", "x", F.col("v").alias("occ"))
