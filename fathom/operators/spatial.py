"""Spatial joins: polygons, neighbours, cells. Equi-joins on bins carry them; ray casting and distances are residuals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom import model as M
from fathom.shared import checkpointed


def edges_of(polygons: DataFrame, geom: str = "geom_id", rings: str = "rings") -> DataFrame:
    """Edge table of polygons with rings array<array<struct<x,y>>>, the first ring the outer one."""
    ring = polygons.select(geom, F.posexplode(rings).alias("ring", "pts"))
    shut = F.when(F.element_at("pts", 1) == F.element_at("pts", -1), F.col("pts")).otherwise(F.concat("pts", F.slice("pts", 1, 1)))
    ring = ring.select(geom, "ring", shut.alias("pts")).where(F.size("pts") >= 4)
    step = ring.select(geom, "ring", F.posexplode(F.arrays_zip(F.slice("pts", 1, F.size("pts") - 1).alias("a"), F.slice("pts", 2, F.size("pts") - 1).alias("b"))).alias("i", "e"))
    return step.select(geom, "ring", "i", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def ring_polygons(spark: SparkSession, polygons: dict[int, list[list[tuple[float, float]]]]) -> DataFrame:
    """A small literal table of polygons."""
    return spark.createDataFrame([(k, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for k, rings in polygons.items()], "geom_id long, rings array<array<struct<x double, y double>>>")


def crosses(x: Column, y: Column) -> Column:
    """Whether a ray to the east from (x, y) crosses the edge; half-open at the edge's ends."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    rise = F.when(y2 == y1, F.lit(1.0)).otherwise(y2 - y1)
    return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / rise + x1)


def points_in_polygons(points: DataFrame, edges: DataFrame, key: str, x: str = "x", y: str = "y", bin_size: float = 1.0) -> DataFrame:
    """(key, geom_id) of the points inside a polygon: an odd number of crossings of the outer ring, an even one of every hole.

    Points and edges meet on bands of y as wide as ``bin_size``: an edge goes to each band it spans, so
    that a point is compared only with edges of its band.
    """
    band = lambda c: F.floor(c / bin_size)
    spread = edges.withColumn("__band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))))
    near = points.select(key, F.col(x).alias("__x"), F.col(y).alias("__y")).withColumn("__band", band(F.col("__y"))).join(spread, "__band")
    hit = near.where(crosses(F.col("__x"), F.col("__y"))).groupBy(key, "geom_id", "ring").agg((F.count(F.lit(1)) % 2).alias("odd")).where("odd = 1")
    return hit.groupBy(key, "geom_id").agg(F.max((F.col("ring") == 0).cast("int")).alias("outer"), F.sum((F.col("ring") > 0).cast("int")).alias("holes")).where("outer = 1 and holes = 0").select(key, "geom_id")


def even_odd(points: DataFrame, edges: DataFrame, key: str, x: str = "x", y: str = "y", bin_size: float = 1.0) -> DataFrame:
    """Keys of the points that all rings together enclose an odd number of times."""
    band = lambda c: F.floor(c / bin_size)
    spread = edges.withColumn("__band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))))
    near = points.select(key, F.col(x).alias("__x"), F.col(y).alias("__y")).withColumn("__band", band(F.col("__y"))).join(spread, "__band")
    return near.where(crosses(F.col("__x"), F.col("__y"))).groupBy(key).agg((F.count(F.lit(1)) % 2).alias("odd")).where("odd = 1").select(key)


def keep_inside(points: DataFrame, edges: DataFrame, key: str, **how) -> DataFrame:
    return points.join(points_in_polygons(points, edges, key, **how).select(key).distinct(), key, "left_semi")


def drop_inside(points: DataFrame, edges: DataFrame, key: str, **how) -> DataFrame:
    return points.join(points_in_polygons(points, edges, key, **how).select(key).distinct(), key, "left_anti")


def nearest(queries: DataFrame, points: DataFrame, k: int, cell: float, order: tuple[str, ...]) -> DataFrame:
    """The k nearest points (x, y, carried columns) of each query (q, x, y): rows (q, d2, rank, carried), exact.

    Both sides meet on square cells. A query sees the cells around its own; whatever lies within one cell's
    size is complete. Queries with fewer than k points that near go on with cells four times as large.
    Every round is an equi-join; the number of rounds grows with the logarithm of the extent.
    """
    carried = [c for c in points.columns if c not in ("x", "y")]
    total = points.count()
    want = min(k, total)
    open_queries, done, size = queries, None, cell
    window = Window.partitionBy("q").orderBy("d2", *order)
    while want:
        at = lambda c, s: F.floor(c / s).cast("long")
        held = points.select(at(F.col("x"), size).alias("__cx"), at(F.col("y"), size).alias("__cy"), F.col("x").alias("__px"), F.col("y").alias("__py"), *carried)
        steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
        asked = open_queries.select("q", "x", "y", F.explode(steps).alias("__dx")).select("*", F.explode(steps).alias("__dy"))
        asked = asked.select("q", "x", "y", (at(F.col("x"), size) + F.col("__dx")).alias("__cx"), (at(F.col("y"), size) + F.col("__dy")).alias("__cy"))
        dx, dy = F.col("__px") - F.col("x"), F.col("__py") - F.col("y")
        near = asked.join(held, ["__cx", "__cy"]).select("q", (dx * dx + dy * dy).alias("d2"), *carried).where(F.col("d2") <= size * size)
        ranked = near.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= want)
        full = checkpointed(ranked.groupBy("q").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == want).select("q"))
        found = ranked.join(full, "q", "left_semi")
        done = found if done is None else done.unionByName(found)
        open_queries = open_queries.join(full, "q", "left_anti")
        if open_queries.isEmpty():
            return done
        size *= 4
    return queries.sparkSession.createDataFrame([], done.schema if done is not None else "q long, d2 double, rank int")


def idw(neighbours: DataFrame, value: str = "depth", power: float = M.IDW_POWER, soften: float = M.IDW_SOFTEN) -> DataFrame:
    """Inverse-distance means of the neighbours of each query; the softening keeps weights finite at no distance."""
    weight = F.lit(1.0) / F.pow(F.col("d2") + soften * soften, F.lit(power / 2))
    return neighbours.groupBy("q").agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias("z"), F.sqrt(F.min("d2")).alias("nearest"))


def cell_lookup(points: DataFrame, cells: DataFrame, iy: Column, ix: Column) -> DataFrame:
    """Left join of points with the cells at their computed index (y, x, k)."""
    return points.withColumn("y", iy).withColumn("x", ix).join(cells.select("y", "x", "k"), ["y", "x"], "left")


def bilinear(points: DataFrame, cells: DataFrame, fy: Column, fx: Column, key: str, value: str = "z") -> DataFrame:
    """Weighted mean of the four cells around fractional indices; missing cells give their weight to the others, NULL unless over half stays."""
    from fathom.functions.exprs import bilinear_weights

    y0, x0 = F.floor(fy), F.floor(fx)
    around = points.select(key, y0.alias("__y0"), x0.alias("__x0"), F.explode(bilinear_weights(fx - x0, fy - y0)).alias("n"))
    around = around.select(key, (F.col("__y0") + F.col("n.dy")).cast("int").alias("y"), (F.col("__x0") + F.col("n.dx")).cast("int").alias("x"), F.col("n.w").alias("w"))
    met = around.join(cells.select("y", "x", value), ["y", "x"], "left")
    has = F.when(F.col(value).isNotNull(), F.col("w")).otherwise(F.lit(0.0))
    return met.groupBy(key).agg(F.sum(has).alias("__w"), F.sum(has * F.coalesce(value, F.lit(0.0))).alias("__v")).select(key, F.when(F.col("__w") > 0.5, F.col("__v") / F.col("__w")).alias(value))


def metre_factor(lat0: float) -> float:
    return math.cos(math.radians(lat0))


def union_area(polygons: DataFrame, by: str) -> DataFrame:
    """Areas of closed rings in square metres by category, holes taken off (shoelace)."""
    ring = polygons.select(by, F.posexplode("rings").alias("ring", "pts"))
    step = ring.select(by, "ring", F.explode(F.arrays_zip(F.slice("pts", 1, F.size("pts") - 1).alias("a"), F.slice("pts", 2, F.size("pts") - 1).alias("b"))).alias("e"), F.md5(F.to_json("pts")).alias("__id"))
    double = step.groupBy(by, "ring", "__id").agg(F.abs(F.sum(F.col("e.a.x") * F.col("e.b.y") - F.col("e.b.x") * F.col("e.a.y"))).alias("__d"))
    return double.groupBy(by).agg((F.sum(F.when(F.col("ring") == 0, F.col("__d")).otherwise(-F.col("__d"))) / 2).alias("area"))


def seeded(components: DataFrame, holds_seed: str = "holds_seed", area: str = "area") -> DataFrame:
    """The components that hold the seed, or the largest where none does."""
    best = components.agg(F.max(holds_seed).alias("__any"), F.max(area).alias("__most"))
    return components.join(F.broadcast(best), (F.col("__any") & F.col(holds_seed)) | (~F.col("__any") & (F.col(area) == F.col("__most")))).drop("__any", "__most")
