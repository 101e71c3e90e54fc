"""Views of the driver's tables as soundings, rasters, fixes, rings and polygons. The tables hold no geography; fixed arithmetic gives it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom import model as M

NY, NX = 96, 128
GRID = M.GridSpec(M.GeoRef(-1.2, 44.93, -1.08, 45.002), 401, 81, "node", "south", "up")
LEVEL_NOW = 13.43
#: Offsets of a ring's twelve points.
DIRECTIONS = ((10, 0), (9, 5), (5, 9), (0, 10), (-5, 9), (-9, 5), (-10, 0), (-9, -5), (-5, -9), (0, -10), (5, -9), (9, -5))
#: Polygons over raster indices (x, y): one with a hole, a triangle, and a square across both.
POLYGONS = {
    1: [[(10.5, 10.5), (60.5, 10.5), (60.5, 70.5), (10.5, 70.5), (10.5, 10.5)], [(20.5, 20.5), (40.5, 20.5), (40.5, 40.5), (20.5, 40.5), (20.5, 20.5)]],
    2: [[(70.25, 15.25), (120.25, 30.25), (90.25, 85.25), (70.25, 15.25)]],
    3: [[(50.75, 30.75), (100.75, 30.75), (100.75, 60.75), (50.75, 60.75), (50.75, 30.75)]],
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def soundings(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "lineitem").select(
        c("l_returnflag").alias("code"), F.concat(F.lit("Étang "), c("l_linestatus")).alias("name"), c("l_shipdate").alias("date"), "l_orderkey", "l_linenumber",
        (F.lit(-1.2) + (c("l_partkey") % 400) * 0.0003).alias("lon"), (F.lit(44.93) + (c("l_suppkey") % 80) * 0.0009).alias("lat"), (c("l_quantity") / 5.0).alias("depth"),
    )


def raster(spark: SparkSession, d: str, odd: bool = False) -> DataFrame:
    """Classes by cell; ``odd``: a second survey, of the odd lines only."""
    li = table(spark, d, "lineitem")
    li = li.where("l_linenumber % 2 = 1") if odd else li
    return li.groupBy((F.col("l_orderkey") % NY).cast("int").alias("y"), (F.col("l_partkey") % NX).cast("int").alias("x")).agg(F.least(F.lit(7), F.floor(F.avg("l_quantity") / 6.25)).cast("int").alias("k"))


def fixes(spark: SparkSession, d: str) -> DataFrame:
    return fixes_of(table(spark, d, "events"))


def fixes_of(events: DataFrame) -> DataFrame:
    """Fixes of a table or a stream of events."""
    c = F.col
    return events.select("user_id", "event_id", c("ts").cast("timestamp").alias("ts"), (F.lit(-1.2) + (c("event_id") % 997) * 0.00012).alias("lon"), (F.lit(44.93) + (c("user_id") % 83) * 0.00087).alias("lat"), c("value").alias("accuracy"), ((c("event_id") % 50) / 10.0).alias("speed"))


def lookup_cells(spark: SparkSession, d: str) -> DataFrame:
    """Classes at the nodes of GRID."""
    li = table(spark, d, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 80).cast("int").alias("y"), (F.col("l_partkey") % 400).cast("int").alias("x")).agg(F.least(F.lit(7), F.floor(F.avg("l_quantity") / 6.25)).cast("int").alias("k"))


def rings(spark: SparkSession, d: str) -> DataFrame:
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(DIRECTIONS)))
    p = table(spark, d, "part").select("p_partkey", "p_size", F.explode(each).alias("d")).select("p_partkey", "p_size", "d.*")
    c = F.col
    at = lambda base, step, delta, turn: (base + (c("p_partkey") % 37) * step + c(delta) * (2 + c("p_size") % 9) + (c("p_partkey") * (c("i") + turn)) % 5).cast("double")
    return p.select((c("p_partkey") % 6).cast("int").alias("k"), c("p_partkey").alias("ring_id"), "i", at(F.lit(300), 10, "dx", 3).alias("x"), at(F.lit(200), 8, "dy", 7).alias("y"))


def polygons(spark: SparkSession) -> DataFrame:
    from fathom.operators.spatial import ring_polygons

    return ring_polygons(spark, POLYGONS)


def colours(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "part").select("p_partkey", (c("p_partkey") * 7 % 256).cast("int").alias("r"), (c("p_partkey") * 13 % 256).cast("int").alias("g"), (c("p_size") * 5 % 256).cast("int").alias("b"))


# The same as SQL.
_EDGES = ", ".join(f"({g}, {r}, {i}, {a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for g, rs in POLYGONS.items() for r, ring in enumerate(rs) for i, (a, b) in enumerate(zip(ring, ring[1:], strict=False)))
_DIRS = ", ".join(f"({i}, {dx}, {dy})" for i, (dx, dy) in enumerate(DIRECTIONS))
_RASTER = "SELECT CAST(l_orderkey % 96 AS INT) AS y, CAST(l_partkey % 128 AS INT) AS x, CAST(least(7, floor(avg(l_quantity) / 6.25e0)) AS INT) AS k FROM lineitem {} GROUP BY 1, 2"
VIEWS = {
    "soundings": "SELECT l_returnflag AS code, 'Étang ' || l_linestatus AS name, l_shipdate AS date, l_orderkey, l_linenumber, -1.2e0 + (l_partkey % 400) * 3e-4 AS lon, 44.93e0 + (l_suppkey % 80) * 9e-4 AS lat, l_quantity / 5e0 AS depth FROM lineitem",
    "raster": _RASTER.format(""),
    "raster_b": _RASTER.format("WHERE l_linenumber % 2 = 1"),
    "fixes": "SELECT user_id, event_id, ts, -1.2e0 + (event_id % 997) * 1.2e-4 AS lon, 44.93e0 + (user_id % 83) * 8.7e-4 AS lat, value AS accuracy, (event_id % 50) / 1e1 AS speed FROM events",
    "cells": "SELECT CAST(l_suppkey % 80 AS INT) AS y, CAST(l_partkey % 400 AS INT) AS x, CAST(least(7, floor(avg(l_quantity) / 6.25e0)) AS INT) AS k FROM lineitem GROUP BY 1, 2",
    "edges": f"SELECT * FROM (VALUES {_EDGES}) v(geom_id, ring, i, x1, y1, x2, y2)",
    "rings": f"SELECT CAST(p_partkey % 6 AS INT) AS k, p_partkey AS ring_id, CAST(i AS INT) AS i, CAST(300 + (p_partkey % 37) * 10 + dx * (2 + p_size % 9) + (p_partkey * (i + 3)) % 5 AS DOUBLE) AS x, CAST(200 + (p_partkey % 37) * 8 + dy * (2 + p_size % 9) + (p_partkey * (i + 7)) % 5 AS DOUBLE) AS y FROM part CROSS JOIN (VALUES {_DIRS}) v(i, dx, dy)",
    "colours": "SELECT p_partkey, CAST(p_partkey * 7 % 256 AS INT) AS r, CAST(p_partkey * 13 % 256 AS INT) AS g, CAST(p_size * 5 % 256 AS INT) AS b FROM part",
    "around": "SELECT k, ring_id, i, x, y, coalesce(lag(x) OVER w, last_value(x) OVER a) AS px, coalesce(lag(y) OVER w, last_value(y) OVER a) AS py, coalesce(lead(x) OVER w, first_value(x) OVER a) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER a) AS ny FROM rings WINDOW w AS (PARTITION BY k, ring_id ORDER BY i), a AS (PARTITION BY k, ring_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
}


def sql(query: str, *views: str, recursive: bool = False) -> str:
    """A query over the views named, in their order."""
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views)
    return ("WITH RECURSIVE " if recursive else "WITH ") + head + (" " if query.lstrip().upper().startswith("SELECT") else ", ") + query
