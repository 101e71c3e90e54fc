"""Sinks: CSV, GeoJSON, packed grids, reports, tile tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators import raster


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def geojson_features(df: DataFrame) -> DataFrame:
    """One feature a row of (lon, lat, depth_m, n, date): text that any number of tasks can write."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct("depth_m", "n", "date").alias("properties"))
    return df.select("lon", "lat", F.to_json(feature).alias("value"))


def geojson_points(df: DataFrame, licence: str) -> DataFrame:
    """One row: a feature collection, for a map's worth of points."""
    one = geojson_features(df).agg(F.sort_array(F.collect_list(F.struct("lon", "lat", "value"))).alias("fs"))
    head = F.concat(F.lit('{"type":"FeatureCollection","licence":'), F.lit(json.dumps(licence)), F.lit(',"features":['))
    return one.select(F.concat(head, F.array_join(F.transform("fs", lambda x: x["value"]), ","), F.lit("]}")).alias("value"))


def packed_grid(cells: DataFrame, header: dict) -> DataFrame:
    """One row: the grid's header and its rows as strings, in the order of y."""
    rows = raster.pack_rows(cells).agg(F.sort_array(F.collect_list(F.struct("y", "line"))).alias("rs"))
    return rows.select(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in header.items()), F.transform("rs", lambda r: r["line"]).alias("rows"))).alias("value"))


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path, ignoreNullFields=False)


def write_tiles(tiles: DataFrame, path: str) -> None:
    """A table by map and level, so that a level of detail reads its own folder only."""
    tiles.repartition("map", "level").write.mode("overwrite").partitionBy("map", "level").parquet(path)


def write_classes(cells: DataFrame, path: str) -> None:
    cells.write.mode("overwrite").parquet(path)


def share_text(fix: DataFrame) -> DataFrame:
    return fix.select(F.format_string("%.5f, %.5f (%.1f to %.1f m)", "lat", "lon", "depth_lo", "depth_hi").alias("value"))
