"""Tile pyramids: cover of a viewport, manifest, differences of two covers, strip placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom import model as M


def manifest(maps: DataFrame, levels: tuple[int, ...] = M.TILE_LEVELS, tile: int = M.TILE_PIXELS) -> DataFrame:
    """Pixel size, columns and rows of every level of maps (map, width, height)."""
    each = maps.select("map", "width", "height", F.explode(F.array(*(F.lit(n) for n in levels))).alias("level"))
    size = each.select("map", "level", (F.col("width") * F.col("level")).alias("pixel_width"), (F.col("height") * F.col("level")).alias("pixel_height"))
    return size.withColumns({"cols": F.ceil(F.col("pixel_width") / float(tile)).cast("int"), "rows": F.ceil(F.col("pixel_height") / float(tile)).cast("int")})


def cover(views: DataFrame, manifests: DataFrame, margin: int = 1, tile: int = M.TILE_PIXELS) -> DataFrame:
    """Tiles (view, map, level, tx, ty) that views (view, map, level, x0, y0, x1, y1 in level pixels) see, with a margin."""
    at = lambda c: F.floor(F.col(c) / float(tile)).cast("int")
    v = views.join(manifests.select("map", "level", "cols", "rows"), ["map", "level"])
    low = lambda c: F.greatest(F.lit(0), at(c) - margin)
    high = lambda c, n: F.least(F.col(n) - 1, at(c) + margin)
    v = v.withColumns({"ax": low("x0"), "bx": high("x1", "cols"), "ay": low("y0"), "by": high("y1", "rows")}).where("ax <= bx and ay <= by")
    v = v.withColumn("tx", F.explode(F.sequence("ax", "bx"))).withColumn("ty", F.explode(F.sequence("ay", "by")))
    return v.select("view", "map", "level", "tx", "ty")


def tile_changes(now: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tiles to add and to remove."""
    return wanted.exceptAll(now).withColumn("action", F.lit("add")).unionAll(now.exceptAll(wanted).withColumn("action", F.lit("remove")))


def tile_bytes(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("map", "level").agg((F.max("tx") + 1).alias("cols"), (F.max("ty") + 1).alias("rows"), F.count(F.lit(1)).alias("tiles"), F.sum("bytes").alias("bytes"))


def strip_offsets(strips: DataFrame) -> DataFrame:
    """Canvas row of strips (strip, y0, y1, height): offset from the first over the median of the strips' scales."""
    scale = strips.agg(F.median((F.col("y1") - F.col("y0")) / F.col("height")).alias("scale"), F.min("y0").alias("top"))
    return strips.join(F.broadcast(scale)).select("strip", F.rint((F.col("y0") - F.col("top")) / F.col("scale")).cast("int").alias("offset"), "height")


def placed_bbox(x0: Column, y0: Column, x1: Column, y1: Column, view: dict[str, float], ref: M.GeoRef) -> list[Column]:
    """Bounds of a placed rectangle from its share of the viewport; pages grow downwards."""
    fx = lambda x: (x - view["x0"]) / (view["x1"] - view["x0"])
    fy = lambda y: (y - view["y0"]) / (view["y1"] - view["y0"])
    wide, high = ref.east - ref.west, ref.north - ref.south
    return [(fx(x0) * wide + ref.west).alias("west"), (fx(x1) * wide + ref.west).alias("east"), (F.lit(ref.north) - fy(y0) * high).alias("north"), (F.lit(ref.north) - fy(y1) * high).alias("south")]
