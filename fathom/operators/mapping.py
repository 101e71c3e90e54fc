"""Map work: palettes from patches, legends, inventories of images and drawings, bands, strokes, layered drawings, polygon burns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fathom import model as M
from fathom.functions import exprs as E
from fathom.operators import calibrate, curves, kernels, raster, relational, spatial


def land(df: DataFrame, path: str) -> None:
    """Write once: a landing folder that exists stays as it is."""
    df.write.mode("ignore").parquet(path)


def decode_classes(pixels: DataFrame, palette=M.DISPLAY_PALETTE, alpha: int = 128, strict: bool = True) -> DataFrame:
    """(y, x, k) of pixels (y, x, r, g, b, a): NULL where transparent; strict fails on colours beside the palette."""
    seen = pixels.select("y", "x", "a", E.nearest_colour(F.col("r"), F.col("g"), F.col("b"), palette).alias("n"))
    water = F.col("a") >= alpha
    if strict:
        seen = seen.where(F.when(~water | (F.col("n.d2") == 0), F.lit(True)).otherwise(F.raise_error(F.lit("a colour is not of the palette"))))
    return seen.select("y", "x", F.when(water, F.col("n.k")).alias("k"))


def classify(pixels: DataFrame, palette=M.SOURCE_PALETTE, tolerance: float = 58.0) -> DataFrame:
    """(y, x, k, distance) of pixels (y, x, r, g, b); k NULL beyond the tolerance."""
    near = pixels.select("y", "x", E.nearest_colour(F.col("r"), F.col("g"), F.col("b"), palette).alias("n"))
    return near.select("y", "x", F.when(F.sqrt("n.d2") < tolerance, F.col("n.k")).alias("k"), F.sqrt("n.d2").alias("distance"))


def segment(pixels: DataFrame, key: str, palette=M.SOURCE_PALETTE, tolerance: float = 58.0, holes: int | None = None) -> DataFrame:
    """Whole segmentation of a map image (key, y, x, r, g, b): nearest colour, closing, largest water body, holes, nearest fill."""
    import numpy as np

    found = pixels.select(key, "y", "x", E.nearest_colour(F.col("r"), F.col("g"), F.col("b"), palette).alias("n"))
    cells = found.select(key, "y", "x", F.when(F.sqrt("n.d2") < tolerance, F.col("n.k")).alias("k"))

    def kernel(field):
        m = field >= 0
        h, w = m.shape
        shifts = [(dy, dx) for dy in range(3) for dx in range(3)]
        wide = np.pad(m, 2)  # the closing sees the grid as part of an endless plane
        grown = np.logical_or.reduce([wide[dy : dy + h + 2, dx : dx + w + 2] for dy, dx in shifts])
        closed = np.logical_and.reduce([grown[dy : dy + h, dx : dx + w] for dy, dx in shifts])
        lab, n = kernels.label(closed)
        if not n:
            return np.full(field.shape, -1)
        sizes = np.bincount(lab.ravel())
        sizes[0] = 0
        lake = kernels.fill_holes(lab == sizes.argmax(), holes)
        out = kernels.nearest_fill(field, lake)
        return np.where(lake, out, -1)

    return kernels.by_raster(cells, key, kernel)


def patch_palette(pixels: DataFrame, patches: DataFrame) -> DataFrame:
    """Median colour of each fixed patch (k, y0, y1, x0, x1; ends left out) of pixels (y, x, r, g, b). Patches are a legend's few."""
    inside = F.col("y").between(F.col("y0"), F.col("y1") - 1) & F.col("x").between(F.col("x0"), F.col("x1") - 1)
    rows = patches.withColumn("y", F.explode(F.sequence("y0", F.col("y1") - 1)))
    met = pixels.join(rows, "y").where(inside)
    return met.groupBy("k").agg(*(F.median(c).alias(c) for c in "rgb"))


def swatches(components: DataFrame, page_width: float) -> DataFrame:
    """Legend swatches among components (page, component, x0, x1, y0, y1, cells): by size and place."""
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    cx, cy = (F.col("x0") + F.col("x1")) / 2.0, (F.col("y0") + F.col("y1")) / 2.0
    s = components.select("page", "component", cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"), "cells")
    return s.where(F.col("w").between(18, 130) & F.col("h").between(10, 70) & (F.col("cells") >= 180) & (F.col("cx") <= page_width * 0.13))


def legend(found: DataFrame, keep: int = 12) -> DataFrame:
    """(page, rank, cx, cy): the nearest to the median column first, the most regular eight of them, or seven and the eighth inferred."""
    mid = found.groupBy("page").agg(F.median("cx").alias("mid"))
    near = relational.top_per_group(found.join(mid, "page"), ["page"], [F.abs(F.col("cx") - F.col("mid")), F.desc("cells"), F.col("cy")], keep)
    more = calibrate.inferred_swatch(near.select("page", "cx", "cy"))
    every = near.select("page", "cx", "cy").unionByName(more.select("page", "cx", "cy"))
    best = calibrate.legend_run(every).select("page", F.col("cy").alias("first"))
    return relational.top_per_group(every.join(best, "page").where("cy >= first"), ["page"], [F.col("cy")], 8).select("page", "rank", "cx", "cy")


def colour_inventory(pixels: DataFrame, key: str, palette=M.SOURCE_PALETTE) -> DataFrame:
    """Means, deviations, and shares of pixels within 30 and 60 of the palette, by image."""
    d = F.sqrt(E.nearest_colour(F.col("r"), F.col("g"), F.col("b"), palette)["d2"])
    stats = [f(c).alias(f"{n}_{c}") for c in "rgb" for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return pixels.withColumn("__d", d).groupBy(key).agg(*stats, *(F.avg((F.col("__d") < t).cast("double")).alias(f"within{t}") for t in (30, 60)))


def drawing_inventory(drawings: DataFrame, most: int = 20) -> DataFrame:
    """The commonest fill and stroke colours of drawings (fill, stroke), with their counts."""
    parts = [relational.top_counts(drawings.where(F.col(c).isNotNull()).select(F.lit(c).alias("kind"), F.col(c).alias("colour")).withColumn("key", F.concat_ws(" ", "kind", "colour")), "key", most) for c in ("fill", "stroke")]
    return parts[0].unionAll(parts[1])


def token_presence(texts: DataFrame, key: str, text: str, tokens: list[str]) -> DataFrame:
    return texts.select(key, *(F.contains(F.col(text), F.lit(t)).alias(t) for t in tokens))


def strips_of(images: DataFrame, width: int = 1924, least: float = 900.0, count: int = 6) -> DataFrame:
    """The strips of a map among images (image, width, x0, x1, y0, y1), in their order; an error unless there are so many."""
    found = images.where((F.col("width") == width) & (F.col("x1") - F.col("x0") >= least))
    n = found.agg(F.count(F.lit(1)).alias("__n"))
    held = found.join(F.broadcast(n))
    return held.where(F.when(F.col("__n") == count, F.lit(True)).otherwise(F.raise_error(F.lit("another number of strips")))).drop("__n").orderBy("y0")


def media_of(items: DataFrame, title: str) -> DataFrame:
    """Media rows (id, title, sizes map) of one exact title, with the largest size."""
    size = F.map_entries("sizes")
    same = F.lower(F.trim("title")) == title.lower()
    return items.where(same).select("id", "title", F.array_max(F.transform(size, lambda e: F.struct(E.integer_or_zero(e["value"]).alias("width"), e["key"].alias("name")))).alias("largest")).select("id", "title", "largest.*")


def aspect_gate(images: DataFrame, low: float = 1.35, high: float = 1.48) -> DataFrame:
    ratio = F.col("width") / F.col("height").cast("double")
    return images.where(F.when((ratio > low) & (ratio < high), F.lit(True)).otherwise(F.raise_error(F.lit("the image has another shape"))))


def depth_bands(cells: DataFrame, step: float = 0.5) -> DataFrame:
    """Cells of a continuous grid by filled-contour band."""
    return cells.where("z is not null").groupBy(F.floor(F.col("z") / step).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("cells"))


def strokes(cells: DataFrame, colour: str = "#244e5a", alpha: int = 210) -> DataFrame:
    """Cells with their display colour, boundary cells in a dark one."""
    edge = raster.boundary(cells).select("y", "x", F.lit(1).alias("__edge"))
    names = F.array(*(F.lit("#%02x%02x%02x" % c) for c in M.DISPLAY_PALETTE))
    return cells.where("k is not null").join(edge, ["y", "x"], "left").select("y", "x", F.when(F.col("__edge") == 1, F.lit(colour)).otherwise(F.get(names, F.col("k"))).alias("colour"), F.when(F.col("__edge") == 1, alpha).otherwise(255).alias("alpha"))


def layered_svg(rings: DataFrame, width: int, height: int, digits: int = 1) -> DataFrame:
    """One row: a drawing with a path for each class, cumulative fills from shallow to deep."""
    paths = curves.svg_paths(rings, digits).groupBy("k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ring_id", "d"))), lambda p: p["d"]), " ").alias("d"))
    names = F.array(*(F.lit("#%02x%02x%02x" % c) for c in M.DISPLAY_PALETTE))
    line = F.concat(F.lit('<path id="band-'), F.col("k").cast("string"), F.lit('" fill="'), F.get(names, F.col("k")), F.lit('" fill-rule="evenodd" d="'), "d", F.lit('"/>'))
    body = paths.agg(F.sort_array(F.collect_list(F.struct("k", line.alias("l")))).alias("ls"))
    return body.select(F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}">'), F.array_join(F.transform("ls", lambda x: x["l"]), ""), F.lit("</svg>")).alias("value"))


def scaled_strokes(factor: float):
    """A function of SVG text that scales its stroke widths; arithmetic in a replacement needs a kernel."""
    import re

    @F.pandas_udf(StringType())
    def scaled(svg: pd.Series) -> pd.Series:
        at = re.compile(r'(stroke-width=")([\d.]+)(")')
        return svg.map(lambda s: None if s is None else at.sub(lambda m: f"{m[1]}{float(m[2]) * factor:.3f}{m[3]}", s))

    return scaled


def burn(cells: DataFrame, polygons: DataFrame, bin_size: float = 8.0) -> DataFrame:
    """Cells with ``inside``: in any polygon, each with its own holes taken off."""
    keyed = cells.withColumn("__cell", F.shiftleft(F.col("y").cast("long"), 32).bitwiseOR(F.col("x").cast("long")))
    hit = spatial.points_in_polygons(keyed, spatial.edges_of(polygons), "__cell", bin_size=bin_size).select("__cell").distinct().withColumn("__in", F.lit(True))
    return keyed.join(hit, "__cell", "left").withColumn("inside", F.coalesce("__in", F.lit(False))).drop("__cell", "__in")


def open_water(points: DataFrame, mask: DataFrame | None, key: str) -> DataFrame:
    """points with ``inside``; true everywhere while there is no mask."""
    if mask is None:
        return points.withColumn("inside", F.lit(True))
    return points.join(mask.select(key).distinct().withColumn("__in", F.lit(True)), key, "left").withColumn("inside", F.coalesce("__in", F.lit(False))).drop("__in")


def stable_interior(cells: DataFrame, ny: int, nx: int, radius: int = 1) -> DataFrame:
    """Cells further than ``radius`` from any boundary cell."""
    near = raster.dilate(raster.boundary(cells).select("y", "x"), ny, nx, raster.square(radius))
    return cells.where("k is not null").join(near, ["y", "x"], "left_anti")


def size_ratio(now: DataFrame, before: DataFrame, key: str, size: str = "bytes") -> DataFrame:
    """Sizes against an earlier report's; NULL where it has none."""
    return now.join(before.select(key, F.col(size).alias("__b")), key, "left").select(key, size, F.try_divide(F.col(size).cast("double"), F.col("__b").cast("double")).alias("ratio"))


def simplify_metric(rings: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """Rings of degrees (k, ring_id, i, x, y) simplified to so many metres of the national grid, without meeting themselves anew."""
    east, north = E.lambert93(F.col("x"), F.col("y"))
    metric = rings.select("k", "ring_id", "i", east.alias("x"), north.alias("y"))
    kept = curves.simplified_valid(metric, tolerance).select("k", "ring_id", "i")
    return rings.join(kept, ["k", "ring_id", "i"], "left_semi")


def in_view(c: Column, low: Column, high: Column) -> Column:
    """Inclusive bounds."""
    return (c >= low) & (c <= high)
