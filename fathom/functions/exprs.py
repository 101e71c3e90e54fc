"""Column builders: parsing, coordinates, levels, bands, colours, formats. All stay within generated code."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom import model as M

ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def normal_name(c: Column) -> Column:
    """Accents off, lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.translate(c, ACCENTED, PLAIN)), "[^a-z0-9]", "")


def decimal_comma(c: Column) -> Column:
    """A number with a decimal comma or point; NULL where there is none."""
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")


def integer_or_zero(c: Column) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(0))


def first_filled(*cs: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))


def round_index(c: Column, rounding: str) -> Column:
    """``up``: halves up; ``even``: halves to even; ``down``: floor."""
    return {"up": lambda: F.floor(c + 0.5), "even": lambda: F.rint(c), "down": lambda: F.floor(c)}[rounding]().cast("int")


def grid_index(lon: Column, lat: Column, spec: M.GridSpec) -> tuple[Column, Column]:
    """(iy, ix) of a position, by the grid's registration; may lie off the grid."""
    r = spec.ref
    fx = (lon - r.west) / (r.east - r.west)
    fy = (lat - r.south) / (r.north - r.south)
    if spec.rows == "north":
        fy = F.lit(1.0) - fy
    if spec.registration == "node":
        return round_index(fy * (spec.ny - 1.0), spec.rounding), round_index(fx * (spec.nx - 1.0), spec.rounding)
    if spec.registration == "centre":
        return round_index(fy * float(spec.ny) - 0.5, spec.rounding), round_index(fx * float(spec.nx) - 0.5, spec.rounding)
    return round_index(fy * float(spec.ny), "down"), round_index(fx * float(spec.nx), "down")


def grid_position(iy: Column, ix: Column, spec: M.GridSpec) -> tuple[Column, Column]:
    """(lon, lat) of a node or of a cell's centre."""
    r = spec.ref
    if spec.registration == "node":
        fx, fy = ix / float(max(spec.nx - 1, 1)), iy / float(max(spec.ny - 1, 1))
    else:
        fx, fy = (ix + 0.5) / float(spec.nx), (iy + 0.5) / float(spec.ny)
    if spec.rows == "north":
        fy = F.lit(1.0) - fy
    return F.lit(r.west) + fx * (r.east - r.west), F.lit(r.south) + fy * (r.north - r.south)


def metres(lon: Column, lat: Column, lon0: float, lat0: float, cos0: float) -> tuple[Column, Column]:
    """Local metres east and north of an origin."""
    return (lon - lon0) * (M.METRES_PER_DEGREE * cos0), (lat - lat0) * M.METRES_PER_DEGREE


def similarity(x: Column, y: Column, cx: float, cy: float, dx: Column, dy: Column, sx: Column, sy: Column, theta: Column) -> tuple[Column, Column]:
    """Scale and turn about a centre, then shift."""
    u, v = (x - cx) * sx, (y - cy) * sy
    return F.cos(theta) * u - F.sin(theta) * v + cx + dx, F.sin(theta) * u + F.cos(theta) * v + cy + dy


def lambert93_constants() -> tuple[float, float, float, float]:
    """Exponent, radius factor, northing of the pole, and eccentricity."""
    a, e = 6378137.0, math.sqrt(2 / 298.257222101 - (1 / 298.257222101) ** 2)
    iso = lambda p: math.log(math.tan(math.pi / 4 + p / 2) * ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2))
    scale = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    p0, p1, p2 = math.radians(46.5), math.radians(44.0), math.radians(49.0)
    n = math.log(scale(p1) / scale(p2)) / (iso(p2) - iso(p1))
    c = a * scale(p1) / n * math.exp(n * iso(p1))
    return n, c, 6600000.0 + c * math.exp(-n * iso(p0)), e


def lambert93(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Lambert-93 easting and northing of WGS84, in closed form."""
    n, c, pole, e = lambert93_constants()
    p = F.radians(lat)
    s = F.sin(p) * e
    length = F.log(F.tan(p / 2 + math.pi / 4)) + F.log((F.lit(1.0) - s) / (F.lit(1.0) + s)) * (e / 2)
    r = F.exp(length * -n) * c
    g = F.radians(lon - 3.0) * n
    return r * F.sin(g) + 700000.0, F.lit(pole) - r * F.cos(g)


def bilinear_weights(fx: Column, fy: Column) -> Column:
    """The four neighbours (dy, dx, w) of a fractional place in a cell."""
    one = F.lit(1.0)
    return F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), ((fy if dy else one - fy) * (fx if dx else one - fx)).alias("w")) for dy in (0, 1) for dx in (0, 1)))


def confidence(distance: Column) -> Column:
    near, mid, far = M.CONFIDENCE_METRES
    return F.when(distance <= near, 3).when(distance <= mid, 2).when(distance <= far, 1).otherwise(0)


def quantise(depth: Column, step: float = M.DEPTH_STEP, cap: float = M.DEPTH_CAP) -> Column:
    """Clipped, then to the nearest step, halves to even."""
    return F.rint(F.greatest(F.lit(0.0), F.least(F.lit(cap), depth)) / step) * step


def clamp_level(level: Column) -> Column:
    low, high = M.LEVEL_LIMITS
    return F.round(F.greatest(F.lit(low), F.least(F.lit(high), level)), 2)


def band_info(k: Column, level: Column, reference: float = M.REFERENCE_LEVEL) -> list[Column]:
    """Depth now and altitude of the bed for class k, a metre each at the reference level."""
    shift = level - reference
    return [(k + shift).alias("depth_lo"), (k + 1 + shift).alias("depth_hi"), (k + 0.5 + shift).alias("depth_mid"), (F.lit(reference) - (k + 1)).alias("bed_lo"), (F.lit(reference) - k).alias("bed_hi"), shift.alias("shift")]


def interval_error(k: Column, depth: Column) -> Column:
    """Distance of a depth from the class's interval, closed at both ends."""
    return F.greatest(k - depth, F.lit(0.0)) + F.greatest(depth - (k + 1.0), F.lit(0.0))


def squared_distance(r: Column, g: Column, b: Column, colour: Sequence[int]) -> Column:
    return (r - colour[0]) * (r - colour[0]) + (g - colour[1]) * (g - colour[1]) + (b - colour[2]) * (b - colour[2])


def nearest_colour(r: Column, g: Column, b: Column, palette: Sequence[Sequence[int]]) -> Column:
    """struct(d2, k) of the nearest palette colour, the lowest index on ties."""
    return F.array_min(F.array(*(F.struct(squared_distance(r, g, b, p).cast("int").alias("d2"), F.lit(k).alias("k")) for k, p in enumerate(palette))))


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lpad(F.lower(F.hex(x)), 2, "0") for x in (r, g, b)))


def lod(scale: Column, dpr: Column) -> Column:
    need = scale * F.least(dpr, F.lit(1.5))
    return F.when(need <= 2, 2).when(need <= 4, 4).otherwise(8)


def world_height(width: float, metres_wide: Column, metres_high: Column) -> Column:
    return F.floor(F.lit(width) * metres_high / metres_wide + 0.5).cast("int")


def reject_reason(lon: Column, lat: Column, depth: Column) -> Column:
    """The first rule a sounding breaks: numbers, then the open region, then the sign; deep ones are listed apart."""
    west, east, south, north = M.REGION
    inside = (lon > west) & (lon < east) & (lat > south) & (lat < north)
    return (
        F.when(lon.isNull() | lat.isNull() | depth.isNull(), "bad_numeric").when(~inside, "outside_bbox").when(depth < 0, "negative_depth").when(depth > M.DEPTH_CAP, "too_deep").otherwise("ok")
    )


def speed_label(speed: Column) -> Column:
    return F.format_string("%.1f km/h", speed * 3.6)
