"""The registered queries and the SQL that checks them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom import model as M
from fathom.functions import exprs as E
from fathom.operators import calibrate, contour, curves, distance, kernels, mapping, overlay, qc, raster, relational, spatial, tiles
from fathom.plans import carriers as C
from fathom.plans.carriers import NX, NY, sql
from fathom.shared import Tables, checkpointed
from fathom.sources import pages, sinks, survey, text
from fathom.streaming import gate, live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COS0 = spatial.metre_factor(44.966)
METRES = f"({M.METRES_PER_DEGREE!r}e0 * {COS0!r}e0)"


def query(name: str, check: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if check:
            SQL[name] = check
        return f

    return keep


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places."""
    return df.select(*(r6(f.name).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema))


# Points and levels.


@query("coord_median", sql("SELECT round(lon, 7) AS lon, round(lat, 7) AS lat, round(median(depth), 3) AS depth_m, count(*) AS n FROM soundings GROUP BY 1, 2", "soundings"))
def coord_median(spark, d):
    return relational.coordinate_median(C.soundings(spark, d))


@query("class_histogram", sql("SELECT CAST(v.k AS INT) AS k, count(r.k) AS cells FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) v(k) LEFT JOIN raster r ON r.k = v.k GROUP BY 1", "raster"))
def class_histogram(spark, d):
    return relational.class_histogram(C.raster(spark, d))


@query("class_mean", sql("SELECT round(avg(k + 0.5e0), 6) AS mean_depth, round(avg(CASE WHEN k = 7 THEN 1e0 ELSE 0e0 END), 6) AS deepest, count(*) AS n FROM raster", "raster"))
def class_mean(spark, d):
    return rounded(C.raster(spark, d).agg(relational.class_mean(F.col("k")).alias("mean_depth"), F.avg((F.col("k") == 7).cast("double")).alias("deepest"), F.count(F.lit(1)).alias("n")))


def _index(lon: str = "lon", lat: str = "lat") -> tuple[str, str]:
    r = C.GRID.ref
    return f"CAST(floor(({lat} - {r.south}e0) / ({r.north}e0 - {r.south}e0) * {C.GRID.ny - 1}e0 + 0.5e0) AS INT)", f"CAST(floor(({lon} - ({r.west}e0)) / ({r.east}e0 - ({r.west}e0)) * {C.GRID.nx - 1}e0 + 0.5e0) AS INT)"


_IY, _IX = _index()


@query("cell_lookup", sql(f"SELECT f.event_id, f.y, f.x, c.k FROM (SELECT event_id, {_IY} AS y, {_IX} AS x FROM fixes) f LEFT JOIN cells c ON f.y = c.y AND f.x = c.x", "fixes", "cells"))
def cell_lookup(spark, d):
    f = C.fixes(spark, d)
    iy, ix = E.grid_index(F.col("lon"), F.col("lat"), C.GRID)
    return spatial.cell_lookup(f, C.lookup_cells(spark, d), iy, ix).select("event_id", "y", "x", "k")


@query(
    "point_depth",
    sql(
        f"""SELECT f.event_id, f.user_id, c.k, round(c.k + s, 6) AS depth_lo, round(c.k + 1 + s, 6) AS depth_hi, round(c.k + 0.5e0 + s, 6) AS depth_mid, round(13.21e0 - (c.k + 1), 6) AS bed_lo, round(13.21e0 - c.k, 6) AS bed_hi
        FROM (SELECT *, {_IY} AS y, {_IX} AS x, 13.43e0 - 13.21e0 AS s FROM fixes) f LEFT JOIN cells c ON f.y = c.y AND f.x = c.x""",
        "fixes", "cells",
    ),
)
def point_depth(spark, d):
    """The flagship: fixes to cells to classes to depths at today's level."""
    iy, ix = E.grid_index(F.col("lon"), F.col("lat"), C.GRID)
    levels = spark.range(1).select(F.lit(C.LEVEL_NOW).alias("level"))
    got = gate.enrich(C.fixes(spark, d), C.lookup_cells(spark, d), levels, iy, ix)
    return rounded(got.select("event_id", "user_id", "k", "depth_lo", "depth_hi", "depth_mid", "bed_lo", "bed_hi"))


@query("level_shift", sql("SELECT DISTINCT c_nationkey, round(greatest(12.5e0, least(15.5e0, 12 + c_nationkey / 5e0)), 2) AS level, k, round(k + (round(greatest(12.5e0, least(15.5e0, 12 + c_nationkey / 5e0)), 2) - 13.21e0), 6) AS depth_lo, round(k + 1 + (round(greatest(12.5e0, least(15.5e0, 12 + c_nationkey / 5e0)), 2) - 13.21e0), 6) AS depth_hi FROM customer, (VALUES (0), (2), (7)) v(k)", "raster"))
def level_shift(spark, d):
    level = E.clamp_level(F.lit(12) + F.col("c_nationkey") / 5.0)
    rows = C.table(spark, d, "customer").select("c_nationkey", level.alias("level")).distinct().select("*", F.explode(F.array(F.lit(0), F.lit(2), F.lit(7))).alias("k"))
    return rounded(rows.select("c_nationkey", "level", "k", *E.band_info(F.col("k"), F.col("level"))).select("c_nationkey", "level", "k", "depth_lo", "depth_hi"))


_REASON = "CASE WHEN lon IS NULL OR lat IS NULL OR depth IS NULL THEN 'bad_numeric' WHEN NOT (lon > -1.25e0 AND lon < -1e0 AND lat > 44.85e0 AND lat < 45.1e0) THEN 'outside_bbox' WHEN depth < 0 THEN 'negative_depth' WHEN depth > 8 THEN 'too_deep' ELSE 'ok' END"


@query("reject_audit", sql(f"SELECT {_REASON} AS reason, code, count(*) AS n FROM (SELECT code, lon - CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS lon, lat, CASE WHEN l_linenumber = 6 THEN NULL ELSE depth - CASE WHEN l_linenumber = 5 THEN 1 ELSE 0 END END AS depth FROM soundings) GROUP BY 1, 2", "soundings"))
def reject_audit(spark, d):
    n = F.col("l_linenumber")
    s = C.soundings(spark, d).withColumns({"lon": F.col("lon") - F.when(n == 7, 1).otherwise(0), "depth": F.when(n != 6, F.col("depth") - F.when(n == 5, 1).otherwise(0))})
    return s.select(E.reject_reason(F.col("lon"), F.col("lat"), F.col("depth")).alias("reason"), "code").groupBy("reason", "code").agg(F.count(F.lit(1)).alias("n"))


@query("name_match", "SELECT doc_id, regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g') AS name FROM documents WHERE contains(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g'), 'ion') OR source IN ('src3', 'src49') OR ends_with(source, '9')")
def name_match(spark, d):
    name = E.normal_name(F.col("text"))
    return C.table(spark, d, "documents").select("doc_id", name.alias("name"), "source").where(F.col("name").contains("ion") | F.col("source").isin("src3", "src49") | F.col("source").endswith("9")).select("doc_id", "name")


@query("decimal_comma", "SELECT event_id, try_cast(replace(trim(v), ',', '.') AS DOUBLE) AS value FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN ' n/a ' ELSE ' ' || replace(printf('%.2f', value), '.', ',') || ' ' END AS v FROM events)")
def decimal_comma(spark, d):
    v = F.when(F.col("event_id") % 10 == 0, F.lit(" n/a ")).otherwise(F.concat(F.lit(" "), F.replace(F.format_string("%.2f", "value"), F.lit("."), F.lit(",")), F.lit(" ")))
    return C.table(spark, d, "events").select("event_id", E.decimal_comma(v).alias("value"))


@query("last_row_wins", sql("SELECT code, name, arg_max(depth, (date, l_orderkey, l_linenumber, lon, lat, depth)) AS depth, arg_min(depth, (date, l_orderkey, l_linenumber, lon, lat, depth)) AS first_depth FROM soundings GROUP BY 1, 2", "soundings"))
def last_row_wins(spark, d):
    order = ("date", "l_orderkey", "l_linenumber", "lon", "lat", "depth")
    s = C.soundings(spark, d)
    first = relational.first_row(s, ["code", "name"], order, ["depth"]).withColumnRenamed("depth", "first_depth")
    return relational.last_row(s, ["code", "name"], order, ["depth"]).join(first, ["code", "name"])


@query("bin_thinning", sql(f"SELECT CAST(floor((lon - (-1.2e0)) * {METRES} / 3e2) AS BIGINT) AS bx, CAST(floor((lat - 44.93e0) * {M.METRES_PER_DEGREE!r}e0 / 3e2) AS BIGINT) AS by, round(median(lon), 6) AS lon, round(median(lat), 6) AS lat, round(median(depth), 6) AS depth, count(*) AS n FROM soundings GROUP BY 1, 2", "soundings"))
def bin_thinning(spark, d):
    x, y = E.metres(F.col("lon"), F.col("lat"), -1.2, 44.93, COS0)
    return rounded(relational.bin_thinning(C.soundings(spark, d), x, y, 300.0))


@query("bbox_summary", sql(f"SELECT round(min(lon), 6) AS west, round(max(lon), 6) AS east, round(min(lat), 6) AS south, round(max(lat), 6) AS north, round((max(lon) - min(lon)) * {METRES}, 6) AS metres_wide, round((max(lat) - min(lat)) * {M.METRES_PER_DEGREE!r}e0, 6) AS metres_high, CAST(floor(1e3 * ((max(lat) - min(lat)) * {M.METRES_PER_DEGREE!r}e0) / ((max(lon) - min(lon)) * {METRES}) + 0.5e0) AS INT) AS world_height, round(median(depth), 6) AS median_depth FROM soundings", "soundings"))
def bbox_summary(spark, d):
    b = C.soundings(spark, d).agg(F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.median("depth").alias("median_depth"))
    b = b.withColumns({"metres_wide": (F.col("east") - F.col("west")) * (M.METRES_PER_DEGREE * COS0), "metres_high": (F.col("north") - F.col("south")) * M.METRES_PER_DEGREE})
    return rounded(b.select("west", "east", "south", "north", "metres_wide", "metres_high", E.world_height(1000.0, F.col("metres_wide"), F.col("metres_high")).alias("world_height"), "median_depth"))


@query("percentile_by_code", sql("SELECT code, round(quantile_cont(depth, 0.5), 6) AS p50, round(quantile_cont(depth, 0.95), 6) AS p95, round(quantile_cont(depth, 0.99), 6) AS p99 FROM soundings GROUP BY 1", "soundings"))
def percentile_by_code(spark, d):
    return rounded(C.soundings(spark, d).groupBy("code").agg(*relational.percentiles(F.col("depth"), (0.5, 0.95, 0.99))))


@query("value_counts", sql("SELECT r * 65536 + g * 256 + b AS colour, '#' || lpad(lower(hex(r)), 2, '0') || lpad(lower(hex(g)), 2, '0') || lpad(lower(hex(b)), 2, '0') AS hex, count(*) AS n FROM colours GROUP BY 1, 2 ORDER BY n DESC, hex LIMIT 20", "colours"))
def value_counts(spark, d):
    c = C.colours(spark, d).select((F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).alias("colour"), E.hex_colour(F.col("r"), F.col("g"), F.col("b")).alias("hex"))
    return c.groupBy("colour", "hex").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "hex").limit(20)


@query("distinct_values", "SELECT lang, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM documents GROUP BY 1")
def distinct_values(spark, d):
    return C.table(spark, d, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def _lambert_sql() -> str:
    n, c, y0, e = E.lambert93_constants()
    iso = f"(ln(tan(radians(lat) / 2 + {math.pi / 4!r}e0)) + ln((1 - {e!r}e0 * sin(radians(lat))) / (1 + {e!r}e0 * sin(radians(lat)))) * {e / 2!r}e0)"
    return f"r AS (SELECT DISTINCT lon, lat, {c!r}e0 * exp(-{n!r}e0 * {iso}) AS r, radians(lon - 3) * {n!r}e0 AS g FROM soundings) SELECT lon, lat, round(r * sin(g) + 7e5, 2) AS east, round({y0!r}e0 - r * cos(g), 2) AS north FROM r"


@query("lambert93", sql(_lambert_sql(), "soundings"))
def lambert93(spark, d):
    x, y = E.lambert93(F.col("lon"), F.col("lat"))
    return C.soundings(spark, d).select("lon", "lat").distinct().select("lon", "lat", F.round(x, 2).alias("east"), F.round(y, 2).alias("north"))


# Surveys and rasters.

_AGREE = "count(*) AS n, round(avg(CASE WHEN a.k = b.k THEN 1e0 ELSE 0e0 END), 6) AS exact, round(avg(CASE WHEN abs(a.k - b.k) <= 1 THEN 1e0 ELSE 0e0 END), 6) AS within1, round(avg(CAST(abs(a.k - b.k) AS DOUBLE)), 6) AS mae, round(avg(CAST(a.k - b.k AS DOUBLE)), 6) AS bias"


@query("survey_agreement", sql(f"SELECT {_AGREE} FROM raster a JOIN raster_b b ON a.y = b.y AND a.x = b.x WHERE a.y % 2 = 0 AND a.x % 2 = 0", "raster", "raster_b"))
def survey_agreement(spark, d):
    both = raster.overlay(C.raster(spark, d), C.raster(spark, d, odd=True)).where("a is not null and b is not null and y % 2 = 0 and x % 2 = 0")
    return rounded(both.agg(*relational.agreement(F.col("a"), F.col("b"))))


@query("orientation_sweep", sql(f"SELECT v.flip_y, v.flip_x, v.swap, {_AGREE} FROM raster a CROSS JOIN (SELECT * FROM (VALUES (0), (1)) p(flip_y), (VALUES (0), (1)) q(flip_x), (VALUES (0), (1)) s(swap)) v JOIN raster_b b ON b.y = CASE WHEN v.swap = 1 THEN CASE WHEN flip_x = 1 THEN 127 - a.x ELSE a.x END ELSE CASE WHEN flip_y = 1 THEN 95 - a.y ELSE a.y END END AND b.x = CASE WHEN v.swap = 1 THEN CASE WHEN flip_y = 1 THEN 95 - a.y ELSE a.y END ELSE CASE WHEN flip_x = 1 THEN 127 - a.x ELSE a.x END END GROUP BY 1, 2, 3 ORDER BY exact DESC, within1 DESC", "raster", "raster_b"))
def orientation_sweep(spark, d):
    a, b = C.raster(spark, d), C.raster(spark, d, odd=True).withColumnRenamed("k", "b")
    variants = F.array(*(F.struct(F.lit(p).alias("flip_y"), F.lit(q).alias("flip_x"), F.lit(s).alias("swap")) for p in (0, 1) for q in (0, 1) for s in (0, 1)))
    v = a.select("y", "x", F.col("k").alias("a"), F.explode(variants).alias("v")).select("y", "x", "a", "v.*")
    fy, fx = F.when(F.col("flip_y") == 1, NY - 1 - F.col("y")).otherwise(F.col("y")), F.when(F.col("flip_x") == 1, NX - 1 - F.col("x")).otherwise(F.col("x"))
    v = v.select("flip_y", "flip_x", "swap", "a", F.when(F.col("swap") == 1, fx).otherwise(fy).alias("y"), F.when(F.col("swap") == 1, fy).otherwise(fx).alias("x"))
    return rounded(v.join(b, ["y", "x"]).groupBy("flip_y", "flip_x", "swap").agg(*relational.agreement(F.col("a"), F.col("b")))).orderBy(F.desc("exact"), F.desc("within1"))


@query("raster_iou", sql("SELECT t, count(*) FILTER (a >= t AND b >= t) AS \"both\", count(*) FILTER (a >= t OR b >= t) AS either, round(count(*) FILTER (a >= t AND b >= t) / nullif(count(*) FILTER (a >= t OR b >= t), 0)::DOUBLE, 6) AS iou, round(count(*) FILTER (a >= t) / nullif(count(*) FILTER (b >= t), 0)::DOUBLE, 6) AS area_ratio FROM (SELECT coalesce(p.k, -1) AS a, coalesce(q.k, -1) AS b FROM raster p FULL JOIN raster_b q ON p.y = q.y AND p.x = q.x), (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) v(t) GROUP BY 1", "raster", "raster_b"))
def raster_iou(spark, d):
    both = raster.overlay(C.raster(spark, d), C.raster(spark, d, odd=True)).select(F.coalesce("a", F.lit(-1)).alias("a"), F.coalesce("b", F.lit(-1)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("t"))
    return rounded(both.groupBy("t").agg(*relational.overlap(F.col("a") >= F.col("t"), F.col("b") >= F.col("t"))))


@query("class_edges", sql("SELECT DISTINCT a.y, a.x, a.k FROM raster a JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) v(dy, dx) ON true JOIN raster b ON b.y = a.y + dy AND b.x = a.x + dx WHERE a.k != b.k", "raster"))
def class_edges(spark, d):
    return raster.boundary(C.raster(spark, d))


_NEAR = ", ".join(f"{{'d2': CAST((r - {p[0]}) * (r - {p[0]}) + (g - {p[1]}) * (g - {p[1]}) + (b - {p[2]}) * (b - {p[2]}) AS INT), 'k': {k}}}" for k, p in enumerate(M.DISPLAY_PALETTE))


@query("nearest_palette", sql(f"SELECT p_partkey, n.d2 AS d2, CAST(n.k AS INT) AS k FROM (SELECT p_partkey, list_min([{_NEAR}]) AS n FROM colours)", "colours"))
def nearest_palette(spark, d):
    c = C.colours(spark, d)
    return c.select("p_partkey", E.nearest_colour(F.col("r"), F.col("g"), F.col("b"), M.DISPLAY_PALETTE).alias("n")).select("p_partkey", "n.d2", "n.k")


@query("color_stats", sql("SELECT round(avg(r), 6) AS mean_r, round(stddev_pop(r), 6) AS std_r, round(avg(g), 6) AS mean_g, round(stddev_pop(g), 6) AS std_g, round(avg(CASE WHEN (r - 50) * (r - 50) + (g - 127) * (g - 127) + (b - 205) * (b - 205) < 3600 THEN 1e0 ELSE 0e0 END), 6) AS near FROM colours", "colours"))
def color_stats(spark, d):
    r, g, b = (F.col(c) for c in "rgb")
    return rounded(C.colours(spark, d).agg(F.avg(r).alias("mean_r"), F.stddev_pop(r).alias("std_r"), F.avg(g).alias("mean_g"), F.stddev_pop(g).alias("std_g"), F.avg((E.squared_distance(r, g, b, M.DISPLAY_PALETTE[5]) < 60 * 60).cast("double")).alias("near")))


@query("mask_stats", sql("SELECT count(*) FILTER (w) AS before, count(*) FILTER (w AND p) AS after, count(*) FILTER (w) - count(*) FILTER (w AND p) AS removed, round((count(*) FILTER (w) - count(*) FILTER (w AND p)) / greatest(count(*) FILTER (w), 1)::DOUBLE, 6) AS removed_fraction, count(*) FILTER (NOT p) AS masked_cells FROM (SELECT a.k IS NOT NULL AND a.k > 0 AS w, coalesce(b.k, 0) < 4 AS p FROM raster a LEFT JOIN raster_b b ON a.y = b.y AND a.x = b.x)", "raster", "raster_b"))
def mask_stats(spark, d):
    both = raster.overlay(C.raster(spark, d), C.raster(spark, d, odd=True))
    return rounded(both.agg(*relational.mask_report(F.coalesce(F.col("a") > 0, F.lit(False)), F.coalesce("b", F.lit(0)) < 4)))


@query("morph_dilate", sql("SELECT DISTINCT y + dy AS y, x + dx AS x FROM raster, (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) v(dy, dx) WHERE k >= 5 AND y + dy BETWEEN 0 AND 95 AND x + dx BETWEEN 0 AND 127", "raster"))
def morph_dilate(spark, d):
    return raster.dilate(C.raster(spark, d).where("k >= 5").select("y", "x"), NY, NX)


@query("morph_close", sql("s AS (SELECT * FROM (VALUES (-1), (0), (1)) p(dy), (VALUES (-1), (0), (1)) q(dx)), g AS (SELECT DISTINCT y + dy AS y, x + dx AS x FROM raster, s WHERE k >= 5 AND y + dy BETWEEN 0 AND 95 AND x + dx BETWEEN 0 AND 127) SELECT y + dy AS y, x + dx AS x FROM g, s WHERE y + dy BETWEEN 0 AND 95 AND x + dx BETWEEN 0 AND 127 GROUP BY 1, 2 HAVING count(*) = 9", "raster"))
def morph_close(spark, d):
    return raster.close(C.raster(spark, d).where("k >= 5").select("y", "x"), NY, NX)


@query("morph_open", sql("e AS (SELECT y + dy AS y, x + dx AS x FROM raster, (VALUES (0, 0), (0, -1), (-1, 0), (-1, -1)) v(dy, dx) WHERE k >= 3 GROUP BY 1, 2 HAVING count(*) = 4) SELECT DISTINCT y + dy AS y, x + dx AS x FROM e, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(dy, dx)", "raster"))
def morph_open(spark, d):
    pair = [(0, 0), (0, 1), (1, 0), (1, 1)]
    mask = C.raster(spark, d).where("k >= 3").select("y", "x")
    eroded = raster.erode(mask, NY, NX, pair)
    return raster.dilate(eroded, NY, NX, pair)


_REACH = "m AS (SELECT y, x FROM raster WHERE k >= 5), reach AS (SELECT y, x, y AS ry, x AS rx FROM m UNION SELECT r.y, r.x, m.y, m.x FROM reach r, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) v(dy, dx), m WHERE m.y = r.ry + v.dy AND m.x = r.rx + v.dx), labels AS (SELECT y, x, min(ry * 4294967296 + rx) AS component FROM reach GROUP BY 1, 2)"


@query("components", sql(_REACH + " SELECT y, x, component FROM labels", "raster", recursive=True))
def components(spark, d):
    return kernels.components_by_blocks(C.raster(spark, d).where("k >= 5").select("y", "x"), 32)


@query("largest_component", sql(_REACH + " SELECT component, count(*) AS cells FROM labels GROUP BY 1 ORDER BY cells DESC, component LIMIT 1", "raster", recursive=True))
def largest_component(spark, d):
    return components(spark, d).groupBy("component").agg(F.count(F.lit(1)).alias("cells")).orderBy(F.desc("cells"), "component").limit(1)


@query("small_holes", sql("full_grid AS (SELECT y, x FROM range(96) a(y), range(128) b(x)), m AS (SELECT g.y, g.x FROM full_grid g LEFT JOIN raster r ON r.y = g.y AND r.x = g.x WHERE coalesce(r.k, -1) < 3), reach AS (SELECT y, x, y AS ry, x AS rx FROM m UNION SELECT r.y, r.x, m.y, m.x FROM reach r, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) v(dy, dx), m WHERE m.y = r.ry + v.dy AND m.x = r.rx + v.dx), labels AS (SELECT y, x, min(ry * 4294967296 + rx) AS component FROM reach GROUP BY 1, 2), s AS (SELECT component, count(*) AS cells, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM labels GROUP BY 1) SELECT component, cells FROM s WHERE cells <= 9 AND y0 > 0 AND y1 < 95 AND x0 > 0 AND x1 < 127", "raster", recursive=True))
def small_holes(spark, d):
    every = spark.range(NY * NX).select(F.floor(F.col("id") / NX).cast("int").alias("y"), (F.col("id") % NX).cast("int").alias("x"))
    holes = every.join(C.raster(spark, d).where("k >= 3"), ["y", "x"], "left_anti")
    s = kernels.components_by_blocks(holes, 32).groupBy("component").agg(F.count(F.lit(1)).alias("cells"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    return s.where((F.col("cells") <= 9) & (F.col("y0") > 0) & (F.col("y1") < NY - 1) & (F.col("x0") > 0) & (F.col("x1") < NX - 1)).select("component", "cells")


@query("nearest_fill", sql("have AS (SELECT y, x, k FROM raster WHERE k >= 3), g AS (SELECT CAST(a.y AS INT) AS y, CAST(b.x AS INT) AS x FROM range((SELECT max(y) + 1 FROM have)) a(y), range((SELECT max(x) + 1 FROM have)) b(x)) SELECT g.y, g.x, arg_min(h.k, CAST((g.y - h.y) * (g.y - h.y) + (g.x - h.x) * (g.x - h.x) AS BIGINT) * 1000000 + h.y * 1000 + h.x) AS k FROM g, have h GROUP BY 1, 2", "raster"))
def nearest_fill(spark, d):
    """Every cell of the grid gets the class of the nearest that has one."""
    have = C.raster(spark, d).where("k >= 3")
    size = have.agg(F.max("y"), F.max("x")).first()
    return distance.nearest_sources(have, (size[0] or 0) + 1, (size[1] or 0) + 1, strip_cells=1 << 11).select("y", "x", "k")


_KERNEL = "w AS (SELECT CAST(d AS INT) AS d, exp(-0.5e0 * (d / 1.3e0) * (d / 1.3e0)) AS w FROM range(-5, 6) v(d)), n AS (SELECT d, w / (SELECT sum(w) FROM w) AS w FROM w), a AS (SELECT y + d AS y, x, sum(w) AS v FROM raster, n WHERE k >= 4 GROUP BY 1, 2)"


@query("gaussian_blur", sql(_KERNEL + " SELECT y, x + d AS x, round(sum(v * w), 6) AS occ FROM a, n GROUP BY 1, 2", "raster"))
def gaussian_blur(spark, d):
    return rounded(raster.occupancy(C.raster(spark, d).where("k >= 4"), 1.3, F.lit(1.0)))


def _contour_sql(rounds: int = 15) -> str:
    """Rings by doubling: the least point ahead within 2, 4, .. steps."""
    side = {0: "(y + 1) * 4294967296 + (x + 1) * 2", 1: "(y + 1) * 4294967296 + (x + 2) * 2 + 1", 2: "(y + 2) * 4294967296 + (x + 1) * 2", 3: "(y + 1) * 4294967296 + (x + 1) * 2 + 1"}
    cases = " UNION ALL ".join(f"SELECT t, {side[a]} AS node, {side[b]} AS nxt FROM squares WHERE c = {c}" for c, pairs in kernels.CASES.items() for a, b in pairs)
    doubled = ", ".join(f"r{k + 1} AS MATERIALIZED (SELECT a.t, a.node, b.nxt, least(a.m, b.m) AS m FROM r{k} a JOIN r{k} b ON b.t = a.t AND b.node = a.nxt)" for k in range(rounds))
    px = lambda n: f"((({n} & 4294967295) >> 1) - 1 + CASE WHEN {n} & 1 = 1 THEN 0 ELSE 0.5e0 END)"
    py = lambda n: f"(({n} >> 32) - 1 + CASE WHEN {n} & 1 = 1 THEN 0.5e0 ELSE 0 END)"
    area = f"{px('l.node')} * {py('l.nxt')} - {px('l.nxt')} * {py('l.node')}"
    return sql(
        f"""masks AS (SELECT CAST(t AS INT) AS t, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM raster, range(8) v(t) WHERE t <= k),
squares AS (SELECT t, y - dy AS y, x - dx AS x, sum(b) AS c FROM masks, (VALUES (0, 0, 1), (0, 1, 2), (1, 1, 4), (1, 0, 8)) v(dy, dx, b) GROUP BY ALL),
links AS MATERIALIZED ({cases}), r0 AS (SELECT t, node, nxt, node AS m FROM links), {doubled}
SELECT l.t, r.m AS ring_id, count(*) AS points, sum({area}) / 2 AS area FROM links l JOIN r{rounds} r ON r.t = l.t AND r.node = l.node GROUP BY 1, 2""",
        "raster",
    )


@query("marching_squares", _contour_sql())
def marching_squares(spark, d):
    """Points and signed area of every ring of every threshold's contours."""
    around = Window.partitionBy("t", "ring_id").orderBy("i")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(around), F.first(c).over(whole))
    p = contour.rings(raster.thresholds(C.raster(spark, d)), tile=32).withColumns({"nx": after("x"), "ny": after("y")})
    return p.groupBy("t", "ring_id").agg(F.count(F.lit(1)).alias("points"), (F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2).alias("area"))


_MASKS = "masks AS (SELECT y, x, CAST(t AS INT) AS t FROM raster, range(8) v(t) WHERE t <= k AND NOT (t = 2 AND (y + x) % 5 = 0))"


@query("nesting_check", sql(_MASKS + " SELECT t, count(*) AS faults FROM masks m WHERE t > 0 AND NOT EXISTS (SELECT 1 FROM masks b WHERE b.y = m.y AND b.x = m.x AND b.t = m.t - 1) GROUP BY 1", "raster"))
def nesting_check(spark, d):
    return raster.nesting_faults(raster.thresholds(C.raster(spark, d)).where("not (t = 2 and (y + x) % 5 = 0)"))


@query("cart_class", sql(_MASKS + ", c AS (SELECT y, x, t FROM (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY t) AS r FROM masks) WHERE r = t + 1) SELECT y, x, max(t) AS k FROM c GROUP BY 1, 2", "raster"))
def cart_class(spark, d):
    return raster.top_class(raster.parent_clip(raster.thresholds(C.raster(spark, d)).where("not (t = 2 and (y + x) % 5 = 0)")))


_EDGE = "SELECT DISTINCT a.y, a.x FROM {0} a, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) v(dy, dx), {0} b WHERE b.y = a.y + dy AND b.x = a.x + dx AND a.k >= 5 AND b.k < 5"


@query("boundary_distance", sql(f"p AS ({_EDGE.format('raster')}), q AS ({_EDGE.format('raster_b')}), d AS (SELECT p.y, p.x, q.y AS qy, q.x AS qx, (p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x) AS d2 FROM p, q), n AS (SELECT sqrt(min(d2)) AS v FROM d GROUP BY y, x UNION ALL SELECT sqrt(min(d2)) AS v FROM d GROUP BY qy, qx) SELECT count(*) AS n, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99, round(max(v), 6) AS most FROM n", "raster", "raster_b"))
def boundary_distance(spark, d):
    """Distances from each boundary to the other, both ways."""

    def edge(cells: DataFrame) -> DataFrame:
        m = cells.select("y", "x", F.when(F.col("k") >= 5, 1).otherwise(0).alias("k"))
        return raster.boundary(m).where("k = 1").select("y", "x", "k")

    p, q = edge(C.raster(spark, d)), edge(C.raster(spark, d, odd=True))
    one_way = lambda a, b: distance.nearest_sources(b, NY, NX, strip_cells=1 << 11).select("y", "x", "d2").join(a, ["y", "x"]).select(F.sqrt("d2").alias("v"))
    near = one_way(p, q).unionByName(one_way(q, p))
    return rounded(near.agg(F.count(F.lit(1)).alias("n"), *relational.percentiles(F.col("v"), (0.95, 0.99)), F.max("v").alias("most")))


@query("grid_pack", sql("g AS (SELECT a.y, b.x, r.k FROM range(96) a(y) CROSS JOIN range(128) b(x) LEFT JOIN raster r ON r.y = a.y AND r.x = b.x) SELECT CAST(y AS INT) AS y, string_agg(coalesce(CAST(k AS VARCHAR), '.'), '' ORDER BY x) AS line FROM g GROUP BY 1", "raster"))
def grid_pack(spark, d):
    every = spark.range(NY * NX).select(F.floor(F.col("id") / NX).cast("int").alias("y"), (F.col("id") % NX).cast("int").alias("x"))
    return raster.pack_rows(every.join(C.raster(spark, d), ["y", "x"], "left"))


@query("strip_stitch", "WITH s AS (SELECT CAST(s_nationkey AS INT) AS strip, CAST(s_nationkey * 3 AS INT) AS y0, CAST(count(*) AS INT) AS n FROM supplier GROUP BY 1, 2), l AS (SELECT strip, CAST(y0 + i AS INT) AS y, strip * 100 + i AS line FROM s, range(5) v(i)) SELECT y, CAST(arg_max(line, strip) AS INT) AS line, max(strip) AS strip FROM l GROUP BY 1")
def strip_stitch(spark, d):
    s = C.table(spark, d, "supplier").select(F.col("s_nationkey").cast("int").alias("strip")).distinct()
    s = s.select("strip", (F.col("strip") * 3).alias("y0"), F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (F.col("strip") * 100 + i).cast("int")).alias("rows"))
    return raster.stripes(s)


# Spatial joins.

_CROSS = "(y1 > y) != (y2 > y) AND x < (x2 - x1) * (y - y1) / (CASE WHEN y2 = y1 THEN 1e0 ELSE y2 - y1 END) + x1"
_INSIDE = f"hits AS (SELECT r.y, r.x, geom_id, ring FROM (SELECT y, x FROM raster) r, edges WHERE {_CROSS} GROUP BY 1, 2, 3, 4 HAVING count(*) % 2 = 1), inside AS (SELECT y, x, geom_id FROM hits GROUP BY 1, 2, 3 HAVING max(CASE WHEN ring = 0 THEN 1 ELSE 0 END) = 1 AND sum(CASE WHEN ring > 0 THEN 1 ELSE 0 END) = 0)"


def _cells_with_key(spark, d) -> tuple[DataFrame, DataFrame]:
    cells = C.raster(spark, d).withColumn("cell", F.col("y") * 1000 + F.col("x"))
    return cells, spatial.edges_of(C.polygons(spark))


@query("pip_holes", sql(_INSIDE + " SELECT y * 1000 + x AS cell, CAST(geom_id AS BIGINT) AS geom_id FROM inside", "raster", "edges"))
def pip_holes(spark, d):
    cells, edges = _cells_with_key(spark, d)
    return spatial.points_in_polygons(cells, edges, "cell", bin_size=8.0)


@query("shore_semi", sql(_INSIDE + " SELECT k, count(*) AS n FROM raster r WHERE EXISTS (SELECT 1 FROM inside i WHERE i.y = r.y AND i.x = r.x) GROUP BY 1", "raster", "edges"))
def shore_semi(spark, d):
    cells, edges = _cells_with_key(spark, d)
    return relational.counter(spatial.keep_inside(cells, edges, "cell", bin_size=8.0), "k")


@query("island_anti", sql(_INSIDE + " SELECT k, count(*) AS n FROM raster r WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.y = r.y AND i.x = r.x) GROUP BY 1", "raster", "edges"))
def island_anti(spark, d):
    cells, edges = _cells_with_key(spark, d)
    return relational.counter(spatial.drop_inside(cells, edges, "cell", bin_size=8.0), "k")


@query("even_odd_union", sql(f"SELECT r.y * 1000 + r.x AS cell FROM (SELECT y, x FROM raster) r, edges WHERE {_CROSS} GROUP BY 1 HAVING count(*) % 2 = 1", "raster", "edges"))
def even_odd_union(spark, d):
    cells, edges = _cells_with_key(spark, d)
    return spatial.even_odd(cells, edges, "cell", bin_size=8.0)


@query("polygon_area", sql("SELECT k, round(sum(d) / 2, 6) AS area FROM (SELECT k, ring_id, abs(sum(x * ny - nx * y)) AS d FROM around GROUP BY 1, 2) GROUP BY 1", "rings", "around"))
def polygon_area(spark, d):
    """Area of the rings of each class."""
    return rounded(curves.category_area(C.rings(spark, d), "k"))


_NODES = "nodes AS (SELECT CAST(iy * 100 + ix AS BIGINT) AS q, 17e0 + ix * 313e0 AS x, 11e0 + iy * 271e0 AS y FROM range(30) a(iy), range(30) b(ix)), pts AS (SELECT x, y, median(depth) AS depth FROM (SELECT (lon - (-1.2e0)) * " + METRES + f" AS x, (lat - 44.93e0) * {M.METRES_PER_DEGREE!r}e0 AS y, depth FROM soundings) GROUP BY 1, 2), near AS (SELECT q, (p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y) AS d2, depth FROM nodes n, pts p), top AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, depth) AS r FROM near QUALIFY r <= 16), z AS (SELECT q, sum(1e0 / (d2 + 144e0) * depth) / sum(1e0 / (d2 + 144e0)) AS z, sqrt(min(d2)) AS nearest FROM top GROUP BY 1)"


def _interpolated(spark, d) -> DataFrame:
    x, y = E.metres(F.col("lon"), F.col("lat"), -1.2, 44.93, COS0)
    pts = C.soundings(spark, d).select(x.alias("x"), y.alias("y"), "depth").groupBy("x", "y").agg(F.median("depth").alias("depth"))
    nodes = spark.range(900).select((F.floor(F.col("id") / 30) * 100 + F.col("id") % 30).alias("q"), (F.lit(17.0) + (F.col("id") % 30) * 313.0).alias("x"), (F.lit(11.0) + F.floor(F.col("id") / 30) * 271.0).alias("y"))
    return spatial.idw(spatial.nearest(nodes, pts, M.IDW_NEIGHBOURS, 200.0, ("depth",)))


@query("knn_idw", sql(_NODES + " SELECT q, round(z, 5) AS z, round(nearest, 5) AS nearest FROM z", "soundings"))
def knn_idw(spark, d):
    return _interpolated(spark, d).select("q", F.round("z", 5).alias("z"), F.round("nearest", 5).alias("nearest"))


@query("confidence_bands", sql(_NODES + " SELECT CAST(CASE WHEN nearest <= 75 THEN 3 WHEN nearest <= 175 THEN 2 WHEN nearest <= 325 THEN 1 ELSE 0 END AS INT) AS confidence, round(round_even(greatest(0e0, least(8e0, z)) / 5e-2, 0) * 5e-2, 6) AS depth, count(*) AS n FROM z GROUP BY 1, 2", "soundings"))
def confidence_bands(spark, d):
    return _interpolated(spark, d).groupBy(E.confidence(F.col("nearest")).alias("confidence"), r6(E.quantise(F.col("z"))).alias("depth")).agg(F.count(F.lit(1)).alias("n"))


@query("bilinear_sample", sql("p AS (SELECT event_id, (event_id % 941) / 1e1 AS fy, (event_id % 1259) / 1e1 AS fx FROM events), n AS (SELECT event_id, CAST(floor(fy) AS INT) + dy AS y, CAST(floor(fx) AS INT) + dx AS x, (CASE WHEN dy = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE WHEN dx = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w FROM p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(dy, dx)) SELECT event_id, round(CASE WHEN sum(CASE WHEN k IS NULL THEN 0 ELSE w END) > 0.5 THEN sum(CASE WHEN k IS NULL THEN 0 ELSE w * (k + 0.5e0) END) / sum(CASE WHEN k IS NULL THEN 0 ELSE w END) END, 5) AS z FROM n LEFT JOIN raster r ON r.y = n.y AND r.x = n.x GROUP BY 1", "raster"))
def bilinear_sample(spark, d):
    points = C.table(spark, d, "events").select("event_id", ((F.col("event_id") % 941) / 10.0).alias("fy"), ((F.col("event_id") % 1259) / 10.0).alias("fx"))
    cells = C.raster(spark, d).withColumn("z", F.col("k") + 0.5)
    return spatial.bilinear(points, cells, F.col("fy"), F.col("fx"), "event_id").select("event_id", F.round("z", 5).alias("z"))


@query("seed_components", sql(_REACH + ", s AS (SELECT component, count(*) AS area, max(CASE WHEN y = 40 AND x = 60 THEN 1 ELSE 0 END) = 1 AS holds_seed FROM labels GROUP BY 1), b AS (SELECT bool_or(holds_seed) AS any_seed, max(area) AS most FROM s) SELECT component, area, holds_seed FROM s, b WHERE (any_seed AND holds_seed) OR (NOT any_seed AND area = most)", "raster", recursive=True))
def seed_components(spark, d):
    s = components(spark, d).groupBy("component").agg(F.count(F.lit(1)).alias("area"), F.max((F.col("y") == 40) & (F.col("x") == 60)).alias("holds_seed"))
    return spatial.seeded(checkpointed(s))


# Rings.


@query("ring_metrics", sql("SELECT k, ring_id, count(*) AS n, round(sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))), 5) AS perimeter, round(sum(x * ny - nx * y) / 2, 5) AS area, round(sqrt(avg(((px - x * 2 + nx) * (px - x * 2 + nx) + (py - y * 2 + ny) * (py - y * 2 + ny)) / 4)), 5) AS roughness FROM around GROUP BY 1, 2", "rings", "around"))
def ring_metrics(spark, d):
    m = curves.metrics(C.rings(spark, d))
    return m.select("k", "ring_id", "n", *(F.round(c, 5).alias(c) for c in ("perimeter", "area", "roughness")))


_SEG = "SELECT *, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS len FROM around"


@query("ring_densify", sql(f"s AS ({_SEG}), p AS (SELECT *, greatest(1, CAST(ceil(len / 3e1) AS INT)) AS parts FROM s) SELECT k, ring_id, i, CAST(j AS INT) AS j, round(x + (nx - x) * (j / CAST(parts AS DOUBLE)), 6) AS x, round(y + (ny - y) * (j / CAST(parts AS DOUBLE)), 6) AS y FROM p, range(20) v(j) WHERE j < parts", "rings", "around"))
def ring_densify(spark, d):
    return rounded(curves.densify(C.rings(spark, d), 30.0))


@query("chaikin", sql("SELECT k, ring_id, CAST(i * 2 + j AS INT) AS i, round(x * (1 - t) + nx * t, 6) AS x, round(y * (1 - t) + ny * t, 6) AS y FROM around, (VALUES (0, 0.25e0), (1, 0.75e0)) v(j, t)", "rings", "around"))
def chaikin(spark, d):
    return rounded(curves.chaikin(C.rings(spark, d)))


def _taubin_sql() -> str:
    step = "{1} AS (SELECT k, ring_id, i, x + ((px + nx) / 2 - x) * ({2}) AS x, y + ((py + ny) / 2 - y) * ({2}) AS y FROM (" + C.VIEWS["around"].replace("FROM rings", "FROM {0}") + "))"
    parts, now = [], "rings"
    for n, f in enumerate(["5e-1", "-53e-2"] * 2):
        parts.append(step.format(now, f"t{n}", f))
        now = f"t{n}"
    return ", ".join(parts) + f" SELECT k, ring_id, i, round(x, 10) AS x, round(y, 10) AS y FROM {now}"


@query("taubin", sql(_taubin_sql(), "rings"))
def taubin(spark, d):
    t = curves.taubin(C.rings(spark, d), 2)
    return t.select("k", "ring_id", "i", F.round("x", 10).alias("x"), F.round("y", 10).alias("y"))


_ON = f"s AS ({_SEG}), c AS (SELECT *, sum(len) OVER (PARTITION BY k, ring_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto, sum(len) OVER (PARTITION BY k, ring_id) AS total FROM s), on_ring AS (SELECT k, ring_id, f, total, p.x * (1 - t) + p.nx * t AS x, p.y * (1 - t) + p.ny * t AS y, degrees(atan2(p.ny - p.y, p.nx - p.x)) AS a FROM (SELECT k, ring_id, f, max(total) AS total, arg_min({{'x': x, 'y': y, 'nx': nx, 'ny': ny, 'len': len, 'upto': upto}}, i) AS p, (f * max(total) - (arg_min(upto, i) - arg_min(len, i))) / (arg_min(len, i) + 1e-12) AS t FROM c, (VALUES (0.46e0), (0.72e0)) v(f) WHERE upto >= f * total GROUP BY 1, 2, 3)), placed AS (SELECT k, ring_id, f, total, x, y, CASE WHEN a > 90 THEN a - 180 WHEN a < -90 THEN a + 180 ELSE a END AS angle FROM on_ring)"


@query("point_on_ring", sql(_ON + " SELECT k, ring_id, round(x, 5) AS x, round(y, 5) AS y, round(angle, 5) AS angle, round(total, 5) AS total FROM placed WHERE f < 0.5", "rings", "around"))
def point_on_ring(spark, d):
    p = curves.point_on_ring(C.rings(spark, d), F.lit(0.46))
    return p.select("k", "ring_id", *(F.round(c, 5).alias(c) for c in ("x", "y", "angle", "total")))


_LABELS = ", l AS (SELECT k, ring_id, rank FROM (SELECT k, ring_id, row_number() OVER (PARTITION BY k ORDER BY round(total, 6) DESC, ring_id) AS rank FROM placed WHERE f < 0.5 AND total >= 180) WHERE rank <= 8), cand AS (SELECT l.rank, p.*, p.x BETWEEN 15 AND 635 AND p.y BETWEEN 15 AND 465 AS ok FROM l JOIN placed p ON p.k = l.k AND p.ring_id = l.ring_id), one AS (SELECT k, min(rank) AS rank FROM cand c WHERE f < 0.5 AND ok GROUP BY 1), two AS (SELECT c.k, min(c.rank) AS rank FROM cand c JOIN one ON one.k = c.k AND c.rank > one.rank WHERE f > 0.5 AND ok GROUP BY 1) SELECT c.k, c.ring_id, round(x, 5) AS x, round(y, 5) AS y, round(angle, 5) AS angle FROM cand c WHERE (f < 0.5 AND (k, rank) IN (SELECT (k, rank) FROM one)) OR (f > 0.5 AND (k, rank) IN (SELECT (k, rank) FROM two))"


@query("label_top2", sql(_ON + _LABELS, "rings", "around"))
def label_top2(spark, d):
    """Two labels at most on the longest rings of each isobath; the choice depends on what was accepted before."""
    got = curves.labels(C.rings(spark, d), 650.0, 480.0)
    return got.select("k", "ring_id", *(F.round(c, 5).alias(c) for c in ("x", "y", "angle")))


@query("longest_rings", sql("SELECT k, ring_id, round(perimeter, 5) AS perimeter, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY round(perimeter, 5) DESC, ring_id) AS INT) AS rank FROM (SELECT k, ring_id, sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))) AS perimeter FROM around GROUP BY 1, 2)) WHERE rank <= 8", "rings", "around"))
def longest_rings(spark, d):
    m = curves.metrics(C.rings(spark, d)).select("k", "ring_id", F.round("perimeter", 5).alias("perimeter"))
    return relational.top_per_group(m, ["k"], [F.desc("perimeter"), F.col("ring_id")], 8)


@query("collinear_reduce", sql("SELECT k, ring_id, i, x, y FROM around WHERE NOT ((x - px) * (ny - y) - (y - py) * (nx - x) = 0 AND (x - px) * (nx - x) + (y - py) * (ny - y) > 0)", "rings", "around"))
def collinear_reduce(spark, d):
    return curves.collinear_free(C.rings(spark, d))


def _peucker_sql(tolerance: float) -> str:
    off = "CASE WHEN l = 0 THEN (x - ax) * (x - ax) + (y - ay) * (y - ay) ELSE ((x - ax) * dy - (y - ay) * dx) * ((x - ax) * dy - (y - ay) * dx) END"
    return sql(
        f"""n AS (SELECT k, ring_id, CAST(count(*) AS INT) AS n FROM rings GROUP BY 1, 2), p AS (SELECT k, ring_id, i, x, y FROM rings UNION ALL SELECT k, ring_id, n, x, y FROM rings JOIN n USING (k, ring_id) WHERE i = 0),
s AS (SELECT k, ring_id, 0 AS a, n AS b FROM n UNION ALL SELECT k, ring_id, unnest([a, m]), unnest([m, b]) FROM (
  SELECT k, ring_id, a, b, arg_max(i, (off, -i)) AS m, max(off) AS far, any_value(l) AS l FROM (
    SELECT *, {off} AS off FROM (SELECT s.k, s.ring_id, s.a, s.b, c.i, c.x, c.y, u.x AS ax, u.y AS ay, v.x - u.x AS dx, v.y - u.y AS dy, (v.x - u.x) * (v.x - u.x) + (v.y - u.y) * (v.y - u.y) AS l
      FROM s JOIN p u ON u.k = s.k AND u.ring_id = s.ring_id AND u.i = s.a JOIN p v ON v.k = s.k AND v.ring_id = s.ring_id AND v.i = s.b JOIN p c ON c.k = s.k AND c.ring_id = s.ring_id AND c.i > s.a AND c.i < s.b)) GROUP BY 1, 2, 3, 4)
  WHERE far > CASE WHEN l = 0 THEN 1 ELSE l END * {tolerance * tolerance!r}e0)
SELECT DISTINCT k, ring_id, i, x, y FROM p JOIN s USING (k, ring_id) WHERE p.i = s.a""",
        "rings", recursive=True,
    )


@query("douglas_peucker", _peucker_sql(4.0))
def douglas_peucker(spark, d):
    return curves.simplified(C.rings(spark, d), 4.0)


_MEET = """z AS (SELECT k, ring_id, i, x AS ax, y AS ay, nx AS bx, ny AS by FROM around), m AS (SELECT a.k, a.ring_id FROM z a JOIN z b ON b.k = a.k AND b.ring_id = a.ring_id AND a.i + 1 < b.i AND b.i - a.i < 11
WHERE sign((a.bx - a.ax) * (b.ay - a.ay) - (a.by - a.ay) * (b.ax - a.ax)) * sign((a.bx - a.ax) * (b.by - a.ay) - (a.by - a.ay) * (b.bx - a.ax)) <= 0
  AND sign((b.bx - b.ax) * (a.ay - b.ay) - (b.by - b.ay) * (a.ax - b.ax)) * sign((b.bx - b.ax) * (a.by - b.ay) - (b.by - b.ay) * (a.bx - b.ax)) <= 0
  AND greatest(a.ax, a.bx) >= least(b.ax, b.bx) AND greatest(b.ax, b.bx) >= least(a.ax, a.bx) AND greatest(a.ay, a.by) >= least(b.ay, b.by) AND greatest(b.ay, b.by) >= least(a.ay, a.by))"""


@query("self_crossing", f"WITH plain AS ({C.VIEWS['rings']}), rings AS (SELECT k, ring_id, CASE WHEN ring_id % 3 = 0 THEN i * 5 % 12 ELSE i END AS i, x, y FROM plain), around AS ({C.VIEWS['around']}), {_MEET} SELECT k, ring_id, count(*) AS n FROM m GROUP BY 1, 2")
def self_crossing(spark, d):
    """Rings that meet themselves, and at how many pairs of sides; a third of the rings are strung as stars."""
    strung = C.rings(spark, d).withColumn("i", F.when(F.col("ring_id") % 3 == 0, F.col("i") * 5 % 12).otherwise(F.col("i")))
    return curves.crossings(strung, 40.0).groupBy("k", "ring_id").agg(F.count(F.lit(1)).alias("n"))


@query("simplify_valid", sql(_MEET + ", c AS (SELECT DISTINCT k, ring_id FROM m) SELECT r.k, count(DISTINCT r.ring_id) AS rings, count(DISTINCT c.ring_id) AS crossed FROM rings r LEFT JOIN c ON c.k = r.k AND c.ring_id = r.ring_id GROUP BY 1", "rings", "around"))
def simplify_valid(spark, d):
    """Rings simplified to within 20 by class, and those that meet themselves: no others than before."""
    found = curves.simplified_valid(C.rings(spark, d), 20.0)
    crossed = curves.crossings(found, 40.0).select("k", "ring_id").distinct().withColumn("crossed", F.lit(1))
    each = found.select("k", "ring_id").distinct().join(crossed, ["k", "ring_id"], "left")
    return each.groupBy("k").agg(F.count(F.lit(1)).alias("rings"), F.count("crossed").alias("crossed"))


def _overlay_sql() -> str:
    """All edges of a class against all, and below every cut's middle the heights of what covers it."""
    at = lambda e, x: f"({e}.y1 + ({x} - {e}.x1) * (({e}.y2 - {e}.y1) / ({e}.x2 - {e}.x1)))"
    low, high = "greatest(a.x1, b.x1)", "least(a.x2, b.x2)"
    return sql(
        f"""e AS MATERIALIZED (SELECT k, ring_id, least(x, nx) AS x1, CASE WHEN x < nx THEN y ELSE ny END AS y1, greatest(x, nx) AS x2, CASE WHEN x < nx THEN ny ELSE y END AS y2 FROM around WHERE x <> nx),
w AS (SELECT a.k, a.x1 AS x FROM e a UNION SELECT a.k, a.x2 FROM e a UNION SELECT a.k, {low} + ({high} - {low}) * (({at('a', low)} - {at('b', low)}) / (({at('a', low)} - {at('b', low)}) - ({at('a', high)} - {at('b', high)})))
  FROM e a JOIN e b ON a.k = b.k AND a.ring_id < b.ring_id AND {low} < {high} WHERE ({at('a', low)} - {at('b', low)}) * ({at('a', high)} - {at('b', high)}) < 0),
s AS MATERIALIZED (SELECT k, x AS u, lead(x) OVER (PARTITION BY k ORDER BY x) AS v FROM w),
h AS MATERIALIZED (SELECT s.k, u, v, e.ring_id, {at('e', '(u + v) / 2')} AS y FROM s JOIN e ON e.k = s.k AND e.x1 < (u + v) / 2 AND (u + v) / 2 < e.x2 WHERE v - u > 1e-9),
p AS (SELECT *, row_number() OVER (PARTITION BY k, u, ring_id ORDER BY y) % 2 AS enters FROM h),
c AS (SELECT *, sum(CASE WHEN enters = 1 THEN 1 ELSE -1 END) OVER (PARTITION BY k, u ORDER BY y, enters DESC ROWS UNBOUNDED PRECEDING) AS n, lead(y) OVER (PARTITION BY k, u ORDER BY y, enters DESC) - y AS dy FROM p)
SELECT k, round(sum(CASE WHEN n > 0 THEN dy * (v - u) ELSE 0 END), 2) AS union_area, round(sum(CASE WHEN n % 2 = 1 THEN dy * (v - u) ELSE 0 END), 2) AS odd_area, round(sum(n * coalesce(dy, 0) * (v - u)), 2) AS sum_area FROM c GROUP BY 1""",
        "rings", "around",
    )


@query("overlay_areas", _overlay_sql())
def overlay_areas(spark, d):
    """Area of the union, of the symmetric difference, and of all rings of each class."""
    found = overlay.areas(overlay.ring_edges(C.rings(spark, d), "k", "ring_id"))
    return found.select(F.col("by").alias("k"), *(F.round(c, 2).alias(c) for c in ("union_area", "odd_area", "sum_area")))


@query("svg_path", sql("SELECT k, ring_id, 'M ' || string_agg(printf('%.1f,%.1f', x, y), ' L ' ORDER BY i) || ' Z' AS d FROM rings GROUP BY 1, 2", "rings"))
def svg_path(spark, d):
    return curves.svg_paths(C.rings(spark, d), 1)


def _smoothing_sql() -> str:
    shape = "{0} AS (SELECT k, ring_id, count(*) AS n, sum(x * ny - nx * y) / 2 AS area, sqrt(avg(((px - x * 2 + nx) * (px - x * 2 + nx) + (py - y * 2 + ny) * (py - y * 2 + ny)) / 4)) AS roughness FROM (" + C.VIEWS["around"].replace("FROM rings", "FROM {1}") + ") GROUP BY 1, 2)"
    steps = _taubin_sql().rpartition(" SELECT k, ring_id, i, round")[0]
    return f"{steps}, {shape.format('b', 'rings')}, {shape.format('a', 't3')} SELECT b.k, round(sum(b.roughness * b.n) / sum(b.n), 5) AS before, round(sum(a.roughness * b.n) / sum(b.n), 5) AS after, round(max(abs(a.area - b.area) / greatest(abs(b.area), 1e-9)), 5) AS area_change FROM b JOIN a ON a.k = b.k AND a.ring_id = b.ring_id GROUP BY 1"


@query("smoothing_report", sql(_smoothing_sql(), "rings"))
def smoothing_report(spark, d):
    """Roughness before and after smoothing, and the change of area, by isobath."""
    r = C.rings(spark, d)
    return curves.smoothing_report(r, curves.taubin(r, 2)).select("k", *(F.round(c, 5).alias(c) for c in ("before", "after", "area_change")))


# Calibration and legends.

_CANDIDATES = ((0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0), (1, 3.0, -2.0, 1.01, 0.99, 0.0, 0.25), (2, -1.5, 4.25, 0.98, 1.02, 0.0, -0.5))
_CAND = ", ".join("(" + ", ".join(f"{v}e0" if i else str(v) for i, v in enumerate(c)) + ")" for c in _CANDIDATES)
_OBJECTIVE = f"c AS (SELECT * FROM (VALUES {_CAND}) v(candidate, dx, dy, sx, sy, theta, off)), p AS (SELECT CAST(l_partkey % 128 AS DOUBLE) + 0.125e0 AS x, CAST(l_orderkey % 96 AS DOUBLE) + 0.375e0 AS y, l_quantity / 6.25e0 AS depth FROM lineitem), m AS (SELECT candidate, dx, dy, sx, sy, theta, off, depth + off AS q, CAST(round_even((y - 48e0) * sy + 48e0 + dy, 0) AS INT) AS cy, CAST(round_even((x - 64e0) * sx + 64e0 + dx, 0) AS INT) AS cx FROM p, c), e AS (SELECT m.*, r.k, greatest(r.k - q, 0) + greatest(q - (r.k + 1), 0) AS err FROM m LEFT JOIN raster r ON r.y = cy AND r.x = cx), a AS (SELECT candidate, dx, dy, sx, sy, theta, off, avg(CASE WHEN k IS NULL THEN NULL WHEN err < 0.5 THEN err * err ELSE 0.25e0 + (err - 0.5e0) * 0.5e0 END) AS fit, avg(CASE WHEN k IS NULL THEN 0e0 ELSE 1e0 END) AS valid FROM e GROUP BY ALL) SELECT CAST(candidate AS INT) AS candidate, round(CASE WHEN valid < 0.5 THEN 10 + (0.5e0 - valid) * 20 ELSE fit + 0.7e0 * (1 - valid) + 2e-3 * (dx / 30 * dx / 30 + dy / 30 * dy / 30) + 3e-2 * ((sx - 1) / 25e-3) * ((sx - 1) / 25e-3) + 3e-2 * ((sy - 1) / 25e-3) * ((sy - 1) / 25e-3) + 2e-3 * (off / 0.5e0) * (off / 0.5e0) END, 6) AS objective FROM a"


def _survey_points(spark: SparkSession, d: str) -> DataFrame:
    return C.table(spark, d, "lineitem").select(((F.col("l_partkey") % 128).cast("double") + 0.125).alias("x"), ((F.col("l_orderkey") % 96).cast("double") + 0.375).alias("y"), (F.col("l_quantity") / 6.25).alias("depth"))


@query("calibrate_objective", sql(_OBJECTIVE, "raster"))
def calibrate_objective(spark, d):
    candidates = spark.createDataFrame(_CANDIDATES, "candidate int, dx double, dy double, sx double, sy double, theta double, off double")
    return rounded(calibrate.objectives(_survey_points(spark, d), C.raster(spark, d), candidates, 64.0, 48.0))


_ON_CELLS = "e AS (SELECT l_quantity / 6.25e0 AS q, r.k, greatest(r.k - l_quantity / 6.25e0, 0) + greatest(l_quantity / 6.25e0 - (r.k + 1), 0) AS err FROM lineitem LEFT JOIN raster r ON r.y = l_orderkey % 96 AND r.x = l_partkey % 128 AND r.k > 2)"
_HUBER = "CASE WHEN k IS NULL THEN NULL WHEN err < 0.5 THEN err * err ELSE 0.25e0 + (err - 0.5e0) * 0.5e0 END"


@query("calibration_report", sql(_ON_CELLS + " SELECT round(avg(CASE WHEN k IS NULL THEN 0e0 ELSE 1e0 END), 6) AS valid_fraction, round(avg(CASE WHEN k IS NOT NULL THEN CASE WHEN err = 0 THEN 1e0 ELSE 0e0 END END), 6) AS in_band, round(avg(CASE WHEN k IS NOT NULL THEN err END), 6) AS mean_error, round(median(CASE WHEN k IS NOT NULL THEN abs(q - (k + 0.5e0)) END), 6) AS median_mid_error FROM e", "raster"))
def calibration_report(spark, d):
    """How points fit the cells of classes over 2 under them."""
    p = _survey_points(spark, d).withColumns({"cell_y": F.floor("y").cast("int"), "cell_x": F.floor("x").cast("int")})
    met = p.join(C.raster(spark, d).where("k > 2").select(F.col("y").alias("cell_y"), F.col("x").alias("cell_x"), "k"), ["cell_y", "cell_x"], "left")
    return rounded(calibrate.fit_report(met, F.col("k"), F.col("depth")))


@query("calibrate_fit", sql(_ON_CELLS.replace(" AND r.k > 2", "") + f" SELECT round(avg({_HUBER}), 6) AS unmoved, true AS no_worse FROM e", "raster"))
def calibrate_fit(spark, d):
    """Evolution, then the simplex, one job for each generation: the objective without a transform, and that the fit is no worse."""
    points, cells = _survey_points(spark, d), C.raster(spark, d)
    _, fitted = calibrate.calibrate(points, cells, size=8, generations=3, rounds=4)
    still = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0)], "candidate int, " + ", ".join(f"{n} double" for n in calibrate.PARAMETERS))
    return rounded(calibrate.objectives(points, cells, still, 64.0, 48.0).select(F.col("objective").alias("unmoved"), (F.lit(fitted) <= F.col("objective")).alias("no_worse")))


_SWATCH = "s AS (SELECT CAST(s_nationkey % 5 AS INT) AS page, 100 + s_suppkey % 3 + 0e0 AS cx, s_suppkey * 30 + (s_suppkey * s_suppkey) % 7 + 0e0 AS cy FROM supplier), g AS (SELECT *, lead(cy) OVER (PARTITION BY page ORDER BY cy) - cy AS gap FROM s), r AS (SELECT page, cy, count(*) OVER w AS n, stddev_pop(gap) OVER v / (avg(gap) OVER v + 1e-9) + 3e-3 * stddev_pop(cx) OVER w AS score FROM g WINDOW w AS (PARTITION BY page ORDER BY cy ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), v AS (PARTITION BY page ORDER BY cy ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING))"


@query("legend_run", f"WITH {_SWATCH} SELECT page, arg_min(cy, (round(score, 9), cy)) AS cy, round(min(score), 6) AS score FROM r WHERE n = 8 GROUP BY 1")
def legend_run(spark, d):
    c = F.col
    s = C.table(spark, d, "supplier").select((c("s_nationkey") % 5).cast("int").alias("page"), (F.lit(100.0) + c("s_suppkey") % 3).alias("cx"), (c("s_suppkey") * 30 + (c("s_suppkey") * c("s_suppkey")) % 7 + 0.0).alias("cy"))
    return rounded(calibrate.legend_run(s))


# Pages and texts.

_HREF = r"(?i)<a\s[^>]*?href\s*=\s*[\"'']([^\"'']+)[\"'']"


@query("link_extract", f"SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '{_HREF}', 1))) AS href FROM pages")
def link_extract(spark, d):
    return C.table(spark, d, "pages").select("page_id", F.explode(F.array_distinct(pages.hrefs(F.col("html")))).alias("href"))


_FOLLOW = f"""WITH s AS (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '{_HREF}', 1))) AS href FROM pages WHERE page_id % 20 = 0),
l AS (SELECT page_id, url, regexp_replace(CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href WHEN href LIKE '/%' THEN regexp_extract(url, '^([a-z]+://[^/]+)', 1) || href
  ELSE regexp_replace(regexp_extract(url, '^([a-z]+://[^?#]*)', 1), '([^/:])/[^/]*$', '\\1') || '/' || href END, '#.*$', '') AS link FROM s),
f AS (SELECT link, min(page_id) AS from_id, count(DISTINCT page_id) AS n_pages FROM l WHERE regexp_extract(link, '^[a-z]+://([^/?#]+)', 1) = regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) GROUP BY link),
k AS (SELECT regexp_replace(url, '#.*$', '') AS link, min(page_id) AS known_id, bool_or(page_id % 20 = 0) AS seed FROM pages GROUP BY 1)
SELECT link, from_id, n_pages, known_id FROM f LEFT JOIN k USING (link) WHERE NOT coalesce(seed, false)"""


@query("link_follow", _FOLLOW)
def link_follow(spark, d):
    """One link on from every twentieth page."""
    p = C.table(spark, d, "pages")
    return pages.frontier(p, p.where("page_id % 20 = 0"))


@query("line_hits", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM l), h AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM e WHERE regexp_matches(line, '[0-9]{3}|token|License')) SELECT doc_id, line_no, line FROM h WHERE r <= 40")
def line_hits(spark, d):
    return text.line_hits(C.table(spark, d, "documents"), "doc_id", "text", "[0-9]{3}|token|License", 40)


@query("url_grid", "SELECT b || n || '.' || e AS url, b AS base, n AS name, e AS ending FROM (VALUES ('https://a.example/'), ('https://b.example/x/'), ('https://c.example/')) p(b), (SELECT DISTINCT lower(r_name) AS n FROM region) q, (VALUES ('shp'), ('gpkg'), ('csv')) r(e)")
def url_grid(spark, d):
    names = C.table(spark, d, "region").select(F.lower("r_name").alias("name")).distinct()
    return pages.address_grid(names, ["https://a.example/", "https://b.example/x/", "https://c.example/"], ["shp", "gpkg", "csv"])


# Tiles.

_MANIFEST = "m AS (SELECT 'map' || n_nationkey AS map, CAST(700 + n_nationkey * 37 AS INT) AS width, CAST(900 + n_nationkey * 53 AS INT) AS height FROM nation), f AS (SELECT map, CAST(l AS INT) AS level, CAST(width * l AS INT) AS pixel_width, CAST(height * l AS INT) AS pixel_height, CAST(ceil(width * l / 1024e0) AS INT) AS cols, CAST(ceil(height * l / 1024e0) AS INT) AS rows FROM m, (VALUES (2), (4), (8)) v(l))"


def _manifest(spark, d) -> DataFrame:
    n = F.col("n_nationkey")
    return tiles.manifest(C.table(spark, d, "nation").select(F.concat(F.lit("map"), n.cast("string")).alias("map"), (n * 37 + 700).cast("int").alias("width"), (n * 53 + 900).cast("int").alias("height")))


@query("tile_manifest", f"WITH {_MANIFEST} SELECT map, level, pixel_width, pixel_height, cols, rows FROM f")
def tile_manifest(spark, d):
    return _manifest(spark, d)


_VIEWS = "w AS (SELECT c_custkey AS view, 'map' || c_nationkey AS map, CAST(CASE WHEN need <= 2 THEN 2 WHEN need <= 4 THEN 4 ELSE 8 END AS INT) AS level, c_custkey % 700 + 0e0 AS x0, c_custkey % 900 + 0e0 AS y0 FROM (SELECT *, (1 + c_custkey % 80 / 1e1) * least(1 + c_custkey % 3, 1.5e0) AS need FROM customer))"


def _views(spark, d) -> DataFrame:
    c = F.col("c_custkey")
    level = E.lod(F.lit(1.0) + (c % 80) / 10.0, (1 + c % 3).cast("double"))
    v = C.table(spark, d, "customer").select(c.alias("view"), F.concat(F.lit("map"), F.col("c_nationkey").cast("string")).alias("map"), level.alias("level"), (c % 700 + 0.0).alias("x0"), (c % 900 + 0.0).alias("y0"))
    return v.withColumns({"x1": F.col("x0") + 1500.0, "y1": F.col("y0") + 900.0})


@query("lod_pick", f"WITH {_VIEWS} SELECT level, count(*) AS n FROM w GROUP BY 1")
def lod_pick(spark, d):
    return relational.counter(_views(spark, d), "level")


@query("tile_cover", f"WITH {_MANIFEST}, {_VIEWS} SELECT w.view, w.map, w.level, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty FROM w JOIN f ON w.map = f.map AND w.level = f.level JOIN range(40) a(tx) ON tx BETWEEN greatest(0, floor(x0 / 1024) - 1) AND least(cols - 1, floor((x0 + 1500) / 1024) + 1) JOIN range(60) b(ty) ON ty BETWEEN greatest(0, floor(y0 / 1024) - 1) AND least(rows - 1, floor((y0 + 900) / 1024) + 1)")
def tile_cover(spark, d):
    return tiles.cover(_views(spark, d), _manifest(spark, d))


@query("tile_changes", "SELECT n_nationkey AS tile, CASE WHEN n_nationkey % 2 = 0 THEN 'add' ELSE 'remove' END AS action FROM nation WHERE (n_nationkey % 2 = 0) != (n_nationkey % 3 = 0) AND (n_nationkey % 2 = 0 OR n_nationkey % 3 = 0)")
def tile_changes(spark, d):
    n = C.table(spark, d, "nation").select(F.col("n_nationkey").alias("tile"))
    return tiles.tile_changes(n.where("tile % 3 = 0"), n.where("tile % 2 = 0"))


# Streams, on tables.

_GATE = "f AS (SELECT *, accuracy <= 20 AS good, epoch_us(ts) - epoch_us(first_value(ts) OVER w) >= 12000000 AS late, arg_min(event_id, (accuracy, ts, event_id)) OVER w AS best_id, min(accuracy) OVER w AS best FROM fixes WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), g AS (SELECT *, coalesce(bool_or(good) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS had FROM f), h AS (SELECT *, NOT good AND late AND NOT had AS may FROM g), o AS (SELECT *, sum(CASE WHEN may THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nth FROM h)"


_GATED = sql(_GATE + " SELECT user_id, event_id, CASE WHEN good THEN event_id WHEN may AND nth = 1 THEN best_id END AS emitted_id, CASE WHEN good THEN accuracy WHEN may AND nth = 1 THEN best END AS accuracy, CASE WHEN good THEN 'delivered' WHEN may AND nth = 1 THEN 'fallback' ELSE 'refining' END AS status FROM o", "fixes")


@query("gps_gate_batch", _GATED)
def gps_gate_batch(spark, d):
    return gate.gate_table(C.fixes(spark, d))


def _fold_sql(most: int) -> str:
    far = "(f.x - t.kx) * (f.x - t.kx) + (f.y - t.ky) * (f.y - t.ky) > 1"
    return sql(
        f"""f AS (SELECT user_id, event_id, (lon + 1.2e0) * 1e4 AS x, (lat - 44.93e0) * 1e4 AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM fixes),
t AS (SELECT user_id, event_id, rn, x AS kx, y AS ky, true AS kept FROM f WHERE rn = 1 UNION ALL
  SELECT f.user_id, f.event_id, f.rn, CASE WHEN {far} THEN f.x ELSE t.kx END, CASE WHEN {far} THEN f.y ELSE t.ky END, {far} FROM t JOIN f ON f.user_id = t.user_id AND f.rn = t.rn + 1),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) AS back, row_number() OVER (PARTITION BY user_id ORDER BY rn) AS nth, count(*) OVER (PARTITION BY user_id) AS n FROM t WHERE kept)
SELECT user_id, CAST(nth - 1 - greatest(n - {most}, 0) AS INT) AS i, event_id, kx AS x, ky AS y FROM k WHERE back <= {most}""",
        "fixes", recursive=True,
    )


def _track_points(fixes: DataFrame) -> DataFrame:
    return fixes.withColumns({"x": (F.col("lon") + 1.2) * 10000.0, "y": (F.col("lat") - 44.93) * 10000.0})


def _live(spark: SparkSession, d: str, of: Callable[[DataFrame], DataFrame], mode: str, last: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """A stream of the events' files, run to its end."""
    with Tables(spark) as tables:
        files = spark.readStream.schema(C.table(spark, d, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parque[t]")  # a pattern, as a stream takes no single file
        done = live.run_to_end(of(C.fixes_of(files)), tables.path("live"), tables.path("live-checkpoint"), mode)
        return tables.kept(last(done), "live-rows")


@query("gps_gate_stream", _GATED)
def gps_gate_stream(spark, d):
    return _live(spark, d, live.gate_stream, "append")


@query("track_stream", _fold_sql(30))
def track_stream(spark, d):
    """The last 30 points of each track from a stream with state."""
    newest = F.max("n").over(Window.partitionBy("user_id"))
    return _live(spark, d, lambda f: live.track_stream(_track_points(f), most=30), "update", lambda df: df.withColumn("m", newest).where("n = m").drop("n", "m"))


@query("track_cap", _fold_sql(M.TRACK_LENGTH))
def track_cap(spark, d):
    """The last 800 points of each track, kept by their distance from the one kept before."""
    return gate.track_table(_track_points(C.fixes(spark, d)))


@query("hourly_fixes", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(avg(value), 6) AS accuracy FROM events GROUP BY 1")
def hourly_fixes(spark, d):
    """An extension: the table form of the watermarked windows."""
    return rounded(C.table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("accuracy")))


@query("report_struct")
def report_struct(spark, d):
    """A nested report as one JSON text; its parts are checked as queries of their own."""
    metrics = C.raster(spark, d).agg(relational.class_mean(F.col("k")).alias("mean_depth"), F.count(F.lit(1)).alias("n"))
    judged = qc.judged(metrics.withColumn("mean_shift", F.col("mean_depth") - 4.0).withColumn("within1", F.lit(1.0)), qc.PUBLISHED)
    return qc.report(summary=judged, classes=relational.class_histogram(C.raster(spark, d))).select(F.to_json(F.struct("summary", "classes")).alias("report"))


@query("geojson_points")
def geojson_points(spark, d):
    """A GeoJSON feature for every place; read back in the tests."""
    points = C.soundings(spark, d).groupBy("lon", "lat").agg(F.median("depth").alias("depth_m"), F.count(F.lit(1)).alias("n"), F.max("date").cast("string").alias("date"))
    return sinks.geojson_features(points).select("value")


# Map work.


@query("depth_bands", sql(_NODES + " SELECT CAST(floor(z / 5e-1) AS INT) AS band, count(*) AS cells FROM z GROUP BY 1", "soundings"))
def depth_bands(spark, d):
    return mapping.depth_bands(_interpolated(spark, d))


@query("polygon_burn", sql(_INSIDE + " SELECT r.y, r.x, EXISTS (SELECT 1 FROM inside i WHERE i.y = r.y AND i.x = r.x) AS inside FROM raster r", "raster", "edges"))
def polygon_burn(spark, d):
    return mapping.burn(C.raster(spark, d), C.polygons(spark), 8.0).select("y", "x", "inside")


@query("stable_interior", sql("s AS (SELECT y, x, CAST((y // 16 + x // 16) % 8 AS INT) AS k FROM raster), b AS (SELECT DISTINCT a.y, a.x FROM s a JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) v(dy, dx) ON true JOIN s c ON c.y = a.y + dy AND c.x = a.x + dx WHERE a.k != c.k), g AS (SELECT DISTINCT y + dy AS y, x + dx AS x FROM b, (SELECT * FROM (VALUES (-1), (0), (1)) p(dy), (VALUES (-1), (0), (1)) q(dx))) SELECT y, x, k FROM s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.y = s.y AND g.x = s.x)", "raster"))
def stable_interior(spark, d):
    """On the raster's cells with classes in squares of 16, as its own classes leave no interior."""
    squares = C.raster(spark, d).withColumn("k", F.expr("cast((y div 16 + x div 16) % 8 as int)"))
    return mapping.stable_interior(squares, NY, NX).select("y", "x", "k")


_HEX = ", ".join("'#%02x%02x%02x'" % c for c in M.DISPLAY_PALETTE)


@query("class_strokes", sql(f"b AS (SELECT DISTINCT a.y, a.x FROM raster a JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) v(dy, dx) ON true JOIN raster c ON c.y = a.y + dy AND c.x = a.x + dx WHERE a.k != c.k) SELECT r.y, r.x, CASE WHEN b.y IS NOT NULL THEN '#244e5a' ELSE ([{_HEX}])[r.k + 1] END AS colour, CAST(CASE WHEN b.y IS NOT NULL THEN 210 ELSE 255 END AS INT) AS alpha FROM raster r LEFT JOIN b ON b.y = r.y AND b.x = r.x", "raster"))
def class_strokes(spark, d):
    return mapping.strokes(C.raster(spark, d))


@query("patch_palette", sql("p AS (SELECT CAST(p_partkey % 40 AS INT) AS y, CAST(p_partkey % 30 AS INT) AS x, r, g, b FROM colours) SELECT CAST(k AS INT) AS k, median(r) AS r, median(g) AS g, median(b) AS b FROM p JOIN (VALUES (0, 2, 9, 3, 11), (1, 12, 19, 3, 11), (2, 22, 33, 5, 25)) v(k, y0, y1, x0, x1) ON y >= y0 AND y < y1 AND x >= x0 AND x < x1 GROUP BY 1", "colours"))
def patch_palette(spark, d):
    pixels = C.colours(spark, d).select((F.col("p_partkey") % 40).cast("int").alias("y"), (F.col("p_partkey") % 30).cast("int").alias("x"), "r", "g", "b")
    return mapping.patch_palette(pixels, spark.createDataFrame([(0, 2, 9, 3, 11), (1, 12, 19, 3, 11), (2, 22, 33, 5, 25)], "k int, y0 int, y1 int, x0 int, x1 int"))


@query("classify_colours", sql(f"SELECT CAST(k AS INT) AS k, count(*) AS n, round(quantile_cont(distance, 0.95), 6) AS p95 FROM (SELECT CASE WHEN sqrt(n.d2) < 58 THEN n.k END AS k, sqrt(n.d2) AS distance FROM (SELECT list_min([{_NEAR}]) AS n FROM colours)) GROUP BY 1", "colours"))
def classify_colours(spark, d):
    pixels = C.colours(spark, d).withColumns({"y": F.lit(0), "x": F.col("p_partkey")})
    return rounded(mapping.classify(pixels, M.DISPLAY_PALETTE, 58.0).groupBy("k").agg(F.count(F.lit(1)).alias("n"), *relational.percentiles(F.col("distance"), (0.95,))))


@query("colour_inventory", sql(f"SELECT image, round(avg(r), 6) AS mean_r, round(stddev_pop(r), 6) AS std_r, round(avg(g), 6) AS mean_g, round(stddev_pop(g), 6) AS std_g, round(avg(b), 6) AS mean_b, round(stddev_pop(b), 6) AS std_b, round(avg(CASE WHEN sqrt(d2) < 30 THEN 1e0 ELSE 0e0 END), 6) AS within30, round(avg(CASE WHEN sqrt(d2) < 60 THEN 1e0 ELSE 0e0 END), 6) AS within60 FROM (SELECT p_partkey % 7 AS image, r, g, b, list_min([{_NEAR}]).d2 AS d2 FROM colours) GROUP BY 1", "colours"))
def colour_inventory(spark, d):
    return rounded(mapping.colour_inventory(C.colours(spark, d).withColumn("image", F.col("p_partkey") % 7), "image", M.DISPLAY_PALETTE))


@query("open_water", sql(_INSIDE + " SELECT count(*) FILTER (EXISTS (SELECT 1 FROM inside i WHERE i.y = r.y AND i.x = r.x)) AS inside, count(*) AS n FROM raster r", "raster", "edges"))
def open_water(spark, d):
    cells, edges = _cells_with_key(spark, d)
    mask = spatial.points_in_polygons(cells, edges, "cell", bin_size=8.0)
    return mapping.open_water(cells, mask, "cell").agg(F.count_if("inside").alias("inside"), F.count(F.lit(1)).alias("n"))


@query("size_ratio", "SELECT n.o_orderpriority AS priority, n.bytes, round(n.bytes / CAST(b.bytes AS DOUBLE), 6) AS ratio FROM (SELECT o_orderpriority, count(*) AS bytes FROM orders GROUP BY 1) n LEFT JOIN (SELECT o_orderpriority, count(*) AS bytes FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority != '1-URGENT' GROUP BY 1) b ON n.o_orderpriority = b.o_orderpriority")
def size_ratio(spark, d):
    sized = lambda df: df.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("bytes"))
    o = C.table(spark, d, "orders")
    return rounded(mapping.size_ratio(sized(o), sized(o.where("o_orderstatus = 'F' and o_orderpriority != '1-URGENT'")), "priority"))


@query("layered_svg")
def layered_svg(spark, d):
    """One drawing of all rings; its paths are checked in svg_path."""
    return mapping.layered_svg(C.rings(spark, d), 650, 480)


@query("segment_map")
def segment_map(spark, d):
    """Classes of a map image, cleaned to its largest water body; its steps are tested on known shapes."""
    p = C.colours(spark, d).select(F.lit(1).alias("map"), (F.col("p_partkey") % 40).cast("int").alias("y"), (F.col("p_partkey") % 37).cast("int").alias("x"), "r", "g", "b")
    one = p.groupBy("map", "y", "x").agg(*(F.min(c).alias(c) for c in "rgb"))
    return mapping.segment(one, "map", M.DISPLAY_PALETTE).select("y", "x", "k")


# Files, written and read back through the data source.


def _through_files(df: DataFrame, kind: str, ask=lambda r: r, **options: str) -> DataFrame:
    spark = df.sparkSession
    survey.register(spark)
    with Tables(spark) as tables:
        path = tables.path(f"survey-{kind}")
        df.write.format("survey").option("kind", kind).mode("append").save(path)
        read = spark.read.format("survey").option("kind", kind).options(**options).load(path)
        return tables.kept(ask(read), "read-back")


def _event_soundings(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return C.table(spark, d, "events").select(c("event_id").cast("string").alias("code"), F.concat("event_type", F.lit('; "é"')).alias("name"), F.date_format("ts", "yyyy-MM-dd").alias("date"), (c("event_id") * 0.001).alias("lon"), (c("user_id") / 7.0).alias("lat"), c("value").alias("depth"))


_EVENT_SOUNDINGS = """SELECT CAST(event_id AS VARCHAR) AS code, event_type || '; "é"' AS name, strftime(ts, '%Y-%m-%d') AS date, event_id * 1e-3 AS lon, user_id / 7e0 AS lat, value AS depth FROM events"""


@query("delimited_round_trip", _EVENT_SOUNDINGS)
def delimited_round_trip(spark, d):
    """Events as delimited text with decimal commas, read in ranges of bytes."""
    return _through_files(_event_soundings(spark, d), "delimited", split_bytes="65536")


@query("geojson_round_trip", _EVENT_SOUNDINGS)
def geojson_round_trip(spark, d):
    return _through_files(_event_soundings(spark, d), "geojson")


@query("delimited_filter", f"SELECT code, name, depth FROM ({_EVENT_SOUNDINGS}) WHERE depth > 50 AND lat <= 5.5e0 AND name LIKE 'c%'")
def delimited_filter(spark, d):
    """Comparisons are evaluated in the reader."""
    return _through_files(_event_soundings(spark, d), "delimited", lambda r: r.where("depth > 50 and lat <= 5.5 and name like 'c%'").select("code", "name", "depth"))


@query("zip_round_trip", "SELECT CAST(doc_id AS VARCHAR) AS code, nullif(text, '') AS name, nullif(lang, '') AS date, doc_id * 1e0 AS depth FROM documents")
def zip_round_trip(spark, d):
    """Whole texts of documents as names, in the members of archives."""
    c = F.col
    docs = C.table(spark, d, "documents").select(c("doc_id").cast("string").alias("code"), c("text").alias("name"), c("lang").alias("date"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"), c("doc_id").cast("double").alias("depth"))
    return _through_files(docs, "zip", lambda r: r.select("code", "name", "date", "depth"))


@query("matched_soundings", sql("SELECT code, name, count(*) AS n, round(sum(depth), 3) AS depth FROM soundings WHERE regexp_replace(lower(strip_accents(name)), '[^a-z0-9]', '', 'g') LIKE '%etangf%' OR lower(code) IN ('a', 'r') OR lower(code) LIKE '%a' GROUP BY 1, 2", "soundings"))
def matched_soundings(spark, d):
    """A lake's soundings: by its name, its codes or the end of the first code."""
    kept = text.matching(C.soundings(spark, d), "etangf", ("a", "r"))
    return kept.groupBy("code", "name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("depth"), 3).alias("depth"))
