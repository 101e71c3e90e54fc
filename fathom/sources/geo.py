"""GeoJSON, map-service and page-description sources, as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RING = "array<array<double>>"
FEATURE = "struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>"


def features(spark: SparkSession, path: str) -> DataFrame:
    """(properties map, kind, coordinates as text) of the features of GeoJSON files: a collection, one feature, or a bare geometry."""
    text = spark.read.text(path, wholetext=True)
    top = text.select("value", F.get_json_object("value", "$.type").alias("type"))
    collection = F.from_json(F.get_json_object("value", "$.features"), f"array<{FEATURE}>")
    one = F.array(F.from_json("value", FEATURE))
    bare = F.array(F.struct(F.lit("Feature").alias("type"), F.create_map().cast("map<string,string>").alias("properties"), F.struct(F.col("type").alias("type"), F.get_json_object("value", "$.coordinates").alias("coordinates")).alias("geometry")))
    fs = F.when(F.col("type") == "FeatureCollection", collection).when(F.col("type") == "Feature", one).otherwise(bare)
    return top.select(F.explode(fs).alias("f")).select("f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def polygons(found: DataFrame) -> DataFrame:
    """features() of polygons and multipolygons to (properties, part, rings); another kind is an error, an empty one is left out."""
    parts = F.when(F.col("kind") == "Polygon", F.array(F.from_json("coordinates", f"array<{RING}>"))).when(F.col("kind") == "MultiPolygon", F.from_json("coordinates", f"array<array<{RING}>>"))
    parts = F.when(F.col("kind").isin("Polygon", "MultiPolygon"), parts).otherwise(F.raise_error(F.concat(F.lit("not a polygon: "), F.coalesce("kind", F.lit("none")))))
    rows = found.select("properties", F.posexplode(parts).alias("part", "raw"))
    rings = F.transform("raw", lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return rows.select("properties", "part", rings.alias("rings")).where(F.size("rings") > 0)


def points(found: DataFrame) -> DataFrame:
    xy = F.from_json("coordinates", "array<double>")
    return found.where("kind = 'Point'").select(xy[0].alias("lon"), xy[1].alias("lat"), F.try_element_at("properties", F.lit("depth_m")).try_cast("double").alias("depth"), F.try_element_at("properties", F.lit("date")).alias("date"))


def attribute(properties: str, *names: str):
    """The first filled of a feature's attributes, by alias."""
    return F.coalesce(*(F.nullif(F.try_element_at(properties, F.lit(n)), F.lit("")) for n in names))


def permanent_water(found: DataFrame) -> DataFrame:
    """Features that are permanent and no marsh."""
    kind, lasting = F.lower(attribute("properties", "nature", "NATURE")), F.lower(attribute("properties", "persistance", "persistence", "PERSISTANC"))
    return found.where((lasting == "permanent") & (F.coalesce(kind, F.lit("")) != "marais"))


def overpass(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """Outer and inner rings of named map elements: (osm_type, osm_id, name, role, ring), the first of each element."""
    point = "array<struct<lat: double, lon: double>>"
    schema = f"struct<elements: array<struct<type: string, id: bigint, tags: map<string, string>, geometry: {point}, members: array<struct<role: string, geometry: {point}>>>>>"
    e = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)["elements"]).alias("e")).select("e.*")
    named = e.withColumn("name", F.try_element_at("tags", F.lit("name"))).where(F.col("name").rlike(f"(?i){pattern}"))
    first = named.groupBy("type", "id").agg(F.min_by(F.struct("name", "geometry", "members"), F.to_json(F.struct("name", "geometry"))).alias("v")).select("type", "id", "v.*")
    way = F.array(F.struct(F.lit("outer").alias("role"), F.col("geometry")))
    parts = first.select(F.col("type").alias("osm_type"), F.col("id").alias("osm_id"), "name", F.explode(F.when(F.col("type") == "way", way).otherwise(F.col("members"))).alias("m"))
    ring = F.transform("m.geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    shut = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    return parts.where(F.size("m.geometry") >= 3).select("osm_type", "osm_id", "name", "m.role", shut.alias("ring")).where(F.size("ring") >= 4)


NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)"


def page_viewports(texts: DataFrame, text: str = "value") -> DataFrame:
    """Of page-description text, the largest viewport's box and its eight ground points' bounds."""
    box = F.regexp_extract_all(text, F.lit(rf"/BBox\s*\[\s*((?:{NUMBER}\s*){{4}})\]"), F.lit(1))
    numbers = lambda s: F.transform(F.split(F.trim(s), r"\s+"), lambda x: x.cast("double"))
    sized = F.transform(box, lambda s: F.struct(F.abs((numbers(s)[2] - numbers(s)[0]) * (numbers(s)[3] - numbers(s)[1])).alias("area"), numbers(s).alias("box")))
    ground = numbers(F.regexp_extract(text, rf"/GPTS\s*\[\s*((?:{NUMBER}\s*){{8}})\]", 1))
    lat, lon = F.filter(ground, lambda _, i: i % 2 == 0), F.filter(ground, lambda _, i: i % 2 == 1)
    return texts.select(F.array_max(sized)["box"].alias("box"), F.array_min(lon).alias("west"), F.array_max(lon).alias("east"), F.array_min(lat).alias("south"), F.array_max(lat).alias("north"))


def svg_layers(texts: DataFrame, text: str = "value") -> DataFrame:
    """(layer, path, i, x, y) of the depth layers' subpaths of SVG text."""
    layers = texts.select(F.explode(F.regexp_extract_all(text, F.lit(r'(id="depth-\d+"[^>]*\sd="[^"]*")'), F.lit(1))).alias("tag"))
    found = layers.select(F.regexp_extract("tag", r'id="depth-(\d+)"', 1).cast("int").alias("layer"), F.regexp_extract("tag", r'\sd="([^"]*)"', 1).alias("d"))
    sub = found.select("layer", F.posexplode(F.filter(F.split("d", "[Mm]"), lambda s: F.trim(s) != "")).alias("path", "s"))
    numbers = sub.select("layer", "path", F.regexp_extract_all("s", F.lit(f"({NUMBER})"), F.lit(1)).alias("ns"))
    i = F.explode(F.when(F.size("ns") >= 2, F.sequence(F.lit(0), F.floor(F.size("ns") / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>")))
    return numbers.select("layer", "path", "ns", i.alias("i")).select("layer", "path", "i", F.col("ns")[F.col("i") * 2].cast("double").alias("x"), F.col("ns")[F.col("i") * 2 + 1].cast("double").alias("y"))
