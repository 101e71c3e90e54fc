import pytest
from pyspark.sql import functions as F

from fathom import model as M
from fathom.operators import mapping


def pixels(spark, rows):
    return spark.createDataFrame([(1, y, x, *M.SOURCE_PALETTE[k]) if k >= 0 else (1, y, x, 255, 255, 255) for y, line in enumerate(rows) for x, k in enumerate(line)], "map int, y int, x int, r int, g int, b int")


def test_segment(spark):
    W = -1
    rows = [[W] * 9, [W, 0, 0, 0, 0, 0, 0, 0, W], [W, 0, 1, 1, 1, 1, 1, 0, W], [W, 0, 1, W, W, W, 1, 0, W], [W, 0, 1, W, W, W, 1, 0, W], [W, 0, 1, W, W, W, 1, 0, W], [W, 0, 1, 1, 1, 1, 1, 0, W], [W, 0, 0, 0, 0, 0, 0, 0, W], [W] * 9, [W] * 9, [W] * 9, [W] * 8 + [3]]
    # white is far from every colour of the palette
    got = {(r.y, r.x): r.k for r in mapping.segment(pixels(spark, rows), "map", tolerance=20).collect()}
    assert got[11, 8] == -1 and got[0, 0] == -1  # another water body, and the outside
    assert got[4, 4] == 1 and got[1, 1] == 0 and sum(k >= 0 for k in got.values()) == 49  # the hole is filled from the nearest
    kept = {(r.y, r.x): r.k for r in mapping.segment(pixels(spark, rows), "map", tolerance=20, holes=3).collect()}
    assert kept[4, 4] == -1


def test_decode(spark):
    rows = [(0, 0, *M.DISPLAY_PALETTE[3], 255), (0, 1, 1, 2, 3, 0)]
    schema = "y int, x int, r int, g int, b int, a int"
    assert [(r.x, r.k) for r in mapping.decode_classes(spark.createDataFrame(rows, schema)).orderBy("x").collect()] == [(0, 3), (1, None)]
    with pytest.raises(Exception, match="not of the palette"):
        mapping.decode_classes(spark.createDataFrame([(0, 0, 1, 2, 3, 255)], schema)).collect()


def test_legend(spark):
    regular = [(1, i, 20, 60, 100 + 50 * i, 120 + 50 * i, 700) for i in range(8)]
    noise = [(1, 90, 20, 60, 20, 40, 700), (1, 91, 21, 61, 70, 90, 400), (1, 92, 500, 560, 10, 30, 900), (1, 93, 20, 25, 10, 30, 900)]
    seven = [(2, i, 20, 60, 100 + 50 * i, 120 + 50 * i, 700) for i in range(7)]
    df = spark.createDataFrame(regular + noise + seven, "page int, component int, x0 int, x1 int, y0 int, y1 int, cells int")
    got = {p: [r.cy for r in mapping.legend(mapping.swatches(df, 1000.0)).orderBy("rank").collect() if r.page == p] for p in (1, 2)}
    assert got == {1: [110.0 + 50 * i for i in range(8)], 2: [110.0 + 50 * i for i in range(8)]}


def test_strips_media_and_shapes(spark):
    images = spark.createDataFrame([(i, 1924, 0.0, 924.0, 10.0 * i, 10.0 * i + 9) for i in range(5, -1, -1)] + [(9, 1924, 0.0, 100.0, 0.0, 1.0)], "image int, width int, x0 double, x1 double, y0 double, y1 double")
    assert [r.image for r in mapping.strips_of(images).collect()] == list(range(6))
    with pytest.raises(Exception, match="number of strips"):
        mapping.strips_of(images.where("image > 0")).collect()
    media = spark.createDataFrame([(1, " The Map ", {"full": "2048", "thumb": "x"}), (2, "other", {"full": "1"})], "id int, title string, sizes map<string,string>")
    assert [tuple(r) for r in mapping.media_of(media, "the map").collect()] == [(1, " The Map ", 2048, "full")]
    mapping.aspect_gate(spark.createDataFrame([(1414, 1000)], "width int, height int")).collect()
    with pytest.raises(Exception, match="another shape"):
        mapping.aspect_gate(spark.createDataFrame([(1000, 1000)], "width int, height int")).collect()


def test_text_outputs(spark):
    s = spark.createDataFrame([('<p stroke-width="2" d="stroke-width"/>',), (None,)], "v string").select(mapping.scaled_strokes(1.5)("v").alias("v")).collect()
    assert s[0].v == '<p stroke-width="3.000" d="stroke-width"/>' and s[1].v is None
    t = mapping.token_presence(spark.createDataFrame([(1, "has /VP here")], "k int, t string"), "k", "t", ["/VP", "/GPTS"]).first()
    assert tuple(t) == (1, True, False)
    d = mapping.drawing_inventory(spark.createDataFrame([("red", None), ("red", "blue")], "fill string, stroke string")).collect()
    assert [(r.key, r.n) for r in d] == [("fill red", 2), ("stroke blue", 1)]


def test_land_once(spark, tmp_path):
    for n in (1, 2):
        mapping.land(spark.range(n), str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x")).count() == 1


def test_open_water_without_mask(spark):
    p = spark.range(3).withColumnRenamed("id", "k")
    assert mapping.open_water(p, None, "k").where("inside").count() == 3
    assert mapping.open_water(p, p.where("k = 1"), "k").where("inside").count() == 1


def test_simplify_in_metres(spark):
    ring = [(0.0, 45.0), (0.0005, 45.0000001), (0.001, 45.0), (0.001, 45.001), (0.0, 45.001)]
    df = spark.createDataFrame([(0, 1, i, x, y) for i, (x, y) in enumerate(ring)], "k int, ring_id long, i int, x double, y double")
    assert sorted(r.i for r in mapping.simplify_metric(df).collect()) == [0, 2, 3, 4]
    assert mapping.simplify_metric(df.withColumn("y", F.when(F.col("i") == 1, 45.0002).otherwise(F.col("y")))).count() == 5
