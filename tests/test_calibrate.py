"""Points that are alike are moved once with their number, which changes no objective."""

from pyspark.sql import functions as F

from fathom.operators import calibrate

CANDIDATES = ((0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0), (1, 1.5, -0.75, 1.01, 0.99, 0.01, 0.25), (2, 70.0, 70.0, 1.0, 1.0, 0.0, 0.0))


def test_alike_points(spark, monkeypatch):
    points = spark.range(4000).select((F.col("id") % 20 + 0.125).alias("x"), (F.col("id") % 16 + 0.25).alias("y"), F.when(F.col("id") % 11 > 0, F.col("id") % 5 + 0.5).alias("depth"))
    cells = spark.range(300).select((F.col("id") % 15).cast("int").alias("y"), (F.col("id") % 20).cast("int").alias("x"), (F.col("id") % 4).cast("int").alias("k"))
    candidates = spark.createDataFrame(CANDIDATES, "candidate int, " + ", ".join(f"{n} double" for n in calibrate.PARAMETERS))
    few = calibrate.weighted(points)
    assert few.count() <= 20 * 16 * 6 < few.agg(F.sum("n")).first()[0] == 4000
    each = points.withColumn("n", F.lit(1))  # not gathered
    found = [{r.candidate: round(r.objective, 9) for r in calibrate.objectives(p, cells, candidates, 10.0, 8.0).collect()} for p in (points, few, each)]
    assert found[0] == found[1] == found[2] and found[0][2] > 10 > found[0][1]
    fits = []
    for most in (0, 100_000):  # by a shuffle of the cells, or sent to all points
        monkeypatch.setattr(calibrate, "FEW_CELLS", most)
        fits.append(calibrate.calibrate(points, cells, size=4, generations=1, rounds=1)[1])
    assert abs(fits[0] - fits[1]) < 1e-9
