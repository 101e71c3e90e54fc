"""Areas of unions and symmetric differences against shapes whose areas are known, and counted cells."""

import random

import numpy as np
from pyspark.sql import functions as F

from fathom.operators import overlay


def square(x, y, s, turn=1):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)][::turn]


def areas(spark, shapes):
    rows = [(k, g, i, float(x), float(y)) for (k, g), ps in shapes.items() for i, (x, y) in enumerate(ps)]
    df = spark.createDataFrame(rows, "k int, ring_id long, i int, x double, y double")
    return {r.by: (round(r.union_area, 6), round(r.odd_area, 6), round(r.sum_area, 6)) for r in overlay.areas(overlay.ring_edges(df, "k", "ring_id")).collect()}


def test_known_shapes(spark):
    shapes = {
        (1, 1): square(0, 0, 10), (1, 2): square(5, 5, 10, -1), (1, 3): square(5, 0, 10),  # three that overlap and share sides
        (2, 1): square(0, 0, 10), (2, 2): square(0, 0, 10, -1),  # the same twice
        (3, 1): [(0, 0), (10, 0), (5, 10)], (3, 2): [(0, 5), (10, 5), (5, -5)],  # a star
        (4, 1): square(0, 0, 4), (4, 2): square(10, 10, 2),  # apart
        (5, 1): square(0, 0, 10), (5, 2): square(3, 3, 2),  # one within the other
        (6, 1): square(0, 0, 4), (6, 2): square(4, 0, 4),  # side by side
    }
    assert areas(spark, shapes) == {1: (200, 150, 300), 2: (100, 0, 200), 3: (68.75, 37.5, 100), 4: (20, 20, 20), 5: (100, 96, 104), 6: (32, 32, 32)}


def test_cells(spark):
    rng = random.Random(2)
    shapes, count = {}, np.zeros((60, 60), int)
    for g in range(14):  # right-angled shapes on a lattice, so that cells count their areas
        x, y, w, h = rng.randrange(40), rng.randrange(40), rng.randrange(4, 20), rng.randrange(4, 20)
        a, b = rng.randrange(1, w), rng.randrange(1, h)
        shapes[1, g] = [(x, y), (x + w, y), (x + w, y + b), (x + a, y + b), (x + a, y + h), (x, y + h)]
        count[y : y + b, x : x + w] += 1
        count[y + b : y + h, x : x + a] += 1
    assert areas(spark, shapes) == {1: ((count > 0).sum(), (count % 2).sum(), count.sum())}


def test_no_rings(spark):
    df = spark.createDataFrame([], "k int, ring_id long, i int, x double, y double")
    assert overlay.areas(overlay.ring_edges(df, "k", "ring_id")).select(F.count("*")).first()[0] == 0


def test_many_rings_over_each_other(spark):
    """Copies are laid over the others once: 150 different octagons that all meet, twenty times each and one of them once more."""
    rng = random.Random(5)
    distinct = [[(rng.randrange(40) + dx, rng.randrange(40) + dy) for dx, dy in ((10, 0), (30, 0), (40, 10), (40, 30), (30, 40), (10, 40), (0, 30), (0, 10))] for _ in range(150)]
    once = overlay.ring_edges(spark.createDataFrame([(1, g, i, float(x), float(y)) for g, ps in enumerate(distinct) for i, (x, y) in enumerate(ps)], "k int, ring_id long, i int, x double, y double"), "k", "ring_id")
    copies = once.withColumn("geom", F.explode(F.sequence(F.col("geom"), F.col("geom") + F.when(F.col("geom") == 7, 20000).otherwise(19000), F.lit(1000))))
    assert overlay._weighted(copies).select("geom", "m").distinct().count() == 150
    a, b, one = overlay.areas(once).first(), overlay.areas(copies).first(), overlay.areas(once.where("geom = 7")).first()
    assert abs(a.union_area - b.union_area) < 1e-6 and abs(b.odd_area - one.odd_area) < 1e-6
    assert abs(b.sum_area - 20 * a.sum_area - one.sum_area) < 1e-4
