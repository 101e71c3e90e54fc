"""Rounds of simplification: what they compare, and what they send."""

import re

from pyspark.sql import functions as F

from fathom.operators import curves
from fathom.shared import Tables


def spiral_rings(spark, n):
    """Thin bent rings that meet themselves when simplified, and some that do from the begin."""
    at = F.col("i")
    r = spark.range(n).select((F.col("id") % 3).cast("int").alias("k"), F.col("id").alias("ring_id"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("i"))
    bend = F.sin(F.when(at < 20, at).otherwise(39 - at) * (0.3 + F.col("ring_id") % 7 * 0.1)) * 9
    return r.select("k", "ring_id", "i", F.when(at < 20, at).otherwise(39 - at).cast("double").alias("x"), (bend + F.when(at < 20, 0.0).otherwise(F.when((F.col("ring_id") % 4 == 0) & (at > 30), -1.0).otherwise(1.0) * (F.col("ring_id") % 5 + 0.5))).alias("y"))


def test_sides_with_and_without_cells(spark, monkeypatch):
    rings, found = spiral_rings(spark, 40), []
    for few in (0, 1000):
        monkeypatch.setattr(curves, "FEW_SIDES", few)
        crossed = sorted(map(tuple, curves.crossings(rings, 3.0).collect()))
        found.append((crossed, sorted(map(tuple, curves.simplified_valid(rings, 3.0).collect()))))
    assert found[0][0] and found[0] == found[1]


def test_only_changed_rings_again(spark, monkeypatch):
    plans, write = [], Tables.written

    def seen(self, df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(self, df, name)

    monkeypatch.setattr(Tables, "written", seen)
    rings = spiral_rings(spark, 40)
    found = curves.simplified_valid(rings, 3.0)
    names = [name for name, _ in plans]
    assert names.count("crossing") > 1 and names.count("again") == names.count("crossing") - 1 and names.count("kept") == 1
    # Only hot segments are sent to all tasks.
    assert not [line for name, plan in plans for line in plan.splitlines() if re.search(r"Broadcast\w*Join", line) and "LeftOuter" not in line]
    assert found.select("k", "ring_id").distinct().count() == 40
