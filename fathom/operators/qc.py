"""Quality gates: metrics, limits, and a report that fails closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits of the gates: (metric, least, most).
PUBLISHED = (("mean_shift", -0.08, 0.08), ("within1", 0.90, None))
ROUND_TRIP = (("iou", 0.995, None), ("stable_exact", 0.999, None), ("mean_shift", -0.015, 0.015))
SMOOTH = (("iou", 0.997, None), ("within1", 0.999, None), ("mean_shift", -0.01, 0.01))


def judged(metrics: DataFrame, gates) -> DataFrame:
    """metrics with an array of the gates they break; a missing metric breaks its gate."""
    broken = []
    for name, least, most in gates:
        bad = F.col(name).isNull()
        if least is not None:
            bad = bad | (F.col(name) < least)
        if most is not None:
            bad = bad | (F.col(name) > most)
        broken.append(F.when(bad, F.lit(name)))
    return metrics.withColumn("broken", F.filter(F.array(*broken), lambda b: b.isNotNull()))


def gate(metrics: DataFrame, gates) -> DataFrame:
    """metrics, or an error where one breaks a gate."""
    j = judged(metrics, gates)
    said = F.concat(F.lit("gates not met: "), F.array_join("broken", ", "))
    return j.where(F.when(F.size("broken") == 0, F.lit(True)).otherwise(F.raise_error(said))).drop("broken")


def report(**parts: DataFrame) -> DataFrame:
    """One row with a struct for each one-row part and an array of structs for the others."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name)).withColumn("__k", F.lit(0))
        out = one if out is None else out.join(one, "__k")
    return out.drop("__k")
