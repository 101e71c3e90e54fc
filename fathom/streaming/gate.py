"""Position fixes: the accuracy gate and tracks on tables (on streams: live.py), and enrichment on both.

The gate, for each subscription in the order of (ts, event_id): every fix of at most 20 m is delivered;
where none has been and 12 s have passed since the first, the best so far is delivered once, when the
next fix comes. After that only good fixes are. A fix without an accuracy is not a good one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom import model as M

EMITTED = "user_id long, event_id long, emitted_id long, accuracy double, status string"


def gate_table(fixes: DataFrame, accuracy: float = M.GATE_ACCURACY, seconds: float = M.GATE_SECONDS) -> DataFrame:
    """The gate over a table: (user_id, event_id of the fix that came, emitted_id and accuracy of the fix delivered, status)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    good = F.coalesce(F.col("accuracy") <= accuracy, F.lit(False))
    late = F.unix_micros("ts") - F.unix_micros(F.first("ts").over(upto)) >= int(seconds * 1_000_000)
    best = F.min_by(F.struct("event_id", "accuracy"), F.when(F.col("accuracy").isNotNull(), F.struct("accuracy", "ts", "event_id"))).over(upto)
    f = fixes.withColumns({"good": good, "late": late, "best": best}).withColumn("had", F.coalesce(F.max(F.col("good").cast("int")).over(before), F.lit(0)))
    f = f.withColumn("may", ~F.col("good") & F.col("late") & (F.col("had") == 0) & F.col("best.event_id").isNotNull())
    f = f.withColumn("nth", F.sum(F.col("may").cast("int")).over(upto))
    once = F.col("may") & (F.col("nth") == 1)
    status = F.when(F.col("good"), "delivered").when(once, "fallback").otherwise("refining")
    chosen = F.when(F.col("good"), F.struct("event_id", "accuracy")).when(once, F.col("best"))
    return f.select("user_id", "event_id", chosen["event_id"].alias("emitted_id"), chosen["accuracy"].alias("accuracy"), status.alias("status"))


TRACK = "user_id long, i int, event_id long, x double, y double"


def _kept(pdf: pd.DataFrame, last: tuple[float, float] | None, least: float) -> list[tuple[int, float, float]]:
    out = []
    for event, x, y in zip(pdf.event_id, pdf.x, pdf.y, strict=True):
        if last is None or (x - last[0]) * (x - last[0]) + (y - last[1]) * (y - last[1]) > least * least:
            last = (x, y)
            out.append((int(event), float(x), float(y)))
    return out


def track_table(fixes: DataFrame, least: float = 1.0, most: int = M.TRACK_LENGTH) -> DataFrame:
    """The last ``most`` points of each track whose distance from the point kept before is over ``least``.

    What is kept depends on what was kept, which a window can't express; a user's fixes are one group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["ts", "event_id"])
        rows = _kept(p, None, least)[-most:]
        return pd.DataFrame([(p.user_id.iloc[0], i, *r) for i, r in enumerate(rows)], columns=["user_id", "i", "event_id", "x", "y"])

    return fixes.select("user_id", "ts", "event_id", "x", "y").groupBy("user_id").applyInPandas(run, TRACK)


def enrich(fixes: DataFrame, cells: DataFrame, levels: DataFrame, iy, ix) -> DataFrame:
    """Stream or table of fixes with the class under them and the level's depth interval; fixes off the grid stay. Of ``levels`` one row counts."""
    from fathom.functions.exprs import band_info

    placed = fixes.withColumns({"y": iy, "x": ix, "__one": F.lit(1)})
    met = placed.join(cells.select("y", "x", "k"), ["y", "x"], "left").join(F.broadcast(levels.limit(1).withColumn("__one", F.lit(1))), "__one", "left").drop("__one")
    return met.select("*", *band_info(F.col("k"), F.col("level")))


def windowed_counts(fixes: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: fixes by tumbling window with a watermark."""
    return fixes.withWatermark("ts", late).groupBy(F.window("ts", length)).agg(F.count(F.lit(1)).alias("n"), F.avg("accuracy").alias("accuracy"))
