"""Calibration of a survey against class cells: whole populations of candidates in one job, generations in a loop over gathered points."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import exprs as E
from fathom.operators.relational import robust_objective
from fathom.shared import Tables

PARAMETERS = ("dx", "dy", "sx", "sy", "theta", "off")
BOUNDS = ((-80, 80), (-80, 80), (0.97, 1.03), (0.97, 1.03), (-np.radians(2), np.radians(2)), (-0.8, 0.8))
#: Cells of the largest raster that is sent to all points; with more, points and cells meet by a shuffle.
FEW_CELLS = 100_000


def prior() -> Column:
    """A weak preference for no transform."""
    sq = lambda c: c * c
    c = F.col
    return (sq(c("dx") / 30) + sq(c("dy") / 30)) * 0.002 + sq((c("sx") - 1) / 0.025) * 0.03 + sq((c("sy") - 1) / 0.025) * 0.03 + sq(c("theta") / 0.025) * 0.015 + sq(c("off") / 0.5) * 0.002


def weighted(points: DataFrame) -> DataFrame:
    """Points (x, y, depth) with the number n of those that are alike; points that have a column n stand for so many."""
    n = F.sum("n") if "n" in points.columns else F.count(F.lit(1))
    return points.groupBy("x", "y", "depth").agg(n.alias("n"))


def objectives(points: DataFrame, cells: DataFrame, candidates: DataFrame, cx: float, cy: float) -> DataFrame:
    """(candidate, objective) of candidates (candidate, dx, dy, sx, sy, theta, off): points (x, y, depth) moved onto cells (y, x, k).

    The candidates of a generation are a few dozen rows; points that are alike are one row with their number (``weighted``), which is sent once for each of them.
    """
    n = candidates.select(F.collect_list(F.struct("candidate", *PARAMETERS)).alias("cs")).first()["cs"]
    each = F.array(*(F.struct(*(F.lit(r[i]).alias(name) for i, name in enumerate(("candidate", *PARAMETERS)))) for r in n))
    few = points if "n" in points.columns else weighted(points)
    moved = few.select("x", "y", "depth", "n", F.explode(each).alias("c")).select("x", "y", "depth", "n", "c.*")
    mx, my = E.similarity(F.col("x"), F.col("y"), cx, cy, F.col("dx"), F.col("dy"), F.col("sx"), F.col("sy"), F.col("theta"))
    placed = moved.select("candidate", "n", (F.col("depth") + F.col("off")).alias("q"), F.rint(my).cast("int").alias("cell_y"), F.rint(mx).cast("int").alias("cell_x"))
    met = placed.join(cells.select(F.col("y").alias("cell_y"), F.col("x").alias("cell_x"), "k"), ["cell_y", "cell_x"], "left")
    known = F.col("k").isNotNull()
    fit = robust_objective(E.interval_error(F.col("k"), F.col("q")), known, weight=F.col("n"))
    found = met.groupBy("candidate").agg(fit.alias("fit"), (F.sum(F.when(known, F.col("n")).otherwise(0)) / F.sum("n")).alias("valid"))
    poor = F.lit(10.0) + (F.lit(0.5) - F.col("valid")) * 20
    judged = F.when(F.col("valid") < 0.5, poor).otherwise(F.col("fit") + prior()).alias("objective")
    return found.join(F.broadcast(candidates.select("candidate", *PARAMETERS)), "candidate").select("candidate", judged)


def evolve(loss: Callable[[np.ndarray], np.ndarray], bounds=BOUNDS, size: int = 24, generations: int = 20, seed: int = 42) -> tuple[np.ndarray, float]:
    """Differential evolution (best/1/bin) with one call of ``loss`` for each whole generation."""
    rng = np.random.default_rng(seed)
    low, high = np.array(bounds, float).T
    people = low + rng.random((size, len(low))) * (high - low)
    people[0] = np.clip([0, 0, 1, 1, 0, 0][: len(low)], low, high)
    cost = loss(people)
    for _ in range(generations):
        best = people[cost.argmin()]
        a, b = (people[rng.permutation(size)] for _ in range(2))
        trial = np.where(rng.random(people.shape) < 0.7, best + rng.uniform(0.5, 1.0) * (a - b), people)
        trial = np.where((trial < low) | (trial > high), low + rng.random(people.shape) * (high - low), trial)
        new = loss(trial)
        better = new <= cost
        people[better], cost[better] = trial[better], new[better]
        if cost.std() <= 2e-4 * abs(cost.mean()):
            break
    return people[cost.argmin()], float(cost.min())


def nelder_mead(loss: Callable[[np.ndarray], np.ndarray], start: np.ndarray, scale: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """A simplex that asks for its reflected, stretched and two contracted points in one call."""
    simplex = np.vstack([start, start + np.diag(scale)])
    cost = loss(simplex)
    for _ in range(rounds):
        order = cost.argsort()
        simplex, cost = simplex[order], cost[order]
        if np.ptp(cost) < 1e-5 and np.abs(simplex[1:] - simplex[0]).max() < 1e-4:
            break
        middle = simplex[:-1].mean(0)
        d = middle - simplex[-1]
        points = np.array([middle + d, middle + 2 * d, middle + d / 2, middle - d / 2])
        r, e, out, inner = values = loss(points)
        if r < cost[0]:
            k = 1 if e < r else 0
        elif r < cost[-2]:
            k = 0
        else:
            k = 2 if out <= inner else 3
        if values[k] < cost[-1]:
            simplex[-1], cost[-1] = points[k], values[k]
        else:
            simplex[1:] = (simplex[1:] + simplex[0]) / 2
            cost[1:] = loss(simplex[1:])
    return simplex[cost.argmin()], float(cost.min())


def calibrate(points: DataFrame, cells: DataFrame, size: int = 24, generations: int = 20, rounds: int = 40) -> tuple[np.ndarray, float]:
    """The better of the evolved and the polished parameters, and its objective. One job a generation, over points and cells that are gathered once."""
    spark = points.sparkSession
    with Tables(spark) as tables:
        few, cells = tables.written(weighted(points), "points"), tables.written(cells, "cells")
        # By rows, as a compressed table's bytes say little about what it takes in memory.
        cells = cells.hint("broadcast" if cells.count() <= FEW_CELLS else "merge")
        cx, cy = few.agg(F.percentile("x", F.lit(0.5), F.col("n")), F.percentile("y", F.lit(0.5), F.col("n"))).first()

        def loss(people: np.ndarray) -> np.ndarray:
            table = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(people)], "candidate int, " + ", ".join(f"{n} double" for n in PARAMETERS))
            got = {r.candidate: r.objective for r in objectives(few, cells, table, cx, cy).collect()}
            return np.array([got[k] for k in range(len(people))])

        p, cost = evolve(loss, size=size, generations=generations)
        q, polished = nelder_mead(loss, p, np.array([2.0, 2.0, 0.002, 0.002, 0.002, 0.05]), rounds)
    return (q, polished) if polished <= cost else (p, cost)


def fit_report(points: DataFrame, k: Column, depth: Column) -> DataFrame:
    """Valid share, share in the band, mean interval error and median error from the middle."""
    error = E.interval_error(k, depth)
    return points.agg(F.avg(k.isNotNull().cast("double")).alias("valid_fraction"), F.avg(F.when(k.isNotNull(), (error == 0).cast("double"))).alias("in_band"), F.avg(F.when(k.isNotNull(), error)).alias("mean_error"), F.median(F.when(k.isNotNull(), F.abs(depth - (k + 0.5)))).alias("median_mid_error"))


def legend_run(swatches: DataFrame, length: int = 8) -> DataFrame:
    """The begin of the most regular run of ``length`` swatches (cx, cy) down the page, and its score: spread of gaps over their mean, and a little of the spread across."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("page").orderBy("cy")
    run = w.rowsBetween(0, length - 1)
    gaps = w.rowsBetween(0, length - 2)
    s = swatches.withColumn("gap", F.lead("cy").over(w) - F.col("cy"))
    s = s.withColumns({"n": F.count(F.lit(1)).over(run), "score": F.stddev_pop("gap").over(gaps) / (F.avg("gap").over(gaps) + 1e-9) + F.stddev_pop("cx").over(run) * 0.003})
    return s.where(F.col("n") == length).groupBy("page").agg(F.min_by(F.struct("cy", "score"), F.struct("score", "cy")).alias("b")).select("page", "b.cy", "b.score")


def inferred_swatch(swatches: DataFrame) -> DataFrame:
    """The place of an eighth swatch below seven regular ones."""
    from pyspark.sql.window import Window

    s = swatches.withColumn("gap", F.lead("cy").over(Window.partitionBy("page").orderBy("cy")) - F.col("cy"))
    a = s.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("spread"), F.stddev_pop("cx").alias("across"), F.max("cy").alias("last"), F.median("gap").alias("gap"), F.median("cx").alias("cx"))
    return a.where("n = 7 and mean > 20 and spread < 4 and across < 3").select("page", "cx", (F.col("last") + F.col("gap")).alias("cy"))
