"""Contours of masks of any size: marching squares at one half as joins, rings by distributed list ranking.

Each cell of a mask sets one corner of the four squares around it, and a square's corners, added up, choose its case: which of its sides
a contour joins, the high side on the left, where saddles keep the high corners together. Every point (the middle of a side) has one next point.
Within a tile points are strung to chains; a ring within a tile is done with that. Chains are ranked by pointer
jumping: in each round every chain learns from the one twice as far ahead, first the ring's smallest point, then how far the ring's end is, so that
rounds grow with the logarithm of the tiles that a ring crosses. No group holds more than a tile of one mask.

A ring's id is the number of its smallest point, and points are numbered from there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.kernels import CASES
from fathom.shared import Tables


def point(y: Column, x: Column, upright: int) -> Column:
    """The number of the middle of a side: of the one from (y, x) to the right, or of the upright one down."""
    return F.shiftleft((y + 1).cast("long"), 32) + (x + 1).cast("long") * 2 + upright


def links(masks: DataFrame, key: str) -> DataFrame:
    """(key, node, to) of the contours of masks (key, y, x)."""
    corner = lambda dy, dx, bit: F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.lit(bit).alias("bit"))
    corners = masks.select(key, "y", "x").distinct().select(key, F.inline(F.array(corner(0, 0, 1), corner(0, 1, 2), corner(1, 1, 4), corner(1, 0, 8))))
    squares = corners.groupBy(key, "y", "x").agg(F.sum("bit").cast("int").alias("case"))
    y, x = F.col("y"), F.col("x")
    side = {0: point(y, x, 0), 1: point(y, x + 1, 1), 2: point(y + 1, x, 0), 3: point(y, x, 1)}
    none = F.array().cast("array<struct<node:bigint,to:bigint>>")
    joined = F.coalesce(*(F.when(F.col("case") == c, F.array(*(F.struct(side[a].alias("node"), side[b].alias("to")) for a, b in pairs))) for c, pairs in CASES.items()), none)
    return squares.where("case < 15").select(key, F.inline(joined))


def string(node: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of points that are sorted, with where each leads: their chain's first point, their rank in it, and whether they end it."""
    n = len(node)
    at = np.minimum(np.searchsorted(node, to), n - 1)
    after = np.where(node[at] == to, at, -1)
    before = np.full(n, -1)
    before[after[after >= 0]] = np.flatnonzero(after >= 0)

    def ranked() -> tuple[np.ndarray, np.ndarray]:
        top = np.where(before >= 0, before, np.arange(n))
        rank = (before >= 0).astype(np.int64)
        for _ in range(n.bit_length()):
            rank, top = rank + rank[top], top[top]
        return top, rank

    top, rank = ranked()
    closed = np.flatnonzero(before[top] >= 0)
    if len(closed):
        least, jump = node.copy(), np.where(after >= 0, after, np.arange(n))
        for _ in range(n.bit_length()):
            least, jump = np.minimum(least, least[jump]), jump[jump]
        before[closed[node[closed] == least[closed]]] = -1
        top, rank = ranked()
    return node[top], rank, (after < 0) | (before[after] < 0)


def _chains(points: DataFrame, key: str, tile: int) -> DataFrame:
    """(key, node, head, rank, to): ``to`` at a chain's last point only."""
    y = F.shiftright("node", 32)
    x = F.shiftright(F.col("node").bitwiseAND(F.lit(0xFFFFFFFF)), 1)
    tiled = points.select(key, F.floor(y / tile).cast("int").alias("ty"), F.floor(x / tile).cast("int").alias("tx"), "node", "to")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        node, to = t.column("node").to_numpy(), t.column("to").to_numpy()
        head, rank, last = string(node, to)
        return pa.table({key: t.column(key), "node": t.column("node"), "head": pa.array(head), "rank": pa.array(rank), "to": pa.array(to, mask=~last)})

    return tiled.groupBy(key, "ty", "tx").applyInArrow(run, f"{key} {points.schema[key].dataType.simpleString()}, node long, head long, rank long, to long")


def rings(masks: DataFrame, key: str = "t", tile: int = 512) -> DataFrame:
    """(key, ring_id, i, x, y) of the closed rings around masks (key, y, x); outside the raster nothing is set."""
    with Tables(masks.sparkSession) as tables:
        strung = tables.written(_chains(links(masks, key), key, tile), "strung")
        chains = strung.groupBy(key, "head").agg(F.count(F.lit(1)).alias("length"), F.max("to").alias("to"), F.min(F.struct("node", "rank")).alias("own"))
        chains = tables.written(chains.select(key, "head", "length", "to", "own", F.col("own").alias("least")), "chains")

        def ahead(now: DataFrame, *cols: Column) -> DataFrame:
            far = now.select(key, F.col("head").alias("to"), F.struct(*(c for c in now.columns if c not in (key, "head"))).alias("far"))
            return now.join(far, [key, "to"], "left").select(key, "head", *cols)

        # The smallest point of each ring: windows double until no one learns of a smaller one.
        now, moving = chains.select(key, "head", "to", F.col("least.node").alias("least")), True
        while moving:
            new = tables.written(ahead(now, F.col("far.to").alias("to"), F.least("least", "far.least").alias("least"), (F.col("far.least") < F.col("least")).alias("changed")), "least")
            moving = not new.where("changed").isEmpty()
            now = new.drop("changed")
        named = tables.written(chains.drop("least").join(now.select(key, "head", F.col("least").alias("ring_id")), [key, "head"]), "named")

        # How far it is to the end of each ring, which is before the chain that holds its smallest point.
        first = F.col("own.node") == F.col("ring_id")
        begins = named.where(first).select(key, F.col("head").alias("to"), F.lit(True).alias("round"))
        now = named.select(key, "head", "to", "length").join(begins, [key, "to"], "left")
        now = tables.written(now.select(key, "head", F.when(F.col("round").isNull(), F.col("to")).alias("to"), F.col("length").alias("left")), "cut")
        while not now.where("to is not null").isEmpty():
            now = tables.written(ahead(now, F.col("far.to").alias("to"), (F.col("left") + F.coalesce("far.left", F.lit(0))).alias("left")), "left")

        placed = named.join(now.select(key, "head", "left"), [key, "head"])
        whole = placed.where(first).select(key, "ring_id", F.col("left").alias("whole"), F.col("own.rank").alias("skip"))
        placed = placed.join(whole, [key, "ring_id"]).select(key, "head", "ring_id", "whole", (F.col("whole") - F.col("left") - F.col("skip")).alias("begin"))
        up = F.col("node").bitwiseAND(F.lit(1)) == 1
        y = (F.shiftright("node", 32) - 1).cast("double")
        x = (F.shiftright(F.col("node").bitwiseAND(F.lit(0xFFFFFFFF)), 1) - 1).cast("double")
        out = strung.join(placed, [key, "head"]).select(key, "ring_id", F.pmod(F.col("begin") + F.col("rank"), F.col("whole")).alias("i"), F.when(up, x).otherwise(x + 0.5).alias("x"), F.when(up, y + 0.5).otherwise(y).alias("y"))
        return tables.kept(out, "rings")
