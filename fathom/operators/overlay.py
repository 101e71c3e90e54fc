"""Overlay of polygons by what lies above and below their edges: areas of unions and symmetric differences, exact but for rounding.

Edges (by, geom, x1, y1, x2, y2) are cut into strips of x. At an edge's begin within a strip the parity of each geometry's edges above it decides which
ones are on its upper side, and those with an edge in it itself are on the other side if not on this one. From there on a geometry's parity
changes only where the edge meets one of its edges (upright ones among them), so that a strip needs a pass over its pairs of edges and a sort of the places where they meet. Holes and rings need no
orientation, edges of several geometries may coincide, and a part of an edge bounds the union (or what an odd number of geometries cover) if only one of its
sides is in it. Areas are sums of integrals below such parts; upright edges have none and only cut others.

Geometries of the same edges are laid over the others once, with their number as weight, which is exact: copies cost no more than to tell them. A geometry of over ``LONG`` edges
is not compared. Strips are as wide as an edge is on average; a strip's edges are taken in blocks against all of the strip, so that memory is bounded by its edges, not by their pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from fathom.shared import Tables

#: Nearer than this, in units of the coordinates, is the same place.
SAME = 1e-7
#: Edges of the longest geometry that is compared with others as a whole.
LONG = 4096
#: Pairs of edges that a kernel looks at together.
PAIRS = 1 << 20

def ring_edges(rings: DataFrame, by: str, geom: str) -> DataFrame:
    """Edges of rings (by, geom, i, x, y) from left to right."""
    from fathom.operators.curves import with_neighbours

    e = with_neighbours(rings).where("x != nx or y != ny").select(F.col(by).alias("by"), F.col(geom).alias("geom"), *(F.col(c) for c in ("x", "y", "nx", "ny")))
    right = F.col("x") < F.col("nx")
    end = lambda a, b, n: F.when(right, F.col(a)).otherwise(F.col(b)).cast("double").alias(n)
    return e.select("by", "geom", end("x", "nx", "x1"), end("y", "ny", "y1"), end("nx", "x", "x2"), end("ny", "y", "y2"))


def _weighted(edges: DataFrame) -> DataFrame:
    """(by, geom, m, x1, y1, x2, y2) of one of the m geometries that have the same edges."""
    upright = F.col("x1") == F.col("x2")
    ends = {"y1": F.when(upright, F.least("y1", "y2")).otherwise(F.col("y1")), "y2": F.when(upright, F.greatest("y1", "y2")).otherwise(F.col("y2"))}
    e = edges.where("x1 <= x2 and y1 is not null and y2 is not null").withColumns(ends).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("by", "geom")))
    shape = F.struct("x1", "y1", "x2", "y2")
    short = e.where(F.col("n") <= LONG).groupBy("by", "geom").agg(F.sort_array(F.collect_list(shape)).alias("es"))
    short = short.groupBy("by", "es").agg(F.min("geom").alias("geom"), F.count(F.lit(1)).cast("double").alias("m"))
    long = e.where(F.col("n") > LONG).select("by", "geom", F.lit(1.0).alias("m"), "x1", "y1", "x2", "y2")
    return short.select("by", "geom", "m", F.inline("es")).unionByName(long)


def _slope(e: np.ndarray) -> np.ndarray:
    return (e[3] - e[1]) / np.where(e[0] < e[2], e[2] - e[0], np.inf)


def _sides(f: np.ndarray, number: np.ndarray, first: np.ndarray, m: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Three sums over those of the edges f (columns x1, y1, x2, y2; of a geometry together) that have the places ``some``."""
    e = f[:, some]
    a, b = e[:, :, None], f[:, None, :]
    upright = b[0] == b[2]
    low, high = np.maximum(a[0], b[0]), np.minimum(a[2], b[2])
    met = np.where(upright, (a[0] < b[0]) & (b[0] < a[2]), low < high)
    begin = lambda g, x: g[1] + (x - g[0]) * _slope(g)
    end = lambda g, x: np.where(x == g[2], g[3], begin(g, x))
    left, right = begin(b, low) - begin(a, low), end(b, high) - end(a, high)
    left[np.abs(left) <= SAME] = 0.0
    right[np.abs(right) <= SAME] = 0.0
    spans = met & ~upright & (b[0] <= a[0])
    who, x, gain = [], [], []
    counts = []
    for over in (np.greater, np.greater_equal):  # above the edge's upper side, and its lower one
        at_left, at_right = over(left, 0.0), over(right, 0.0)
        parity = np.add.reduceat((spans & at_left).astype(np.int32), first, axis=1) % 2
        counts.append(parity @ m)
        i, j = np.nonzero(met & (at_left != at_right))
        lo, hi, u, v = (t[i, j] for t in (low, high, left, right))
        where = np.clip(lo + (hi - lo) * (u / (u - v)), lo, hi)
        g = number[j]
        order = np.lexsort((where, g, i))
        i, where, g = i[order], where[order], g[order]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (g[1:] != g[:-1])
        rank = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
        change = np.zeros((3, len(i)))
        change[len(counts) - 1] = np.where((parity[i, g] + rank) % 2 == 0, m[g], -m[g])
        who.append(i), x.append(where), gain.append(change)
    # Where edges coincide, only the first counts.
    i, j = np.nonzero(met & ~upright & (left == 0) & (right == 0) & (np.arange(f.shape[1])[None, :] < some[:, None]))
    for t, way in ((low, 1.0), (high, -1.0)):
        change = np.zeros((3, len(i)))
        change[2] = way
        who.append(i), x.append(t[i, j]), gain.append(change)
    k = e.shape[1]
    all_ = np.arange(k)
    change = np.vstack([*counts, np.zeros(k)])
    who = np.concatenate([all_, *who, all_])
    x = np.concatenate([e[0], *x, e[2]])
    gain = np.hstack([change, *gain, -change])
    kind = np.concatenate([np.zeros(k, int), np.ones(len(who) - 2 * k, int), np.full(k, 2)])
    order = np.lexsort((kind, x, who))
    who, x, gain = who[order], x[order], gain[:, order]
    # Running sums of each edge from its begin on.
    begins = np.searchsorted(who, all_)
    total = np.cumsum(gain, axis=1)
    before = np.hstack([np.zeros((3, 1)), total])[:, begins]
    state = np.rint(total - before[:, who])[:, :-1]
    same = who[1:] == who[:-1]
    u, v, o = x[:-1], x[1:], who[:-1]
    below = np.where(same & (state[2] == 0), (v - u) * (e[1][o] + ((u + v) / 2 - e[0][o]) * _slope(e)[o]), 0.0)
    up, down = state[0], state[1]
    return np.array([(((down > 0) * 1.0 - (up > 0)) * below).sum(), ((down % 2 - up % 2) * below).sum(), ((down - up) * below).sum()])


def _strip_sums(edges: pa.Table) -> pa.Table:
    """Sums of one strip of a category, its edges cut to the strip."""
    geoms = edges.column("geom").combine_chunks().dictionary_encode()
    number = geoms.indices.to_numpy()
    order = np.argsort(number, kind="stable")
    number = number[order]
    f = np.array([edges.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")])[:, order]
    f[1::2] -= f[1::2].mean()  # what is below cancels out
    first = np.flatnonzero(np.diff(number, prepend=-1))
    m = edges.column("m").to_numpy()[order][first]
    sloping, step = np.flatnonzero(f[0] < f[2]), max(1, PAIRS // f.shape[1])
    found = sum((_sides(f, number, first, m, sloping[k : k + step]) for k in range(0, len(sloping), step)), np.zeros(3))
    return pa.table({"by": edges.column("by").slice(0, 1), **{n: [v] for n, v in zip(("any", "odd", "all"), found.tolist(), strict=True)}})


def areas(edges: DataFrame) -> DataFrame:
    """(by, union_area, odd_area, sum_area): of what any geometry covers, of what an odd number covers, and of all added up."""
    with Tables(edges.sparkSession) as tables:
        edges = tables.written(_weighted(edges), "edges")
        wide = edges.agg(F.avg(F.col("x2") - F.col("x1"))).first()[0] or 1.0
        strip = lambda x: F.floor(F.col(x) / wide)
        slope = F.try_divide(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
        at = lambda x: F.when(x == F.col("x1"), F.col("y1")).when(x == F.col("x2"), F.col("y2")).otherwise(F.col("y1") + (x - F.col("x1")) * slope)
        e = edges.withColumn("strip", F.explode(F.sequence(strip("x1"), strip("x2"))))
        u, v = F.greatest(F.col("x1"), F.col("strip") * F.lit(wide)), F.least(F.col("x2"), (F.col("strip") + 1) * F.lit(wide))
        end = F.when(F.col("x1") == F.col("x2"), F.col("y2")).otherwise(at(v))
        cut = e.where((u < v) | (F.col("x1") == F.col("x2"))).select("by", "strip", "geom", "m", u.alias("x1"), at(u).alias("y1"), v.alias("x2"), end.alias("y2"))
        # As many partitions as asked for, as strips are few bytes and much work.
        parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = StructType([edges.schema["by"], *(StructField(n, DoubleType()) for n in ("any", "odd", "all"))])
        sums = cut.repartition(parts, "by", "strip").groupBy("by", "strip").applyInArrow(_strip_sums, out)
        return tables.kept(sums.groupBy("by").agg(F.sum("any").alias("union_area"), F.sum("odd").alias("odd_area"), F.sum("all").alias("sum_area")), "areas")
