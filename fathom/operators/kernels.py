"""Kernels that need a whole raster or ring: components, holes, distances, contours, simplification.

Each runs in NumPy on one raster or ring at a time, grouped by a key; a raster of a few million cells
fits a task. Components of larger rasters are labelled over the whole cluster by blocks:
``components_by_blocks`` labels blocks apart and merges labels along their borders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators.graph import components
from fathom.shared import Tables


def label(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Labels from 1 of the 4-connected components, in the order of their first cell, and their number."""
    h, w = mask.shape
    runs, of_row = [], []
    for y in range(h):
        d = np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]]))
        begin = len(runs)
        runs += [(y, a, b) for a, b in zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist(), strict=True)]
        of_row.append((begin, len(runs)))
    parent = list(range(len(runs)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for y in range(1, h):
        i, j = of_row[y - 1][0], of_row[y][0]
        while i < of_row[y - 1][1] and j < of_row[y][1]:
            if runs[i][1] < runs[j][2] and runs[j][1] < runs[i][2]:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if runs[i][2] <= runs[j][2]:
                i += 1
            else:
                j += 1
    out, names = np.zeros(mask.shape, np.int64), {}
    for k, (y, a, b) in enumerate(runs):
        out[y, a:b] = names.setdefault(root(k), len(names) + 1)
    return out, len(names)


def fill_holes(mask: np.ndarray, most: int | None = None) -> np.ndarray:
    """The mask with its holes filled; with ``most``, only holes of so many cells or fewer."""
    holes, n = label(~mask)
    border = np.unique(np.concatenate([holes[0], holes[-1], holes[:, 0], holes[:, -1]]))
    sizes = np.bincount(holes.ravel(), minlength=n + 1)
    fill = np.ones(n + 1, bool)
    fill[border] = fill[0] = False
    if most is not None:
        fill &= sizes <= most
    return mask | fill[holes]


def distances(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance to the nearest mask cell and its flat index, ties to the smallest (y, x)."""
    h, w = mask.shape
    far = float(4 * (h + w) ** 2)
    column, best = np.full((h, w), far), np.full((h, w), -1)
    last = np.full(w, -1)
    for y in range(h):  # nearest above or here
        last = np.where(mask[y], y, last)
        column[y] = np.where(last >= 0, (y - last) ** 2.0, far)
        best[y] = last
    last = np.full(w, -1)
    for y in range(h - 1, -1, -1):
        last = np.where(mask[y], y, last)
        d = np.where(last >= 0, (y - last) ** 2.0, far)
        nearer = d < column[y]
        column[y], best[y] = np.where(nearer, d, column[y]), np.where(nearer, last, best[y])
    out, index, xs = np.empty((h, w)), np.empty((h, w), np.int64), np.arange(w)
    gaps = (xs[:, None] - xs[None, :]) ** 2.0
    for y in range(h):
        total = column[y][None, :] + gaps
        least = total.min(1)
        flat = np.where((total == least[:, None]) & (best[y] >= 0)[None, :], best[y][None, :] * w + xs[None, :], h * w)
        out[y], index[y] = least, flat.min(1)
    return out, index


def nearest_fill(classes: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Classes with the cells of ``need`` that have none (-1) taken from the nearest that has one."""
    has = classes >= 0
    if not has.any():
        return classes
    _, index = distances(has)
    return np.where(need & ~has, classes.ravel()[np.minimum(index, classes.size - 1)], classes)


def gaussian(field: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    radius = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    k /= k.sum()
    pad = lambda a: np.pad(a, ((radius, radius), (0, 0)))
    once = lambda a: sum(w * pad(a)[i : i + a.shape[0]] for i, w in enumerate(k))
    return once(once(field).T).T


#: Sides of a cell (0 top, 1 right, 2 bottom, 3 left) that its contour joins, by corners above the level (1 top left, 2 top right, 4 bottom right, 8 bottom left), the high side on the left. Saddles keep the high corners together.
CASES = {
    1: [(0, 3)], 2: [(1, 0)], 3: [(1, 3)], 4: [(2, 1)], 5: [(0, 1), (2, 3)], 6: [(2, 0)], 7: [(2, 3)],
    8: [(3, 2)], 9: [(0, 2)], 10: [(1, 2), (3, 0)], 11: [(1, 2)], 12: [(3, 1)], 13: [(0, 1)], 14: [(3, 0)],
}


def contours(field: np.ndarray, level: float = 0.5) -> list[np.ndarray]:
    """Closed rings (x, y) at a level, by marching squares over a field with a border of zeros."""
    f = np.pad(field.astype(float), 1)
    up = f > level
    case = up[:-1, :-1] * 1 + up[:-1, 1:] * 2 + up[1:, 1:] * 4 + up[1:, :-1] * 8
    links: dict[tuple, tuple] = {}
    for y, x in np.argwhere((case > 0) & (case < 15)).tolist():
        side = {0: (y, x, 0), 1: (y, x + 1, 1), 2: (y + 1, x, 0), 3: (y, x, 1)}
        for a, b in CASES[int(case[y, x])]:
            links[side[a]] = side[b]

    def place(s: tuple) -> tuple[float, float]:
        y, x, upright = s
        v, w = f[y, x], f[y + 1, x] if upright else f[y, x + 1]
        t = (level - v) / (w - v)
        return (x - 1.0, y - 1.0 + t) if upright else (x - 1.0 + t, y - 1.0)

    rings = []
    while links:
        begin = at = next(iter(links))
        ring = []
        while at in links:
            ring.append(place(at))
            at = links.pop(at)
        if at == begin and len(ring) > 2:
            rings.append(np.array(ring))
    return rings


def douglas_peucker(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices kept of an open line."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, d = points[a + 1 : b] - points[a], points[b] - points[a]
        length = np.hypot(*d)
        off = np.abs(p[:, 0] * d[1] - p[:, 1] * d[0]) / length if length else np.hypot(p[:, 0], p[:, 1])
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.flatnonzero(keep)


def simplify_ring(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices kept of a closed ring: from its first point round to it."""
    kept = douglas_peucker(np.vstack([points, points[:1]]), tolerance)
    return kept[kept < len(points)]


def collinear_free(points: np.ndarray) -> np.ndarray:
    """Indices of a ring without points on the line between their neighbours, to the end."""
    index = np.arange(len(points))
    while len(index) > 3:
        p = points[index]
        a, b = p - np.roll(p, 1, 0), np.roll(p, -1, 0) - p
        on = (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0] == 0) & ((a * b).sum(1) > 0)
        on &= ~np.roll(on & (np.arange(len(on)) % 2 == 0), 1)
        if not on.any():
            break
        index = index[~on]
    return index


def taubin(points: np.ndarray, iterations: int, lam: float, mu: float) -> np.ndarray:
    for _ in range(iterations):
        for step in (lam, mu):
            points = points + step * ((np.roll(points, 1, 0) + np.roll(points, -1, 0)) / 2 - points)
    return points


def by_raster(cells: DataFrame, key: str, kernel: Callable[[np.ndarray], np.ndarray], empty: int = -1) -> DataFrame:
    """Apply a kernel to each raster (key, y, x, k): its classes, ``empty`` where there is none, to a raster of the same size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf.y.to_numpy(), pdf.x.to_numpy()
        field = np.full((y.max() + 1, x.max() + 1), empty)
        field[y, x] = pdf.k.fillna(empty).to_numpy().astype(int)
        out = kernel(field)
        yy, xx = np.indices(out.shape)
        return pd.DataFrame({key: pdf[key].iloc[0], "y": yy.ravel().astype("int32"), "x": xx.ravel().astype("int32"), "k": out.ravel().astype("int64")})

    return cells.select(key, "y", "x", "k").groupBy(key).applyInPandas(run, f"{key} {cells.schema[key].dataType.simpleString()}, y int, x int, k long")


def by_ring(points: DataFrame, keys: list[str], kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply a kernel to each ring (keys, i, x, y); it gives points (x, y).

    A ring is a row of two arrays on its way to the kernel, so that a batch holds many rings.
    """
    ordered = points.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("ps"))
    rings = ordered.select(*keys, F.transform("ps", lambda p: p["x"].cast("double")).alias("xs"), F.transform("ps", lambda p: p["y"].cast("double")).alias("ys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys = b.column("xs"), b.column("ys")
            at = xs.offsets.to_numpy()
            every = np.column_stack([xs.values.to_numpy(zero_copy_only=False), ys.values.to_numpy(zero_copy_only=False)])
            out = [kernel(every[i:j]) for i, j in zip(at, at[1:], strict=False)]
            row = np.repeat(np.arange(len(out)), [len(o) for o in out])
            i = np.concatenate([np.arange(len(o), dtype="int32") for o in out]) if out else np.zeros(0, "int32")
            p = np.concatenate(out) if out else np.zeros((0, 2))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(row)) for k in keys), pa.array(i), pa.array(p[:, 0]), pa.array(p[:, 1])], names=[*keys, "i", "x", "y"])

    schema = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)
    return rings.mapInArrow(run, f"{schema}, i int, x double, y double")


def components_by_blocks(mask: DataFrame, block: int = 512) -> DataFrame:
    """(y, x, component) of the cells of a mask (y, x): the smallest flat place y << 32 | x reached over direct neighbours.

    Blocks are labelled apart; labels that touch across borders are links, whose components are found by
    contraction. A block's border, not its cells, takes part in that, and rounds grow with the logarithm of the blocks that a component crosses.
    """
    place = lambda y, x: F.shiftleft(F.col(y).cast("long"), 32).bitwiseOR(F.col(x).cast("long"))
    blocked = mask.select("y", "x", F.floor(F.col("y") / block).alias("by"), F.floor(F.col("x") / block).alias("bx"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf.y.to_numpy(np.int64), pdf.x.to_numpy(np.int64)
        field = np.zeros((int(y.max() - y.min()) + 1, int(x.max() - x.min()) + 1), bool)
        field[y - y.min(), x - x.min()] = True
        names, n = label(field)
        own = names[y - y.min(), x - x.min()]
        least = np.full(n + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, own, (y << 32) | x)
        return pd.DataFrame({"y": y.astype("int32"), "x": x.astype("int32"), "label": least[own]})

    with Tables(mask.sparkSession) as tables:
        labels = tables.written(blocked.groupBy("by", "bx").applyInPandas(run, "y int, x int, label long"), "labels")
        up = labels.where(F.col("y") % block == 0).select((F.col("y") - 1).alias("y"), "x", F.col("label").alias("u"))
        left = labels.where(F.col("x") % block == 0).select("y", (F.col("x") - 1).alias("x"), F.col("label").alias("u"))
        links = up.unionByName(left).join(labels, ["y", "x"]).select("u", F.col("label").alias("v")).distinct()
        rooted = components(links).select(F.col("node").alias("label"), "root")
        return tables.kept(labels.join(rooted, "label", "left").select("y", "x", F.coalesce("root", "label").alias("component")), "components")
