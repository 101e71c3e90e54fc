"""Nearest source of every cell of a raster of any size, by an exact transform in two passes.

Down the columns every cell finds the nearest source of its column; along the rows the lower envelope of the
parabolas over these finds the nearest of all. A column's sources are one group; rows are grouped in strips of
``strip_cells`` cells at most (one row at least), so tasks grow in number with the raster and not in size. Between the passes
the raster is shuffled once, in packed pieces of a column in a strip; columns without a source are never sent.

All is in integers: squared distances are multiplied by one more than the columns and the rank of a column's source is added, so
that no two sums are equal and ties go to the smallest (y, x).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOUND = "y int, x int, sy int, sx int, d2 long, k int"


def column_nearest(sources: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Place among ascending sources of the nearest one to each y, ties to the smaller."""
    after = np.minimum(np.searchsorted(sources, ys), len(sources) - 1)
    before = np.maximum(after - 1, 0)
    return np.where(np.abs(ys - sources[before]) <= np.abs(sources[after] - ys), before, after)


def row_minima(columns: np.ndarray, cost: np.ndarray, scale: int, width: int) -> np.ndarray:
    """For every row of costs (rows, columns) and every x, the place of the column of least scale * (x - column)**2 + cost.

    The best column moves to the right only as x does, so the places for every second x bound those between; levels
    of halved steps do a row in about columns * log(width) sums, all rows at once. Sums must differ.
    """
    rows, n = cost.shape
    best = np.zeros((rows, width + 1), np.int64)
    best[:, 0] = (scale * columns * columns + cost).argmin(1)
    best[:, width] = n - 1  # a wall to the right of the last x
    for level in reversed(range((width - 1).bit_length())):
        step = 1 << level
        xs = np.arange(step, width, 2 * step)
        low, high = best[:, xs - step], best[:, np.minimum(xs + step, width)]
        size = (high - low + 1).ravel()
        starts = np.cumsum(size) - size
        column = np.arange(size.sum()) - np.repeat(starts - low.ravel(), size)
        at = np.repeat(np.arange(rows * len(xs)), size)
        off = columns[column] - xs[at % len(xs)]
        total = scale * off * off + cost[at // len(xs), column]
        least = np.minimum.reduceat(total, starts)
        best[:, xs] = column[np.flatnonzero(total == least[at])].reshape(rows, len(xs))
    return best[:, :width]


def nearest_sources(sources: DataFrame, height: int, width: int, strip_cells: int = 1 << 19) -> DataFrame:
    """(y, x, sy, sx, d2, k) for every cell of a raster: the nearest source (y, x, k), its squared distance and its value.

    Of several sources of one cell the smallest value counts. Without a source there is no row.
    """
    if (width + 1) * (height * height + width * width) >= 1 << 62:
        raise ValueError("distances of a raster of this size need more than 64 bits")
    strip = max(1, strip_cells // width)
    columns = sources.groupBy("x", "y").agg(F.min("k").alias("k")).groupBy("x").agg(F.sort_array(F.collect_list(F.struct("y", "k"))).alias("s"))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, s in zip(b.column("x").to_pylist(), b.column("s"), strict=True):
                at, k = (np.array(s.values.field(c).to_numpy(zero_copy_only=False)) for c in ("y", "k"))
                for begin in range(0, height, strip * 64):
                    ys = np.arange(begin, min(begin + strip * 64, height))
                    i = column_nearest(at, ys)
                    cuts = range(0, len(ys), strip)
                    packed = [[a[i[c : c + strip]].astype("<i4").tobytes() for c in cuts] for a in (at, k)]
                    yield pa.RecordBatch.from_arrays([pa.array([int(ys[c]) // strip for c in cuts], pa.int32()), pa.array([x] * len(cuts), pa.int32()), pa.array(packed[0], pa.binary()), pa.array(packed[1], pa.binary())], names=["strip", "x", "sy", "k"])

    def along(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("x").to_numpy())
        xs = table.column("x").to_numpy()[order].astype(np.int64)
        read = lambda c: np.stack([np.frombuffer(table.column(c)[int(j)].as_py(), "<i4") for j in order], 1).astype(np.int64)
        sy, k = read("sy"), read("k")
        top = table.column("strip")[0].as_py() * strip
        ys = np.arange(top, top + len(sy))
        scale = len(xs) + 1
        rank = np.argsort(np.argsort(sy * width + xs[None, :], axis=1), axis=1)
        place = row_minima(xs, scale * (ys[:, None] - sy) ** 2 + rank, scale, width)
        row = np.arange(len(sy))[:, None]
        near_y, near_x = sy[row, place], xs[place]
        x = np.broadcast_to(np.arange(width), near_x.shape)
        y = np.broadcast_to(ys[:, None], near_x.shape)
        d2 = (x - near_x) ** 2 + (y - near_y) ** 2
        cast = lambda a, t="int32": pa.array(np.ascontiguousarray(a).ravel().astype(t))
        return pa.table({"y": cast(y), "x": cast(x), "sy": cast(near_y), "sx": cast(near_x), "d2": cast(d2, "int64"), "k": cast(k[row, place])})

    pieces = columns.mapInArrow(down, "strip int, x int, sy binary, k binary")
    return pieces.groupBy("strip").applyInArrow(along, FOUND)
