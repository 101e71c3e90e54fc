"""Distance transform and contours that no task holds whole, against kernels that do."""

import numpy as np
import pytest

from fathom.operators import contour, distance, kernels


def cells(spark, mask, k=1):
    return spark.createDataFrame([(int(y), int(x), k) for y, x in np.argwhere(mask)], "y int, x int, k int")


@pytest.mark.parametrize(("shape", "share", "strip"), [((17, 23), 0.1, 1), ((40, 9), 0.02, 100), ((1, 30), 0.2, 7), ((30, 1), 0.2, 7), ((25, 25), 0.5, 10_000)])
def test_nearest_sources(spark, shape, share, strip):
    mask = np.random.default_rng(shape[0]).random(shape) < share
    mask[0, 0] = True
    d2, index = kernels.distances(mask)
    got = np.zeros((*shape, 3), int)
    rows = distance.nearest_sources(cells(spark, mask), *shape, strip_cells=strip).collect()
    assert len(rows) == mask.size
    for r in rows:
        got[r.y, r.x] = r.d2, r.sy, r.sx
    assert (got[..., 0] == d2).all()
    assert (got[..., 1] * shape[1] + got[..., 2] == index).all()  # ties to the smallest (y, x)


def test_ties_and_repeats(spark):
    circle = [(5 + a, 5 + b, k) for k, (a, b) in enumerate([(5, 0), (-5, 0), (0, 5), (0, -5), (3, 4), (3, -4), (-3, 4), (-3, -4), (4, 3), (-4, -3)])]
    df = spark.createDataFrame(circle + [(0, 5, 9), (0, 5, 7)], "y int, x int, k int")
    (r,) = distance.nearest_sources(df, 11, 11, 30).where("y = 5 and x = 5").collect()
    assert (r.sy, r.sx, r.d2, r.k) == (0, 5, 25, 1)
    assert distance.nearest_sources(df.limit(0), 11, 11).count() == 0
    with pytest.raises(ValueError, match="64 bits"):
        distance.nearest_sources(df, 1 << 21, 1 << 21)


def test_strings():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 40):
        order = rng.permutation(n)
        nxt = np.empty(n, int)
        nxt[order] = np.roll(order, -1)  # one ring
        head, rank, last = contour.string(np.arange(n) * 10, nxt * 10)
        assert (head == 0).all() and sorted(rank) == list(range(n)) and last.sum() == 1
        walk = [0]
        while len(walk) < n:
            walk.append(nxt[walk[-1]])
        assert rank[walk].tolist() == list(range(n))
    head, rank, last = contour.string(np.array([1, 2, 5, 9]), np.array([2, 77, 1, 9]))
    assert head.tolist() == [5, 5, 5, 9] and rank.tolist() == [1, 2, 0, 0] and last.tolist() == [False, True, False, True]


def ring_key(points):
    """A ring from its smallest point on."""
    p = [tuple(map(float, q)) for q in points]
    k = p.index(min(p))
    return tuple(p[k:] + p[:k])


@pytest.mark.parametrize("tile", [1, 4, 512])
def test_rings(spark, tile):
    rng = np.random.default_rng(1)
    masks = {0: rng.random((12, 15)) < 0.5, 1: np.zeros((5, 5), bool), 2: np.ones((6, 4), bool), 3: np.zeros((21, 21), bool)}
    masks[3][1::2] = True  # a snake over the whole raster
    for y in range(2, 20, 2):
        masks[3][y, 20 if y % 4 else 0] = True
    rows = [(t, int(y), int(x)) for t, m in masks.items() for y, x in np.argwhere(m)]
    got = {}
    for r in sorted(contour.rings(spark.createDataFrame(rows, "t int, y int, x int"), "t", tile).collect(), key=lambda r: r.i):
        got.setdefault((r.t, r.ring_id), []).append((r.i, r.x, r.y))
    assert all([p[0] for p in ps] == list(range(len(ps))) for ps in got.values())
    for t, m in masks.items():
        mine = sorted(ring_key([p[1:] for p in ps]) for (k, _), ps in got.items() if k == t)
        assert mine == sorted(ring_key(ring) for ring in kernels.contours(m))
    assert max(len(ps) for ps in got.values()) > 400
