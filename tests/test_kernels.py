import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathom.operators import calibrate, kernels


@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 2**31))
@settings(max_examples=60, deadline=None)
def test_labels_are_a_partition(h, w, seed):
    m = np.random.default_rng(seed).random((h, w)) < 0.55
    lab, n = kernels.label(m)
    assert ((lab > 0) == m).all() and set(np.unique(lab[m])) == set(range(1, n + 1))
    for y in range(h):
        for x in range(w):
            for dy, dx in ((0, 1), (1, 0)):
                if y + dy < h and x + dx < w and m[y, x] and m[y + dy, x + dx]:
                    assert lab[y, x] == lab[y + dy, x + dx]
    # flood fill reaches each label from one of its cells
    for k in range(1, n + 1):
        todo, seen = [tuple(np.argwhere(lab == k)[0])], set()
        while todo:
            p = todo.pop()
            if p in seen:
                continue
            seen.add(p)
            for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)):
                q = (p[0] + dy, p[1] + dx)
                if 0 <= q[0] < h and 0 <= q[1] < w and m[q]:
                    todo.append(q)
        assert len(seen) == (lab == k).sum()


@given(st.integers(1, 10), st.integers(1, 10), st.integers(0, 2**31))
@settings(max_examples=60, deadline=None)
def test_distances_are_brute_force(h, w, seed):
    m = np.random.default_rng(seed).random((h, w)) < 0.3
    if not m.any():
        return
    d, index = kernels.distances(m)
    cells = np.argwhere(m)
    for y in range(h):
        for x in range(w):
            all_d = (cells[:, 0] - y) ** 2 + (cells[:, 1] - x) ** 2
            best = min((int(a), int(c[0]), int(c[1])) for a, c in zip(all_d, cells, strict=True))
            assert d[y, x] == best[0] and divmod(int(index[y, x]), w) == best[1:]


def test_holes():
    m = np.ones((7, 7), bool)
    m[2:4, 2:4] = m[5, 5] = m[0, 3] = False
    assert kernels.fill_holes(m).sum() == 48
    assert kernels.fill_holes(m, 1).sum() == 44


def test_contour_of_a_square():
    f = np.zeros((10, 12))
    f[3:6, 4:9] = 1
    (ring,) = kernels.contours(f)
    x, y = ring.T
    assert abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2) == pytest.approx(5 * 3 - 0.5)
    f[4, 6] = 0
    assert len(kernels.contours(f)) == 2
    assert kernels.contours(np.zeros((4, 4))) == []


@given(st.integers(3, 40), st.integers(0, 2**31), st.floats(0.01, 3))
@settings(max_examples=60, deadline=None)
def test_simplified_within_tolerance(n, seed, tolerance):
    p = np.random.default_rng(seed).random((n, 2)) * 10
    keep = kernels.douglas_peucker(p, tolerance)
    assert keep[0] == 0 and keep[-1] == n - 1
    for a, b in zip(keep, keep[1:], strict=False):
        d = p[b] - p[a]
        for q in p[a + 1 : b]:
            off = abs((q - p[a])[0] * d[1] - (q - p[a])[1] * d[0]) / np.hypot(*d) if d.any() else np.hypot(*(q - p[a]))
            assert off <= tolerance + 1e-9


def test_taubin_fixture():
    ring = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)
    out = kernels.taubin(ring, 1, 0.5, -0.53)
    assert np.allclose(out[0], (0.235, 0.235)) or np.allclose(out.mean(0), (1, 1))
    assert len(out) == 4


def test_gaussian_keeps_mass():
    f = np.zeros((21, 21))
    f[10, 10] = 1
    assert kernels.gaussian(f, 1.3).sum() == pytest.approx(1)


def test_collinear():
    p = np.array([(0, 0), (1, 0), (2, 0), (3, 0), (3, 3), (0, 3)], float)
    assert kernels.collinear_free(p).tolist() == [0, 3, 4, 5]


def test_search_finds_the_minimum():
    target = np.array([5.0, -7, 1.01, 0.99, 0.01, 0.3])
    scale = np.array([80, 80, 0.03, 0.03, 0.035, 0.8])
    loss = lambda p: (((p - target) / scale) ** 2).sum(1)
    p, cost = calibrate.evolve(loss, generations=60)
    q, polished = calibrate.nelder_mead(loss, p, scale / 20, 200)
    assert polished <= cost and polished < 1e-3 and math.isfinite(cost)


def test_components_of_links(spark):
    import random

    from fathom.operators.graph import components

    rng = random.Random(3)
    path = [(k, k + 1) for k in range(0, 70)]  # a long line of nodes
    star = [(1000, 1001 + k) for k in range(80)]
    other = [(rng.randrange(2000, 2060), rng.randrange(2000, 2060)) for _ in range(40)]
    links = path + star + other + path[:5]
    parent: dict[int, int] = {}

    def root(n: int) -> int:
        while parent.setdefault(n, n) != n:
            n = parent[n]
        return n

    for u, v in links:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long").repartition(3)).collect()}
    assert got == {n: root(n) for u, v in links if u != v for n in (u, v)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
