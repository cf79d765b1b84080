"""Rasters in blocks against whole rasters in numpy."""

from __future__ import annotations

import numpy as np
import pytest

from cairn.operators import raster, sampling

POINTS = "tile string, point_id long, x double, y double, z double, classification int"


def smooth(grid, sigma):
    """Gaussian over mirrored edges, each cell from its definition."""
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        n = grid.shape[axis]
        at = (np.arange(n)[:, None] + np.arange(-reach, reach + 1)) % (2 * n)
        grid = (np.take(grid, np.where(at < n, at, 2 * n - 1 - at), axis=axis) * (w if axis else w[:, None])).sum(axis=axis + 1)
    return grid


def whole_surface(p, size, sigma):
    x, y, z = p[:, 0], p[:, 1], p[:, 2]
    shape = [int(np.ceil(np.ptp(c) / size)) + 1 for c in (x, y)]
    i, j = (np.minimum(((c - c.min()) / size).astype(int), n - 1) for c, n in zip((x, y), shape, strict=True))
    grid = np.full(shape, -np.inf)
    np.maximum.at(grid, (i, j), z)
    grid[np.isinf(grid)] = grid[~np.isinf(grid)].mean()
    return smooth(grid, sigma)[i, j]


def whole_low(p, size, sigma):
    x, y, z = p[:, 0], p[:, 1], p[:, 2]
    if len(z) < 50:
        return np.full(len(z), z.mean())
    shape = [int(np.ceil(np.ptp(c) / size)) + 3 for c in (x, y)]
    u, v = ((c - c.min() + 2 * size) / size for c in (x, y))
    i, j = u.astype(int), v.astype(int)
    total, count = np.zeros(shape), np.zeros(shape)
    np.add.at(total, (i, j), z)
    np.add.at(count, (i, j), 1)
    known = np.argwhere(count > 0)
    grid = np.empty(shape)
    for a in range(shape[0]):
        for b in range(shape[1]):
            near = known[((known - (a, b)) ** 2).sum(axis=1).argmin()]
            grid[a, b] = total[tuple(near)] / count[tuple(near)]
    grid = smooth(grid, sigma)
    a, b = np.clip(u - 0.5, 0, shape[0] - 1), np.clip(v - 0.5, 0, shape[1] - 1)
    a0, b0 = a.astype(int), b.astype(int)
    a1, b1 = np.minimum(a0 + 1, shape[0] - 1), np.minimum(b0 + 1, shape[1] - 1)
    s, t = a - a0, b - b0
    return (1 - s) * ((1 - t) * grid[a0, b0] + t * grid[a0, b1]) + s * ((1 - t) * grid[a1, b0] + t * grid[a1, b1])


def clouds():
    """An even tile, one with a wide gap, one that is a line, one point, one small tile; some points without a class."""
    rng = np.random.default_rng(5)
    even = rng.uniform(0, 60, (1500, 2))
    gap = np.concatenate([rng.uniform(0, 8, (200, 2)), rng.uniform(0, 8, (200, 2)) + (90, 40)])
    line = np.stack([np.linspace(0, 30, 80), np.zeros(80)], axis=1)
    return {"even": even, "gap": gap - 20, "line": line, "one": np.ones((1, 2)), "few": rng.uniform(0, 9, (30, 2))}


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(6)
    tiles = {n: np.round(np.column_stack([p, rng.uniform(100, 140, len(p))]) * 64) / 64 for n, p in clouds().items()}
    rows = [(n, 1000 * k + i, *map(float, q), (2, 3, None)[i % 3]) for k, (n, p) in enumerate(tiles.items()) for i, q in enumerate(p)]
    return tiles, spark.createDataFrame(rows, POINTS).cache()


@pytest.mark.parametrize("block", [5, 64])
@pytest.mark.parametrize("most", [40, 200_000])
def test_flattened_heights_equal_the_whole_raster(points, monkeypatch, block, most):
    monkeypatch.setattr(raster, "MOST_POINTS", most)  # blocks with more points are split
    tiles, pts = points
    got = raster.flatten_non_ground(pts, 2, 2.0, block=block).toPandas()
    assert len(got) == sum(map(len, tiles.values()))
    for n, p in tiles.items():
        z = got[got.tile == n].sort_values("point_id").z.to_numpy()
        want = np.where(np.arange(len(p)) % 3 == 0, p[:, 2], whole_surface(p, 2.0, 2.0))
        assert np.allclose(z, want, atol=1e-9), n


@pytest.mark.parametrize("block", [6, 64])
def test_low_frequency_equals_the_whole_raster(points, block):
    tiles, pts = points
    got = raster.low_frequency(pts, 3.0, block=block).toPandas()
    assert len(got) == sum(map(len, tiles.values()))
    for n, p in tiles.items():
        z = got[got.tile == n].sort_values("point_id").z_low.to_numpy()
        assert np.allclose(z, whole_low(p, 3.0, 1.5), atol=1e-9), n


def test_queries_of_the_terrain_split_carry_the_smooth_target(points):
    tiles, pts = points
    got = sampling.terrain_split(pts, 3, low=3.0).toPandas()
    assert set(got.role[got.gt_low.notna()]) == {"query"} and got.gt_low[got.role == "query"].notna().all()
    even = got[got.tile == "even"].sort_values("point_id")
    asked = (even.role == "query").to_numpy()
    assert 0 < asked.sum() < len(even)
    assert np.allclose(even.gt_low[asked], whole_low(tiles["even"], 3.0, 1.5)[asked], atol=1e-9)


def test_empty_cloud(points):
    _, pts = points
    assert raster.flatten_non_ground(pts.limit(0), 2).count() == 0
    assert raster.low_frequency(pts.limit(0)).count() == 0
