"""Farthest-point sampling over leaves against the sequential order."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from cairn.operators import spread


def sequential(frame, m):
    frame = frame.sort_values("point_id")
    ids, xyz = frame.point_id.tolist(), frame[["x", "y", "z"]].to_numpy()
    take = [0]
    while len(take) < min(m, len(ids)):
        far = [min(float(((p - xyz[t]) ** 2).sum()) for t in take) if i not in take else -1.0 for i, p in enumerate(xyz)]
        take.append(max(range(len(ids)), key=lambda i: (far[i], -i)))
    return [ids[t] for t in take]


def lattice(n, seed):
    """Places on a coarse lattice, so that most distances tie, with many copies of one place."""
    rng = np.random.default_rng(seed)
    places = rng.integers(0, (40, 25, 3), (n, 3)).astype(float)
    places[: n // 3] = (7, 7, 1)
    return pd.DataFrame({"point_id": rng.permutation(n) * 3 + 2**53, **dict(zip("xyz", places.T, strict=True))})


def scattered(n, seed):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"point_id": rng.permutation(n), "x": rng.normal(2_600_000, 50, n), "y": rng.uniform(0, 80, n), "z": rng.exponential(4, n)})


@pytest.mark.parametrize("make", [lattice, scattered])
def test_huge_clouds_equal_the_sequential_order(spark, monkeypatch, make):
    """Two clouds over leaves, one in a task; ties go to the lower id."""
    monkeypatch.setattr(spread, "ONE_TASK", 500)
    monkeypatch.setattr(spread, "LEAF", 20)
    monkeypatch.setattr(spread, "CELLS", 60)
    monkeypatch.setattr(spread, "AT_ONCE", 8)
    used, made = [], spread._Spread
    monkeypatch.setattr(spread, "_Spread", lambda *of: used.append(made(*of)) or used[-1])
    clouds = pd.concat([make(900, 1).assign(tile="a"), make(700, 2).assign(tile="b"), make(300, 3).assign(tile="c")])
    got = spread.fps(spark.createDataFrame(clouds), 25).toPandas().sort_values(["tile", "rank"])
    for tile, part in clouds.groupby("tile"):
        assert got[got.tile == tile].point_id.tolist() == sequential(part, 25)
    cells = sum(len(c.cells) for c in used[0].clouds.values())
    assert cells > 60 and used[0].jobs < 25 and used[0].read < 0.6 * used[0].jobs * cells


def test_more_points_wanted_than_there_are(spark, monkeypatch):
    rows = [("a", 4, 0.0, 0.0, 0.0), ("a", 2, 0.0, 0.0, 0.0), ("a", 9, 3.0, 0.0, 0.0), ("a", 1, None, 0.0, 0.0), ("a", 7, float("nan"), 0.0, 0.0)]
    pts = spark.createDataFrame(rows, "tile string, point_id long, x double, y double, z double")
    want = [("a", 2, 0), ("a", 9, 1), ("a", 4, 2)]
    assert sorted(map(tuple, spread.fps(pts, 10).collect()), key=lambda r: r[2]) == want
    monkeypatch.setattr(spread, "ONE_TASK", 1)
    assert sorted(map(tuple, spread.fps(pts, 10).collect()), key=lambda r: r[2]) == want
    assert spread.fps(pts.limit(0), 3).count() == 0
