"""Ground planes of odd candidate sets, running sums over ranges, proportional strata."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import geometry, sampling, selection


def test_ground_plane_equals_least_squares(spark):
    """None to two candidates, points on lines (also along an axis), one place, a plane, a plane far from the origin."""
    rng = np.random.default_rng(0)
    t = np.linspace(0, 5, 6)
    sets = {
        "two": np.array([[0, 0, 4.0], [1, 2, 8.0]]),
        "line": np.column_stack([t, 2 * t + 1, 3 * t + rng.normal(0, 0.1, 6)]),
        "axis": np.column_stack([np.full(6, 3.0), t, t * t]),
        "place": np.array([[2, 1, z] for z in (1.0, 2.0, 6.0)]),
        "plane": np.column_stack([rng.uniform(0, 9, (40, 2)), rng.normal(0, 1, 40)]),
        "far": np.column_stack([rng.uniform(0, 0.01, (40, 2)) + (2_600_000, 1_200_000), rng.normal(0, 1, 40)]),
    }
    pts = spark.createDataFrame([(n, i, *map(float, p)) for n, s in sets.items() for i, p in enumerate(s)], "tile string, point_id long, x double, y double, z double")
    got = {r["tile"]: (r["a"], r["b"], r["c"]) for r in geometry.ground_plane(pts).collect()}
    for n, s in sets.items():
        if n == "far":
            near = s - (2_600_000, 1_200_000, 0)
            want = np.linalg.lstsq(np.column_stack([near[:, :2], np.ones(len(s))]), s[:, 2], rcond=None)[0]
            assert np.allclose(got[n][:2], want[:2], rtol=1e-3)
        elif len(s) < 3:
            assert got[n] == (0.0, 0.0, np.median(s[:, 2]))
        else:
            want = np.linalg.lstsq(np.column_stack([s[:, :2], np.ones(len(s))]), s[:, 2], rcond=None)[0]
            assert np.allclose(got[n], want, atol=1e-6), n


def test_running_sums(spark):
    df = spark.range(3000).selectExpr("id", "id * 7919 % 3001 AS k", "id % 5 AS w")
    rows = sorted(selection.in_order(df, ["k"], F.col("w")).collect(), key=lambda r: r["k"])
    assert [r["place"] for r in rows] == list(range(3000))
    assert [r["upto"] for r in rows] == np.cumsum([r["w"] for r in rows]).tolist()


def allocation(sizes, n):
    share = [max(1, n * c // sum(sizes)) for c in sizes]
    while sum(share) > n and max(share) > 1:
        share[share.index(max(share))] -= 1
    return share


@pytest.mark.parametrize("n", [3, 20, 57])
def test_proportional_strata(spark, n):
    """A stratum with most rows, many of one row, a null stratum, more strata than rows asked for, a small tile."""
    sizes = {"a": [900, 30, 5, 1, 1, 1, 1, 1], "b": [40, 40, 40], "c": [2, 1]}
    rows = [(t, 1000 * k + i, k if k else None) for t, cs in sizes.items() for k, c in enumerate(cs) for i in range(c)]
    df = spark.createDataFrame(rows, "tile string, point_id long, s int")
    got = sampling.stratified_share(df, ["s"], n, 1).toPandas()
    for t, cs in sizes.items():
        mine = got[got.tile == t]
        assert len(mine) == min(n, sum(cs)) and mine.point_id.is_unique
        if sum(cs) > n and n >= len(cs):
            counts = mine.s.fillna(0).value_counts()
            assert all(counts.get(k, 0) >= min(c, a) for k, (c, a) in enumerate(zip(cs, allocation(cs, n), strict=True)))
    again = sampling.stratified_share(df.repartition(7), ["s"], n, 1).toPandas()
    assert set(again.point_id) == set(got.point_id)
