"""Tile selection and budgets against the sequential rules."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import sampling


def greedy(rows, n, cap, classes, shares):
    """One tile after the other, as the rules are worded."""
    rows = sorted(rows, key=lambda r: (-r["priority"], r["tile"]))
    taken, used = {}, {}

    def take(r, why):
        if r["tile"] in taken or used.get(r["source_block"], 0) >= cap:
            return False
        taken[r["tile"]] = why
        used[r["source_block"]] = used.get(r["source_block"], 0) + 1
        return True

    for b in {r["source_block"] for r in rows}:
        take(next(r for r in rows if r["source_block"] == b), "block")
    for c in classes:
        some = [r for r in rows if r[c] > 0]
        if some:
            take(min(some, key=lambda r: (-r[c], r["tile"])), f"class {c}")
    for e, share in shares.items():
        own = [r for r in rows if r["environment"] == e]
        for r in own:
            if sum(o["tile"] in taken for o in own) >= max(1, round(n * share)) or len(taken) >= n:
                break
            take(r, "environment")
    for r in rows:
        if len(taken) < n:
            take(r, "fill")
    return taken


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_selection_equals_the_greedy_rule(spark, seed):
    """Tied scores, a block with a third of the tiles, a class that no tile has, environments without a share."""
    rng = np.random.default_rng(seed)
    names = [*sampling.ENVIRONMENT_SHARES, "elsewhere"]
    rows = [{"tile": i, "source_block": int(rng.choice([0, rng.integers(1, 9)], p=[0.35, 0.65])), "priority": float(rng.integers(0, 12)), "environment": names[rng.integers(len(names))], "n_1": int(rng.integers(0, 4)), "n_2": int(rng.integers(0, 3)), "n_3": 0} for i in range(150)]
    stats = spark.createDataFrame(rows, "tile int, source_block int, priority double, environment string, n_1 int, n_2 int, n_3 int")
    n, cap = (24, 3) if seed < 3 else (40, 6)
    got = sampling.select_tiles(stats, n, cap, classes=["n_1", "n_2", "n_3"])
    assert got.columns == [*stats.columns, "reason"]
    assert {r.tile: r.reason for r in got.collect()} == greedy(rows, n, cap, ["n_1", "n_2", "n_3"], sampling.ENVIRONMENT_SHARES)


def test_selection_says_when_the_cap_is_too_small(spark):
    stats = spark.createDataFrame([(i, None if i % 2 else 1, None, "a") for i in range(6)], "tile int, source_block int, priority double, environment string")
    assert sampling.select_tiles(stats, 4, 2).count() == 4
    with pytest.raises(ValueError, match="4 tiles instead of 5"):
        sampling.select_tiles(stats, 5, 2)


def shares(caps, most):
    out = []
    for i, c in enumerate(caps):
        out.append(min(c, most // (len(caps) - i)))
        most -= out[-1]
    return out


@pytest.mark.parametrize(("most", "size", "kind"), [(10**9, 60, "skewed"), (3000, 37, "skewed"), (40, 10, "small"), (10**6, 50, "falling"), (0, 50, "small")])
def test_quotas_of_many_runs_equal_the_sequential_rule(spark, monkeypatch, most, size, kind):
    monkeypatch.setattr(sampling, "WALK", size)
    rng = np.random.default_rng(size)
    caps = {"skewed": (rng.pareto(0.7, 500) * 50).astype(int), "small": rng.integers(0, 9, 200), "falling": np.arange(400, 0, -1) ** 2}[kind].tolist()
    order = rng.permutation(len(caps)).tolist()
    counts = spark.createDataFrame([(i, caps[i]) for i in order], "tile int, cap long")
    got = {r.tile: r.quota for r in sampling.tile_quotas(counts, most).collect()}
    assert [got[i] for i in range(len(caps))] == shares(caps, most)


def test_budget_takes_the_first_rows_of_the_hashed_order(spark):
    """A tile with most rows, one with a single row; an empty table."""
    pts = spark.range(3000).select(F.when(F.col("id") < 2500, 1).when(F.col("id") < 2999, 2).otherwise(3).alias("tile"), F.col("id").alias("point_id"))
    got = sampling.budget_sample(pts, 900, 0.5, 7)
    assert {r.tile: r["count"] for r in got.groupBy("tile").count().collect()} == dict(zip([1, 2], shares([1250, 249, 0], 900), strict=False))
    order = pts.where("tile = 1").orderBy(sampling.unit_hash(7, "tile", "point_id"), "point_id").limit(300)
    assert {r.point_id for r in got.where("tile = 1").collect()} == {r.point_id for r in order.collect()}
    assert sampling.budget_sample(pts.limit(0), 10, 0.5, 7).count() == 0
