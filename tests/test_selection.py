"""Selection by counting against sorted values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cairn.operators import grid, selection


def test_ranks_equal_sorted_values(spark):
    """Negative values, a value that most rows share, neighbouring doubles, single rows, huge and tiny ranges, ranks beyond the group."""
    rng = np.random.default_rng(2)
    near = np.nextafter(1.0, 2.0)
    groups = {"a": rng.normal(0, 1e6, 3000), "b": np.r_[np.full(900, 7.0), rng.uniform(-1, 8, 300)], "c": np.array([1.0, near, near, 1.0]), "d": np.array([5.0]), "e": np.r_[1e-300, 2e-300, 1e300, rng.uniform(0, 1, 200)]}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    asked = [(g, r) for g, vs in groups.items() for r in sorted({1, 2, len(vs) // 2, len(vs) - 1, len(vs), len(vs) + 1, 0}) if r >= 0]
    found = {(r["g"], r["rank"]): r for r in selection.select_ranks(rows, ["g"], "v", spark.createDataFrame(asked, "g string, rank long")).collect()}
    assert set(found) == {(g, r) for g, r in asked if 1 <= r <= len(groups[g])}
    for (g, r), row in found.items():
        want = np.sort(groups[g])[r - 1]
        assert row["v"] == want and row["below"] == (groups[g] < want).sum() and row["equal"] == (groups[g] == want).sum()


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=2001), np.round(rng.exponential(size=2001), 1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, float("nan"))], "x double, y double")
    shares = [0.01, 0.5, 0.99, 0.0, 1.0]
    got = selection.percentiles(df, {"x": F.col("x"), "y": F.col("y"), "none": F.lit(None)}, shares)
    assert np.allclose(got["x"], np.percentile(x, [100 * s for s in shares]), atol=1e-12)
    assert np.allclose(got["y"], np.percentile(y, [100 * s for s in shares]), atol=1e-12)
    assert got["none"] == [None] * 5


def brute_split(rows, most, name):
    if len(rows) <= most or len({r[1:] for r in rows}) == 1:
        return {name: rows}
    wide = np.ptp([r[2] for r in rows]) >= np.ptp([r[3] for r in rows])
    key = lambda r: (r[2] if wide else r[3], r[1])
    order = sorted(rows, key=key)
    bound = key(order[len(rows) // 2 - 1])
    first = [r for r in order if key(r) <= bound]
    first = first if len(first) < len(rows) else [r for r in order if key(r) < bound]
    return brute_split(first, most, name + ".0") | brute_split([r for r in order if r not in first], most, name + ".1")


def test_split_equals_brute_force_on_ties(spark):
    """Far deeper than any fixed number of rounds; rows that tie in place and id; a tile of nothing but copies stays whole."""
    rng = np.random.default_rng(4)
    rows = [("a", i, float(rng.integers(0, 6)), float(rng.integers(0, 6))) for i in range(70)]
    rows += [("b", i % 3, 1.0, float(i % 2)) for i in range(12)] + [("c", 1, 2.0, 2.0)] * 9 + [("d", 2, 0.0, 0.0)] + [("d", 3, 0.0, 0.0)] * 6
    df = spark.createDataFrame(rows, "part string, point_id long, x double, y double")
    got = {}
    for r in grid.split_large(df, 4).collect():
        got.setdefault(r["part"], []).append(tuple(r)[1:])
    want = {}
    for name in "abcd":
        want |= brute_split([r for r in rows if r[0] == name], 4, name)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(r[1:] for r in v) for k, v in want.items()}


def test_nothing_is_ranked(spark):
    df = spark.range(400).selectExpr("'t' AS part", "id AS point_id", "CAST(id AS double) AS x", "0.0D AS y")
    plan = grid.split_large(df, 30)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
