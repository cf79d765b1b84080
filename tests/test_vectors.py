"""Exact vector search over inverted lists against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import vectors


def cloud(n, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centers = np.random.default_rng(99).normal(size=(12, 16))
    return centers[rng.integers(0, 12, n)] + rng.normal(0, spread, (n, 16))


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, i % 5, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, label int, feature array<double>")


@pytest.mark.parametrize("rows", [60, 8192])
@pytest.mark.parametrize("k", [1, 6, 700])
def test_neighbours_equal_numpy(spark, monkeypatch, rows, k):
    """Lists and queries split into small tasks; copies, a zero vector, a null vector, k beyond the number of rows."""
    monkeypatch.setattr(vectors, "ROWS", rows)
    x = np.concatenate([cloud(500, 1), np.repeat(cloud(1, 5), 80, axis=0), np.zeros((1, 16))])
    q = np.concatenate([cloud(120, 2), x[[3, 550]], np.zeros((1, 16))])
    ref = frame(spark, x).union(spark.createDataFrame([(9_999, 0, None)], "vec_id long, label int, feature array<double>"))
    got = vectors.vector_knn(ref, frame(spark, q, 10_000), k).toPandas()
    unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    d = 1 - unit(q) @ unit(x).T
    for i, far in enumerate(d):
        mine = got[got.vec_id == 10_000 + i].sort_values("rank")
        want = np.sort(far)[:k]
        assert np.allclose(mine.d, want, atol=1e-12) and mine.other.is_unique
        assert np.allclose(far[mine.other], mine.d, atol=1e-12) and (mine.label == mine.other % 5).all()


def test_bounds_rule_lists_out(spark):
    ref, queries = frame(spark, cloud(1500, 3)), frame(spark, cloud(200, 4), 10_000)
    lists = vectors.InvertedLists(ref, "feature", "vec_id", "label")
    asked = queries.select(F.col("vec_id").alias("id"), vectors.l2norm("feature").alias("v"))
    first = lists.visits(asked, 5, False).select(F.sum(F.size("lists"))).first()[0]
    best = lists.search(lists.visits(asked, 5, False), 5).groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, 5).alias("best"))
    reach = asked.join(best.select("id", F.sqrt(2 * F.element_at("best", -1)["d"]).alias("reach")), "id")
    again = lists.visits(reach, 5, True).select(F.sum(F.size("lists"))).first()[0]
    every = 200 * len(lists.centers)
    assert first < 0.1 * every and first + again < 0.35 * every


def test_no_rows(spark):
    none = frame(spark, cloud(3, 1)).limit(0)
    assert vectors.vector_knn(none, frame(spark, cloud(3, 1)), 2).count() == 0
    assert vectors.vector_knn(frame(spark, cloud(3, 1)), none, 2).count() == 0
