"""Centroid clustering with a table of pivot distances (LAESA) and exact integer arithmetic.

Each vector's distances to a few fixed pivots are computed once and stored. In a round the centroids' distances to the pivots
are known too, and by the triangle inequality the largest difference over the pivots bounds the distance of a vector and a centroid from below.
Only centroids whose bound does not exceed the best distance so far get an exact distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import materialize

#: Integer components beyond this could make a squared distance overflow.
MOST = 1 << 27


def exact(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows, as exact 64-bit integers."""
    away = vectors - centroids
    return np.einsum("ij,ij->i", away, away)


def assign(vectors: np.ndarray, far: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties to the smaller number) and squared distance of each vector, and how many exact distances that took.

    ``far`` holds the vectors' distances to the pivots. Bounds are lowered by more than the rounding of square roots, so no nearest
    centroid is ruled out.
    """
    own = np.sqrt([exact(pivots, c) for c in centroids])
    bound = np.zeros((len(vectors), len(centroids)))
    for p in range(len(pivots)):
        a, b = far[:, p, None], own[None, :, p]
        np.maximum(bound, np.abs(a - b) - 1e-9 * (a + b + 1), out=bound)
    who = bound.argmin(axis=1)
    best, count = exact(vectors, centroids[who]), len(vectors)
    reach = np.sqrt(best) * (1 + 1e-9)
    first = who.copy()
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= reach) & (first != c))
        found = exact(vectors[rows], centroids[c])
        nearer = (found < best[rows]) | ((found == best[rows]) & (c < who[rows]))
        rows, found, count = rows[nearer], found[nearer], count + len(rows)
        who[rows], best[rows], reach[rows] = c, found, np.sqrt(found) * (1 + 1e-9)
    return who, best, count


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1)


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int, seed: str) -> DataFrame:
    """``vec_id, x, rank_key``: vectors with exactly ``dims`` components, none null or not finite, as ``floor(scale * x)``."""
    v = F.col(vec_col)
    sound = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))), 256)
    return vectors.where(v.isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("x"), key.alias("rank_key"))


def kmeans(vectors: DataFrame, k: int = 8, rounds: int = 10, pivots: int = 16, dims: int = 64, scale: int = 1024, seed: str = "3:", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``: one row per kept vector.

    Centroids start as the ``k`` vectors whose ``sha256(seed + id)`` is smallest, the pivots as the ``pivots`` smallest; they and the sums of a
    round (``k`` rows) are all that the driver holds. Each round assigns every vector, then replaces every non-empty
    centroid by the componentwise floor of the exact mean.

    Edge cases: null vectors, other lengths, null and non-finite components are left out; a null id counts as an empty string in the seeding hash,
    equal hashes (repeated ids) are ordered by their components; equal seeds leave the larger number empty; fewer than ``k`` vectors give as many
    clusters, none gives an empty table; integer components beyond ``MOST`` raise an error, as squared distances would not fit 64 bits. Only
    the two named columns are read.
    """
    spark = vectors.sparkSession
    whole = materialize(integer_vectors(vectors, id_col, vec_col, dims, scale, seed), "integer-vectors")
    if not whole.where(F.exists("x", lambda x: F.abs(x) > MOST)).isEmpty():
        raise ValueError(f"a component times {scale} is beyond {MOST}")
    first = np.array([r["x"] for r in whole.orderBy("rank_key", "x").select("x").limit(max(k, pivots)).collect()], np.int64).reshape(-1, dims)
    if not len(first):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    fixed, centroids = first[:pivots], first[:k].copy()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), np.int64)
            far = np.stack([np.sqrt(exact(x, p)) for p in fixed], axis=1) if len(x) else np.empty((0, len(fixed)))
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(fixed))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(far.ravel()))], ["vec_id", "x", "far"])

    table = materialize(whole.select("vec_id", "x").mapInArrow(measure, "vec_id long, x array<long>, far array<double>"), "pivot-table")
    for _ in range(rounds):
        centroids = _moved(table, centroids, fixed, dims)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, best, _ = assign(_matrix(batch.column(1), np.int64), _matrix(batch.column(2), float), centroids, fixed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(who.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])

    found = materialize(table.mapInArrow(final, "vec_id long, cluster int, distance long"), "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38, 0)")).alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    per: Column = of([sums.get(c, 0) for c in range(len(centroids))]).cast("long")
    return found.select("vec_id", "cluster", "distance", per.alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), of(names).alias("centroid_sha256"))


def _moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray, dims: int) -> np.ndarray:
    """The centroids after a round: each task sums its vectors per cluster, Spark adds the tasks' sums."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), np.int64)
            if len(x):
                who, _, _ = assign(x, _matrix(batch.column(1), float), centroids, pivots)
                for c in np.unique(who):
                    total[c] += x[who == c].sum(axis=0)
                count += np.bincount(who, minlength=len(count))
        used = np.flatnonzero(count)
        ends = pa.array(np.arange(len(used) + 1, dtype=np.int32) * dims)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.ListArray.from_arrays(ends, pa.array(total[used].ravel()))], ["cluster", "n", "s"])

    parts = table.select("x", "far").mapInArrow(sums, "cluster int, n long, s array<long>")
    exact_sum = lambda i: F.sum(F.get("s", F.lit(i)).cast("decimal(38, 0)")).alias(f"s{i}")
    moved = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(exact_sum(i) for i in range(dims))).collect():
        moved[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(dims)]
    return moved


def oracle_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3:") -> str:
    """All rounds in DuckDB SQL."""
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    nearest = lambda c: f"(SELECT v.row, arg_min({{'c': c.c, 'd': {distance}}}, {{'d': {distance}, 'c': c.c}}) AS best FROM v CROSS JOIN {c} c GROUP BY v.row)"
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c, x FROM v QUALIFY c < {k})",
    ]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED {nearest(f'c{r}')}")
        parts.append(f"m{r} AS MATERIALIZED (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (SELECT best.c AS c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r} JOIN v USING (row) CROSS JOIN range(1, {dims + 1}) t(i) GROUP BY best.c, i) GROUP BY c)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN m{r} m USING (c))")
    parts.append(f"f AS MATERIALIZED (SELECT vec_id, best.c AS c, best.d AS d FROM {nearest(f'c{rounds}')} JOIN v USING (row))")
    return f"WITH {', '.join(parts)} SELECT f.vec_id, f.c::INTEGER AS cluster, f.d AS distance, (sum(f.d) OVER (PARTITION BY f.c))::BIGINT AS cluster_inertia, (sum(f.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(o.x, ',')) AS centroid_sha256 FROM f JOIN c{rounds} o ON f.c = o.c"
