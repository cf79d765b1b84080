"""Exact nearest vectors by cosine, over inverted lists with triangle-inequality bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.scalar import l2norm
from cairn.operators.neighbors import checkpointed

#: Inverted lists at most, rows of a list (or of its queries) that one task holds; what is larger is split by id.
LISTS, ROWS = 1024, 8192


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class InvertedLists:
    """Unit vectors of ``ref`` in lists by their nearest centroid: centroids are rows chosen by hash, about the root of their number. Each list knows its
    size and radius; centroids, sizes and radii are what every task holds, and ``LISTS`` bounds them."""

    def __init__(self, ref: DataFrame, feature: str, id_col: str, carry: str) -> None:
        self.id_col, self.carry, self.kinds = id_col, carry, {f.name: f.dataType.simpleString() for f in ref.schema}
        unit = checkpointed(ref.select(F.col(id_col).alias("id"), F.col(carry).alias("carry"), l2norm(feature).alias("v")).where("id IS NOT NULL AND v IS NOT NULL"))
        count = min(LISTS, int(np.ceil(np.sqrt(unit.count()))))
        picked = unit.orderBy(F.xxhash64("id"), "id").limit(count).collect()
        self.dims = len(picked[0]["v"]) if picked else 0
        self.centers = np.array([r["v"] for r in picked], float).reshape(len(picked), self.dims)
        centers, dims = self.centers, self.dims

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                far = distances(_matrix(batch.column(2), dims), centers) if batch.num_rows else np.empty((0, 1))
                at = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(far[np.arange(len(at)), at])], ["id", "carry", "v", "list", "far"])

        self.empty = not picked
        if self.empty:
            return
        self.rows = checkpointed(unit.mapInArrow(deal, f"id {self.kinds[id_col]}, carry {self.kinds[carry]}, v array<double>, list int, far double"))
        sizes, radii = np.zeros(count, np.int64), np.full(count, -np.inf)
        for r in self.rows.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
            sizes[r["list"]], radii[r["list"]] = r["n"], r["far"]
        self.sizes, self.radii = sizes, radii

    def visits(self, queries: DataFrame, k: int, again: bool) -> DataFrame:
        """``id, v, lists``: the lists to visit, at first or (``again``, with ``reach``, the k-th distance so far) of the rest those that may hold a nearer row:
        a row of a list is no nearer than the query's distance to the centroid less the list's radius."""
        centers, dims, radii, sizes = self.centers, self.dims, self.radii, self.sizes

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                far = distances(_matrix(batch.column(1), dims), centers)
                visit = first_lists(far, sizes, k)
                if again:
                    reach = batch.column(2).to_numpy()
                    visit = ~visit & (far - radii <= reach[:, None] * (1 + 1e-9) + 1e-7)
                row, at = np.nonzero(visit)
                ends = np.searchsorted(row, np.arange(len(visit) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32)))], ["id", "v", "lists"])

        return queries.select("id", "v", *(["reach"] if again else [])).mapInArrow(choose, f"id {self.kinds[self.id_col]}, v array<double>, lists array<int>")

    def search(self, asked: DataFrame, k: int) -> DataFrame:
        """``id, best``: the k nearest of each query in each list it visits, as lists of ``d, other, carry``."""
        dims, parts = self.dims, lambda n: np.maximum(1, -(-n // ROWS))
        asked = checkpointed(asked.select("id", "v", F.explode("lists").alias("list")))
        load = np.zeros(len(self.sizes), np.int64)
        for r in asked.groupBy("list").count().collect():
            load[r["list"]] = r["count"]
        of = lambda numbers: F.get(F.array(*map(F.lit, numbers.tolist())), F.col("list")).cast("int")
        subs, shares = of(parts(self.sizes)), of(parts(load))
        dealt = lambda d, own, other, mine, theirs: d.withColumn(mine, F.pmod(F.xxhash64("id"), own).cast("int")).withColumn(theirs, F.explode(F.sequence(F.lit(0), other - 1)))
        queries, rows = dealt(asked, shares, subs, "share", "sub"), dealt(self.rows, subs, shares, "sub", "share")

        def near(q: pa.Table, t: pa.Table) -> pa.Table:
            t = t.sort_by("id")
            out = {"id": q["id"]}
            take = np.zeros((q.num_rows, 0), np.int64)
            d = np.zeros(take.shape)
            if q.num_rows and t.num_rows:
                d = 1.0 - _matrix(q["v"], dims) @ _matrix(t["v"], dims).T
                take = np.argsort(d, axis=1, kind="stable")[:, :k]
                d = np.take_along_axis(d, take, 1)
            ends = pa.array((np.arange(q.num_rows + 1) * take.shape[1]).astype(np.int32))
            at = pa.array(take.ravel())
            for name, values in (("d", pa.array(d.ravel())), ("other", t["id"].take(at).combine_chunks()), ("carry", t["carry"].take(at).combine_chunks())):
                out[name] = pa.ListArray.from_arrays(ends, values)
            return pa.table(out)

        ident, carry = self.kinds[self.id_col], self.kinds[self.carry]
        key = ["list", "sub", "share"]
        found = queries.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(near, f"id {ident}, d array<double>, other array<{ident}>, carry array<{carry}>")
        return found.select("id", F.arrays_zip("d", "other", "carry").alias("best"))


def first_lists(far: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Which lists each query visits first: the nearest ones that hold at least ``k`` rows together."""
    order = np.argsort(far, axis=1, kind="stable")
    held = np.cumsum(sizes[order], axis=1) - sizes[order]
    visit = np.zeros(far.shape, bool)
    np.put_along_axis(visit, order, held < k, axis=1)
    return visit & (sizes > 0)


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors (or zeros), by dot products."""
    square = (x * x).sum(axis=1)[:, None] + (centers * centers).sum(axis=1) - 2.0 * (x @ centers.T)
    return np.sqrt(np.maximum(square, 0.0))


def vector_knn(ref: DataFrame, queries: DataFrame, k: int, feature: str = "feature", id_col: str = "vec_id", carry: str = "label") -> DataFrame:
    """``(id, other, d, rank, carry)``: the k nearest rows of ``ref`` to each query by cosine distance ``d``, equal ones by id, exactly.

    A query first visits the nearest lists that hold k rows; its k-th distance then rules out the lists whose rows cannot be nearer, by the
    triangle inequality on unit vectors. Lists and their queries are split into tasks of bounded size, and a list of k travels per query and task.
    Ids are unique; null ids and vectors are left out.
    """
    lists = InvertedLists(ref, feature, id_col, carry)
    ident, label = (lists.kinds[c] for c in (id_col, carry))
    if lists.empty:
        return ref.sparkSession.createDataFrame([], f"`{id_col}` {ident}, other {ident}, d double, rank int, `{carry}` {label}")
    asked = checkpointed(queries.select(F.col(id_col).alias("id"), l2norm(feature).alias("v")).where("id IS NOT NULL AND v IS NOT NULL"))
    best: Column = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")
    first = checkpointed(lists.search(lists.visits(asked, k, False), k).groupBy("id").agg(best))
    # On the unit sphere the squared distance is twice the cosine distance.
    kth = F.when(F.size("best") >= k, F.sqrt(2 * F.greatest(F.element_at("best", -1)["d"], F.lit(0.0)))).otherwise(F.lit(float("inf")))
    reached = asked.join(first.select("id", kth.alias("reach")), "id")
    more = lists.search(lists.visits(reached, k, True), k)
    merged = first.unionByName(more).groupBy("id").agg(best)
    return merged.select(F.col("id").alias(id_col), F.posexplode("best").alias("p", "e")).select(id_col, "e.other", "e.d", (F.col("p") + 1).alias("rank"), F.col("e.carry").alias(carry))
