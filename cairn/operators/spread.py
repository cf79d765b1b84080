"""Farthest-point sampling: a small cloud in one task, a huge one over its leaves, with the same result."""

from __future__ import annotations

import operator
from collections.abc import Iterable
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.neighbors import LEAF, _Leaves, checkpointed, knn, shared_path

#: Points of a cloud that one task samples at most; leaves of a larger one (about); leaves that a job reads anew and larger clouds sampled at a time.
ONE_TASK, CELLS, AT_ONCE, CLOUDS = 4_000_000, 16_384, 64, 16


def fps(pts: DataFrame, m: int, by: str = "tile", id_col: str = "point_id") -> DataFrame:
    """Farthest-point sampling ``(by, point_id, rank)`` of ``m`` points a cloud from the first (lowest id); ties go to the lower id, and a
    cloud of at most ``m`` points is taken whole. Points without a place are left out; ids are unique within a cloud.

    Clouds of at most ``ONE_TASK`` points take a task each, in parallel. Those of more are sampled over leaves (``_Spread``): equal results, and no task holds more
    than a leaf.
    """
    kind = pts.schema[by].dataType.simpleString()
    pts = pts.select(by, F.col(id_col).cast("long").alias(id_col), *(F.col(c).cast("double").alias(c) for c in "xyz")).dropna(subset=list("xyz"))
    schema = f"`{by}` {kind}, `{id_col}` long, rank int"

    def sample(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(id_col)
        xyz, ids = frame[["x", "y", "z"]].to_numpy(), frame[id_col].to_numpy()
        take, far = [0], np.full(len(ids), np.inf)
        while len(take) < min(m, len(ids)):
            far = np.minimum(far, _squared(xyz, xyz[take[-1]]))
            far[take[-1]] = -1.0
            take.append(int(far.argmax()))
        return pd.DataFrame({by: frame[by].iloc[0], id_col: ids[take], "rank": np.arange(len(take))})

    counts = checkpointed(pts.groupBy(by).agg(F.count("*").alias("n")))
    huge = [tuple(r) for r in counts.where((F.col("n") > ONE_TASK) & F.col(by).isNotNull()).orderBy(by).collect()]
    if not huge:
        return pts.groupBy(by).applyInPandas(sample, schema)
    out = pts.where(F.col(by).isNull() | ~F.col(by).isin([b for b, _ in huge])).groupBy(by).applyInPandas(sample, schema)
    for i in range(0, len(huge), CLOUDS):
        some = huge[i : i + CLOUDS]
        of = pts.where(F.col(by).isin([b for b, _ in some]))
        out = out.unionByName(pts.sparkSession.createDataFrame(_Spread(of, max(n for _, n in some), by, id_col).take(m), schema))
    return out


def _squared(xyz: np.ndarray, p: Iterable[float]) -> np.ndarray:
    x, y, z = p
    return (xyz[:, 0] - x) ** 2 + (xyz[:, 1] - y) ** 2 + (xyz[:, 2] - z) ** 2


class _Spread:
    """Huge clouds cut into leaves, which are written in order, so that a job reads only those it asks for.

    Of each leaf the driver keeps its box and its farthest point so far. Distances only shrink as points are taken. So a leaf's farthest point stays the one unless
    a point taken is nearer to it than all before; then the leaf is stale, and its old distance and the box's far corner bound what it may have. Points are
    taken while no stale leaf can beat the best known one; then a job reads the stale leaves of the greatest bounds anew. What the driver keeps is bounded by
    ``CLOUDS`` times a small multiple of ``CELLS`` rows, and by ``m`` rows a cloud.
    """

    def __init__(self, pts: DataFrame, most: int, by: str, id_col: str) -> None:
        self.by, self.kind = by, pts.schema[by].dataType.simpleString()
        leaves = _Leaves(pts, by, id_col, ("x", "y", "z"), max(LEAF, -(-most // CELLS)))
        rows = leaves.own(leaves.points(pts)).select(by, F.xxhash64(*leaves.key).alias("cell"), "id", "x", "y", "z")
        path = shared_path(pts.sparkSession, "leaves")
        rows.repartitionByRange("cell").sortWithinPartitions("cell").write.option("parquet.block.size", 8 << 20).parquet(path)
        self.rows = pts.sparkSession.read.schema(rows.schema).parquet(path)
        ends = [f(c).alias(f"{n}_{c}") for n, f in (("least", F.min), ("most", F.max)) for c in "xyz"]
        table = self.rows.groupBy(by, "cell").agg(F.count("*").alias("n"), F.min(F.struct("id", "x", "y", "z")).alias("first"), *ends).toPandas()
        self.clouds = {getattr(cloud, "item", lambda c=cloud: c)(): _Cloud(part) for cloud, part in table.groupby(by)}
        self.jobs, self.read = 0, 0

    def take(self, m: int) -> list[tuple[Any, int, int]]:
        """``(by, id, rank)`` of all clouds."""
        while asked := {c: cells for c, cloud in self.clouds.items() if (cells := cloud.advance(m))}:
            self._refresh(asked)
        return [(c, int(p[0]), rank) for c, cloud in self.clouds.items() for rank, p in enumerate(cloud.taken[:m])]

    def _refresh(self, asked: dict[Any, list[int]]) -> None:
        by, cells = self.by, [c for some in asked.values() for c in some]
        taken = {c: self.clouds[c].taken for c in asked}

        def farthest(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("id")
            xyz, ids, far = frame[["x", "y", "z"]].to_numpy(), frame.id.to_numpy(), np.full(len(frame), np.inf)
            for number, *place in taken[frame[by].iloc[0]]:
                far = np.minimum(far, _squared(xyz, place))
                far[ids == number] = -1.0
            at = int(far.argmax())
            return pd.DataFrame({by: frame[by].iloc[:1], "cell": frame.cell.iloc[:1], "far": far[at], "id": ids[at], **{c: xyz[at, k] for k, c in enumerate("xyz")}})

        # Short lists, as one of more than ten values reaches the files as a single wide range.
        lists = [F.col("cell").isin(cells[i : i + 10]) for i in range(0, len(cells), 10)]
        read = self.rows if len(cells) > CLOUDS * AT_ONCE else self.rows.where(reduce(operator.or_, lists))
        found = read.groupBy(by, "cell").applyInPandas(farthest, f"`{by}` {self.kind}, cell long, far double, id long, x double, y double, z double").toPandas()
        self.jobs, self.read = self.jobs + 1, self.read + len(cells)
        for c in asked:
            self.clouds[c].renew(found[found[by] == c])


class _Cloud:
    """A cloud's leaves as arrays, and the points taken, ``(id, x, y, z)``."""

    def __init__(self, part: pd.DataFrame) -> None:
        self.cells, self.n = part.cell.to_numpy(), int(part.n.sum())
        self.low, self.high = part[["least_x", "least_y", "least_z"]].to_numpy(), part[["most_x", "most_y", "most_z"]].to_numpy()
        self.far, self.stale = np.full(len(part), np.inf), np.ones(len(part), bool)
        self.id, self.xyz = np.full(len(part), np.iinfo(np.int64).max), np.zeros((len(part), 3))
        self.taken: list[tuple[int, float, float, float]] = []
        self._add(tuple(min(part["first"])))

    def _add(self, point: tuple[int, float, float, float]) -> None:
        self.taken.append(point)
        place = np.array(point[1:])
        corner = (np.maximum(np.abs(self.low - place), np.abs(self.high - place)) ** 2).sum(axis=1) * (1 + 1e-9)
        nearer = _squared(self.xyz, place) < self.far
        self.stale |= nearer | (self.id == point[0])
        self.far = np.where(self.stale, np.minimum(self.far, corner), self.far)

    def advance(self, m: int) -> list[int]:
        """Take points while the best known one beats all bounds; the leaves to be read next, none at the end."""
        while len(self.taken) < min(m, self.n):
            bound = self.far[self.stale].max(initial=-np.inf)
            known = np.flatnonzero(~self.stale)
            best = known[np.lexsort((self.id[known], -self.far[known]))[:1]]
            if not len(best) or self.far[best[0]] <= bound:
                at = np.flatnonzero(self.stale)
                if np.isinf(bound):
                    return self.cells[at].tolist()
                return self.cells[at[np.argsort(-self.far[at], kind="stable")[:AT_ONCE]]].tolist()
            self._add((int(self.id[best[0]]), *self.xyz[best[0]].tolist()))
        return []

    def renew(self, part: pd.DataFrame) -> None:
        order = np.argsort(self.cells)
        at = order[np.searchsorted(self.cells[order], part.cell.to_numpy())]
        self.far[at], self.id[at], self.xyz[at], self.stale[at] = part.far, part.id, part[["x", "y", "z"]], False


def patches(pts: DataFrame, count: int, size: int, by: str = "tile", id_col: str = "point_id") -> DataFrame:
    """``count`` patches per cloud: farthest-point centres with their ``size`` nearest points."""
    centers = checkpointed(fps(pts, count, by, id_col))
    near = knn(pts.join(centers.select(by, id_col), [by, id_col]), pts, size, by, id_col)
    return near.join(centers.select(by, F.col(id_col).alias("src"), F.col("rank").alias("patch")), [by, "src"])
