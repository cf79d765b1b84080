"""Tile rasters in blocks with halos: surfaces of points, holes filled, smoothed by a truncated Gaussian, read back at the points.

A raster is a table of occupied cells; no tile is ever held whole. Its plane is cut into blocks, and a block's task gets the
cells of the block and of a halo as wide as the Gaussian reaches, fills an array, smooths it and reads it at the block's points: one Arrow
pass a block. Blocks with very many points are split by id, each part with the same cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.neighbors import checkpointed, knn

#: Cells along a block's side, points of a task.
BLOCK, MOST_POINTS = 64, 200_000


def gaussian(sigma: float) -> np.ndarray:
    """Weights at whole cells up to four sigma, rounded, that sum to 1."""
    reach = int(4.0 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return w / w.sum()


def place(pts: DataFrame, size: float, pad: int = 0, spare: int = 1, by: str = "tile") -> DataFrame:
    """``pts`` with its cell ``__i, __j``, the raster's shape ``__ni, __nj`` and the position ``__u, __v`` in cells from the raster's corner.

    The corner lies ``pad`` cells below the tile's least x and y; a side has ``spare`` cells beyond those that the extent (rounded up) takes.
    """
    cell = F.lit(float(size))
    sides = (("x", "i", "u"), ("y", "j", "v"))
    box = pts.groupBy(by).agg(*(e for c, i, _ in sides for e in ((F.min(c) - pad * cell).alias(f"__o{i}"), (F.ceil((F.max(c) - F.min(c)) / cell) + spare).cast("long").alias(f"__n{i}"))))
    at = pts.join(box, by).withColumns({f"__{u}": (F.col(c) - F.col(f"__o{i}")) / cell for c, i, u in sides})
    return at.withColumns({f"__{i}": F.least(F.greatest(F.floor(f"__{u}"), F.lit(0)), F.col(f"__n{i}") - 1) for _, i, u in sides}).drop("__oi", "__oj")


def cells_of(placed: DataFrame, value: Column, by: str = "tile") -> DataFrame:
    """``(by, __i, __j, __ni, __nj, value)``: the occupied cells with an aggregate of their points."""
    return placed.groupBy(by, "__i", "__j").agg(F.first("__ni").alias("__ni"), F.first("__nj").alias("__nj"), value.alias("value"))


def _reach(i: str, halo: int, block: int) -> Column:
    """The blocks along one side whose halo holds cell ``__i``."""
    last = F.floor((F.col(f"__n{i}") - 1) / block)
    to = lambda d: F.least(F.greatest(F.floor((F.col(f"__{i}") + d) / block), F.lit(0)), last)
    return F.explode(F.sequence(to(-halo), to(halo)))


def nearest_filled(cells: DataFrame, blocks: DataFrame, halo: int, block: int = BLOCK, by: str = "tile") -> DataFrame:
    """``cells`` and every empty cell of ``blocks(by, __bi, __bj, __ni, __nj)`` and their halos, with the value of the nearest occupied cell
    (between centres; ties to the lower row, then column)."""
    span = lambda i: F.explode(F.sequence(F.greatest(F.col(f"__b{i}") * block - halo, F.lit(0)), F.least((F.col(f"__b{i}") + 1) * block + halo, F.col(f"__n{i}")) - 1))
    asked = blocks.withColumn("__i", span("i")).withColumn("__j", span("j")).select(by, "__i", "__j", "__ni", "__nj").distinct()
    empty = checkpointed(asked.join(cells, [by, "__i", "__j"], "left_anti"))
    spot = lambda d: d.withColumns({"cell_id": F.shiftleft("__i", 31).bitwiseOR(F.col("__j")), "x": F.col("__i").cast("double"), "y": F.col("__j").cast("double")})
    near = knn(spot(empty).select(by, "cell_id", "x", "y"), spot(cells).select(by, "cell_id", "x", "y"), 1, by, "cell_id", dims=("x", "y"))
    value = near.join(spot(cells).select(by, F.col("cell_id").alias("dst"), "value"), [by, "dst"]).select(by, F.col("src").alias("cell_id"), "value")
    return cells.unionByName(spot(empty).join(value, [by, "cell_id"]).select(*cells.columns))


def smoothed(placed: DataFrame, cells: DataFrame, sigma: float, fill: str = "mean", bilinear: bool = False, block: int = BLOCK, by: str = "tile", id_col: str = "point_id") -> DataFrame:
    """``(by, id, surface)``: a raster's values after a Gaussian of ``sigma`` cells with mirrored edges, at every point of ``placed``.

    Empty cells have the mean of the occupied ones (``mean``) or the nearest occupied one's value (``nearest``; a raster that is one block is filled
    in its task, only wider ones are searched). A point reads its own cell, or
    with ``bilinear`` the four cell centres round it, the raster continued beyond its edges by its border cells.
    """
    weights = gaussian(sigma)
    reach, halo = len(weights) // 2, len(weights) // 2 + 1
    key = [by, "__bi", "__bj"]
    at = placed.select(by, F.col(id_col).alias("id"), "__i", "__j", "__u", "__v", "__ni", "__nj", *(F.floor(F.col(f"__{i}") / block).alias(f"__b{i}") for i in "ij"))
    blocks = checkpointed(at.groupBy(*key).agg(F.first("__ni").alias("__ni"), F.first("__nj").alias("__nj"), F.ceil(F.count("*") / F.lit(float(MOST_POINTS))).cast("int").alias("__parts")))
    cells = checkpointed(cells.withColumn("value", F.col("value").cast("double")))
    if fill == "nearest":
        wide = (F.col("__ni") > block) | (F.col("__nj") > block)
        broad = blocks.where(wide)
        if not broad.isEmpty():
            cells = cells.where(~wide).unionByName(nearest_filled(cells.where(wide), broad, halo, block, by))
    level = cells.groupBy(by).agg(F.avg("value").alias("level"))
    sent = cells.withColumn("__bi", _reach("i", halo, block)).withColumn("__bj", _reach("j", halo, block)).join(blocks.drop("__ni", "__nj"), key).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).join(level, by)
    split = blocks.where("__parts > 1").select(*key, "__parts")
    dealt = at.join(split, key, "left").withColumn("__part", F.pmod(F.xxhash64("id"), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")

    def read(points: pa.Table, known: pa.Table) -> pa.Table:
        if not points.num_rows:
            return pa.table({by: points[by], "id": points["id"], "surface": pa.array([], pa.float64())})
        first = {c: points[c][0].as_py() for c in ("__bi", "__bj", "__ni", "__nj")}
        cut = []
        for i in "ij":
            n, low = first[f"__n{i}"], first[f"__b{i}"] * block
            a, b = max(0, low - 1), min(n, low + block + 1)  # a ring more than the block, for the centres round a point
            lo, hi = max(0, a - reach), min(n, b + reach)
            cut.append((a, b, lo, hi))
        (a0, b0, lo0, hi0), (a1, b1, lo1, hi1) = cut
        grid = np.full((hi0 - lo0, hi1 - lo1), known["level"][0].as_py())
        i, j = known["__i"].to_numpy(), known["__j"].to_numpy()
        inside = (i >= lo0) & (i < hi0) & (j >= lo1) & (j < hi1)
        grid[i[inside] - lo0, j[inside] - lo1] = known["value"].to_numpy()[inside]
        if fill == "nearest" and max(first["__ni"], first["__nj"]) <= block:
            _fill_nearest(grid, i, j)
        grid = np.pad(grid, [(reach - (a - lo), reach - (hi - b)) for a, b, lo, hi in cut], mode="symmetric")
        rows = sum(w * grid[t : t + b0 - a0] for t, w in enumerate(weights))
        done = sum(w * rows[:, t : t + b1 - a1] for t, w in enumerate(weights))
        if not bilinear:
            surface = done[points["__i"].to_numpy() - a0, points["__j"].to_numpy() - a1]
        else:
            (p0, p1, s), (q0, q1, t) = (_between(points[c].to_numpy(), first[f"__n{i}"], a) for c, i, a in (("__u", "i", a0), ("__v", "j", a1)))
            surface = (1 - s) * ((1 - t) * done[p0, q0] + t * done[p0, q1]) + s * ((1 - t) * done[p1, q0] + t * done[p1, q1])
        return pa.table({by: points[by], "id": points["id"], "surface": surface})

    group = [*key, "__part"]
    kinds = {f.name: f.dataType.simpleString() for f in at.schema}
    return dealt.groupBy(*group).cogroup(sent.groupBy(*group)).applyInArrow(read, f"`{by}` {kinds[by]}, id {kinds['id']}, surface double")


def _fill_nearest(grid: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give every cell of a whole raster but the occupied ``i, j`` the value of the nearest of those (ties to the lower row, then column)."""
    occupied = np.zeros(grid.shape, bool)
    occupied[i, j] = True
    known, empty = np.argwhere(occupied), np.argwhere(~occupied)
    step = max(1, 2**20 // len(known))
    for k in range(0, len(empty), step):
        part = empty[k : k + step]
        near = known[((part[:, None, :] - known) ** 2).sum(axis=2).argmin(axis=1)]
        grid[part[:, 0], part[:, 1]] = grid[near[:, 0], near[:, 1]]


def _between(position: np.ndarray, n: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two cells (counted from ``start``) whose centres enclose a position, and its share of the way."""
    at = np.clip(position - 0.5, 0, n - 1)
    low = np.floor(at).astype(np.int64)
    return low - start, np.minimum(low + 1, n - 1) - start, at - low


def flatten_non_ground(pts: DataFrame, ground: int, size: float = 1.0, sigma: float = 2.0, block: int = BLOCK, by: str = "tile", id_col: str = "point_id", col: str = "classification") -> DataFrame:
    """z of points that are not ground (or have no class) replaced by the smoothed surface of the greatest z of all points: crowns and roofs lose
    their roughness, the ground keeps its heights. Empty cells count with the mean of the occupied ones; a point takes its own cell's value."""
    placed = place(pts, size, by=by)
    surface = smoothed(placed.where(~F.coalesce(F.col(col) == ground, F.lit(False))), cells_of(placed, F.max("z"), by), sigma, block=block, by=by, id_col=id_col)
    found = surface.withColumnRenamed("id", id_col)
    return pts.join(found, [by, id_col], "left").withColumn("z", F.coalesce("surface", "z")).drop("surface")


def low_frequency(pts: DataFrame, resolution: float = 3.0, sigma: float = 1.5, least: int = 50, block: int = BLOCK, by: str = "tile", id_col: str = "point_id") -> DataFrame:
    """``(by, point_id, z_low)``: the smooth part of the terrain. Means of z per cell on a raster two cells wider than the tile at each side, holes filled
    from the nearest occupied cell, smoothed, and read bilinearly. Tiles of fewer than ``least`` points have their mean z."""
    mean = pts.groupBy(by).agg(F.avg("z").alias("__mean"), F.count("*").alias("__count"))
    many = pts.join(mean.where(F.col("__count") >= least).select(by), by, "left_semi")
    placed = place(many, resolution, pad=2, spare=3, by=by)
    surface = smoothed(placed, cells_of(placed, F.avg("z"), by), sigma, "nearest", True, block, by, id_col).withColumnRenamed("id", id_col)
    few = pts.join(mean.where(F.col("__count") < least), by).select(by, id_col, F.col("__mean").alias("z_low"))
    return surface.select(by, id_col, F.col("surface").alias("z_low")).unionByName(few)
