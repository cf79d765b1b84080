"""Cells, voxels, fragments, tiles and chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.scalar import unit_hash
from cairn.operators.neighbors import checkpointed
from cairn.operators.selection import select_ranks

XYZ = ("x", "y", "z")
CELL = ["gx", "gy", "gz"]


def _floor(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size)))


def cell(df: DataFrame, size: float) -> DataFrame:
    """Add the integer cell of a lattice that is anchored at 0."""
    return df.withColumns({g: _floor(F.col(c), size) for g, c in zip(CELL, XYZ, strict=True)})


def grid_coord(df: DataFrame, size: float, by: str = "tile") -> DataFrame:
    """Cells, shifted so that the smallest of each tile is 0. The minima are joined back: one row per tile."""
    cells = cell(df, size)
    least = cells.groupBy(by).agg(*(F.min(g).alias(f"__{g}") for g in CELL))
    return cells.join(least, by).withColumns({g: F.col(g) - F.col(f"__{g}") for g in CELL}).drop(*(f"__{g}" for g in CELL))


def displacement(df: DataFrame, size: float, normal: tuple[str, str, str] | None = None) -> DataFrame:
    """Where a point lies in its cell, -1/2 to 1/2 per axis (``dx, dy, dz``), or its projection on a normal (``displacement``)."""
    parts = {f"d{c}": F.col(c) / F.lit(float(size)) - _floor(F.col(c), size) - F.lit(0.5) for c in XYZ}
    out = df.withColumns(parts)
    if normal is None:
        return out
    return out.withColumn("displacement", sum((F.col(f"d{c}") * F.col(n) for c, n in zip(XYZ, normal, strict=True)), F.lit(0.0))).drop("dx", "dy", "dz")


def voxelize(pts: DataFrame, size: float, features: list[str] = (), how: str = "mean", by: str = "tile", id_col: str = "point_id", members: bool = False) -> DataFrame:
    """One row per voxel: mean position, mean / max / first (by id) feature, count and, if asked for, the member ids."""
    agg = {"mean": F.avg, "max": F.max, "first": lambda c: F.min_by(c, id_col)}[how]
    extra = [F.array_sort(F.collect_list(id_col)).alias("members")] if members else []
    return cell(pts, size).groupBy(by, *CELL).agg(*(F.avg(c).alias(f"c{c}") for c in XYZ), *(agg(f).alias(f) for f in features), F.count("*").alias("n"), *extra)


def voxel_reduce(pts: DataFrame, size: float, mean: list[str] = (), last: list[str] = (), vote: list[str] = (), hist: str | None = None, classes: int = 0, by: str = "tile", id_col: str = "point_id") -> DataFrame:
    """Voxels with centre, mean or last (by id) attributes, majority votes (ties to the lowest), and a label histogram of
    ``classes`` counts plus one for labels outside them."""
    counts = []
    if hist:
        within = (F.col(hist) >= 0) & (F.col(hist) < classes)
        counts = [F.array(*(F.count_if(F.col(hist) == k) for k in range(classes)), F.count_if(~F.coalesce(within, F.lit(False)))).alias("histogram")]
    parts = [*(F.avg(c).alias(f"c{c}") for c in XYZ), *(F.avg(c).alias(c) for c in mean), *(F.max_by(c, id_col).alias(c) for c in last), *(F.expr(f"mode({c}, true)").alias(c) for c in vote), *counts]
    return cell(pts, size).groupBy(by, *CELL).agg(*parts, F.count("*").alias("n"))


def voxel_centroids(pts: DataFrame, size: float, by: str = "tile") -> DataFrame:
    """Mean position per cell of a lattice that is anchored at the tile's minimum."""
    least = pts.groupBy(by).agg(*(F.min(c).alias(f"__{c}") for c in XYZ))
    cells = pts.join(least, by).withColumns({g: _floor(F.col(c) - F.col(f"__{c}"), size) for g, c in zip(CELL, XYZ, strict=True)})
    # Dealt by cell before they are added up: with few points to a cell, sums before the shuffle would hold all of a task's input.
    return cells.repartition(by, *CELL).groupBy(by, *CELL).agg(*(F.avg(c).alias(c) for c in XYZ), F.count("*").alias("n"))


def voxel_sample(pts: DataFrame, size: float, seed: int = 0, by: str = "tile", id_col: str = "point_id", forced: Column | None = None) -> DataFrame:
    """One point per voxel by hashed order, and every point for which ``forced`` holds."""
    order = F.struct(unit_hash(seed, by, id_col), F.col(id_col))
    rank = F.row_number().over(Window.partitionBy(by, *CELL).orderBy(order))
    keep = (F.col("__rank") == 1) if forced is None else (F.col("__rank") == 1) | forced
    return cell(pts, size).withColumn("__rank", rank).where(keep).drop("__rank")


def fragments(pts: DataFrame, size: float, most: int | None = None, by: str = "tile", id_col: str = "point_id") -> DataFrame:
    """``fragment`` rows that cover every point of a tile.

    Fragment ``i`` takes point ``i mod count`` of every voxel, for as many fragments as the fullest voxel has points. With
    ``most``, there are at most so many, and fragment ``i`` takes the ``i``-th of that many even parts of each voxel (a voxel
    with fewer points than fragments repeats them).
    """
    per = Window.partitionBy(by, *CELL)
    ranked = cell(pts, size).withColumn("__k", F.row_number().over(per.orderBy(id_col)) - 1).withColumn("__n", F.count("*").over(per))
    loops = ranked.groupBy(by).agg(F.max("__n").alias("__loops"))
    if most is not None:
        loops = loops.withColumn("__loops", F.least("__loops", F.lit(most)))
    joined = ranked.join(loops, by)
    few = F.col("__n") <= F.col("__loops")
    repeats = F.filter(F.sequence(F.lit(0).cast("long"), F.col("__loops") - 1), lambda i: i % F.col("__n") == F.col("__k"))
    part = F.array(F.floor(F.col("__k") * F.col("__loops") / F.col("__n")))
    return joined.withColumn("fragment", F.explode(F.when(few, repeats).otherwise(part))).drop("__k", "__n", "__loops")


def thin_non_class(pts: DataFrame, size: float, keep_class: int, by: str = "tile", id_col: str = "point_id", col: str = "classification") -> DataFrame:
    """All points of one class, and of the others the first (by id) of every voxel."""
    mine = F.coalesce(F.col(col) == keep_class, F.lit(False))
    rank = F.row_number().over(Window.partitionBy(by, *CELL, mine).orderBy(id_col))
    return cell(pts, size).withColumn("__rank", rank).where(mine | (F.col("__rank") == 1)).drop("__rank")


def with_index(pts: DataFrame, order: list[str], by: str = "tile", name: str = "index") -> DataFrame:
    """A stable index from 0 within each tile."""
    return pts.withColumn(name, (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("long"))


def core_boxes(pts: DataFrame, by: list[str]) -> DataFrame:
    """Each tile's own bounding box and count."""
    return pts.groupBy(*by).agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))), F.count("*").alias("n"))


def in_core(pts: DataFrame, tiles: DataFrame, by: list[str]) -> DataFrame:
    """Points within their tile's box, borders included."""
    return pts.join(tiles.select(*by, "min_x", "max_x", "min_y", "max_y"), by).where("x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y").drop("min_x", "max_x", "min_y", "max_y")


def tile_grid(pts: DataFrame, width: float, height: float, shifts: int = 1, source: str = "source") -> DataFrame:
    """Assign points to square windows of ``shifts`` squared grids, each offset by a fraction of the window:
    one row per point and grid with ``grid, tx, ty``. With one grid every point has one tile."""
    least = pts.groupBy(source).agg(F.min("x").alias("__x"), F.min("y").alias("__y"))
    offsets = F.array(*(F.struct(F.lit(i * shifts + j).alias("grid"), F.lit(i * width / shifts).alias("ox"), F.lit(j * height / shifts).alias("oy")) for i in range(shifts) for j in range(shifts)))
    rows = pts.join(least, source).withColumn("__o", F.explode(offsets))
    tx, ty = _floor(F.col("x") - F.col("__x") + F.col("__o.ox"), width), _floor(F.col("y") - F.col("__y") + F.col("__o.oy"), height)
    return rows.withColumn("grid", F.col("__o.grid")).withColumn("tx", tx).withColumn("ty", ty).drop("__o", "__x", "__y")


def number_tiles(tiles: DataFrame, source: str = "source", keys: tuple[str, ...] = ("grid", "tx", "ty")) -> DataFrame:
    """``tile_no`` from 0 within each source, in the order of the keys; ``tiles`` has a row per point or per tile."""
    named = tiles.select(source, *keys).distinct()
    return named.withColumn("tile_no", F.row_number().over(Window.partitionBy(source).orderBy(*keys)) - 1)


def absorb_small(pts: DataFrame, least: int, source: str = "source", tile: str = "tile_no") -> DataFrame:
    """Points of tiles with fewer than ``least`` points move to the tile of the same source, large enough, whose centroid
    is nearest (ties to the lower number); a source without such a tile stays as it is.

    The search runs over tiles, a row each, joined within a source.
    """
    stats = pts.groupBy(source, tile).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    small = stats.where(F.col("n") < least).select(source, F.col(tile).alias("from"), F.col("mx").alias("sx"), F.col("my").alias("sy"))
    valid = stats.where(F.col("n") >= least).select(source, F.col(tile).alias("to"), "mx", "my")
    d2 = (F.col("sx") - F.col("mx")) * (F.col("sx") - F.col("mx")) + (F.col("sy") - F.col("my")) * (F.col("sy") - F.col("my"))
    nearest = small.join(valid, source).groupBy(source, "from").agg(F.min_by("to", F.struct(d2, "to")).alias("to"))
    moved = pts.join(nearest.withColumnRenamed("from", tile), [source, tile], "left")
    return moved.withColumn(tile, F.coalesce("to", tile)).drop("to")


def split_large(pts: DataFrame, most: int, key: str = "part", order: Sequence[str] = ("point_id",)) -> DataFrame:
    """Halve tiles with more than ``most`` points at the median along their longer side (x, if equal), again and again.

    ``key`` is a string column naming the tile; halves get ``.0`` (the first ``n div 2`` in the order of the coordinate, then of the numbers in ``order``)
    and ``.1`` appended. The median is selected by counting, so a tile of any size is split without being ranked, and a level deals only the
    points of tiles that are too large still. Points that agree in all of these stay together; a tile of nothing else stays whole.
    """
    done, level = None, pts
    while True:
        box = checkpointed(level.groupBy(key).agg(F.count("*").alias("__n"), (F.max("x") - F.min("x") >= F.max("y") - F.min("y")).alias("__wide"), *(F.min(c).alias(f"__lo{i}") for i, c in enumerate(("x", "y", *order))), *(F.max(c).alias(f"__hi{i}") for i, c in enumerate(("x", "y", *order)))))
        alike = " AND ".join(f"__lo{i} = __hi{i}" for i in range(2 + len(order)))
        large = box.where((F.col("__n") > most) & ~F.expr(alike)).select(key, "__n", "__wide")
        if large.isEmpty():
            return level if done is None else done.unionByName(level)
        rest = level.join(large.select(key), key, "left_anti")
        done = rest if done is None else done.unionByName(rest)
        active = checkpointed(level.join(large, key).withColumn("__along", F.when(F.col("__wide"), F.col("x")).otherwise(F.col("y"))))
        bound = _median(active, key, large.select(key, F.expr("__n div 2").alias("rank")), ["__along", *order])
        names = ["__along", *order]
        # First half: below the bound in the first column that differs, or equal in all (unless nothing lies above).
        first = F.col("__n") > F.col("__upto")
        for c in reversed(names):
            first = F.when(F.col(c) < F.col(f"__at_{c}"), True).when(F.col(c) > F.col(f"__at_{c}"), False).otherwise(first)
        dealt = active.join(bound, key).withColumn(key, F.concat(key, F.when(first, F.lit(".0")).otherwise(F.lit(".1"))))
        level = checkpointed(dealt.select(*pts.columns))


def _median(rows: DataFrame, key: str, ranks: DataFrame, names: list[str]) -> DataFrame:
    """``(key, __at_<name>..., __upto)``: the values of the row at ``ranks(key, rank)`` in the order of ``names``, one column after the other among
    those that tie, and how many rows come no later."""
    found, left = None, ranks.withColumn("__less", F.lit(0).cast("long"))
    for name in names:
        at = checkpointed(select_ranks(rows.select(key, name), [key], name, left.select(key, "rank")).join(left.select(key, "__less"), key).withColumn("__less", F.col("__less") + F.col("below")))
        rows = rows.join(at.select(key, F.col(name).alias(f"__at_{name}")), key).where(F.col(name) == F.col(f"__at_{name}")).drop(f"__at_{name}")
        left = at.select(key, (F.col("rank") - F.col("below")).alias("rank"), "__less")
        one = at.select(key, F.col(name).alias(f"__at_{name}"))
        found = one if found is None else found.join(one, key)
    return found.join(at.select(key, (F.col("__less") + F.col("equal")).alias("__upto")), key)


def buffer_tiles(pts: DataFrame, tiles: DataFrame, buffer: float, source: str = "source", tile: str = "tile_no") -> DataFrame:
    """Every point that lies in a tile's box grown by ``buffer`` (borders included), once per such tile.

    Boxes are exploded to coarse cells of about a box's size, so the join is an equi join; ``in_box`` tells a tile's own points.
    """
    boxes = tiles.select(source, F.col(tile).alias("to_tile"), "min_x", "max_x", "min_y", "max_y")
    size = tiles.groupBy(source).agg((F.greatest(F.max(F.col("max_x") - F.col("min_x")), F.max(F.col("max_y") - F.col("min_y")), F.lit(1e-6)) + F.lit(2.0 * buffer)).alias("__s"))
    grown = boxes.join(size, source)
    for c in ("x", "y"):
        grown = grown.withColumn(f"__c{c}", F.explode(F.sequence(F.floor((F.col(f"min_{c}") - buffer) / F.col("__s")), F.floor((F.col(f"max_{c}") + buffer) / F.col("__s")))))
    placed = pts.join(size, source).withColumn("__cx", F.floor(F.col("x") / F.col("__s"))).withColumn("__cy", F.floor(F.col("y") / F.col("__s"))).drop("__s")
    near = placed.join(grown.drop("__s"), [source, "__cx", "__cy"])
    inside = (F.col("x") >= F.col("min_x") - buffer) & (F.col("x") <= F.col("max_x") + buffer) & (F.col("y") >= F.col("min_y") - buffer) & (F.col("y") <= F.col("max_y") + buffer)
    own = F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y"))
    return near.where(inside).withColumn("in_box", own).drop("__cx", "__cy", "min_x", "max_x", "min_y", "max_y")


def chunk(pts: DataFrame, width: float, stride: float, least: int = 1, by: str = "tile", voxel: float | None = None) -> DataFrame:
    """Overlapping square chunks ``[k * stride, k * stride + width)`` from the tile's minimum: one row per point and chunk,
    chunks with fewer than ``least`` points left out; ``voxel`` thins the points first (first id per cell)."""
    if voxel:
        pts = cell(pts, voxel).withColumn("__k", F.row_number().over(Window.partitionBy(by, *CELL).orderBy("point_id"))).where("__k = 1").drop("__k", *CELL)
    least_xy = pts.groupBy(by).agg(F.min("x").alias("__x"), F.min("y").alias("__y"))
    rows = pts.join(least_xy, by)
    for c in ("x", "y"):
        at = F.col(c) - F.col(f"__{c}")
        first = F.greatest(F.lit(0), F.floor((at - F.lit(float(width))) / F.lit(float(stride))) + 1)
        rows = rows.withColumn(f"chunk_{c}", F.explode(F.sequence(first, F.floor(at / F.lit(float(stride))))))
    rows = rows.drop("__x", "__y")
    if least <= 1:
        return rows
    large = rows.groupBy(by, "chunk_x", "chunk_y").count().where(F.col("count") >= least).drop("count")
    return rows.join(large, [by, "chunk_x", "chunk_y"])
