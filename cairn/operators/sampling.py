"""Hashed sampling, budgets, splits, epoch plans, crops, views."""

from __future__ import annotations

import bisect
import functools
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.scalar import unit_hash
from cairn.operators.geometry import weighed
from cairn.operators.neighbors import checkpointed, look_up, radius_edges
from cairn.operators.raster import low_frequency
from cairn.operators.selection import in_order


def nested_rank(pts: DataFrame, seed: int, keys: Sequence[str] = ("tile", "point_id"), name: str = "rank") -> DataFrame:
    """A hashed number in [0, 1): rows below f1 are among those below any f2 > f1."""
    return pts.withColumn(name, unit_hash(seed, *keys))


def budget_counts(ranks: DataFrame, fractions: Sequence[float], by: Sequence[str] = ("classification",), rank: str = "rank") -> DataFrame:
    """Labels per class for every nested fraction."""
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(F.col(rank) < f).alias(f"n_{i}") for i, f in enumerate(fractions)))


def keep_fraction(pts: DataFrame, fraction: float, seed: int, by: Sequence[str] = ("tile",), id_col: str = "point_id", least: int = 1, divisor: int | None = None) -> DataFrame:
    """An exact share of each group (``max(least, floor(n * fraction))`` rows, or ``n div divisor``), by hashed order."""
    per = Window.partitionBy(*by)
    rank = F.row_number().over(per.orderBy(unit_hash(seed, *by, id_col), F.col(id_col)))
    n = F.count("*").over(per)
    quota = F.floor(n / F.lit(divisor)) if divisor else F.floor(n * F.lit(float(fraction)))
    return pts.withColumn("__r", rank).withColumn("__q", F.greatest(F.lit(least), quota)).where("__r <= __q").drop("__r", "__q")


def downsample(pts: DataFrame, divisor: int, seed: int, by: Sequence[str] = ("tile",), id_col: str = "point_id") -> DataFrame:
    """One in ``divisor`` points of each tile, at least one."""
    return keep_fraction(pts, 1.0, seed, by, id_col, divisor=divisor)


def keep_labels(pts: DataFrame, ratio: float, other: int, seed: int, by: str = "tile", id_col: str = "point_id", col: str = "classification") -> DataFrame:
    """Keep the label of an exact share of every class per tile; the rest become ``other``."""
    per = Window.partitionBy(by, col)
    rank = F.row_number().over(per.orderBy(unit_hash(seed, by, id_col), F.col(id_col)))
    flagged = pts.withColumn("__keep", rank <= F.floor(F.count("*").over(per) * F.lit(float(ratio))))
    return flagged.withColumn(col, F.when(F.col("__keep"), F.col(col)).otherwise(other)).drop("__keep")


def dropout(pts: DataFrame, ratio: float, seed: int, keep: Column | None = None, by: str = "tile", id_col: str = "point_id") -> DataFrame:
    """Drop an exact share of each tile's points, but never those for which ``keep`` holds."""
    per = Window.partitionBy(by)
    rank = F.row_number().over(per.orderBy(unit_hash(seed, by, id_col), F.col(id_col)))
    stays = rank > F.floor(F.count("*").over(per) * F.lit(float(ratio)))
    kept = pts.withColumn("__s", stays if keep is None else stays | F.coalesce(keep, F.lit(False)))
    return kept.where("__s").drop("__s")


def shuffled(pts: DataFrame, seed: int, keys: Sequence[str] = ("tile", "point_id")) -> DataFrame:
    return pts.orderBy(unit_hash(seed, *keys), *keys)


def even_positions(df: DataFrame, n: int, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows at ``n`` evenly spaced positions (rounded half to even) of each group's order; all rows of smaller groups.

    Ranks need the group in order: give ``by``, or use it on tables of groups (blocks, tiles).
    """
    per = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = df.withColumn("__i", F.row_number().over(per.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(per))
    # Position i is taken iff it is the rounding of some j * (N - 1) / (n - 1): only the j's next to it can be.
    step = (F.col("__n") - 1) / F.lit(float(max(1, n - 1)))
    j = F.round(F.col("__i") / F.when(step > 0, step).otherwise(1.0))
    hit = (F.bround(j * step) == F.col("__i")) | (F.bround((j - 1) * step) == F.col("__i")) | ((F.bround((j + 1) * step) == F.col("__i")) & (j + 1 <= n - 1))
    return ranked.where((F.col("__n") <= n) | (hit & (j >= 0))).drop("__i", "__n")


def block_split(df: DataFrame, block: str, fraction: float) -> DataFrame:
    """Adds ``held_out``: evenly spaced blocks (at least one) in the order of their ids."""
    blocks = df.select(block).distinct()
    n = blocks.count()
    held = even_positions(blocks, max(1, round(n * fraction)), [block]).withColumn("held_out", F.lit(True))
    return df.join(held, block, "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def _even(i: Column, n: Column, take: Column) -> Column:
    """Is ``i`` among the ``take`` evenly spaced positions from 0 to ``n - 1``, each rounded (halves to even)?"""
    step = (n - 1) / (take - 1)
    j = F.round(i / step)
    near = [(j + d >= 0) & (j + d <= take - 1) & (F.bround((j + d) * step) == i) for d in (-1, 0, 1)]
    return F.when(take <= 0, False).when(take >= n, True).when(take == 1, i == 0).otherwise(near[0] | near[1] | near[2])


def stratified_share(df: DataFrame, strata: Sequence[str], n: int, seed: int, by: str = "tile", id_col: str = "point_id") -> DataFrame:
    """``n`` rows of each tile (all, if it has no more), strata in proportion to their sizes: each gets ``floor(n * size / total)``, at least 1; what is too
    much is taken one by one from the largest share (ties: the first stratum) above 1; rows are drawn by hash within a stratum, and what is
    still missing from all that are left. With more strata than ``n`` the first ones give a row each."""
    tile, stratum = Window.partitionBy(by), Window.partitionBy(by, *strata)
    sizes = df.groupBy(by, *strata).agg(F.count("*").alias("__c"))
    lists = sizes.groupBy(by).agg(F.sum("__c").alias("__total"), F.array_sort(F.collect_list(F.struct(*strata, "__c"))).alias("__strata"))
    share = F.transform("__strata", lambda e: F.greatest(F.lit(1), F.floor(F.lit(n) * e["__c"] / F.col("__total"))).cast("long"))
    over = F.aggregate("__share", F.lit(0).cast("long"), lambda a, e: a + e) - F.lit(n)
    steps = F.when(over > 0, F.sequence(F.lit(1).cast("long"), over)).otherwise(F.array().cast("array<bigint>"))

    def less(shares: Column, _: Column) -> Column:
        top = F.array_max(shares)
        at = F.array_position(shares, top)
        return F.when(top > 1, F.transform(shares, lambda e, i: F.when(i + 1 == at, e - 1).otherwise(e))).otherwise(shares)

    shares = lists.withColumn("__share", share).withColumn("__share", F.aggregate(steps, F.col("__share"), less))
    each = shares.select(by, "__total", F.posexplode(F.arrays_zip("__strata", "__share")).alias("__s", "e")).select(by, "__total", "__s", *(F.col(f"e.__strata.{c}").alias(f"__stratum_{c}") for c in strata), F.col("e.__share").alias("__take"))
    same = [df[by].eqNullSafe(each[by]), *(df[c].eqNullSafe(each[f"__stratum_{c}"]) for c in strata)]
    rows = df.join(each, functools.reduce(Column.__and__, same)).select(df["*"], "__total", "__s", "__take")
    draw = unit_hash(seed, by, id_col)
    ranked = rows.withColumn("__r", F.row_number().over(stratum.orderBy(draw, id_col))).withColumn("__rest", F.col("__r") > F.col("__take"))
    # Drawn rows first, by stratum; then what fills up, by hash.
    place = F.row_number().over(tile.orderBy("__rest", F.when(F.col("__rest"), 0).otherwise(F.col("__s")), draw, id_col))
    return ranked.withColumn("__p", place).where((F.col("__total") <= n) | (F.col("__p") <= n)).select(*df.columns)


def stratified(df: DataFrame, strata: Sequence[str], n: int, by: str = "tile", id_col: str = "point_id") -> DataFrame:
    """At most ``n`` rows of each tile: every stratum gives an equal base (``n div strata``, at least 1, or all it has) at even positions in the
    order of ids, then the rest of the tile fills up at even positions; of more than ``n`` the first by id stay. A tile of at most ``n`` rows stays whole."""
    tile, stratum = Window.partitionBy(by), Window.partitionBy(by, *strata)
    base = df.groupBy(by).agg(F.greatest(F.lit(1), F.floor(F.lit(n) / F.count_distinct(F.struct(*strata)))).alias("__base"))
    ranked = df.join(base, by).withColumn("__total", F.count("*").over(tile)).withColumn("__n", F.count("*").over(stratum)).withColumn("__i", F.row_number().over(stratum.orderBy(id_col)) - 1)
    ranked = ranked.withColumn("__in", (F.col("__total") <= n) | _even(F.col("__i"), F.col("__n"), F.least("__n", "__base")))
    inside = F.sum(F.col("__in").cast("long")).over(tile)
    ranked = ranked.withColumn("__k", inside).withColumn("__j", F.row_number().over(Window.partitionBy(by, "__in").orderBy(id_col)) - 1)
    rest = F.col("__total") - F.col("__k")
    fill = _even(F.col("__j"), rest, F.least(F.greatest(F.lit(n) - F.col("__k"), F.lit(0)), rest))
    chosen = ranked.where(F.col("__in") | fill)
    last = F.row_number().over(tile.orderBy(id_col))
    return chosen.withColumn("__last", last).where((F.col("__total") <= n) | (F.col("__last") <= n)).select(*df.columns)


def batch_offsets(sizes: DataFrame, batch: int, order: str = "cloud", n: str = "n") -> DataFrame:
    """``batch_id``, position in the batch, cumulative ``offset`` within it, and ``start`` (what is before) per cloud. One row per cloud."""
    numbered = sizes.withColumn("__i", F.row_number().over(Window.orderBy(order)) - 1)
    per = Window.partitionBy("batch_id").orderBy("__i")
    out = numbered.withColumn("batch_id", F.floor(F.col("__i") / batch)).withColumn("in_batch", F.col("__i") % batch)
    return out.withColumn("offset", F.sum(n).over(per)).withColumn("start", F.col("offset") - F.col(n)).drop("__i")


def shift_inverse(rows: DataFrame, starts: DataFrame, on: str = "cloud", inverse: str = "inverse") -> DataFrame:
    """Inverse indexes of a batch: each cloud's shifted by the voxels before it (``starts(cloud, start)``)."""
    return rows.join(starts.select(on, F.col("start").alias("__s")), on).withColumn(inverse, F.col(inverse) + F.col("__s")).drop("__s")


def mix_pairs(pts: DataFrame, clouds: DataFrame, cloud: str = "cloud", instance: str = "instance") -> DataFrame:
    """Consecutive clouds become one: ``mixed`` is the pair's number; the second's instance ids move past the first's."""
    numbered = clouds.select(cloud).distinct().withColumn("__i", F.row_number().over(Window.orderBy(cloud)) - 1)
    tops = pts.groupBy(cloud).agg((F.max(instance) + 1).alias("__top")).join(numbered, cloud)
    per = Window.partitionBy(F.floor(F.col("__i") / 2)).orderBy("__i")
    shift = tops.withColumn("mixed", F.floor(F.col("__i") / 2)).withColumn("__shift", F.coalesce(F.greatest(F.lag("__top").over(per), F.lit(0)), F.lit(0))).select(cloud, "mixed", "__shift")
    return pts.join(shift, cloud).withColumn(instance, F.when(F.col(instance) >= 0, F.col(instance) + F.col("__shift")).otherwise(F.col(instance))).drop("__shift")


def serialize(pts: DataFrame, code: Column, by: str = "tile", id_col: str = "point_id") -> DataFrame:
    """``code`` and each point's place in its order within the tile (ties by id); the inverse permutation is that place."""
    coded = pts.withColumn("code", code)
    return coded.withColumn("place", (F.row_number().over(Window.partitionBy(by).orderBy("code", id_col)) - 1).cast("long"))


def smooth_metric(metrics: DataFrame, window: int, run: Sequence[str] = ("run", "name"), order: str = "iter", value: str = "value") -> DataFrame:
    """Median and mean of the last ``window`` values, latest, and running mean from the beginning."""
    per = Window.partitionBy(*run).orderBy(order)
    recent = per.rowsBetween(-(window - 1), 0)
    return metrics.withColumn("median", F.percentile(value, 0.5).over(recent)).withColumn("mean", F.avg(value).over(recent)).withColumn("running", F.avg(value).over(per.rowsBetween(Window.unboundedPreceding, 0)))


def best_epoch(metrics: DataFrame, run: Sequence[str] = ("run",), order: str = "iter", value: str = "value", planned: int | None = None) -> DataFrame:
    """Best value and its first epoch, epochs run, last value, and whether it stopped before ``planned`` epochs."""
    out = metrics.groupBy(*run).agg(F.max(value).alias("best"), F.min_by(order, F.struct(-F.col(value), F.col(order))).alias("best_epoch"), F.count("*").alias("epochs"), F.max_by(value, order).alias("final"))
    return out.withColumn("stopped", F.lit(False) if planned is None else F.col("epochs") < planned)


def curve_auc(df: DataFrame, by: Sequence[str] = ("method",), fraction: str = "fraction", value: str = "miou") -> DataFrame:
    """Area under value over log10(fraction), divided by the range, and rank by it (1 is best)."""
    per = Window.partitionBy(*by).orderBy("__x")
    x = df.withColumn("__x", F.log10(fraction))
    area = x.withColumn("__a", (F.col("__x") - F.lag("__x").over(per)) * (F.col(value) + F.lag(value).over(per)) / 2)
    out = area.groupBy(*by).agg((F.sum("__a") / F.nullif(F.max("__x") - F.min("__x"), F.lit(0.0))).alias("auc"))
    return out.withColumn("place", F.rank().over(Window.orderBy(F.desc("auc"))))


def rank_by(df: DataFrame, score: str, by: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    per = Window.partitionBy(*by) if by else Window.partitionBy()
    return df.withColumn("place", F.rank().over(per.orderBy(F.desc(score), *ties)))


def sphere_crop(pts: DataFrame, n: int, mode: str = "middle", seed: int = 0, by: str = "tile", id_col: str = "point_id") -> DataFrame:
    """The ``n`` points of each tile nearest to a centre point: its middle row by id (``n div 2``), a hashed random one, or the mean of
    its ``covered`` points. Ties to the lower id."""
    if mode == "mean":
        center = pts.where("covered").groupBy(by).agg(*(F.avg(c).alias(f"__{c}") for c in "xyz"))
    else:
        key = F.col(id_col) if mode == "middle" else unit_hash(seed, by, id_col)
        per = Window.partitionBy(by)
        at = F.floor(F.count("*").over(per) / 2) + 1 if mode == "middle" else F.lit(1)
        picked = pts.select(by, "x", "y", "z", F.row_number().over(per.orderBy(key, F.col(id_col))).alias("__r"), at.alias("__at")).where("__r = __at")
        center = picked.select(by, *(F.col(c).alias(f"__{c}") for c in "xyz"))
    d2 = sum(((F.col(c) - F.col(f"__{c}")) * (F.col(c) - F.col(f"__{c}")) for c in "xyz"), F.lit(0.0))
    near = pts.join(center, by).withColumn("__d2", d2)
    return near.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy("__d2", id_col))).where(F.col("__r") <= n).drop("__r", "__d2", "__x", "__y", "__z")


def multi_view(
    pts: DataFrame, seed: int, globals_: int = 2, global_scale: tuple[float, float] = (0.4, 1.0), locals_: int = 4, local_scale: tuple[float, float] = (0.1, 0.4), most: int = 65_536, height: tuple[float, float] = (0.0, 1.0), shared: bool = False, seen: str | None = None, seen_most: int = 102_400,
    by: str = "tile", id_col: str = "point_id",
) -> DataFrame:
    """``view`` rows: a view is the points nearest to its centre, a hashed share within its scale of the tile's points (of at most ``most``), at least one.

    View 0 is the major one; its centre is a point within the tile's ``height`` range. With the boolean column ``seen`` (points that an image shows) it is their
    mean, and the view the nearest ``seen_most`` points. Views 1 to ``globals_ - 1`` have their centres in the major view, or are copies of it (``shared``). The ``locals_`` ones after
    them have theirs among the major view's points that no local view covers yet; when all are covered, it begins anew.
    """
    total = pts.groupBy(by).agg(F.count("*").alias("__n"), F.min("z").alias("__lo"), F.max("z").alias("__hi"))

    def crop(centers: DataFrame, view: int, scale: tuple[float, float]) -> DataFrame:
        d2 = sum(((F.col(x) - F.col(f"__{x}")) * (F.col(x) - F.col(f"__{x}")) for x in "xyz"), F.lit(0.0))
        share = scale[0] + (scale[1] - scale[0]) * unit_hash(f"{seed}/size{view}", by)
        size = F.greatest(F.lit(1), F.floor(share * F.least(F.col("__n"), F.lit(most))))
        if view == 0 and seen is not None:
            size = F.when(F.col("__seen"), F.least(F.col("__n"), F.lit(seen_most))).otherwise(size)
        near = pts.join(centers, by).join(total, by).withColumn("__d2", d2)
        rank = F.row_number().over(Window.partitionBy(by).orderBy("__d2", id_col))
        return near.withColumn("__r", rank).where(F.col("__r") <= size).select(*pts.columns, F.lit(view).alias("view"))

    def drawn(rows: DataFrame, view: int) -> DataFrame:
        first = F.min_by(F.struct("x", "y", "z"), F.struct(unit_hash(f"{seed}/{view}", by, id_col), F.col(id_col))).alias("c")
        return rows.groupBy(by).agg(first).select(by, *(F.col(f"c.{x}").alias(f"__{x}") for x in "xyz"))

    level = lambda share: F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.lit(float(share))
    centers = drawn(pts.join(total, by).where(F.col("z").between(level(height[0]), level(height[1]))), 0)
    if seen is not None:
        mean = pts.where(F.col(seen)).groupBy(by).agg(*(F.avg(x).alias(f"m{x}") for x in "xyz"))
        centers = centers.join(mean, by, "left").select(by, *(F.coalesce(f"m{x}", f"__{x}").alias(f"__{x}") for x in "xyz"), F.col("mx").isNotNull().alias("__seen"))
    out = major = checkpointed(crop(centers, 0, global_scale))
    for v in range(1, globals_):
        out = out.unionByName(major.withColumn("view", F.lit(v)) if shared else crop(drawn(major, v), v, global_scale))
    # How often a point was covered: the least covered points of a tile are those that no view has since it began anew.
    open_points = major.select(by, id_col, *"xyz").withColumn("__times", F.lit(0))
    for v in range(globals_, globals_ + locals_):
        least = open_points.groupBy(by).agg(F.min("__times").alias("__least"))
        part = checkpointed(crop(drawn(open_points.join(least, by).where("__times = __least"), v), v, local_scale))
        out = out.unionByName(part)
        hit = part.select(by, id_col, F.lit(True).alias("__hit"))
        met = open_points.join(least, by).join(hit, [by, id_col], "left")
        open_points = checkpointed(met.select(by, id_col, *"xyz", F.when(F.col("__hit"), F.col("__least") + 1).otherwise(F.col("__times")).alias("__times")))
    return out


def contrastive_pair(pts: DataFrame, transform: Callable[[DataFrame, int], DataFrame], seed: int) -> DataFrame:
    """Two copies of every tile, ``view`` 1 and 2, each through ``transform(points, seed)`` with a seed of its own."""
    return transform(pts, 2 * seed).withColumn("view", F.lit(1)).unionByName(transform(pts, 2 * seed + 1).withColumn("view", F.lit(2)))


def keep_largest(df: DataFrame, n: int, by: str = "n", ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(n)


#: Shares of a tile selection by environment, in the order in which they are filled (fixed values).
ENVIRONMENT_SHARES = {"urban": 0.22, "suburban": 0.20, "dense_vegetation": 0.20, "open_ground": 0.15, "water": 0.08, "rare_infrastructure": 0.10, "mixed": 0.05}


def select_tiles(stats: DataFrame, n: int, cap: int, block: str = "source_block", tile: str = "tile", score: str = "priority", environment: str = "environment", classes: Sequence[str] = (), shares: dict[str, float] = ENVIRONMENT_SHARES) -> DataFrame:
    """``n`` tiles with at most ``cap`` per block, with the ``reason``: the best of every block by ``score``, for each of ``classes`` (count columns)
    the tile that has most of it, the best of each environment up to its share of ``n`` (rounded, at least 1), then the best overall.

    The choice is greedy, yet every step is a table: a tile that is not taken can be chosen if its rank among such tiles of its block is within
    the room that earlier steps left there, and the best of these are, up to the quota. Only the ``cap`` best of each block, and of each block and environment, can
    come to that. The driver sees counts and one tile per class. Equal scores go to the lower tile, null scores come last, tiles
    without a block form one. Raises if the cap does not leave ``n`` tiles.
    """
    order, columns = [F.desc("score"), F.col("tile")], ["tile", "block", "environment", "score"]
    named = dict(zip(columns, (tile, block, environment, score), strict=True))
    rows = stats.select(*(F.col(c).alias(name) for name, c in named.items()), *(F.col(c).alias(f"__{i}") for i, c in enumerate(classes)))

    def top(df: DataFrame, k: int, *per: str) -> DataFrame:
        return df.withColumn("__r", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("__r") <= k)

    pool = checkpointed(top(rows, cap, "block").select(*columns).union(top(rows, cap, "block", "environment").select(*columns)).distinct())
    taken = top(pool, min(cap, 1), "block").select("tile", "block", "environment", F.lit("block").alias("reason"))
    if classes and cap > 1:
        most = rows.agg(*(F.min_by(F.struct("tile", "block", "environment"), F.when(F.col(f"__{i}") > 0, F.struct(-F.col(f"__{i}"), F.col("tile")))).alias(str(i)) for i in range(len(classes)))).first()
        found = [(c, most[i]) for i, c in enumerate(classes) if most[i] is not None]
        have = {r["tile"] for r in taken.where(F.col("tile").isin([r["tile"] for _, r in found])).collect()}
        used: dict = {}  # of a block, beyond its best tile
        more = []
        for c, r in found:
            if r["tile"] not in have and used.get(r["block"], 1) < cap:
                have.add(r["tile"])
                used[r["block"]] = used.get(r["block"], 1) + 1
                more.append((*r, f"class {c}"))
        taken = taken.unionByName(stats.sparkSession.createDataFrame(more, taken.schema))
    taken = checkpointed(taken)
    for name, quota in [*((e, max(1, round(n * share))) for e, share in shares.items()), (None, n)]:
        own = F.lit(True) if name is None else F.coalesce(F.col("environment") == name, F.lit(False))
        now = taken.agg(F.count("*").alias("all"), F.count_if(own).alias("own")).first()
        room = min(quota - now["own"], n - now["all"])
        if room > 0:
            used_of = taken.groupBy(F.col("block").alias("__block")).agg(F.count("*").alias("__used"))
            free = top(pool.where(own).join(taken.select("tile"), "tile", "left_anti"), cap, "block")
            fits = free.join(used_of, F.col("block").eqNullSafe(F.col("__block")), "left").where(F.col("__r") <= cap - F.coalesce("__used", F.lit(0)))
            reason = F.lit("fill" if name is None else "environment").alias("reason")
            taken = checkpointed(taken.unionByName(fits.orderBy(*order).limit(room).select("tile", "block", "environment", reason)))
    count = taken.count()
    if count != n:
        raise ValueError(f"{count} tiles instead of {n}: change the cap or the number")
    return stats.join(taken.select(F.col("tile").alias(tile), "reason"), tile)


def epoch_plan(tiles: DataFrame, weights: DataFrame, loop: int, ranks: int, seed: int, tile: str = "tile", weight: str = "weight", plain: bool = False) -> DataFrame:
    """``(slot, tile, rank)``: every tile once, then ``(loop - 1) * N`` slots drawn by weight with replacement (``plain``: all slots are
    drawn), shuffled by hash, padded to a multiple of ``ranks`` and dealt round robin. A tile of weight 0 is never drawn.

    Draws are hashed uniforms found in the cumulative weights: a range join, made equal by cells of the cumulative share, as many as tiles. Cumulative
    weights and slots are summed and numbered range by range.
    """
    every = checkpointed(tiles.select(tile).distinct().join(weights.select(tile, F.col(weight).alias("w")), tile, "left").withColumn("w", F.coalesce("w", F.lit(0.0))))
    size = every.agg(F.count("*").alias("n"), F.sum("w").alias("w")).first()
    cells, total = max(1024, size["n"]), size["w"] or 0.0
    cell = lambda share: F.floor(share * cells)
    shares = in_order(every.where("w > 0"), [tile], F.col("w")).select(tile, ((F.col("upto") - F.col("w")) / F.lit(float(total))).alias("lo"), (F.col("upto") / F.lit(float(total))).alias("hi"))
    shares = shares.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    slots = tiles.sparkSession.range(max(0, size["n"] * (loop if plain else loop - 1)) if total else 0).select(F.col("id").alias("s"))
    drawn = slots.withColumn("u", unit_hash(seed, "s")).withColumn("cell", cell(F.col("u"))).join(shares, "cell").where("u >= lo AND u < hi").select(tile, F.concat(F.lit("d"), F.col("s").cast("string")).alias("k"))
    plan = drawn if plain else drawn.unionByName(every.select(tile, F.concat(F.lit("e"), F.col(tile).cast("string")).alias("k")))
    placed = checkpointed(in_order(plan.withColumn("o", unit_hash(f"{seed}/order", "k")), ["o", "k"], F.lit(1)).select(F.col("place").alias("slot"), tile))
    count = placed.count()
    padding = placed.where(F.col("slot") < -count % ranks).withColumn("slot", F.col("slot") + count)
    return placed.unionByName(padding).select("slot", tile, (F.col("slot") % ranks).alias("rank"))


#: Tiles that a task walks through when quotas are set.
WALK = 50_000


def _walk(caps: np.ndarray, k: int, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is left after tiles of the given caps, of which the first has ``k - 1`` tiles after it, for each of several ``left`` to begin with; and the quotas of the first."""
    left, quotas = left.copy(), np.zeros(len(caps), np.int64)
    for i, c in enumerate(caps.tolist()):
        take = np.minimum(left // (k - i), c)
        quotas[i] = take[0]
        left -= take
    return left, quotas


def tile_quotas(counts: DataFrame, most: int, by: str = "tile", cap: str = "cap") -> DataFrame:
    """``counts`` with ``quota``: tiles in order get an even share of what is left of ``most`` (rounded down), at most their ``cap``; what a tile cannot use goes to
    those after it. No number of tiles is too large.

    Tiles are numbered and walked in runs of ``WALK``. What a run leaves depends on what it is given, but never falls when that grows, nor grows by
    more than it: so each run tells what it leaves for a guess, for all numbers near it and for some far from it, and the driver chains the runs (one row each).
    Where the chain meets a told number, or lies between two that leave no doubt, it is exact; elsewhere it is the next guess. The first
    run that was guessed becomes exact every time, so this ends; guesses close in on the truth much sooner.
    """
    spark = counts.sparkSession
    rows = checkpointed(in_order(counts, [by], F.lit(1)).drop("upto").withColumn("__run", F.floor(F.col("place") / WALK)))
    n = rows.count()
    runs = -(-n // WALK)
    near = sorted({0, *(s * v for s in (-1, 1) for v in (*range(1, 33), *(2**j for j in range(6, 62))))})
    given_to = lambda table: rows.join(F.broadcast(spark.createDataFrame(table, "__run long, __given long")), "__run").groupBy("__run")

    def told(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        given = np.array(sorted({min(max(int(frame["__given"].iloc[0]) + v, 0), most) for v in near}), np.int64)
        left, _ = _walk(frame[cap].to_numpy(np.int64), n - int(frame.place.iloc[0]), given)
        return pd.DataFrame({"run": [int(frame["__run"].iloc[0])], "given": [given], "left": [left]})

    def quotas(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        _, quota = _walk(frame[cap].to_numpy(np.int64), n - int(frame.place.iloc[0]), frame["__given"].to_numpy(np.int64)[:1])
        return pd.DataFrame({"place": frame.place, "quota": quota})

    start, exact = [most - most * r // max(runs, 1) for r in range(runs)], 1
    while exact < runs:
        asked = range(exact - 1, runs)
        known = {r["run"]: (r["given"], r["left"]) for r in given_to([(r, start[r]) for r in asked]).applyInPandas(told, "run long, given array<long>, left array<long>").collect()}
        sure = True
        for r in asked[:-1]:
            given, left = known[r]
            i = bisect.bisect_left(given, start[r])
            if given[i] == start[r]:
                start[r + 1] = left[i]
            else:
                rise, step = left[i] - left[i - 1], given[i] - given[i - 1]
                sure = sure and rise in (0, step)
                start[r + 1] = left[i - 1] + rise * (start[r] - given[i - 1]) // step
            exact = r + 2 if sure else exact
    return rows.join(given_to(list(enumerate(start))).applyInPandas(quotas, "place long, quota long"), "place").drop("place", "__run")


def budget_sample(df: DataFrame, most: int, ratio: float, seed: int, by: str = "tile", keys: Sequence[str] = ("tile", "point_id")) -> DataFrame:
    """At most ``most`` rows: tiles in order get an even share of what is left, at most ``ratio`` of their own rows (``tile_quotas``); of a tile the rows
    that come first in a hashed order. Rows are counted by buckets of the hash; only those of the bucket in which the quota ends are ranked."""
    rows = df.withColumn("__b", F.floor(unit_hash(seed, *keys) * 1024).cast("int"))
    counts = checkpointed(rows.groupBy(by, "__b").agg(F.count("*").alias("__c")))
    totals = counts.groupBy(by).agg(F.sum("__c").alias("n"))
    table = tile_quotas(totals.select(by, F.least(F.col("n"), F.floor(F.col("n") * F.lit(float(ratio)))).alias("cap")), most, by).select(by, "quota")
    upto = F.sum("__c").over(Window.partitionBy(by).orderBy("__b"))
    ends = counts.withColumn("__upto", upto).join(table, by).where((F.col("__upto") >= F.col("quota")) & (F.col("__upto") - F.col("__c") < F.col("quota")))
    found = look_up(rows, checkpointed(ends.select(by, F.col("__b").alias("__end"), (F.col("quota") - F.col("__upto") + F.col("__c")).alias("__q"))), [by])
    border = found.where("__b = __end").withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(unit_hash(seed, *keys), *keys))).where("__r <= __q")
    return found.where("__b < __end").select(*df.columns).unionByName(border.select(*df.columns))


def degrade_labels(
    pts: DataFrame, seed: int, core: Sequence[int] = (0, 1, 2), rare: Sequence[int] = (3, 4), other: int = 5, flat: float = 0.75, steep_drop: float = 0.4, rare_drop: float = 0.4, radius: float = 2.0, boundary_drop: float = 0.15, by: str = "tile", id_col: str = "point_id", col: str = "classification"
) -> DataFrame:
    """Labels lost as in production, by hashed coins: points of the ``core`` classes on steep ground (``|nz| < flat``) and of ``rare`` classes turn to
    ``other``; then, among the points that still have a class, those with several classes within ``radius``. ``pts`` has nz."""
    coin = lambda name: unit_hash(f"{seed}/{name}", by, id_col)
    steep = F.col(col).isin(list(core)) & (F.abs(F.col("nz")) < flat) & (coin("steep") < steep_drop)
    lost = steep | (F.col(col).isin(list(rare)) & (coin("rare") < rare_drop))
    after = pts.withColumn("__l", F.when(lost, other).otherwise(F.col(col)))
    kept = after.where(F.col("__l") != other).select(by, id_col, "x", "y", "z", "__l")
    near = radius_edges(kept, kept, radius, by, id_col).join(kept.select(by, F.col(id_col).alias("dst"), "__l"), [by, "dst"])
    edge = near.groupBy(by, F.col("src").alias(id_col)).agg((F.min("__l") != F.max("__l")).alias("__edge")).where("__edge")
    eaten = F.col("__edge").isNotNull() & (coin("edge") < boundary_drop)
    return after.join(edge, [by, id_col], "left").withColumn(col, F.when(eaten, other).otherwise(F.col("__l"))).drop("__edge", "__l")


def terrain_split(
    pts: DataFrame, seed: int, random: float = 0.1, feature: float = 0.1, blocks: int = 5, block_size: tuple[float, float] = (2.0, 15.0), resolution: float = 2.0, most: float = 0.9, query_max: int | None = None, ground: int | None = None, extreme: float = 0.3, low: float | None = None, col: str = "classification", by: str = "tile", id_col: str = "point_id"
) -> DataFrame:
    """``role`` 'query' or 'support' of every point, per tile. A point is a query if it lies in the large hole (half to 0.8 of the extents, with probability
    ``extreme``), in one of 0 to ``blocks`` rectangles round drawn points, in the share ``feature`` drawn without replacement by ``terrain_weights`` (smallest
    ``-ln(u) / weight``), or in the ``random`` share.

    With ``ground`` only that class can be a query. Of more than ``most`` of the points (or ``query_max``) a hashed part stays; a tile
    without a query gets one (of ``ground`` if it has any), one without support gives one back. Tiles of fewer than ten points are all support.

    ``low`` adds ``gt_low``: for queries the smooth part of the whole tile's terrain (``low_frequency`` at that cell size), else null.
    """
    u = lambda name, *more: unit_hash(f"{seed}/{name}", by, *more)
    side = lambda c, i: F.lit(block_size[0]) + (block_size[1] - block_size[0]) * u(f"{c}/{i}")
    sides = F.array(*(F.struct((side("x", i) / 2).alias("w"), (side("y", i) / 2).alias("h")) for i in range(blocks)))
    drawn = {"__number": F.floor(u("blocks") * (blocks + 1)).cast("int"), "__sides": sides, "__large": u("extreme") < extreme, "__share": 0.5 + 0.3 * u("share"), "__ux": u("large/x"), "__uy": u("large/y")}
    tiles = pts.groupBy(by).agg(F.count("*").alias("__n")).select(by, "__n", *(e.alias(n) for n, e in drawn.items()))
    # A point's hashes and keys are columns before any sort: a sort would compute an expression anew at every comparison.
    hashes = {**{f"__u{i}": u(f"block{i}", id_col) for i in range(blocks)}, **{f"__u{n}": u(n, id_col) for n in ("feature", "random", "keep")}}
    rows = weighed(pts, resolution, by, "left").withColumnRenamed("weight", "__w").withColumns(hashes).join(tiles, by)
    whole = Window.partitionBy(by)
    ends = {f"__{n}{c}": f(c).over(whole) for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))}
    rows = rows.withColumns(ends | {f"__at{i}": F.min_by(F.struct("x", "y"), F.struct(f"__u{i}", id_col)).over(whole) for i in range(blocks)})
    within = lambda x, y, w, h: (F.abs(F.col("x") - x) <= w) & (F.abs(F.col("y") - y) <= h)
    extent = {c: F.greatest((F.col(f"__hi{c}") - F.col(f"__lo{c}")) * F.col("__share"), F.lit(1.0)) for c in "xy"}
    middle = {c: F.col(f"__lo{c}") + (F.col(f"__hi{c}") - F.col(f"__lo{c}")) * F.col(f"__u{c}") for c in "xy"}
    inside = F.col("__large") & within(middle["x"], middle["y"], extent["x"] / 2, extent["y"] / 2)
    for i in range(blocks):
        at, wide = F.col(f"__at{i}"), F.col("__sides")[i]
        inside = inside | ((F.col("__number") > i) & within(at["x"], at["y"], wide["w"], wide["h"]))
    key = -F.log(F.greatest(F.col("__ufeature"), F.lit(1e-12))) / F.greatest(F.coalesce("__w", F.lit(0.0)), F.lit(1e-300))
    may = F.lit(True) if ground is None else F.coalesce(F.col(col) == ground, F.lit(False))
    rows = rows.select(*pts.columns, "__n", key.alias("__key"), "__urandom", "__ukeep", F.coalesce(inside, F.lit(False)).alias("__in"), may.alias("__may"))
    place = lambda *keys: F.row_number().over(Window.partitionBy(by).orderBy(*keys, id_col))
    rows = rows.withColumn("__f", place("__key")).withColumn("__r", place("__urandom"))
    share = lambda s: F.floor(F.col("__n") * F.lit(float(s)))
    rows = rows.withColumn("__q", F.col("__may") & (F.col("__in") | (F.col("__f") <= share(feature)) | (F.col("__r") <= share(random))))
    bound = F.greatest(F.lit(1), share(most)) if query_max is None else F.least(F.greatest(F.lit(1), share(most)), F.lit(query_max))
    # Chosen points first, then what may stand in; a tile's first place is a query in any case, as long as support is left.
    rows = rows.withColumn("__k", place(F.desc("__q"), F.desc("__may"), "__ukeep"))
    query = ((F.col("__q") & (F.col("__k") <= bound)) | (F.col("__k") == 1)) & (F.col("__n") >= 10) & (F.col("__k") < F.col("__n"))
    out = rows.select(by, id_col, *(c for c in pts.columns if c not in (by, id_col)), F.when(query, "query").otherwise("support").alias("role"))
    if low is None:
        return out
    target = low_frequency(pts, low, by=by, id_col=id_col).withColumnRenamed("z_low", "gt_low")
    return out.join(target, [by, id_col], "left").withColumn("gt_low", F.when(F.col("role") == "query", F.col("gt_low")))
