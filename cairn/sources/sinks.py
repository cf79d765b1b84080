"""Sinks: tiles, predictions, submissions, label budgets, cached statistics, coloured clouds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.scalar import map_values, zorder
from cairn.operators import grid, sampling
from cairn.operators.neighbors import checkpointed


def write_tiles(pts: DataFrame, path: str, source: str = "source", tile: str = "tile_no", rows: int = 4_000_000, cell: float = 1.0) -> None:
    """Points (``orig_idx`` and all extra columns kept) and tables of the ``tiles`` (core boxes, counts, source counts) and ``ranges``.

    Files follow rows, not tiles: points are dealt by ranges of source and place along a space-filling curve over cells, about ``rows`` to a range, and a range
    is a folder with one file, sorted along the curve, so that its row groups have narrow boxes. Points of one cell may be split. ``ranges`` has a row
    per range and tile with its box and count: what ``read_tiles`` looks up. Points without a place are stored, too.
    """
    if "file_range" in pts.columns:
        raise ValueError("a column is named file_range")
    spark = pts.sparkSession
    at = lambda c: F.floor(F.col(c) / F.lit(float(cell))).cast("long")
    coded = pts.withColumn("__code", F.coalesce(zorder(at("x"), at("y"), F.lit(0)), F.lit(-1).cast("long"))).withColumn("__salt", F.xxhash64("orig_idx"))
    dealt = coded.repartitionByRange(max(1, -(-pts.count() // rows)), source, "__code", "__salt").withColumn("file_range", F.spark_partition_id())
    dealt.sortWithinPartitions("file_range", source, "__code").drop("__code", "__salt").write.mode("overwrite").partitionBy("file_range").parquet(f"{path}/points")
    # With no rows at all nothing is written, not even a schema.
    stored = spark.read.schema(f"{pts._jdf.schema().toDDL()}, file_range INT").parquet(f"{path}/points")
    grid.core_boxes(stored, ["file_range", source, tile]).write.mode("overwrite").parquet(f"{path}/ranges")
    box = [f(c).alias(c) for c, f in (("min_x", F.min), ("max_x", F.max), ("min_y", F.min), ("max_y", F.max), ("n", F.sum))]
    totals = stored.groupBy(source).agg(F.count_distinct("orig_idx").alias("source_point_count"))
    spark.read.parquet(f"{path}/ranges").groupBy(source, tile).agg(*box).join(totals, source).write.mode("overwrite").parquet(f"{path}/tiles")


def read_tiles(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, tiles: DataFrame | None = None, source: str = "source", tile: str = "tile_no") -> DataFrame:
    """Points of a store, all or those in ``box`` (least x and y, greatest x and y, borders included) and of ``tiles`` (source and tile).

    The ranges that can hold such points are looked up in the catalogue and prune the folders when the query runs; only their files are read. Within a file the
    box goes down to the row groups.
    """
    points, ranges = spark.read.parquet(f"{path}/points"), spark.read.parquet(f"{path}/ranges")
    if box is not None:
        x0, y0, x1, y1 = (F.lit(float(v)) for v in box)
        ranges = ranges.where((F.col("max_x") >= x0) & (F.col("min_x") <= x1) & (F.col("max_y") >= y0) & (F.col("min_y") <= y1))
        points = points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    if tiles is not None:
        ranges = checkpointed(ranges.join(tiles.select(source, tile), [source, tile], "left_semi").select("file_range").distinct())
        points = points.join(tiles.select(source, tile), [source, tile], "left_semi")
    if box is not None or tiles is not None:
        # A number per range of millions of points. The optimizer prunes folders only by a side that has a filter of its own.
        wanted = ranges.where("file_range >= 0").select("file_range").distinct()
        points = points.join(F.broadcast(wanted), "file_range", "left_semi")
    return points.drop("file_range")


def join_predictions(pts: DataFrame, preds: DataFrame, keys: Sequence[str] = ("tile", "point_id"), cols: dict[str, str] | None = None) -> DataFrame:
    """Points with their predictions (any columns: classes, instances, regression dimensions, superpoint levels); a point without exactly
    one prediction fails the job when it is written."""
    cols = cols or {c: c for c in preds.columns if c not in keys}
    per = preds.groupBy(*keys).agg(F.count("*").alias("__n"), *(F.first(c).alias(f"__{c}") for c in cols))
    joined = pts.join(per, list(keys), "left")
    bad = F.coalesce("__n", F.lit(0)) != 1
    guard = F.when(bad, F.raise_error(F.lit("a point has no prediction or several")).cast("int")).otherwise(F.lit(0))
    out = joined.withColumn("__ok", guard).where("__ok = 0")
    return out.select(*pts.columns, *(F.col(f"__{c}").alias(name) for c, name in cols.items()))


def write_predictions(pts: DataFrame, preds: DataFrame, path: str, **options) -> None:
    join_predictions(pts, preds, **options).write.mode("overwrite").parquet(path)


def submission_labels(preds: DataFrame, inverse: dict[int, int] | None = None, shift: int = 0, col: str = "pred") -> DataFrame:
    """Labels in the submission's numbering: inverse map, or a shift."""
    value: Column = map_values(col, inverse) if inverse else F.col(col) + F.lit(shift)
    return preds.withColumn("label", value.cast("int"))


def export_submission(preds: DataFrame, path: str, name: str = "tile", order: str = "point_id", style: str = "lines", **options) -> None:
    """Text per cloud in point order: one label per line, or ``top3`` class ids as CSV (column ``top3 array<int>``)."""
    rows = submission_labels(preds, **options) if style == "lines" else preds
    line = F.col("label").cast("string") if style == "lines" else F.array_join(F.col("top3").cast("array<string>"), ",")
    rows.withColumn("value", line).repartition(name).sortWithinPartitions(name, order).select(name, "value").write.mode("overwrite").partitionBy(name).text(path)


def label_budget(pts: DataFrame, fractions: Sequence[float], seed: int, keys: Sequence[str] = ("tile", "point_id"), tile: str = "tile") -> tuple[DataFrame, DataFrame]:
    """Ranks below the greatest fraction only, and counts per tile."""
    ranked = sampling.nested_rank(pts.select(*keys, "classification"), seed, keys)
    kept = ranked.where(F.col("rank") < max(fractions))
    return kept, sampling.budget_counts(ranked, fractions, [tile])


def write_label_budget(pts: DataFrame, fractions: Sequence[float], seed: int, path: str, **options) -> None:
    kept, counts = label_budget(pts, fractions, seed, **options)
    kept.write.mode("overwrite").parquet(f"{path}/ranks")
    counts.write.mode("overwrite").parquet(f"{path}/counts")


def apply_label_budget(pts: DataFrame, path: str, fraction: float, keys: Sequence[str] = ("tile", "point_id"), tile: str = "tile", hidden: int = -1, check: bool = True) -> DataFrame:
    """All points, with labels outside the budget hidden; fails if a tile's size is not the one that the budget was written for."""
    spark = pts.sparkSession
    if check:
        sizes = spark.read.parquet(f"{path}/counts").select(tile, F.col("n").alias("__want"))
        changed = pts.groupBy(tile).agg(F.count("*").alias("__n")).join(sizes, tile, "left").where("__want IS NULL OR __n <> __want")
        if not changed.isEmpty():
            raise ValueError(f"tiles differ in size from the budget: {[r[0] for r in changed.limit(5).collect()]}")
    ids = spark.read.parquet(f"{path}/ranks").where(F.col("rank") < fraction).select(*keys).withColumn("__k", F.lit(True))
    return pts.join(ids, list(keys), "left").withColumn("classification", F.when(F.col("__k"), F.col("classification")).otherwise(hidden)).drop("__k")


def cached(table: DataFrame, path: str) -> DataFrame:
    """Read a statistics table if it was written before, else compute and write it."""
    spark = table.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        table.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_colored(pts: DataFrame, colors: DataFrame, path: str, keys: Sequence[str] = ("tile", "point_id")) -> None:
    """Points with the colour columns of a product (PCA or clusters) added."""
    pts.join(colors, list(keys), "left").write.mode("overwrite").parquet(path)
