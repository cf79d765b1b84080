"""The tile store: files of like size, and scans that read only the files they need."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.sources import sinks


def scans(node):
    """The file scans of an executed plan, inside its stages, too."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return scans(node.executedPlan())
    if node.nodeName().endswith("QueryStage"):
        return scans(node.plan())
    below = [s for i in range(node.children().size()) for s in scans(node.children().apply(i))]
    return below + [node] if node.metrics().contains("numFiles") else below


def files_read(df):
    """The files that the scan of the points opened, from the plan's own metrics."""
    df.collect()
    return max(int(s.metrics().apply("numFiles").value()) for s in scans(df._jdf.queryExecution().executedPlan()) if "dynamicpruning" in s.toString())


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Two sources, the second with two thirds of all points, many of these at one place; 400 tiles; a point without a place."""
    rng = np.random.default_rng(4)
    xy = np.r_[rng.uniform(-500, 500, (16_000, 2)), np.full((8000, 2), 3.25)]
    rows = [(int(i % 3 > 0), int(x // 50 * 20 + y // 50), i, i, float(x), float(y), 0.5, f"n{i}") for i, (x, y) in enumerate(xy)] + [(1, 0, 99_999, 99_999, None, None, None, None)]
    pts = spark.createDataFrame(rows, "source int, tile_no int, point_id long, orig_idx long, x double, y double, z double, note string")
    path = f"{tmp_path_factory.mktemp('store')}/s"
    sinks.write_tiles(pts, path, rows=1000)
    return pts.cache(), path


def test_round_trip_and_even_files(spark, store):
    pts, path = store
    back = sinks.read_tiles(spark, path)
    assert back.columns == pts.columns and back.exceptAll(pts).isEmpty() and pts.exceptAll(back).isEmpty()
    sizes = [r["count"] for r in spark.read.parquet(f"{path}/points").groupBy("file_range").count().collect()]
    assert len(sizes) == 25 and max(sizes) < 2000
    tiles = spark.read.parquet(f"{path}/tiles")
    want = pts.groupBy("source", "tile_no").agg(F.min("x").alias("min_x"), F.max("y").alias("max_y"), F.count("*").alias("n"))
    assert tiles.select(want.columns).exceptAll(want).isEmpty() and tiles.count() == want.count()
    assert {r.source: r.source_point_count for r in tiles.select("source", "source_point_count").distinct().collect()} == {r.source: r["count"] for r in pts.groupBy("source").count().collect()}


def test_a_box_reads_only_its_files(spark, store):
    pts, path = store
    box = (-480.0, -470.0, -400.0, -410.0)
    got = sinks.read_tiles(spark, path, box)
    want = pts.where("x BETWEEN -480 AND -400 AND y BETWEEN -470 AND -410")
    assert got.exceptAll(want).isEmpty() and got.count() == want.count() > 0
    ranges = spark.read.parquet(f"{path}/ranges").where("max_x >= -480 AND min_x <= -400 AND max_y >= -470 AND min_y <= -410").select("file_range").distinct().count()
    assert files_read(sinks.read_tiles(spark, path, box)) == ranges < 8


def test_tiles_read_only_their_files(spark, store):
    pts, path = store
    some = pts.where("source = 0").select("source", "tile_no").distinct().orderBy("tile_no").limit(2)
    got, want = sinks.read_tiles(spark, path, tiles=some), pts.join(some, ["source", "tile_no"], "left_semi")
    assert got.exceptAll(want.select(got.columns)).isEmpty() and got.count() == want.count() > 0
    assert files_read(sinks.read_tiles(spark, path, tiles=some)) < 8


def test_empty_table_and_a_clashing_name(spark, tmp_path):
    none = spark.createDataFrame([], "source int, tile_no int, orig_idx long, x double, y double")
    sinks.write_tiles(none, f"{tmp_path}/e")
    assert spark.read.parquet(f"{tmp_path}/e/tiles").count() == 0
    with pytest.raises(ValueError, match="file_range"):
        sinks.write_tiles(none.withColumn("file_range", F.lit(1)), f"{tmp_path}/f")
