"""Ingest round trips, sinks, registry, streams against batches."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn.operators import labels
from cairn.plans import catalog
from cairn.plans.registry import SOURCES, TRANSFORMS, WRITERS, Registry, pipeline
from cairn.sources import ingest, sinks
from cairn.streaming import streams


def las_bytes(xyz, fmt=1):
    head = bytearray(227)
    head[:4] = b"LASF"
    size = 28
    for name, value in {"major": 1, "minor": 2, "header_size": 227, "data_offset": 227, "point_format": fmt, "record_length": size, "legacy_count": len(xyz), "sx": 0.01, "sy": 0.01, "sz": 0.01, "ox": 1000.0, "oy": 0.0, "oz": 0.0}.items():
        code, at = ingest.LAS_HEADER[name]
        struct.pack_into(f"<{code}", head, at, value)
    rows = b"".join(struct.pack("<iiiHBBbBHd", int(x), int(y), int(z), 7, 1 | (2 << 3), 5, 0, 0, 0, 0.0) for x, y, z in xyz)
    return bytes(head) + rows


def test_las_ingest(spark, tmp_path):
    xyz = np.arange(300).reshape(100, 3)
    (tmp_path / "a.las").write_bytes(las_bytes(xyz))
    got = ingest.ingest_las(spark, f"{tmp_path}/*.las", rows=33).toPandas().sort_values("point_id")
    assert got.point_id.tolist() == list(range(100))
    assert np.allclose(got[["x", "y", "z"]], xyz * 0.01 + [1000, 0, 0])
    assert set(got.classification) == {5} and set(got.number_of_returns) == {2} and got.r.isna().all()


def test_npy_ingest(spark, tmp_path):
    for s in ("s1", "s2"):
        (tmp_path / s).mkdir()
        np.save(tmp_path / s / "coord.npy", np.ones((4, 3)))
    np.save(tmp_path / "s1" / "segment.npy", np.arange(4))
    got = ingest.ingest_npy(spark, str(tmp_path), {"coord": 3, "segment": 1}).toPandas()
    assert got[got.scene == "s2"].segment.tolist() == [-1] * 4 and sorted(got[got.scene == "s1"].segment) == [0, 1, 2, 3]


def test_sweeps(spark, tmp_path):
    np.arange(12, dtype="<f4").tofile(tmp_path / "000001.bin")
    np.array([(3 << 16) | 40] * 3, dtype="<u4").tofile(tmp_path / "000001.label")
    got = ingest.ingest_sweeps(spark, f"{tmp_path}/*.bin", labels=f"{tmp_path}/*.label").toPandas()
    assert set(got.label) == {40} and set(got.instance) == {3} and sorted(got.strength) == [3, 7, 11]


def sidecar(path, index):
    tensors = {"features": np.ones((2, 3), "<f4"), "pixel_coord": np.zeros((4, 2), "<i4"), "patch_index": np.array(index, "<i4"), "valid": np.array([1, 1, 0, 1], bool)}
    header, data = {}, b""
    names = {"<f4": "F32", "<i4": "I32", "|b1": "BOOL"}
    for k, v in tensors.items():
        header[k] = {"dtype": names[v.dtype.str], "shape": list(v.shape), "data_offsets": [len(data), len(data) + v.nbytes]}
        data += v.tobytes()
    raw = json.dumps(header).encode()
    path.write_bytes(struct.pack("<Q", len(raw)) + raw + data)


def test_sidecar(spark, tmp_path):
    sidecar(tmp_path / "t.bin", [0, 1, -1, 1])
    patches, corr = ingest.ingest_sidecar(spark, f"{tmp_path}/*.bin")
    assert patches.count() == 2 and corr.where("valid").count() == 3
    sidecar(tmp_path / "t.bin", [0, 5, -1, 1])
    with pytest.raises(Exception, match="out of range"):
        ingest.ingest_sidecar(spark, f"{tmp_path}/*.bin")[1].collect()


def test_text_json_logs_manifest(spark, tmp_path):
    (tmp_path / "chair_1.txt").write_text("1 2 3 4 5 6\n")
    (tmp_path / "desk_2.txt").write_text("1 2 3 4 5 6\n")
    got = ingest.read_xyz_text(spark, f"{tmp_path}/*.txt").toPandas().sort_values("object_id")
    assert got.class_name.tolist() == ["chair", "desk"] and got.object_id.tolist() == [0, 1]
    (tmp_path / "s.json").write_text(json.dumps({"sceneId": "s", "segIndices": [4, 4, 9], "segGroups": [{"objectId": 1, "label": "x", "segments": [4]}]}))
    seg = ingest.read_segments(spark, f"{tmp_path}/s.json").withColumnRenamed("scene", "mesh")
    groups = ingest.read_groups(spark, f"{tmp_path}/s.json").withColumnRenamed("scene", "mesh").withColumn("label", F.lit(7))
    assert labels.assign_groups(seg, groups).where("label = 7").count() == 2
    (tmp_path / "run.log").write_text("epoch 1 mIoU: 0.5 loss=1e-2\nerror\nmIoU: 0.75\n")
    rows = ingest.parse_logs(spark, f"{tmp_path}/*.log").toPandas()
    assert rows[rows.name == "mIoU"].value.tolist() == [0.5, 0.75] and rows[rows.name == "loss"].value.tolist() == [0.01]
    pd.DataFrame({"a": [1], "b": ["x"]}).to_csv(tmp_path / "m.csv", index=False)
    assert ingest.read_manifest(spark, f"{tmp_path}/m.csv").first().b == "x"
    files, report = ingest.inventory(spark, {"r": str(tmp_path)})
    assert files.count() == 5 and report.where("complete").count() == 5


def test_validate_counts_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "v double")
    assert ingest.validate(df, {"finite": ingest.finite("v")}).first().violations == 2
    with pytest.raises(ValueError):
        ingest.validate(df, {}, ["absent"])


def test_tiles_predictions_and_submission(spark, tmp_path):
    pts = spark.createDataFrame([("s", i % 2, i, i, float(i), 0.0, 0.0) for i in range(10)], "source string, tile_no int, point_id long, orig_idx long, x double, y double, z double")
    sinks.write_tiles(pts, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t/points").count() == 10
    assert spark.read.parquet(f"{tmp_path}/t/tiles").agg(F.sum("n")).first()[0] == 10
    preds = pts.select(F.col("tile_no").alias("tile"), "point_id", F.lit(3).alias("pred"))
    points = pts.withColumnRenamed("tile_no", "tile")
    sinks.write_predictions(points, preds, f"{tmp_path}/p")
    with pytest.raises(Exception, match="no prediction"):
        sinks.join_predictions(points, preds.where("point_id > 0")).collect()
    sinks.export_submission(preds, f"{tmp_path}/sub", shift=1)
    lines = [x for p in (tmp_path / "sub").glob("tile=0/*.txt") for x in p.read_text().split()]
    assert lines == ["4"] * 5
    stats = points.groupBy("tile").count()
    assert sinks.cached(stats, f"{tmp_path}/c").count() == sinks.cached(stats.where("false"), f"{tmp_path}/c").count() == 2


def test_registry_and_pipeline(spark):
    catalog.register_all()
    assert {"las", "npy", "sweeps"} <= set(SOURCES.items) and {"tiles", "predictions"} <= set(WRITERS.items)
    df = spark.createDataFrame([(1,), (2,), (3,)], "classification int")
    out = pipeline(df, [{"type": "filter_classes", "keep": [1, 2]}, {"type": "remap", "mapping": {1: 9}}])
    assert sorted(r[0] for r in out.collect()) == [2, 9]
    with pytest.raises(ValueError):
        Registry("x").build("absent")


def test_early_stop_rule():
    def run(values, **options):
        rule, state = streams.EarlyStop(**options), (None, 0, 0)
        for v in values:
            state = rule.step(state, v)
        return state, rule.stopped(state)

    assert run([100, 99.95, 99.8, 99.75, 99.76, 100.0]) == ((99.8, 3, 6), True)
    assert run([0.5, 0.5004], mode="max")[0] == (0.5, 1, 2)
    assert run([0.5, 0.5004, 0.501], mode="max")[0] == (0.501, 0, 3)
    assert run([1.0, float("nan"), None], warmup=2)[0] == (1.0, 1, 3)


def finish(query):
    query.processAllAvailable()
    query.stop()


def test_ingest_resumes(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    spark.range(5).withColumn("v", F.lit(1)).coalesce(1).write.parquet(src)
    for more in (False, True):
        if more:
            spark.range(5, 8).withColumn("v", F.lit(1)).coalesce(1).write.mode("append").parquet(src)
        streams.ingest_tiles(spark, src, "id long, v int", out, ck).awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(8))
    assert spark.read.parquet(out).select("batch").distinct().count() == 2


def test_streams_equal_batches(spark, tmp_path):
    src = str(tmp_path / "events")
    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3).cast("int").alias("target"), (F.col("id") % 4).cast("int").alias("pred"), (F.col("id") % 50).alias("pid"))
    rows.coalesce(1).write.parquet(src)
    batch = spark.read.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    finish(streams.running_confusion(stream).writeStream.outputMode("complete").format("memory").queryName("conf").option("checkpointLocation", str(tmp_path / "c1")).start())
    assert {tuple(r) for r in spark.table("conf").collect()} == {tuple(r) for r in streams.running_confusion(batch).collect()}
    assert streams.confusion_metrics(spark.table("conf"), 4).count() == 1
    finish(streams.windowed_metrics(stream, "ts", ["target"], "pred", "1 hour").writeStream.outputMode("update").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "c2")).start())
    assert {tuple(r) for r in spark.table("win").collect()} == {tuple(r) for r in streams.windowed_metrics(batch, "ts", ["target"], "pred", "1 hour").collect()}
    finish(streams.dedup_points(stream, ["pid"], "ts", "10 days").writeStream.format("memory").queryName("dd").option("checkpointLocation", str(tmp_path / "c3")).start())
    assert spark.table("dd").count() == streams.dedup_points(batch, ["pid"], "ts").count() == 50


def test_frame_fusion_stream(spark, tmp_path):
    src = str(tmp_path / "frames")
    spark.range(20).select((F.col("id") % 2).alias("seq"), F.floor(F.col("id") / 2).alias("frame_no"), F.timestamp_seconds(F.col("id") + 1000).alias("ts")).coalesce(1).write.parquet(src)
    batch = spark.read.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    finish(streams.fuse_stream(stream, 1).writeStream.format("memory").queryName("fused").option("checkpointLocation", str(tmp_path / "c")).start())
    assert {tuple(r) for r in spark.table("fused").collect()} == {tuple(r) for r in streams.fuse_stream(batch, 1).collect()}


def test_early_stop_stream(spark, tmp_path):
    src = str(tmp_path / "m")
    values = [100, 99.95, 99.8, 99.75, 99.76, 100.0]
    schema = "run string, iter long, value double"
    spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], schema).coalesce(1).write.parquet(src)
    batch = spark.read.parquet(src)
    want = {tuple(r) for r in streams.early_stop_batch(batch, streams.EarlyStop()).collect()}
    assert sum(r[-1] for r in want) == 1
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(batch.schema).parquet(src)
    finish(streams.early_stop_stream(stream, streams.EarlyStop()).writeStream.format("memory").queryName("stop").option("checkpointLocation", str(tmp_path / "c")).start())
    assert {tuple(r) for r in spark.table("stop").collect()} == want
