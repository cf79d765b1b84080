"""Frames of a sequence: fusion, poses, sweep history, bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sequence_bounds(frames: DataFrame, seq: str = "seq", order: str = "frame_no") -> DataFrame:
    """Adds the frame's index in its sequence and the sequence's first and last frame."""
    per = Window.partitionBy(seq)
    return frames.withColumn("index", F.row_number().over(per.orderBy(order)) - 1).withColumn("first", F.min(order).over(per)).withColumn("last", F.max(order).over(per))


def fuse_frames(frames: DataFrame, offsets: list[int], seq: str = "seq", order: str = "frame_no") -> DataFrame:
    """``(seq, target, frame_no, offset)``: for each frame the frames at the given offsets that its sequence has (0 is itself)."""
    want = frames.select(seq, F.col(order).alias("target"), F.explode(F.array(*map(F.lit, offsets))).alias("offset")).withColumn(order, F.col("target") + F.col("offset"))
    return want.join(frames.select(seq, order), [seq, order])


def fuse_points(frames: DataFrame, pts: DataFrame, offsets: list[int], label: str = "classification", hidden: int = -1, seq: str = "seq", order: str = "frame_no") -> DataFrame:
    """Points of all fused frames per target frame, moved to the target's pose; labels of other frames than the target are hidden."""
    pairs = align_poses(fuse_frames(frames, offsets, seq, order), frames, seq, order)
    moved = pts.join(pairs, [seq, order])
    m = lambda i: F.col("matrix")[4 * i] * F.col("x") + F.col("matrix")[4 * i + 1] * F.col("y") + F.col("matrix")[4 * i + 2] * F.col("z") + F.col("matrix")[4 * i + 3]
    out = moved.select("*", m(0).alias("__x"), m(1).alias("__y"), m(2).alias("__z"))
    return out.withColumns({"x": F.col("__x"), "y": F.col("__y"), "z": F.col("__z"), label: F.when(F.col("offset") == 0, F.col(label)).otherwise(hidden)}).drop("__x", "__y", "__z", "matrix")


def align_poses(pairs: DataFrame, frames: DataFrame, seq: str = "seq", order: str = "frame_no") -> DataFrame:
    """Adds ``matrix``: ``inverse(target pose) @ pose`` row by row, once per pair of frames (not per point)."""

    @F.pandas_udf("array<double>")
    def relative(target: pd.Series, own: pd.Series) -> pd.Series:
        if not len(target):
            return pd.Series([], dtype=object)
        a = np.stack([np.asarray(t, float).reshape(4, 4) for t in target])
        b = np.stack([np.asarray(t, float).reshape(4, 4) for t in own])
        return pd.Series(list((np.linalg.inv(a) @ b).reshape(-1, 16)))

    own = frames.select(seq, F.col(order), F.col("pose").alias("__own"))
    target = frames.select(seq, F.col(order).alias("target"), F.col("pose").alias("__target"))
    return pairs.join(own, [seq, order]).join(target, [seq, "target"]).withColumn("matrix", relative("__target", "__own")).drop("__own", "__target")


def compose(df: DataFrame, matrices: list[str], out: str = "matrix") -> DataFrame:
    """The product of 4x4 matrix columns, left to right (sensor, ego, global, lidar chains)."""

    @F.pandas_udf("array<double>")
    def product(frame: pd.DataFrame) -> pd.Series:
        if not len(frame):
            return pd.Series([], dtype=object)
        total = np.broadcast_to(np.eye(4), (len(frame), 4, 4))
        for name in frame.columns:
            total = total @ np.stack([np.asarray(t, float).reshape(4, 4) for t in frame[name]])
        return pd.Series(list(total.reshape(-1, 16)))

    return df.withColumn(out, product(F.struct(*matrices)))


def transform_points(pts: DataFrame, matrices: DataFrame, on: list[str]) -> DataFrame:
    """Apply a row's matrix to its points."""
    m = lambda i: F.col("matrix")[4 * i] * F.col("x") + F.col("matrix")[4 * i + 1] * F.col("y") + F.col("matrix")[4 * i + 2] * F.col("z") + F.col("matrix")[4 * i + 3]
    rows = pts.join(matrices.select(*on, "matrix"), on).select("*", m(0).alias("__x"), m(1).alias("__y"), m(2).alias("__z"))
    return rows.withColumns({"x": F.col("__x"), "y": F.col("__y"), "z": F.col("__z")}).drop("__x", "__y", "__z", "matrix")


def sweep_history(frames: DataFrame, n: int, seq: str = "seq", order: str = "frame_no", ts: str = "ts") -> DataFrame:
    """``sweeps``: the ``n`` previous frames, nearest first, as ``(frame_no, lag)``. When history ends its last sweep repeats; a frame
    without history fills its list with itself at lag 0."""
    per = Window.partitionBy(seq).orderBy(order)
    past = lambda k: F.struct(F.lag(order, k).over(per).alias(order), (F.col(ts) - F.lag(ts, k).over(per)).alias("lag"))
    out = frames
    last = F.struct(F.col(order), F.lit(0).cast(frames.schema[ts].dataType).alias("lag"))
    names = []
    for k in range(1, n + 1):
        here = past(k)
        last = F.when(F.lag(order, k).over(per).isNotNull(), here).otherwise(last)
        out = out.withColumn(f"__s{k}", last)
        last = F.col(f"__s{k}")
        names.append(f"__s{k}")
    return out.withColumn("sweeps", F.array(*names)).drop(*names)
