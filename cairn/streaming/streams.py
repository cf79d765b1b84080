"""Structured Streaming: resumable ingest, running metrics, windows, early stop, de-duplication, frame fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from cairn.operators.metrics import seg_metrics


def ingest_tiles(spark: SparkSession, source: str, schema: StructType | str, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Process new tile files once: finished ones are skipped on restart, hidden partial files are ignored.

    A batch is written to a folder of its own number, overwritten if the batch runs again, so a restart leaves no half batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_confusion(rows: DataFrame, target: str = "target", pred: str = "pred") -> DataFrame:
    """Streaming confusion counts; use with output mode ``complete`` or ``update``."""
    return rows.groupBy(target, pred).agg(F.count("*").alias("n"))


def confusion_metrics(conf: DataFrame, classes: int, target: str = "target", pred: str = "pred") -> DataFrame:
    """Segmentation metrics of a (small) confusion table, as in ``foreachBatch``."""
    from cairn.operators.metrics import iou_counts

    return seg_metrics(iou_counts(conf, classes, [], target, pred, weight="n"), classes)


def windowed_metrics(events: DataFrame, ts: str, keys: list[str], value: str, length: str, slide: str | None = None, gap: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and means per key and tumbling, sliding (``slide``) or session (``gap``) window; events later than ``late`` are dropped on
    a stream."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    span = F.session_window(ts, gap) if gap else F.window(ts, length, slide) if slide else F.window(ts, length)
    out = marked.groupBy(span.alias("w"), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "mean")


def dedup_points(points: DataFrame, ids: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Re-delivered points dropped by id: within the watermark on a stream, over all rows in a batch."""
    if points.isStreaming:
        return points.withWatermark(ts, late).dropDuplicatesWithinWatermark(ids)
    return points.dropDuplicates(ids)


class EarlyStop:
    """The rule: better by a relative ``min_delta`` of the best, ``patience`` values without that, after ``warmup`` values; a value that is not
    finite is no improvement; the counter does not run during warm-up."""

    def __init__(self, mode: str = "min", min_delta: float = 0.001, patience: int = 3, warmup: int = 0):
        self.mode, self.min_delta, self.patience, self.warmup = mode, min_delta, patience, warmup

    def step(self, state: tuple[float | None, int, int], value: float | None) -> tuple[float | None, int, int]:
        """``(best, bad, seen)`` after one more value."""
        best, bad, seen = state
        seen += 1
        ok = value is not None and value == value and abs(value) != float("inf")
        if ok and best is None:
            better = True
        elif ok:
            need = abs(best) * self.min_delta
            better = value < best - need if self.mode == "min" else value > best + need
        else:
            better = False
        if better:
            return value, 0, seen
        return best, 0 if seen <= self.warmup else bad + 1, seen

    def stopped(self, state: tuple[float | None, int, int]) -> bool:
        return state[1] >= self.patience


STOP_SCHEMA = "run string, iter long, value double, best double, bad int, stop boolean"


def early_stop_batch(metrics: DataFrame, rule: EarlyStop, run: str = "run", order: str = "iter", value: str = "value") -> DataFrame:
    """The rule over finished runs, a row per value.

    Values stream through a task in the order of their run; only the rule's state is carried along, so a run of any length fits.
    """
    names = ["run", "iter", "value", "best", "bad", "stop"]

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, (None, 0, 0)
        for frame in frames:
            rows = []
            for key, at, v in frame.itertuples(index=False):
                if key != current:
                    current, state = key, (None, 0, 0)
                state = rule.step(state, None if v is None else float(v))
                rows.append((key, at, v, state[0], state[1], rule.stopped(state)))
            yield pd.DataFrame(rows, columns=names)

    return metrics.select(run, order, value).repartition(run).sortWithinPartitions(run, order).mapInPandas(apply, STOP_SCHEMA)


class _StopProcessor(StatefulProcessor):
    def __init__(self, rule: EarlyStop):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stop", "best double, bad int, seen int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = tuple(self.state.get()) if self.state.exists() else (None, 0, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values("iter").itertuples():
            now = self.rule.step(now, float(r.value) if r.value is not None else None)
            out.append((key[0], r.iter, r.value, now[0], now[1], self.rule.stopped(now)))
        self.state.update(now)
        yield pd.DataFrame(out, columns=["run", "iter", "value", "best", "bad", "stop"])

    def close(self) -> None:
        pass


def early_stop_stream(metrics: DataFrame, rule: EarlyStop) -> DataFrame:
    """The rule on a stream of ``(run, iter, value)``: a value state per run, kept in the checkpoint across restarts."""
    return metrics.groupBy("run").transformWithStateInPandas(statefulProcessor=_StopProcessor(rule), outputStructType=STOP_SCHEMA, outputMode="Append", timeMode="None")


def fuse_stream(frames: DataFrame, reach: int, seq: str = "seq", order: str = "frame_no", ts: str = "ts", late: str = "1 minute") -> DataFrame:
    """Each frame with the frames of its sequence at most ``reach`` numbers away: a stream-stream join within watermarks, or a batch join."""
    a = frames.select(F.col(seq), F.col(order).alias("target"), F.col(ts).alias("target_ts"))
    b = frames.select(F.col(seq).alias("__seq"), F.col(order).alias("__no"), F.col(ts).alias("__ts"))
    near = (F.col(seq) == F.col("__seq")) & (F.abs(F.col("__no") - F.col("target")) <= reach)
    if frames.isStreaming:
        a, b = a.withWatermark("target_ts", late), b.withWatermark("__ts", late)
        near &= F.expr(f"__ts >= target_ts - INTERVAL {late} AND __ts <= target_ts + INTERVAL {late}")
    return a.join(b, near).select(seq, "target", F.col("__no").alias(order), (F.col("__no") - F.col("target")).alias("offset"))
