"""Paired block bootstrap: blocks are counted once, then drawn; points are never resampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.scalar import unit_hash
from cairn.operators.metrics import EPS


def draws(blocks: DataFrame, block: str, times: int, seed: int = 42) -> DataFrame:
    """``(b, block, weight)``: how often each of ``times`` resamples draws a block. ``blocks`` has one row per block.

    Slot ``s`` of resample ``b`` draws block number ``floor(u * n)`` in the order of the block ids, with ``u`` hashed from
    ``seed:b:s``.
    """
    numbered = blocks.select(block).distinct().withColumn("i", F.row_number().over(Window.orderBy(block)) - 1)
    n = numbered.agg(F.count("*").alias("n"))
    slots = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("b")).where("n > 0").select("n", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("s"))
    drawn = slots.groupBy("b", F.floor(unit_hash(seed, "b", "s") * F.col("n")).alias("i")).agg(F.count("*").alias("weight"))
    return drawn.join(numbered, "i").select("b", block, "weight")


def _confusions(pairs: DataFrame, block: str, target: str, keep: list[str] = ()) -> DataFrame:
    """Both methods' confusion counts per block, from one scan."""
    counts = pairs.groupBy(block, *keep, target, "pred_a", "pred_b").agg(F.count("*").alias("n"))
    sides = F.array(F.struct(F.lit("a").alias("method"), F.col("pred_a").alias("pred")), F.struct(F.lit("b").alias("method"), F.col("pred_b").alias("pred")))
    rows = counts.select(block, *keep, target, "n", F.explode(sides).alias("s"))
    return rows.groupBy(block, *keep, "s.method", target, F.col("s.pred").alias("pred")).agg(F.sum("n").alias("n"))


def _per_resample(conf: DataFrame, target: str, keys: list[str], classes: int, metric: str, cls: int) -> DataFrame:
    """The metric per key: ``miou`` over ``classes``, or ``f1`` / ``recall`` / ``iou`` of one class."""
    n = F.col("n")
    sides = F.array(F.struct(F.col(target).alias("c"), F.when(F.col(target) == F.col("pred"), n).otherwise(0).alias("i"), F.lit(0).cast("long").alias("p"), n.alias("t")), F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("i"), n.alias("p"), F.lit(0).cast("long").alias("t")))
    per = conf.select(*keys, F.explode(sides).alias("s")).groupBy(*keys, F.col("s.c").alias("c")).agg(*(F.sum(f"s.{x}").cast("double").alias(x) for x in "ipt"))
    i, p, t = F.col("i"), F.col("p"), F.col("t")
    value = {"miou": i / (p + t - i + EPS), "iou": i / (p + t - i + EPS), "f1": 2 * i / (p + t + EPS), "recall": i / (t + EPS)}[metric]
    if metric == "miou":
        return per.groupBy(*keys).agg((F.sum(value) / F.lit(float(classes))).alias("value"))
    return per.groupBy(*keys).agg(F.max(F.when(F.col("c") == cls, value)).alias("value"))


def block_differences(pairs: DataFrame, block: str, classes: int, metric: str = "miou", cls: int = 0, times: int = 1000, seed: int = 42, target: str = "target") -> DataFrame:
    """``(b, value_a, value_b, diff)`` per resample of the blocks; ``pairs`` is the output of ``pair_predictions`` with the block."""
    conf = _confusions(pairs, block, target)
    drawn = conf.join(draws(conf, block, times, seed), block).withColumn("n", F.col("n") * F.col("weight"))
    sums = drawn.groupBy("b", "method", target, "pred").agg(F.sum("n").alias("n"))
    per = _per_resample(sums, target, ["b", "method"], classes, metric, cls)
    both = per.groupBy("b").agg(F.max(F.when(F.col("method") == "a", F.col("value"))).alias("value_a"), F.max(F.when(F.col("method") == "b", F.col("value"))).alias("value_b"))
    return both.withColumn("diff", F.col("value_b") - F.col("value_a"))


def interval(df: DataFrame, value: str = "diff", level: float = 0.95, by: list[str] = (), least: int = 1) -> DataFrame:
    """Mean, percentile interval and the share above 0; nulls unless at least ``least`` values are finite."""
    v = F.when(~F.isnan(value), F.col(value))
    enough = F.count(v) >= least
    told = lambda c: F.when(enough, c)
    return df.groupBy(*by).agg(F.count(v).alias("n"), told(F.avg(v)).alias("mean"), told(F.percentile(v, (1 - level) / 2)).alias("low"), told(F.percentile(v, (1 + level) / 2)).alias("high"), told(F.avg((v > 0).cast("double"))).alias("p_above"))


def block_bootstrap(pairs: DataFrame, block: str, classes: int, metric: str = "miou", cls: int = 0, times: int = 1000, seed: int = 42, target: str = "target") -> DataFrame:
    return interval(block_differences(pairs, block, classes, metric, cls, times, seed, target))


def block_bootstrap_did(pairs: DataFrame, block: str, stratum: str, classes: int, metric: str = "miou", cls: int = 0, times: int = 1000, seed: int = 42, target: str = "target") -> DataFrame:
    """Interval of (b - a) inside a stratum minus (b - a) outside it; ``stratum`` is a boolean column."""
    conf = _confusions(pairs, block, target, [stratum])
    drawn = conf.join(draws(conf, block, times, seed), block).withColumn("n", F.col("n") * F.col("weight"))
    sums = drawn.groupBy("b", stratum, "method", target, "pred").agg(F.sum("n").alias("n"))
    per = _per_resample(sums, target, ["b", stratum, "method"], classes, metric, cls)
    sign = F.when(F.col("method") == "b", 1).otherwise(-1) * F.when(F.col(stratum), 1).otherwise(-1)
    return interval(per.groupBy("b").agg(F.sum(F.col("value") * sign).alias("diff"), F.count("value").alias("k")).where("k = 4"))


def rate_bootstrap(blocks: DataFrame, block: str, hits: str, total: str, group: str | None = None, times: int = 1000, seed: int = 42) -> DataFrame:
    """Interval of ``sum(hits) / sum(total)`` per group over resampled blocks; null with fewer than half the resamples finite."""
    by = [group] if group else []
    drawn = blocks.join(draws(blocks, block, times, seed), block)
    rate = drawn.groupBy("b", *by).agg((F.sum(F.col(hits) * F.col("weight")) / F.nullif(F.sum(F.col(total) * F.col("weight")), F.lit(0))).alias("rate"))
    return interval(rate, "rate", by=by, least=-(-times // 2))


def rate_gap_bootstrap(blocks: DataFrame, block: str, hits: str, total: str, group: str, first, second, times: int = 1000, seed: int = 42) -> DataFrame:
    """Interval of the difference of two groups' rates (first minus second)."""
    drawn = blocks.join(draws(blocks, block, times, seed), block)

    def rate(value) -> Column:
        mine = F.col(group) == value
        return F.sum(F.when(mine, F.col(hits) * F.col("weight"))) / F.nullif(F.sum(F.when(mine, F.col(total) * F.col("weight"))), F.lit(0))

    return interval(drawn.groupBy("b").agg((rate(first) - rate(second)).alias("diff")), least=-(-times // 2))
