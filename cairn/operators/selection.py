"""Exact order statistics of groups of any size, by counting: no task ever holds or sorts the values of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.neighbors import checkpointed

#: Buckets into which a pass cuts the range that is still open.
BUCKETS = 4096


def select_ranks(rows: DataFrame, keys: Sequence[str], value: str, targets: DataFrame) -> DataFrame:
    """``(keys, rank, value, below, equal)`` of ``targets(keys, rank)``: the value at a rank (from 1) among a group's ``value`` (a number, not null),
    how many are less and how many equal.

    Each pass counts the values inside the open range of every target by equal buckets, which combines before the shuffle, and goes on with the
    bucket that holds the rank, between its least and greatest values. A bucket's number never falls as values rise, and a range's ends
    fall into different buckets, so every pass narrows the range; a few passes do. Ranks beyond a group's size give no row.
    """
    of = [*keys, "rank"]
    box = rows.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count("*").alias("__n"))
    state = targets.join(box, list(keys)).where("rank BETWEEN 1 AND __n").select(*of, F.lit(0).cast("long").alias("below"), "__lo", "__hi", F.col("__n").alias("equal"))
    state = checkpointed(state)
    while True:
        open_ = state.where("__lo < __hi")
        if open_.isEmpty():
            return state.select(*of, F.col("__lo").alias(value), "below", "equal")
        inside = rows.join(open_, list(keys)).where(F.col(value).between(F.col("__lo"), F.col("__hi")))
        share = (F.col(value) - F.col("__lo")).cast("double") / (F.col("__hi") - F.col("__lo")).cast("double")
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
        counts = inside.groupBy(*of, "below", bucket.alias("__b")).agg(F.count("*").alias("__c"), F.min(value).alias("__lo"), F.max(value).alias("__hi"))
        upto = F.sum("__c").over(Window.partitionBy(*of).orderBy("__b"))
        found = counts.withColumn("__upto", F.col("below") + upto).where((F.col("__upto") >= F.col("rank")) & (F.col("__upto") - F.col("__c") < F.col("rank")))
        narrowed = found.select(*of, (F.col("__upto") - F.col("__c")).alias("below"), "__lo", "__hi", F.col("__c").alias("equal"))
        state = checkpointed(state.where("__lo = __hi").unionByName(narrowed))


def in_order(df: DataFrame, order: Sequence[str | Column], value: Column) -> DataFrame:
    """``df`` with ``place`` (from 0, in the given order) and ``upto`` (the sum of ``value`` over the rows up to and with this one).

    Rows are dealt by ranges and sorted; a range's own sums are windows over that range, and one row per range carries what lies before it.
    """
    dealt = df.withColumn("__v", value).repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    rows = checkpointed(dealt.withColumn("__m", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__m", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per shuffle partition
    parts = checkpointed(rows.groupBy("__part").agg(F.min("__m").alias("__first"), F.count("*").alias("__n"), F.sum("__v").alias("__s")))
    parts = parts.select("__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__rows"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__sum"))
    own = F.sum("__v").over(Window.partitionBy("__part").orderBy("__m").rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(F.broadcast(parts), "__part").withColumns({"place": F.col("__m") - F.col("__first") + F.col("__rows"), "upto": own + F.col("__sum")}).drop("__v", "__m", "__part", "__first", "__rows", "__sum")


def percentiles(df: DataFrame, columns: dict[str, Column], shares: Sequence[float]) -> dict[str, list[float]]:
    """Percentiles of whole columns, interpolated between the neighbouring ranks; only the results are collected. Nulls and NaN do not count; a
    column without values has nulls."""
    names = list(columns)
    each = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("__k"), columns[c].cast("double").alias("__x")) for i, c in enumerate(names)))).alias("e")).select("e.*").where("__x IS NOT NULL AND NOT isnan(__x)")
    rows = checkpointed(each)
    at = rows.groupBy("__k").agg(F.count("*").alias("n")).withColumn("q", F.explode(F.array(*(F.lit(float(s)) for s in sorted(set(shares))))))
    place = (F.col("n") - 1) * F.col("q")
    targets = at.select("__k", F.explode(F.array(F.floor(place), F.ceil(place))).alias("rank")).select("__k", (F.col("rank") + 1).cast("long").alias("rank")).distinct()
    known = {(r["__k"], r["rank"]): r["__x"] for r in select_ranks(rows, ["__k"], "__x", targets).collect()}
    sizes = {r["__k"]: r["n"] for r in at.select("__k", "n").distinct().collect()}

    def value(k: int, share: float) -> float | None:
        if k not in sizes:
            return None
        place = (sizes[k] - 1) * float(share)
        low, high = known[k, int(place) + 1], known[k, -int(-place // 1) + 1]
        return low + (high - low) * (place - int(place))

    return {c: [value(i, s) for s in shares] for i, c in enumerate(names)}
