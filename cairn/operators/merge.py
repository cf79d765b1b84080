"""Putting overlapping tiles together again: votes, means, identity columns, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_vote(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """Majority label per original point; ties go to the lowest label."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, col).count()
    return counts.groupBy(*keys).agg(F.min_by(col, F.struct(-F.col("count"), F.col(col))).alias(col))


def merge_avg(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """Mean per original point, cast back to the input's type (integers are truncated)."""
    return df.groupBy(*keys).agg(F.avg(col).cast(df.schema[col].dataType).alias(col))


def merge_identity(df: DataFrame, cols: list[str], keys: list[str], tile: str, keep: str = "last") -> DataFrame:
    """Columns that all copies should share: the value of the last (or first) tile."""
    pick = {"last": F.max_by, "first": F.min_by}[keep]
    return df.groupBy(*keys).agg(*(pick(c, tile).alias(c) for c in cols))


def merge_report(df: DataFrame, keys: list[str], id_col: str, source: str, expected: DataFrame | None = None) -> DataFrame:
    """Coverage per source: rows, unique ids, missing ids, mean overlap. ``expected(source, source_point_count)`` gives the
    true counts (else the greatest id plus one); sources whose counts disagree are marked ``invalid``."""
    rep = df.groupBy(source).agg(F.count("*").alias("n_rows"), F.count_distinct(id_col).alias("n_unique"), (F.max(id_col) + 1).alias("by_id"))
    if expected is None:
        rep = rep.withColumn("expected", F.col("by_id")).withColumn("invalid", F.lit(False))
    else:
        want = expected.groupBy(source).agg(F.max("source_point_count").alias("expected"), (F.count_distinct("source_point_count") > 1).alias("invalid"))
        rep = rep.join(want, source, "left").withColumn("invalid", F.coalesce("invalid", F.lit(True)))
    return rep.select(source, "n_rows", "n_unique", (F.col("expected") - F.col("n_unique")).alias("n_missing"), (F.col("n_rows") / F.col("n_unique")).alias("mean_overlap"), "invalid")


def merge_tiles(df: DataFrame, keys: list[str], tile: str, vote: list[str] = (), avg: list[str] = (), identity: list[str] = ()) -> DataFrame:
    """All of a tile merge in one pass over the keys.

    Votes take a first aggregation by label: its result, and the sums for the means, meet in one shuffle on the keys.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    if not vote:
        return df.groupBy(*keys).agg(*(F.avg(c).cast(kinds[c]).alias(c) for c in avg), *(F.max_by(c, tile).alias(c) for c in identity), F.count("*").alias("overlap"))
    # One row per (key, voted labels): sums and last values combine, so the overlap's rows shrink before the second step.
    last = F.max_by(F.struct(*(F.col(c) for c in identity)), F.col(tile)).alias("__last") if identity else F.lit(None).alias("__last")
    part = df.groupBy(*keys, *vote).agg(F.count("*").alias("__n"), F.max(tile).alias("__tile"), last, *(F.sum(c).alias(f"__s_{c}") for c in avg), *(F.count(c).alias(f"__n_{c}") for c in avg))
    if len(vote) == 1:
        c = vote[0]
        return part.groupBy(*keys).agg(
            F.min_by(c, F.struct(-F.col("__n"), F.col(c))).alias(c),
            *((F.sum(f"__s_{a}") / F.sum(f"__n_{a}")).cast(kinds[a]).alias(a) for a in avg),
            *(F.max_by(F.col("__last")[i], "__tile").alias(i) for i in identity),
            F.sum("__n").alias("overlap"),
        )
    base = part.groupBy(*keys).agg(*((F.sum(f"__s_{a}") / F.sum(f"__n_{a}")).cast(kinds[a]).alias(a) for a in avg), *(F.max_by(F.col("__last")[i], "__tile").alias(i) for i in identity), F.sum("__n").alias("overlap"))
    for c in vote:
        base = base.join(merge_vote(df, c, keys), keys, "left")
    return base
