"""Shared helpers of the corpus operators: scratch tables, salted group look-ups, UTF-8 batches."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares (``spark.checkpoint.dir``).

    Only a ``local[...]`` session without that setting, as in tests, gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local_scratch:
            _local_scratch.append(tempfile.mkdtemp(prefix="spark-scratch-"))
        base = f"file://{_local_scratch[0]}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing lazy reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing holds any more: it waits for the driver's garbage collection."""
    for _ in range(2):  # the driver's Python lets go of plans first, then its JVM
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def salts_of(spark: SparkSession) -> int:
    """Over so many buckets the rows of one group are spread: they follow the number of shuffle partitions."""
    return max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))


def attach_group(df: DataFrame, keys: list[str], spread: str, aggs: list[Column], salts: int | None = None, having: Column | None = None) -> DataFrame:
    """Add per-group aggregates to every row, also where one group holds a large part of all rows.

    Aggregation combines map-side; the way back joins on the keys and a salt of ``spread``, so a group
    of any size is met by at most ``salts`` copies of its one result row, and by no more copies than it
    has rows. Keys must not be null. Rows of groups for which ``having`` does not hold are left out.
    """
    salts = salts or salts_of(df.sparkSession)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    groups = salted.groupBy(*keys).agg(*aggs, F.collect_set("__salt").alias("__salts"))
    groups = groups if having is None else groups.where(having)
    groups = groups.withColumn("__salt", F.explode("__salts")).drop("__salts")
    return salted.join(groups, [*keys, "__salt"]).drop("__salt")


def without_ids(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns whatever their names, whose id is not in ``gone(__gone)``, a table of distinct ids.

    One plan at every size: the ids may be a share of all documents, so both sides are shuffled by id, never broadcast.
    Rows with a null id, which may be many, do not move; they go if ``gone`` holds a null.
    """
    ids = gone.select(F.col("__gone").alias(f"__gone_{uuid.uuid4().hex}"))
    theirs, mine = ids[ids.columns[0]], docs[id_col].cast("long")
    kept = docs.where(mine.isNotNull()).join(ids.where(theirs.isNotNull()).hint("merge"), mine == theirs, "left_anti")
    return kept.union(docs.where(mine.isNull())) if gone.where("__gone IS NULL").isEmpty() else kept


def utf8_slices(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text of each holds about ``max_bytes`` (a longer text stays whole)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        yield batch.slice(start)


def numbered(df: DataFrame, group: str, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with ``pos`` (place within its group, from 0) and ``size`` (rows of the group), written to the shared folder.

    Rows are dealt by ranges of (group, order), sorted, and written with Spark's running row number of their
    partition; the places of a partition's rows follow from the counts of the partitions before. So a group of any size is
    spread over many tasks, and only one row per group and partition meets others. ``group`` must not be null.
    Rows that tie in ``order`` get any places among each other.
    """
    keys = [F.col(group), *order]
    dealt = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    at = materialize(dealt.withColumn("__m", F.monotonically_increasing_id()), name)
    at = at.withColumn("__part", F.shiftright("__m", 33)).drop("pos", "size")
    runs = at.groupBy(group, "__part").agg(F.min("__m").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "size": F.sum("__n").over(Window.partitionBy(group))}).drop("__n")
    placed = at.join(materialize(runs, f"{name}-runs"), [group, "__part"])
    return placed.withColumn("pos", F.col("__m") - F.col("__first") + F.col("__before")).drop("__m", "__part", "__first", "__before")
