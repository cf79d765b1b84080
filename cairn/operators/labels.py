"""Class filters, remaps, class maps, masks and annotation joins."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.scalar import map_values


def filter_classes(df: DataFrame, keep: Iterable[int] | None = None, remove: Iterable[int] | None = None, col: str = "classification") -> DataFrame:
    """Keep or remove classes; exactly one of the two lists must be given."""
    if (keep is None) == (remove is None):
        raise ValueError("give exactly one of keep and remove")
    return df.where(F.col(col).isin(list(keep)) if keep is not None else ~F.col(col).isin(list(remove)))


def remap(df: DataFrame, mapping: Mapping[int, int], default: int | None = None, col: str = "classification") -> DataFrame:
    """Map classes; unmapped ones stay, or become ``default``."""
    return df.withColumn(col, map_values(col, mapping, None if default is None else F.lit(default)).cast("int"))


def build_class_map(pts: DataFrame, required: Iterable[int] | None = None, manual: Mapping[int, int] | None = None, col: str = "classification") -> DataFrame:
    """``(old, new)``: manual pairs if given (other classes present keep their id), else contiguous ids from 0 over the
    required classes, or over those found."""
    spark = pts.sparkSession
    if required is not None:
        found = spark.createDataFrame([(int(c),) for c in sorted(set(required))], "old int")
    else:
        found = pts.select(F.col(col).cast("int").alias("old")).where("old IS NOT NULL").distinct()
    if manual is not None:
        return found.withColumn("new", map_values("old", manual).cast("int"))
    # One row per class: the window's single partition is as small as the class list.
    return found.withColumn("new", (F.row_number().over(Window.orderBy("old")) - 1).cast("int"))


def apply_class_map(pts: DataFrame, class_map: DataFrame, ignore: int = -1, col: str = "classification", out: str = "segment") -> DataFrame:
    """Add the mapped class; classes without an entry become ``ignore``."""
    pairs = class_map.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
    return pts.join(pairs, pts[col] == F.col("__old"), "left").withColumn(out, F.coalesce("__new", F.lit(ignore))).drop("__old", "__new")


def invert_map(class_map: DataFrame) -> DataFrame:
    """New to old; where several old classes share a new one the smallest stands for it."""
    return class_map.groupBy(F.col("new").alias("old")).agg(F.min("old").alias("new"))


def mask_labels(pts: DataFrame, keep_ids: DataFrame, on: list[str], hidden: int = -1, col: str = "classification") -> DataFrame:
    """Hide the labels of all rows but those named in ``keep_ids``; geometry stays."""
    flags = keep_ids.select(*on).distinct().withColumn("__kept", F.lit(True))
    return pts.join(flags, on, "left").withColumn(col, F.when(F.col("__kept"), F.col(col)).otherwise(F.lit(hidden))).drop("__kept")


def map_category(df: DataFrame, dictionary: DataFrame, valid: Iterable[str] | None = None, ignore: int = -1, col: str = "category") -> DataFrame:
    """Category name to ``(label, class_index)``. ``dictionary(category, target)``: a null target drops the category to
    ``ignore``, a category without an entry keeps its name; ``class_index`` is the label's place in ``valid``."""
    table = dictionary.select(F.col("category").alias("__c"), F.col("target").alias("__t"), F.lit(True).alias("__has"))
    named = df.join(table, df[col] == F.col("__c"), "left").withColumn("label", F.when(F.col("__has"), F.col("__t")).otherwise(F.col(col)))
    place = F.lit(ignore) if valid is None else map_values("label", {v: i for i, v in enumerate(valid)}, F.lit(ignore))
    return named.withColumn("class_index", F.when(F.col("label").isNull(), F.lit(ignore)).otherwise(place).cast("int")).drop("__c", "__t", "__has")


def assign_groups(vertices: DataFrame, groups: DataFrame, ignore: int = -1) -> DataFrame:
    """Label and instance of the last group (by ``group_order``) that lists a vertex's segment.

    ``vertices(mesh, vertex_id, segment_id)``, ``groups(mesh, group_order, label, object_id, segments)``.
    """
    listed = groups.select("mesh", "group_order", "label", "object_id", F.explode("segments").alias("segment_id"))
    last = listed.groupBy("mesh", "segment_id").agg(F.max_by(F.struct("label", "object_id"), "group_order").alias("g"))
    joined = vertices.join(last, ["mesh", "segment_id"], "left")
    return joined.withColumn("label", F.coalesce("g.label", F.lit(ignore))).withColumn("instance", F.coalesce("g.object_id", F.lit(ignore))).drop("g")


def assign_multilabel(vertices: DataFrame, groups: DataFrame, slots: int = 3, ignore: int = -1) -> DataFrame:
    """Up to ``slots`` labels per vertex in group order; the instance with the fewest vertices that had a free slot
    gives the major label. Segments decide, so the sequential part runs over a mesh's segments, not its vertices."""
    sizes = vertices.groupBy("mesh", "segment_id").agg(F.count("*").alias("n"))
    listed = groups.select("mesh", "group_order", "label", "object_id", F.explode(F.array_distinct("segments")).alias("segment_id"))
    place = F.row_number().over(Window.partitionBy("mesh", "segment_id").orderBy("group_order", "object_id"))
    taken = listed.join(sizes, ["mesh", "segment_id"]).withColumn("slot", place).where(F.col("slot") <= slots)
    sized = taken.join(taken.groupBy("mesh", "group_order", "object_id").agg(F.sum("n").alias("size")), ["mesh", "group_order", "object_id"])
    entry = F.struct("slot", "label", "object_id", "size")
    per = sized.groupBy("mesh", "segment_id").agg(F.array_sort(F.collect_list(entry)).alias("found"), F.min_by("label", F.struct("size", "slot")).alias("major"), F.min_by("object_id", F.struct("size", "slot")).alias("instance"))
    out = vertices.join(per, ["mesh", "segment_id"], "left")
    labels = [F.coalesce(F.get(F.col("found.label"), F.lit(k)), F.lit(ignore)).alias(f"label_{k + 1}") for k in range(slots)]
    return out.select(*vertices.columns, *labels, F.coalesce("major", F.lit(ignore)).alias("major_label"), F.coalesce("instance", F.lit(ignore)).alias("instance"))


def vertex_vote(faces: DataFrame, class_map: DataFrame | None = None, ignore: int = -1) -> DataFrame:
    """``faces(mesh, a, b, c, label)`` -> ``(mesh, vertex_id, label)``: majority of the vertex's faces, ties to the lowest
    label; the class table goes first."""
    mapped = faces if class_map is None else apply_class_map(faces, class_map, ignore, "label", "label")
    corners = mapped.select("mesh", F.explode(F.array("a", "b", "c")).alias("vertex_id"), "label")
    counts = corners.groupBy("mesh", "vertex_id", "label").count()
    return counts.groupBy("mesh", "vertex_id").agg(F.min_by("label", F.struct(-F.col("count"), "label")).alias("label"))


def pair_assets(a: DataFrame, b: DataFrame, c: DataFrame | None = None, key: str = "stem") -> tuple[DataFrame, DataFrame]:
    """Rows that all tables have, and a report ``(key, n_a, n_b[, n_c], complete)``; a stem twice in a table is an error row
    of the report, not of the pairs."""
    sides = [x for x in (("a", a), ("b", b), ("c", c)) if x[1] is not None]
    report = None
    for name, table in sides:
        counts = table.groupBy(key).agg(F.count("*").alias(f"n_{name}"))
        report = counts if report is None else report.join(counts, key, "full_outer")
    names = [f"n_{name}" for name, _ in sides]
    report = report.na.fill(0, names)
    complete = F.lit(True)
    for n in names:
        complete &= F.col(n) == 1
    report = report.withColumn("complete", complete)
    good = report.where("complete").select(key)
    pairs = good
    for _, table in sides:
        pairs = pairs.join(table, key)
    return pairs, report


