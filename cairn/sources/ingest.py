"""Sources: point tables, bulk binary ingest, text, JSON, logs, manifests, splits, inventories, constraints."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairn.functions.scalar import echo, map_values, return_role, stem, valid_return


def read_points(table: DataFrame, color_scale: float | None = None, class_map: dict[int, int] | None = None, ignore: int = -1, extras: Sequence[str] = (), normals: bool = False) -> DataFrame:
    """Attribute mapping of a point table: scaled colours, mapped class (``segment``), echo flags, return role, optional columns defaulted.

    Only what is selected later is read: the result is one projection over the scan.
    """
    has = set(table.columns)
    out = table
    if color_scale:
        out = out.withColumns({c: F.col(c).cast("double") / F.lit(float(color_scale)) for c in ("r", "g", "b") if c in has})
    if "classification" in has:
        out = out.withColumn("segment", map_values("classification", class_map, F.lit(ignore)).cast("int") if class_map is not None else F.col("classification").cast("int"))
    else:
        out = out.withColumn("segment", F.lit(ignore))
    if {"return_number", "number_of_returns"} <= has:
        first, last = echo("return_number", "number_of_returns")
        out = out.withColumns({"is_first": first, "is_last": last, "role": return_role("return_number", "number_of_returns"), "valid_return": valid_return("return_number", "number_of_returns")})
    if "intensity" in has:
        out = out.withColumn("intensity", F.col("intensity").cast("double"))
    return out.withColumns({c: F.lit(None).cast("double") for c in extras if c not in has})


def ensure_columns(df: DataFrame, spec: dict[str, object], overwrite: bool = False) -> DataFrame:
    """Add missing columns with a default; ``overwrite`` sets them in any case."""
    return df.withColumns({c: F.lit(v) for c, v in spec.items() if overwrite or c not in df.columns})


def collect_columns(df: DataFrame, keys: Sequence[str], optional: Sequence[str] = (), feat_keys: Sequence[str] = (), copies: dict[str, str] | None = None, constants: dict[str, object] | None = None) -> DataFrame:
    """Required and optional columns, copies, constants, and a feature vector; a missing required column raises."""
    missing = [k for k in [*keys, *feat_keys] if k not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    feat = [F.array(*(F.col(k).cast("double") for k in feat_keys)).alias("feat")] if feat_keys else []
    more = [F.col(a).alias(b) for b, a in (copies or {}).items()] + [F.lit(v).alias(k) for k, v in (constants or {}).items()]
    return df.select(*keys, *(k for k in optional if k in df.columns and k not in keys), *more, *feat)


# --- binary ingest ---------------------------------------------------------------------------------------------

#: LAS public header: field, struct code, offset (fixed values of the format).
LAS_HEADER = {"major": ("B", 24), "minor": ("B", 25), "header_size": ("H", 94), "data_offset": ("I", 96), "point_format": ("B", 104), "record_length": ("H", 105), "legacy_count": ("I", 107), "sx": ("d", 131), "sy": ("d", 139), "sz": ("d", 147), "ox": ("d", 155), "oy": ("d", 163), "oz": ("d", 171)}
LAS_SCHEMA = "file string, point_id long, x double, y double, z double, intensity int, return_number int, number_of_returns int, classification int, r int, g int, b int"
#: Offset of the colours in a record, by point format (fixed values of the format).
LAS_RGB = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}


def las_header(raw: bytes) -> dict:
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    h = {k: struct.unpack_from(f"<{c}", raw, o)[0] for k, (c, o) in LAS_HEADER.items()}
    h["count"] = struct.unpack_from("<Q", raw, 247)[0] if h["minor"] >= 4 and len(raw) >= 255 else h["legacy_count"]
    if h["point_format"] & 0x80:
        raise ValueError("compressed records are not read here")
    return h


def las_records(raw: bytes, h: dict, first: int, name: str) -> pa.RecordBatch:
    n = len(raw) // h["record_length"]
    rec = np.frombuffer(raw, np.uint8, n * h["record_length"]).reshape(n, -1)
    at = lambda o, t: rec[:, o : o + np.dtype(t).itemsize].copy().view(t)[:, 0]
    fmt = h["point_format"]
    bits = rec[:, 14]
    if fmt >= 6:
        r, k, cls = bits & 15, bits >> 4, rec[:, 16]
    else:
        r, k, cls = bits & 7, (bits >> 3) & 7, rec[:, 15] & 31
    xyz = [at(4 * i, "<i4") * h[f"s{c}"] + h[f"o{c}"] for i, c in enumerate("xyz")]
    rgb = [pa.array(at(LAS_RGB[fmt] + 2 * i, "<u2").astype(np.int32)) if fmt in LAS_RGB else pa.nulls(n, pa.int32()) for i in range(3)]
    ints = [pa.array(v.astype(np.int32)) for v in (at(12, "<u2"), r, k, cls)]
    columns = [pa.array([name] * n, pa.string()), pa.array(np.arange(first, first + n, dtype=np.int64)), *map(pa.array, xyz), *ints, *rgb]
    return pa.RecordBatch.from_arrays(columns, [p.split()[0] for p in LAS_SCHEMA.split(", ")])


class _LasRange(InputPartition):
    def __init__(self, uri: str, header: dict, first: int, count: int):
        self.uri, self.header, self.first, self.count = uri, header, first, count


class LasReader(DataSourceReader):
    """Headers are read on the driver; one partition per file and record range."""

    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.rows = int(options.get("rows", 1_000_000))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        parts = []
        for uri in self.paths:
            system, path = fs.FileSystem.from_uri(uri)
            with system.open_input_file(path) as f:
                h = las_header(f.read_at(min(375, f.size()), 0))
            parts += [_LasRange(uri, h, k, min(self.rows, h["count"] - k)) for k in range(0, h["count"], self.rows)]
        return parts or [_LasRange("", {}, 0, 0)]

    def read(self, partition: _LasRange) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if not partition.count:
            return
        system, path = fs.FileSystem.from_uri(partition.uri)
        h = partition.header
        with system.open_input_file(path) as f:
            for k in range(0, partition.count, 200_000):
                n = min(200_000, partition.count - k)
                first = partition.first + k
                raw = f.read_at(n * h["record_length"], h["data_offset"] + first * h["record_length"])
                yield las_records(raw, h, first, partition.uri)


class LasSource(DataSource):
    """Uncompressed LAS files as a Spark source: ``spark.read.format("las").option("paths", json list of URIs)``."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return LAS_SCHEMA

    def reader(self, schema) -> LasReader:
        return LasReader(dict(self.options))


def list_files(spark: SparkSession, glob: str) -> list[str]:
    """Matching files through Hadoop's file systems, so any store that Spark reads will do."""
    return sorted(r.path for r in spark.read.format("binaryFile").load(glob).select("path").collect())


def ingest_las(spark: SparkSession, glob: str, rows: int = 1_000_000) -> DataFrame:
    spark.dataSource.register(LasSource)
    return spark.read.format("las").option("paths", json.dumps(list_files(spark, glob))).option("rows", rows).load()


def ingest_npy(spark: SparkSession, root: str, assets: dict[str, int], scene: str = "scene") -> DataFrame:
    """``{scene}/{asset}.npy`` to rows: ``assets`` gives each one's width (1 for scalars); missing labels become -1, other missing assets
    null. Lengths within a scene must agree. A scene's arrays meet in one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(root)
    named = files.select(F.element_at(F.split("path", "/"), -2).alias(scene), stem("path").alias("asset"), "content").where(F.col("asset").isin(list(assets)))
    names = [f"{a}_{i}" if w > 1 else a for a, w in assets.items() for i in range(w)]

    def rows(frame: pd.DataFrame) -> pd.DataFrame:
        import io

        arrays = {r.asset: np.load(io.BytesIO(r.content), allow_pickle=False) for r in frame.itertuples()}
        sizes = {len(a) for a in arrays.values()}
        if len(sizes) != 1:
            raise ValueError(f"{frame[scene].iloc[0]}: arrays of different lengths {sorted(sizes)}")
        n = sizes.pop()
        out = {scene: frame[scene].iloc[0], "point_id": np.arange(n)}
        for a, w in assets.items():
            x = arrays[a].reshape(n, -1)[:, :w].astype(float) if a in arrays else np.full((n, w), -1.0 if a in ("segment", "instance") else np.nan)
            out |= {f"{a}_{i}" if w > 1 else a: x[:, i] for i in range(w)}
        return pd.DataFrame(out)

    return named.groupBy(scene).applyInPandas(rows, f"{scene} string, point_id long, " + ", ".join(f"{n} double" for n in names))


def ingest_sweeps(spark: SparkSession, glob: str, width: int = 4, strength_scale: float = 1.0, labels: str | None = None) -> DataFrame:
    """Raw sweeps of float32 rows (x, y, z, strength, ...) with, from ``labels``, the lower 16 bits of a 32-bit label."""

    def decode(kind: str):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for r in frame.itertuples():
                    if kind == "points":
                        x = np.frombuffer(r.content, "<f4").reshape(-1, width).astype(float)
                        yield pd.DataFrame({"frame": r.frame, "point_id": np.arange(len(x)), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2], "strength": x[:, 3] / strength_scale})
                    else:
                        v = np.frombuffer(r.content, "<u4")
                        yield pd.DataFrame({"frame": r.frame, "point_id": np.arange(len(v)), "label": (v & 0xFFFF).astype(int), "instance": (v >> 16).astype(int)})

        return run

    load = lambda g: spark.read.format("binaryFile").load(g).select(stem("path").alias("frame"), "content")
    pts = load(glob).mapInPandas(decode("points"), "frame string, point_id long, x double, y double, z double, strength double")
    if not labels:
        return pts
    return pts.join(load(labels).mapInPandas(decode("labels"), "frame string, point_id long, label int, instance int"), ["frame", "point_id"], "left")


#: Codes of a sidecar's tensors.
SIDECAR_TYPES = {"F16": "<f2", "F32": "<f4", "F64": "<f8", "I32": "<i4", "I64": "<i8", "U8": "u1", "BOOL": "?"}


def sidecar_tensors(raw: bytes) -> dict[str, np.ndarray]:
    """Tensors of a file with an 8-byte little-endian header length, a JSON header ``{name: {dtype, shape, data_offsets}}``, raw data."""
    (size,) = struct.unpack_from("<Q", raw)
    header = json.loads(raw[8 : 8 + size])
    out = {}
    for name, h in header.items():
        if name == "__metadata__":
            continue
        start, end = h["data_offsets"]
        x = np.frombuffer(raw, SIDECAR_TYPES[h["dtype"]], offset=8 + size + start, count=(end - start) // np.dtype(SIDECAR_TYPES[h["dtype"]]).itemsize)
        out[name] = x.reshape(h["shape"])
    return out


def ingest_sidecar(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """``(patches(stem, patch_index, feature), correspondence(stem, point_id, row, col, patch_index, valid, observability))``; shapes and
    ranges are checked."""
    files = spark.read.format("binaryFile").load(glob).select(stem("path").alias("stem"), "content")

    def patches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                f = sidecar_tensors(r.content)["features"]
                if f.ndim != 2:
                    raise ValueError(f"{r.stem}: features must have two dimensions")
                yield pd.DataFrame({"stem": r.stem, "patch_index": np.arange(len(f)), "feature": list(f.astype(np.float32))})

    def points(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                t = sidecar_tensors(r.content)
                n = len(t["patch_index"])
                valid = t["valid"].astype(bool) if "valid" in t else t["patch_index"] >= 0
                obs = t["observability"].astype(float) if "observability" in t else valid.astype(float)
                if t["pixel_coord"].shape != (n, 2) or len(valid) != n or len(obs) != n:
                    raise ValueError(f"{r.stem}: tensors of different lengths")
                if (t["patch_index"][valid] >= len(t["features"])).any() or (t["patch_index"][valid] < 0).any():
                    raise ValueError(f"{r.stem}: patch index out of range")
                if not np.isfinite(obs).all() or (obs < 0).any() or (obs > 1).any():
                    raise ValueError(f"{r.stem}: observability outside [0, 1]")
                yield pd.DataFrame({"stem": r.stem, "point_id": np.arange(n), "row": t["pixel_coord"][:, 0].astype(int), "col": t["pixel_coord"][:, 1].astype(int), "patch_index": t["patch_index"].astype(int), "valid": valid, "observability": obs})

    return files.mapInPandas(patches, "stem string, patch_index int, feature array<float>"), files.mapInPandas(points, "stem string, point_id long, row int, col int, patch_index int, valid boolean, observability double")


# --- text ----------------------------------------------------------------------------------------------------


def read_xyz_text(spark: SparkSession, glob: str, sep: str = " ", schema: str = "x double, y double, z double, r double, g double, b double") -> DataFrame:
    """Delimited point text; one object per file, its class from the file name (``{class}_{k}``), its id by rank of the name."""
    rows = spark.read.csv(glob, sep=sep, schema=schema).withColumn("object", stem(F.input_file_name()))
    names = rows.select("object").distinct().withColumn("object_id", F.dense_rank().over(Window.orderBy("object")) - 1)
    return rows.join(names, "object").withColumn("class_name", F.regexp_extract("object", r"^(.*?)_?\d*$", 1))


def read_segments(spark: SparkSession, glob: str, schema: str = "sceneId string, segIndices array<long>") -> DataFrame:
    """``(scene, vertex_id, segment_id)`` of segmentation JSON files."""
    return spark.read.json(glob, multiLine=True, schema=schema).select(F.col("sceneId").alias("scene"), F.posexplode("segIndices").alias("vertex_id", "segment_id"))


def read_groups(spark: SparkSession, glob: str) -> DataFrame:
    """``(scene, group_order, object_id, label, segments)`` of annotation JSON files."""
    schema = "sceneId string, segGroups array<struct<objectId: long, label: string, segments: array<long>>>"
    return spark.read.json(glob, multiLine=True, schema=schema).select(F.col("sceneId").alias("scene"), F.posexplode("segGroups").alias("group_order", "g")).select("scene", "group_order", F.col("g.objectId").alias("object_id"), "g.label", "g.segments")


def read_manifest(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema) if schema else spark.read.csv(path, header=True)


def parse_metric_lines(lines: DataFrame, text: str = "value", run: str = "run", order: str = "line") -> DataFrame:
    """Lines ``... name: number ...`` of training logs to ``(run, line, name, value)``."""
    pairs = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"([A-Za-z_][\w/]*)\s*[:=]\s*(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"), F.lit(0)))
    rows = lines.select(run, order, pairs.alias("p"))
    return rows.select(run, order, F.regexp_extract("p", r"^([\w/]+)", 1).alias("name"), F.regexp_extract("p", r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)$", 1).cast("double").alias("value"))


def parse_logs(spark: SparkSession, glob: str) -> DataFrame:
    """Metrics of log files, a run per file; lines are numbered by their place in the file."""
    rows = spark.read.text(glob, wholetext=True).select(stem(F.input_file_name()).alias("run"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return parse_metric_lines(rows)


def parse_results(lines: DataFrame, text: str = "value", run: str = "run", order: str = "line") -> DataFrame:
    """Result lines of training logs, ``(run, line, kind, class_id, class_name, name, value)``.

    ``val`` and ``test`` rows are the metrics of ``Val result:`` and ``Test result:`` lines, ``class`` rows those of the class lines that follow a
    test result without a gap (``class_id`` is -1 elsewhere), ``error`` rows hold an error line in ``name``, ``stop`` rows an early stop. A log is ordered as a whole: one run per window.
    """
    # Fixed formats of the logs.
    metric, numbers = r"\b(mIoU|mAcc|OA|mF1|fwIoU|Kappa)\s+([0-9.]+)", r"\b(IoU|Prec|Recall|F1)\s+([0-9.]+)"
    per_class = r"Class\s+(\d+)\s+-\s+(.+?)\s+\|\s+IoU\s+[0-9.]+\s+Prec\s+[0-9.]+\s+Recall\s+[0-9.]+\s+F1\s+[0-9.]+"
    t = F.col(text)
    is_class = t.rlike(per_class)
    rows = lines.select(run, order, t.alias("__t"), is_class.alias("__c"))
    rows = rows.withColumn("__after", F.last(F.when(~F.col("__c"), F.col("__t").contains("Test result:")), ignorenulls=True).over(Window.partitionBy(run).orderBy(order)))
    t = F.col("__t")
    flag = lambda kind, when: F.when(when, F.lit(kind))
    kinds = F.array_compact(F.array(flag("val", t.contains("Val result:")), flag("test", t.contains("Test result:")), flag("class", F.col("__c") & F.col("__after")), flag("error", t.contains(" ERROR]")), flag("stop", t.contains("Training stop requested"))))
    rows = rows.withColumn("kind", F.explode(kinds))
    pairs = lambda pattern: F.arrays_zip(F.regexp_extract_all("__t", F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all("__t", F.lit(pattern), F.lit(2)).alias("value"))
    told = F.when(F.col("kind").isin("val", "test"), pairs(metric)).when(F.col("kind") == "class", pairs(numbers)).otherwise(F.array(F.struct(t.alias("name"), F.lit(None).cast("string").alias("value"))))
    rows = rows.withColumn("__p", F.explode(told))
    mine = F.col("kind") == "class"
    return rows.select(run, order, "kind", F.when(mine, F.regexp_extract("__t", per_class, 1).cast("int")).otherwise(-1).alias("class_id"), F.when(mine, F.regexp_extract("__t", per_class, 2)).alias("class_name"), F.col("__p.name").alias("name"), F.col("__p.value").cast("double").alias("value"))


def summarize_results(results: DataFrame, run: str = "run", order: str = "line", metric: str = "mIoU") -> DataFrame:
    """One row per run: validation epochs, the first best of them (from 1) and its metric, the last one's metric, the test metric, whether it stopped early, errors, and
    ``complete``: exactly one test result and at least one validation."""
    epoch = F.row_number().over(Window.partitionBy(run).orderBy(order))
    val = results.where((F.col("kind") == "val") & (F.col("name") == metric)).withColumn("epoch", epoch)
    best = val.groupBy(run).agg(F.count("*").alias("val_epochs"), F.min_by("epoch", F.struct(-F.col("value"), F.col("epoch"))).alias("best_epoch"), F.max("value").alias("best"), F.max_by("value", "epoch").alias("final"))
    rest = results.groupBy(run).agg(
        F.max(F.when((F.col("kind") == "test") & (F.col("name") == metric), F.col("value"))).alias("test"), F.count_if((F.col("kind") == "test") & (F.col("name") == metric)).alias("__tests"),
        (F.count_if(F.col("kind") == "stop") > 0).alias("early_stopped"), F.count_if(F.col("kind") == "error").alias("errors"),
    )
    out = rest.join(best, run, "left").withColumn("val_epochs", F.coalesce("val_epochs", F.lit(0)))
    return out.withColumn("complete", (F.col("__tests") == 1) & (F.col("val_epochs") > 0)).drop("__tests")


# --- splits, inventories, constraints ------------------------------------------------------------------------------


def resolve_split(manifest: DataFrame, splits: DataFrame, names: Sequence[str], key: str = "scene", labelled: str | None = None) -> DataFrame:
    """Manifest rows of the named splits (``splits(split, scene)``), or of labelled scenes only."""
    chosen = manifest.join(splits.where(F.col("split").isin(list(names))).select(key), key, "left_semi")
    return chosen.where(F.col(labelled)) if labelled else chosen


def inventory(spark: SparkSession, roots: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Files under named roots with size and SHA-256, and a report of which stems each root has."""
    files = None
    for name, root in roots.items():
        part = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.lit(name).alias("root"), "path", stem("path").alias("stem"), "length", F.sha2("content", 256).alias("sha256"))
        files = part if files is None else files.unionByName(part)
    report = files.groupBy("stem").agg(*(F.count_if(F.col("root") == n).alias(f"n_{n}") for n in roots))
    complete = F.lit(True)
    for n in roots:
        complete = complete & (F.col(f"n_{n}") == 1)
    return files, report.withColumn("complete", complete)


def validate(df: DataFrame, rules: dict[str, Column], required: Sequence[str] = ()) -> DataFrame:
    """``(rule, violations)``: rows for which a rule does not hold (null counts as a violation); a missing required column raises."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    sums = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules))).alias("v")).select("v.*")


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
