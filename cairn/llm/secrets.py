"""Secret scans with corpus-wide ownership frequency.

Three fixed patterns give the base spans of a text. Other strings that look like credentials are candidates;
what tells a live one from a documented example is who has it: candidate hashes are counted over all
documents by distinct repositories and owners. A value that one or two owners have is owner-specific and
becomes a span; a value copied widely is an example.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import materialize, salts_of, utf8_slices

#: Base patterns (fixed values). Runs of hexadecimal digits and key ids are matched from their least length up, which
#: finds the same spans as matching all runs and dropping short ones.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "opaque")
#: Candidates beyond the base: long runs of token characters with letters and digits and much entropy.
OPAQUE = re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])[A-Za-z0-9_+/-]{20,}")
LEAST_ENTROPY = 3.5


def entropy(text: str) -> float:
    """Bits per character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind number, end, value)`` of the base patterns, in order."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def opaque_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Candidate strings that no base span touches."""
    out, at, reach = [], 0, 0  # ``reach``: how far the base spans that begin before the candidate's end extend
    for m in OPAQUE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start() and entropy(m[0]) >= LEAST_ENTROPY:
            out.append((m.start(), 3, m.end(), m[0]))
    return out


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in sorted(spans, key=lambda s: s[:3]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None) -> DataFrame:
    """One row per input row: ``row, doc_id, repo, owner, found`` with ``found array<struct<start, kind, end, value>>``,
    ``value`` a 64-bit hash of the secret itself, and ``base_sha256``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.int64())]))
        for batch in utf8_slices(batches, 3):
            found, sums = [], []
            for text in batch.column(3).to_pylist():
                base = base_spans(text) if text else []
                every = sorted(base + (opaque_spans(text, base) if text else []))
                found.append([{"start": s, "kind": k, "end": e, "value": xxhash.xxh3_64_intdigest(v) - (1 << 63)} for s, k, e, v in every])
                sums.append(hashlib.sha256(joined(base).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, span), pa.array(sums)], ["doc_id", "repo", "owner", "found", "base_sha256"])

    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", F.col("source"), F.col("lang")) if repo is None else repo
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner"), F.col(text_col).alias("text"))
    schema = "doc_id long, repo string, owner string, found array<struct<start: long, kind: int, end: long, value: long>>, base_sha256 string"
    return materialize(texts.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "secret-scan")


def secret_scan(docs: DataFrame, live_owners: int = 2, live_repos: int = 4, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_opaque, n_live, n_example``: one row per input row.

    An owner is a ``source`` unless another column is given, a repository what an owner has in one ``lang``.
    ``spans`` lists the base spans and, of the other candidates, those whose value at most ``live_owners``
    distinct owners and ``live_repos`` distinct repositories have. ``n_live`` counts all spans whose value is owner-specific,
    ``n_example`` those whose value is copied more widely. Spans are in code points, ends exclusive.

    Edge cases: a null or empty text has no spans; null owners count as one owner; repeated rows are scanned
    each; an empty table gives an empty table; only the named columns are read.
    """
    rows = scan(docs, id_col, text_col, repo, owner)
    spans = rows.where(F.size("found") > 0).select("row", "repo", "owner", F.explode("found").alias("s"))
    spans = spans.select("row", "s", F.col("s.value").alias("value"), F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("owner", F.lit("")).alias("owner"))
    # Distinct owners of a value, pre-aggregated: a value that most rows hold is one row per task.
    owned = spans.groupBy("value", "repo", "owner").agg(F.count("*").alias("n"))
    counts = owned.groupBy("value").agg(F.count_distinct("repo").alias("repos"), F.count_distinct("owner").alias("owners"))
    live = materialize(counts.select("value", ((F.col("repos") <= live_repos) & (F.col("owners") <= live_owners)).alias("live")), "owners-of-values")
    told = attach_verdict(spans, live)
    by_row = told.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s.start", "s.kind", "s.end", "live"))).alias("told"))
    empty = F.array().cast("array<struct<start: long, kind: int, end: long, live: boolean>>")
    every = rows.select("row", "doc_id", "base_sha256").join(by_row, "row", "left").withColumn("told", F.coalesce("told", empty))
    kind = F.array(*map(F.lit, KINDS))
    listed = F.filter("told", lambda s: (s["kind"] < 3) | s["live"])
    number = lambda k: F.size(F.filter("told", lambda s: s["kind"] == k)).cast("long")
    text = F.array_join(F.transform(listed, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"], s["end"])), ",")
    return every.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), "base_sha256", text.alias("spans"), F.size(F.filter(listed, lambda s: s["kind"] == 3)).cast("long").alias("n_opaque"), F.size(F.filter("told", lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("told", lambda s: ~s["live"])).cast("long").alias("n_example"))


def attach_verdict(spans: DataFrame, live: DataFrame) -> DataFrame:
    """Each span with its value's verdict; spread by salt, as one value may be in most rows."""
    salts = salts_of(spans.sparkSession)
    salted = spans.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    used = salted.select("value", "salt").distinct().join(live, "value")
    return salted.join(used, ["value", "salt"])
