"""Quality classification by hierarchical empirical Bayes.

A document's own evidence is the log-likelihood ratio of binned text features under a naive Bayes model, counted
from labelled documents. Its prior comes from where it was found: the good shares of hosts shrink toward the
global share, those of paths toward their host's, each by a strength estimated from how much shares vary
(method of moments). Sparse sites stay near the prior above them; every level is a grouped aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import attach_group, materialize, utf8_slices, without_ids

#: Text features, each binned to 0..BINS-1.
FEATURES = ("upper_share", "symbol_share", "digit_share", "distinct_words", "repeated_words", "repeated_lines", "word_length", "stop_marks")
BINS = 32
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SYMBOLS[[ord(c) for c in ".,;:'\"-?()"]] = False
_LINE_SHORTEST = 20


def text_bins(text: str) -> list[int]:
    """The bins of one whole text; shares go on a square-root scale, so that small ones are told apart."""
    raw = text.encode("utf-8", "surrogatepass")
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n, n_words = max(1, len(raw)), max(1, len(words))
    upper, lower = int(h[65:91].sum()), int(h[97:123].sum())
    lines = [x for x in raw.split(b"\n") if len(x) >= _LINE_SHORTEST]
    # Each share has a few pseudo-counts of plain text in its denominator, so that a short text, whose shares mean little, looks plain.
    shares = (
        upper / (upper + lower + 60),
        int(h[_SYMBOLS].sum()) / (n + 40),
        int(h[48:58].sum()) / (n + 60),
        # Distinct words fall with a text's length: held against what Heaps' law (exponent 0.85) leaves.
        min(1.0, (len(set(words)) + 5) / (n_words + 5) ** 0.85),
        sum(map(bytes.__eq__, words, words[1:])) / (n_words + 5),
        (len(lines) - len(set(lines))) / (len(lines) + 2),
    )
    bins = [min(BINS - 1, int(BINS * math.sqrt(s))) for s in shares]
    length = (len(raw) + 6.0 * 15) / (n_words + 15)
    return [*bins, min(BINS - 1, int(2 * length)), min(BINS - 1, int(BINS * math.sqrt(int(h[[33, 46, 63]].sum()) / (n_words + 15))))]


def document_features(docs: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id, host, path, bins``: one row per input row; null places and texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in utf8_slices(batches, 3):
            bins = [text_bins(t or "") for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bins, pa.list_(pa.int32()))], ["doc_id", "host", "path", "bins"])

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("text"))
    found = named.mapInArrow(run, "doc_id long, host string, path string, bins array<int>")
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "quality-features")


def fit_evidence(labelled: DataFrame, smoothing: float = 0.1) -> tuple[float, list[list[float]]]:
    """The good share and, per feature and bin, the log-likelihood ratio good : bad.

    ``labelled(bins, good)``; all rows count. At most ``2 * BINS`` counts a feature come to the driver.
    """
    counts = np.zeros((2, len(FEATURES), BINS))
    for r in labelled.select("good", F.posexplode("bins").alias("f", "b")).groupBy("good", "f", "b").count().collect():
        counts[int(r["good"]), r["f"], r["b"]] = r["count"]
    totals = counts[:, 0, :].sum(axis=1)
    # Neighbouring bins lend each other weight, so that an unseen bin between seen ones is not neutral.
    blurred = counts + 0.25 * (np.pad(counts, ((0, 0), (0, 0), (1, 0)))[:, :, :-1] + np.pad(counts, ((0, 0), (0, 0), (0, 1)))[:, :, 1:])
    rates = (blurred + smoothing) / (blurred.sum(axis=2, keepdims=True) + smoothing * BINS)
    share = float((totals[1] + 1) / (totals.sum() + 2))
    return share, np.log(rates[1] / rates[0]).tolist()


def _logit(x: Column) -> Column:
    return F.log(x / (1 - x))


def _strength(sites: DataFrame, share: Column, center: Column) -> float:
    """How many documents a site's prior counts for: between-site variance against binomial noise, by moments.

    ``sites(n, good)``. One row comes to the driver. No spread beyond noise, or one site, gives a strong prior.
    """
    rate = F.col("good") / F.col("n")
    spread = sites.where("n > 1").agg(F.sum("n").alias("w"), F.sum(F.col("n") * F.pow(rate - center, 2)).alias("v"), F.sum(center * (1 - center)).alias("noise"), F.sum(F.col("n") * center * (1 - center)).alias("base")).first()
    if not spread["w"]:
        return 10.0
    base, between = spread["base"] / spread["w"], (spread["v"] - spread["noise"]) / spread["w"]
    return float(min(1000.0, max(2.0, base / between - 1))) if between > 1e-9 and base > 0 else 1000.0


def score_quality(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", threshold: float = 0.5) -> DataFrame:
    """``doc_id, host, path, evidence, host_rate, path_rate, quality, kept``: one row per input row.

    ``labels`` gives 0/1 labels of some documents (several for one id are averaged and rounded half up; nulls are
    ignored). A site's rate counts labels where there are any and the classifier's probability elsewhere,
    without the document that it serves as a prior for. ``kept`` is ``quality >= threshold``.

    Edge cases: a null or empty text has the bins of an empty text; a null host or path is a site of its own;
    without labels all evidence is 0 and every document is kept; repeated rows are scored each; an empty table gives
    an empty table; only the named columns are read.
    """
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.col("source"), F.col("lang")) if path is None else path
    feats = document_features(docs, host, path, id_col, text_col)
    truth = labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).cast("long").alias("doc_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("good"))
    known = feats.join(truth, "doc_id")
    mean, ratios = fit_evidence(known)
    table = F.array(*(F.array(*map(F.lit, f)) for f in ratios))
    evidence = F.aggregate(F.transform("bins", lambda b, i: F.get(F.get(table, i), b)), F.lit(0.0), lambda a, x: a + x)
    scored = feats.join(truth, "doc_id", "left").withColumn("evidence", evidence)
    own = F.coalesce(F.col("good").cast("double"), 1 / (1 + F.exp(-(F.col("evidence") + math.log(mean / (1 - mean))))))
    scored = materialize(scored.select("row", "doc_id", "host", "path", "evidence", own.alias("own")), "quality-evidence")

    sites = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("own").alias("good"))
    hosts = sites.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    overall = F.lit(mean)
    k_host = _strength(hosts, overall, overall)
    host_rate = (F.col("good") + k_host * mean) / (F.col("n") + k_host)
    nested = sites.join(hosts.select("host", host_rate.alias("rate")), "host")
    k_path = _strength(nested, overall, F.col("rate"))

    at_host = attach_group(scored, ["host"], "row", [F.count("*").alias("host_n"), F.sum("own").alias("host_good")])
    at_path = attach_group(at_host, ["host", "path"], "row", [F.count("*").alias("path_n"), F.sum("own").alias("path_good")])
    rest = lambda level: (F.greatest(F.lit(0.0), F.col(f"{level}_good") - F.col("own")), F.col(f"{level}_n") - 1)
    good, n = rest("host")
    rated = at_path.withColumn("host_rate", (good + k_host * mean) / (n + k_host))
    good, n = rest("path")
    rated = rated.withColumn("path_rate", (good + k_path * F.col("host_rate")) / (n + k_path))
    bounded = F.least(F.greatest("path_rate", F.lit(1e-6)), F.lit(1 - 1e-6))
    quality = 1 / (1 + F.exp(-(_logit(bounded) + F.col("evidence"))))
    return rated.withColumn("quality", quality).select("doc_id", "host", "path", "evidence", "host_rate", "path_rate", "quality", (F.col("quality") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not rejected; an id with several rows goes only if all are rejected."""
    scored = score_quality(docs, labels, id_col=id_col, **settings).select(F.col("doc_id").alias("__gone"), "kept")
    gone = scored.groupBy("__gone").agg(F.bool_or("kept").alias("any")).where("NOT any").select("__gone")
    return without_ids(docs, id_col, materialize(gone, "rejected"))
