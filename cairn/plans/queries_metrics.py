"""Queries: evaluation metrics, bootstrap, histories, tile statistics and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import bootstrap, features, merge, metrics, sampling
from cairn.plans.queries_labels import KEY, U, r6
from cairn.plans.registry import Tables, query, rnd
from cairn.streaming import streams

K = 9
M = ["miou", "macc", "oa", "mf1", "fwiou", "kappa"]
EPS = "1e-10::DOUBLE"


def seg_sql(counts: str, by: str, absent: str = "zero") -> str:
    """SQL of the metrics of a count table with columns by, class, i, p, t."""
    mean = (lambda x: f"avg({x}) FILTER (u > 0)") if absent == "skip" else (lambda x: f"sum({x}) / {K}::DOUBLE")
    group = f"{by}, " if by else ""
    return (
        f"SELECT {group}{rnd(mean('iou'))} AS miou, {rnd(mean('rec'))} AS macc, {rnd(f'sum(i) / (sum(t) + {EPS})')} AS oa, {rnd(mean('f1'))} AS mf1, {rnd(f'sum(t * iou) / (sum(t) + {EPS})')} AS fwiou, "
        f"{rnd(f'(sum(i) / (sum(t) + {EPS}) - sum(p * t) / (sum(t) * sum(t) + {EPS})) / (1 - sum(p * t) / (sum(t) * sum(t) + {EPS}) + {EPS})')} AS kappa FROM ("
        f"SELECT *, 2 * pre * rec / (pre + rec + {EPS}) AS f1 FROM (SELECT *, i / (u + {EPS}) AS iou, i / (p + {EPS}) AS pre, i / (t + {EPS}) AS rec FROM (SELECT {group}class, CAST(i AS DOUBLE) AS i, CAST(p AS DOUBLE) AS p, CAST(t AS DOUBLE) AS t, CAST(p + t - i AS DOUBLE) AS u FROM {counts})))" + (f" GROUP BY {by}" if by else "")
    )


def counts_sql(rows: str, by: str = "", target: str = "classification", pred: str = "pred") -> str:
    g = f"{by}, " if by else ""
    return f"(SELECT {g}class, sum(i) AS i, sum(p) AS p, sum(t) AS t FROM (SELECT {g}{target} AS class, CASE WHEN {target} = {pred} THEN 1 ELSE 0 END AS i, 0 AS p, 1 AS t FROM {rows} UNION ALL SELECT {g}{pred}, 0, 1, 0 FROM {rows}) GROUP BY {g}class)"


def merged(t: Tables) -> DataFrame:
    """Original points after the overlap vote of labels and predictions."""
    votes = merge.merge_vote(t.pts, "classification", ["source_block", "orig_idx"]).withColumnRenamed("classification", "target")
    return votes.join(merge.merge_vote(t.pts, "pred", ["source_block", "orig_idx"]), ["source_block", "orig_idx"])


def flagship(t: Tables) -> DataFrame:
    """Merge overlapping tiles by vote, then metrics per source block and overall."""
    return r6(metrics.metrics_by(merged(t), ["source_block"], K), *M).na.fill(-1, ["source_block"])


def _vote(c: str) -> str:
    return f"(SELECT source_block, orig_idx, {c} FROM (SELECT source_block, orig_idx, {c}, row_number() OVER (PARTITION BY source_block, orig_idx ORDER BY count(*) DESC, {c}) AS k FROM pts GROUP BY 1, 2, 3) WHERE k = 1)"


MERGED = f"m AS (SELECT source_block, orig_idx, classification AS target, pred FROM {_vote('classification')} JOIN {_vote('pred')} USING (source_block, orig_idx))"
query("m00_merge_then_metrics", flagship, f"SELECT source_block, 0 AS overall, {', '.join(M)} FROM ({seg_sql(counts_sql('m', 'source_block', 'target'), 'source_block')}) UNION ALL SELECT -1, 1, {', '.join(M)} FROM ({seg_sql(counts_sql('m', '', 'target'), '')})", MERGED)
PT = lambda t: t.pts.withColumnRenamed("classification", "target")
query("a13_iou_counts", lambda t: metrics.iou_counts(PT(t), K, ["tile"], ignore=3).select("tile", "class", "intersection", "n_pred", "n_target", "union"), f"SELECT tile, class, CAST(i AS BIGINT) AS intersection, CAST(p AS BIGINT) AS n_pred, CAST(t AS BIGINT) AS n_target, CAST(p + t - i AS BIGINT) AS \"union\" FROM {counts_sql('(SELECT * FROM pts WHERE classification <> 3)', 'tile')}")
query("a14_confusion", lambda t: r6(metrics.confusion(PT(t), ["source_block"]), "share"), f"SELECT source_block, classification AS target, pred, count(*) AS n, {rnd('count(*) / sum(count(*)) OVER (PARTITION BY source_block, classification)')} AS share FROM pts GROUP BY 1, 2, 3")
query("a15_class_metrics", lambda t: r6(metrics.class_metrics(metrics.iou_counts(PT(t), K)).select("class", "iou", "precision", "recall", "f1"), "iou", "precision", "recall", "f1"), f"SELECT class, {rnd(f'i / (p + t - i + {EPS})')} AS iou, {rnd(f'i / (p + {EPS})')} AS precision, {rnd(f'i / (t + {EPS})')} AS recall, {rnd('2.0 * i / (p + t)')} AS f1 FROM {counts_sql('pts')}")
query("a16_metrics_skip_absent", lambda t: r6(metrics.seg_metrics(metrics.iou_counts(PT(t), K, ["tile"]), K, ["tile"], "skip"), *M), seg_sql(counts_sql("pts", "tile"), "tile", "skip"))
query("a17_binary_metrics", lambda t: r6(metrics.binary_metrics(PT(t), [2, 5]), "iou", "precision", "recall", "f1"), f"SELECT c AS class, {rnd('tp / (tp + fp + fn)')} AS iou, {rnd('tp / (tp + fp)')} AS precision, {rnd('tp / (tp + fn)')} AS recall, {rnd('2.0 * tp / (2 * tp + fp + fn)')} AS f1, tp + fn AS support FROM (SELECT c, count(*) FILTER (classification = c AND pred = c) AS tp, count(*) FILTER (classification <> c AND pred = c) AS fp, count(*) FILTER (classification = c AND pred <> c) AS fn FROM pts, (VALUES (2), (5)) v(c) GROUP BY 1)")
query("a17_label_metrics", lambda t: r6(metrics.binary_metrics(t("labels"), [0, 1], "quality", "toxic"), "iou", "precision", "recall", "f1"), f"SELECT c AS class, {rnd('CASE WHEN tp + fp + fn = 0 THEN 0 ELSE tp / (tp + fp + fn) END')} AS iou, {rnd('CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END')} AS precision, {rnd('CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END')} AS recall, {rnd('CASE WHEN tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END')} AS f1, tp + fn AS support FROM (SELECT c, count(*) FILTER (quality = c AND toxic = c) AS tp, count(*) FILTER (quality <> c AND toxic = c) AS fp, count(*) FILTER (quality = c AND toxic <> c) AS fn FROM labels, (VALUES (0), (1)) v(c) GROUP BY 1)")
query("a18_metrics_by_region", lambda t: r6(metrics.metrics_by(PT(t).withColumn("region", (F.col("orig_idx") % 3).cast("int")), ["region"], K), *M).na.fill(-1, ["region"]), f"SELECT region, 0 AS overall, {', '.join(M)} FROM ({seg_sql(counts_sql('q', 'region'), 'region')}) UNION ALL SELECT -1, 1, {', '.join(M)} FROM ({seg_sql(counts_sql('q'), '')})", "q AS (SELECT *, CAST(orig_idx % 3 AS INT) AS region FROM pts)")
query("a19_mismatch_summary", lambda t: metrics.mismatch_summary(PT(t), ["source_block", "number_of_returns"]), "SELECT source_block, number_of_returns, classification AS target, pred, count(*) AS n FROM pts WHERE classification <> pred GROUP BY 1, 2, 3, 4")
query("a20_region_profile", lambda t: r6(metrics.region_profile(t.pts.withColumn("region", (F.col("orig_idx") % 3).cast("int")), "region", ["tile", "classification"], [0, 1, 2]).withColumn("level", F.col("level").cast("long")), "ratio_0", "ratio_1", "ratio_2").na.fill(-1, ["tile", "classification"]), "SELECT coalesce(tile, -1) AS tile, coalesce(classification, -1) AS classification, CAST(grouping(tile, classification) AS BIGINT) AS level, count(*) AS n, " + ", ".join(f"count(*) FILTER (orig_idx % 3 = {r}) AS n_{r}, {rnd(f'count(*) FILTER (orig_idx % 3 = {r}) / count(*)')} AS ratio_{r}" for r in range(3)) + " FROM pts GROUP BY ROLLUP (tile, classification)")
query("a25_pool_folds", lambda t: r6(metrics.pool_folds(metrics.iou_counts(PT(t).withColumn("fold", F.col("tile") % 6), K, ["fold"]), K).withColumn("pooled", F.col("pooled").cast("int")), *M).na.fill(-1, ["fold"]), f"SELECT fold, 0 AS pooled, {', '.join(M)} FROM ({seg_sql(counts_sql('q', 'fold'), 'fold')}) UNION ALL SELECT -1, 1, {', '.join(M)} FROM ({seg_sql(counts_sql('q'), '')})", "q AS (SELECT *, tile % 6 AS fold FROM pts)")


def _probs(t: Tables) -> DataFrame:
    """Class probabilities of overlapping fragments: every row votes for two classes."""
    rows = F.explode(F.array(F.struct(F.col("pred").alias("class"), F.lit(0.625).alias("p")), F.struct(F.col("classification").alias("class"), F.lit(0.25).alias("p")), F.struct(F.lit(9).alias("class"), F.lit(0.125).alias("p"))))
    return t.pts.select("source_block", "orig_idx", rows.alias("s")).select("source_block", "orig_idx", "s.class", "s.p")


PROBS = "pr AS (SELECT source_block, orig_idx, pred AS class, 0.625::DOUBLE AS p FROM pts UNION ALL SELECT source_block, orig_idx, classification, 0.25::DOUBLE FROM pts UNION ALL SELECT source_block, orig_idx, 9, 0.125::DOUBLE FROM pts)"
query("a26_vote", lambda t: metrics.vote(_probs(t), ["source_block", "orig_idx"]), "SELECT source_block, orig_idx, class AS pred FROM (SELECT source_block, orig_idx, class, row_number() OVER (PARTITION BY source_block, orig_idx ORDER BY sum(p) DESC, class) AS k FROM pr GROUP BY 1, 2, 3) WHERE k = 1", PROBS)
query("t01_topk_classes", lambda t: metrics.topk_classes(_probs(t).groupBy("source_block", "orig_idx", "class").agg(F.sum("p").alias("p")), ["source_block", "orig_idx"], 2), "SELECT * FROM (SELECT source_block, orig_idx, class, sum(p) AS p, CAST(row_number() OVER (PARTITION BY source_block, orig_idx ORDER BY sum(p) DESC, class) AS INT) AS rank FROM pr GROUP BY 1, 2, 3) WHERE rank <= 2", PROBS)
query("a27_mean_pred", lambda t: r6(metrics.mean_pred(t.pts.withColumnRenamed("z", "value"), ["source_block", "orig_idx"]), "value"), f"SELECT source_block, orig_idx, {rnd('avg(z)')} AS value, count(z) AS n FROM pts GROUP BY 1, 2")
REG = lambda t: t.pts.select("tile", F.col("x").alias("target"), F.col("y").alias("pred"))
query("a28_reg_pooled", lambda t: r6(metrics.reg_metrics(REG(t)), "mae", "rmse", "r2"), f"SELECT count(*) AS n, {rnd('avg(abs(y - x))')} AS mae, {rnd('sqrt(avg((y - x) * (y - x)))')} AS rmse, {rnd('1 - sum((y - x) * (y - x)) / (sum(x * x) - sum(x) * sum(x) / count(*))')} AS r2 FROM pts")
query("a28_reg_weighted", lambda t: r6(metrics.reg_metrics(REG(t), tile="tile"), "mae", "rmse", "r2"), f"SELECT CAST(sum(n) AS BIGINT) AS n, {rnd('sum(n * mae) / sum(n)')} AS mae, {rnd('sum(n * rmse) / sum(n)')} AS rmse, {rnd('sum(n * r2) / sum(n)')} AS r2 FROM (SELECT count(*) AS n, avg(abs(y - x)) AS mae, sqrt(avg((y - x) * (y - x))) AS rmse, 1 - sum((y - x) * (y - x)) / greatest(sum(x * x) - sum(x) * sum(x) / count(*), {EPS}) AS r2 FROM pts GROUP BY tile)")


def _parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.pts.select(F.col("tile").alias("shape"), (F.col("tile") % 3).alias("category"), (F.col("classification") % 4).alias("target"), (F.col("pred2") % 4).alias("pred"))
    parts = rows.select("category").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("part < 4 OR category = 1")
    return rows, parts


_PART = "ps AS (SELECT tile AS shape, tile % 3 AS category, classification % 4 AS target, pred2 % 4 AS pred FROM pts), pi AS (SELECT shape, category, avg(CASE WHEN un = 0 THEN 1.0::DOUBLE ELSE i / un END) AS iou FROM (SELECT s.shape, s.category, part, count(*) FILTER (target = part AND pred = part) AS i, count(*) FILTER (target = part OR pred = part) AS un FROM ps s JOIN range(0, 5) r(part) ON part < 4 OR category = 1 GROUP BY 1, 2, 3) GROUP BY 1, 2)"
query("a29_part_iou", lambda t: r6(metrics.part_iou(*_parts(t)), "iou"), f"SELECT shape, category, {rnd('iou')} AS iou FROM pi", _PART)
query("a29_part_means", lambda t: r6(metrics.part_means(metrics.part_iou(*_parts(t))), "instance_iou", "category_iou"), f"SELECT {rnd('(SELECT avg(iou) FROM pi)')} AS instance_iou, {rnd('(SELECT avg(c) FROM (SELECT avg(iou) AS c FROM pi GROUP BY category))')} AS category_iou", _PART)


def _instances(t: Tables) -> tuple[DataFrame, DataFrame]:
    gt = t.pts.select(F.col("tile").alias("scene"), F.expr("point_id * 10 + 0").alias("point_id"), F.col("classification").alias("segment"), F.when(F.col("return_number") == 4, -1).otherwise(F.col("classification")).cast("long").alias("instance"))
    pred = t.pts.select(F.col("tile").alias("scene"), F.expr("point_id * 10 + 0").alias("point_id"), F.col("pred2").cast("long").alias("pred_id"), F.col("pred2").alias("class"), (F.lit(1.0) / F.col("pred2")).alias("score"))
    return pred, gt


query("j21_match_instances", lambda t: metrics.match_instances(*_instances(t)).select("scene", "class", "pred_id", "instance", "both", "n_pred", "n_gt", "n_void"), "SELECT scene, CAST(pred_id AS INT) AS class, CAST(pred_id AS BIGINT) AS pred_id, instance, coalesce(\"both\", 0) AS \"both\", n_pred, n_gt, n_void FROM iz LEFT JOIN io USING (scene, pred_id) LEFT JOIN ig USING (scene, segment, instance)", """ia AS (SELECT tile AS scene, point_id, classification AS segment, CAST(CASE WHEN return_number = 4 THEN -1 ELSE classification END AS BIGINT) AS instance, pred2 AS pred_id FROM pts),
ij AS (SELECT p.scene, p.pred_id, g.segment, g.instance FROM ia p JOIN ia g USING (scene, point_id)),
iz AS (SELECT scene, pred_id, count(*) AS n_pred, count(*) FILTER (instance < 0) AS n_void FROM ij GROUP BY 1, 2),
io AS (SELECT scene, pred_id, segment, instance, count(*) AS "both" FROM ij WHERE segment = pred_id AND instance >= 0 GROUP BY 1, 2, 3, 4),
ig AS (SELECT scene, segment, instance, count(*) AS n_gt FROM ia WHERE instance >= 0 GROUP BY 1, 2, 3)""")
query("a30_instance_ap", lambda t: r6(metrics.instance_ap(*_instances(t), least=10), "ap"))
query("a58_cls_metrics", lambda t: r6(metrics.cls_metrics(PT(t), ["source_block"]), "oa", "macc"), f"SELECT source_block, {rnd('sum(h) / sum(n)')} AS oa, {rnd('avg(h / n)')} AS macc FROM (SELECT source_block, classification, count(*) AS n, count(*) FILTER (classification = pred) AS h FROM pts GROUP BY 1, 2) GROUP BY 1")
query("a58_best_run", lambda t: r6(metrics.best_run(metrics.cls_metrics(PT(t), ["tile"]), "tile", "oa"), "oa"), f"SELECT arg_min(tile, (-oa, tile)) AS tile, {rnd('max(oa)')} AS oa FROM (SELECT tile, count(*) FILTER (classification = pred) / count(*) AS oa FROM pts GROUP BY 1)")
query("a39_cosine_summary", lambda t: r6(metrics.cosine_summary(t.pts.withColumn("cosine", F.col("z")), by=["source_block"]), "mean", "std", "p10", "p50", "p90"), f"SELECT source_block, {rnd('avg(z)')} AS mean, {rnd('stddev_pop(z)')} AS std, {rnd('quantile_cont(z, 0.1)')} AS p10, {rnd('quantile_cont(z, 0.5)')} AS p50, {rnd('quantile_cont(z, 0.9)')} AS p90 FROM pts GROUP BY 1")
query("j22_pair_predictions", lambda t: metrics.pair_predictions(PT(t), PT(t).withColumn("pred", F.col("pred2")), KEY), "SELECT tile, point_id, classification AS target, pred AS pred_a, pred2 AS pred_b FROM pts")


def _pairs(t: Tables) -> DataFrame:
    return PT(t).select("source_block", "tile", "target", F.col("pred2").alias("pred_a"), F.col("pred").alias("pred_b"), (F.col("return_number") == 1).alias("stratum"))


_DRAW = f"blk AS (SELECT tile, row_number() OVER (ORDER BY tile) - 1 AS i, count(*) OVER () AS nb FROM (SELECT DISTINCT tile FROM pts)), dr AS (SELECT b, CAST(floor({U(42, 'b', 's')} * nb) AS BIGINT) AS i, count(*) AS w FROM (SELECT DISTINCT nb FROM blk), range(0, 50) x(b), range(0, 1000) y(s) WHERE s < nb GROUP BY 1, 2), dw AS (SELECT b, tile, w FROM dr JOIN blk USING (i))"


def _boot(pred: str, alias: str, extra: str = "") -> str:
    e = f"{extra}, " if extra else ""
    return f"(SELECT b, {e}sum(i / (p + t - i + {EPS})) / {K}::DOUBLE AS {alias} FROM (SELECT b, {e}class, sum(w * i) AS i, sum(w * p) AS p, sum(w * t) AS t FROM {counts_sql('st', 'tile' + (', ' + extra if extra else ''), 'classification', pred)} JOIN dw USING (tile) GROUP BY b, {e}class) GROUP BY b{', ' + extra if extra else ''})"


def _ci(v: str, src: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    return f"SELECT {g}count({v}) AS n, {rnd(f'avg({v})')} AS mean, {rnd(f'quantile_cont({v}, 0.025)')} AS low, {rnd(f'quantile_cont({v}, 0.975)')} AS high, {rnd(f'avg(CASE WHEN {v} > 0 THEN 1.0::DOUBLE ELSE 0.0 END)')} AS p_above FROM {src}" + (f" GROUP BY {by}" if by else "")


CI = ["mean", "low", "high", "p_above"]
_ST = "st AS (SELECT *, return_number = 1 AS stratum FROM pts), " + _DRAW
query("a22_block_bootstrap", lambda t: r6(bootstrap.block_bootstrap(_pairs(t), "tile", K, times=50), *CI), _ci("d", f"(SELECT x.a, y.c - x.a AS d FROM {_boot('pred2', 'a')} x JOIN {_boot('pred', 'c')} y USING (b))"), _ST)
query("a23_bootstrap_did", lambda t: r6(bootstrap.block_bootstrap_did(_pairs(t), "tile", "stratum", K, times=50), *CI), _ci("d", f"(SELECT b, sum((c - a) * CASE WHEN stratum THEN 1 ELSE -1 END) AS d FROM {_boot('pred2', 'a', 'stratum')} x JOIN {_boot('pred', 'c', 'stratum')} y USING (b, stratum) GROUP BY b)"), _ST)


def _rates(t: Tables) -> DataFrame:
    return t.pts.groupBy("tile", (F.col("orig_idx") % 2).alias("grp")).agg(F.count_if(F.col("pred2") != F.col("classification")).alias("hits"), F.count("*").alias("total"))


_RT = "rt AS (SELECT tile, orig_idx % 2 AS grp, count(*) FILTER (pred2 <> classification) AS hits, count(*) AS total FROM pts GROUP BY 1, 2), " + _DRAW
query("a24_rate_bootstrap", lambda t: r6(bootstrap.rate_bootstrap(_rates(t), "tile", "hits", "total", "grp", 50), *CI), _ci("rate", "(SELECT b, grp, sum(w * hits) / sum(w * total) AS rate FROM rt JOIN dw USING (tile) GROUP BY 1, 2)", "grp"), _RT)
query("a24_rate_gap", lambda t: r6(bootstrap.rate_gap_bootstrap(_rates(t), "tile", "hits", "total", "grp", 1, 0, 50), *CI), _ci("d", "(SELECT b, sum(w * hits) FILTER (grp = 1) / sum(w * total) FILTER (grp = 1) - sum(w * hits) FILTER (grp = 0) / sum(w * total) FILTER (grp = 0) AS d FROM rt JOIN dw USING (tile) GROUP BY 1)"), _RT)

# --- histories ------------------------------------------------------------------------------------------------------
HIST = lambda t: t("events").select(F.col("event_type").alias("run"), F.lit("value").alias("name"), F.col("event_id").alias("iter"), F.col("value").alias("value"))
query("w12_smooth_metric", lambda t: r6(sampling.smooth_metric(HIST(t), 5), "median", "mean", "running").select("run", "iter", "median", "mean", "running"), f"SELECT event_type AS run, event_id AS iter, {rnd('quantile_cont(value, 0.5) OVER w')} AS median, {rnd('avg(value) OVER w')} AS mean, {rnd('avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)')} AS running FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS 4 PRECEDING)")
query("w15_best_epoch", lambda t: sampling.best_epoch(HIST(t), planned=100), "SELECT event_type AS run, max(value) AS best, arg_min(event_id, (-value, event_id)) AS best_epoch, count(*) AS epochs, arg_max(value, event_id) AS final, count(*) < 100 AS stopped FROM events GROUP BY 1")
query("r04_early_stop", lambda t: streams.early_stop_batch(HIST(t), streams.EarlyStop(patience=5)))
query("r03_windowed_metrics", lambda t: r6(streams.windowed_metrics(t("events"), "ts", ["event_type"], "value", "1 day"), "mean").select("window_start", "event_type", "n", "mean"), f"SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, {rnd('avg(value)')} AS mean FROM events GROUP BY 1, 2")
query("r03_session_metrics", lambda t: r6(streams.windowed_metrics(t("events"), "ts", ["user_id"], "value", "", gap="6 hours"), "mean").select("window_start", "user_id", "n", "mean"), f"SELECT min(ts) AS window_start, user_id, count(*) AS n, {rnd('avg(value)')} AS mean FROM (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, sid")
query("r05_dedup_points", lambda t: streams.dedup_points(t.pts.select("source_block", "orig_idx"), ["source_block", "orig_idx"], "ts"), "SELECT DISTINCT source_block, orig_idx FROM pts")
query("r02_running_confusion", lambda t: r6(streams.confusion_metrics(streams.running_confusion(PT(t)), K), *M), seg_sql(counts_sql("pts"), ""))

# --- tiles and classes ------------------------------------------------------------------------------------------------
CLS = list(range(1, 9))
_SHARES = ", ".join(f"count(*) FILTER (classification = {c}) AS n_{c}, {rnd(f'count(*) FILTER (classification = {c}) / count(*)')} AS share_{c}" for c in CLS)
_ENT_RAW = " + ".join(f"CASE WHEN count(*) FILTER (classification = {c}) > 0 THEN -(count(*) FILTER (classification = {c}) / count(*)) * ln(count(*) FILTER (classification = {c}) / count(*)) ELSE 0 END" for c in CLS)
_ENT = rnd(_ENT_RAW)
query("a10_tile_stats", lambda t: r6(features.tile_stats(t.pts, CLS), "z_p01", "z_p50", "z_p99", "z_span", "entropy", *(f"share_{c}" for c in CLS)), f"SELECT tile, count(*) AS points, {rnd('quantile_cont(z, 0.01)')} AS z_p01, {rnd('quantile_cont(z, 0.5)')} AS z_p50, {rnd('quantile_cont(z, 0.99)')} AS z_p99, {rnd('quantile_cont(z, 0.99) - quantile_cont(z, 0.01)')} AS z_span, {_SHARES}, {_ENT} AS entropy FROM pts GROUP BY 1")
query("a09_class_counts", lambda t: features.class_counts(t.pts, 0.5, 3), f"SELECT classification, count(*) AS n FROM pts WHERE {U(3, 'tile')} < 0.5 GROUP BY 1")
_METHODS = {"inverse": "1 / (n / tot + 1e-6)", "sqrt": "1 / (sqrt(n / tot) + 1e-6)", "log": "1 / (ln(1 + n / tot) + 1e-6)", "balanced": "tot / (k * n)", "effective": "(1 - 0.9999::DOUBLE) / (1 - pow(0.9999::DOUBLE, n) + 1e-6)"}


def _weights(t: Tables) -> DataFrame:
    counts = features.class_counts(t.pts)
    out = None
    for m in _METHODS:
        part = features.class_weights(counts, m).withColumn("method", F.lit(m))
        out = part if out is None else out.unionByName(part)
    return r6(out.select("method", "classification", "weight"), "weight")


query("a11_class_weights", _weights, " UNION ALL ".join(f"SELECT '{m}' AS method, classification, {rnd('w' if m in ('balanced', 'effective') else 'w * k / sum(w) OVER ()')} AS weight FROM (SELECT *, {e} AS w FROM cc)" for m, e in _METHODS.items()), "cc AS (SELECT classification, CAST(count(*) AS DOUBLE) AS n, sum(count(*)) OVER () AS tot, count(*) OVER () AS k FROM pts GROUP BY 1)")
#: An order is a tile here: it has some of the classes.
_ORDER = "CAST(floor(orig_idx / 8) AS BIGINT)"
query("a12_tile_weights", lambda t: r6(features.tile_weights(t.pts.withColumn("tile", F.expr(_ORDER)), features.class_weights(features.class_counts(t.pts), normalise=False)), "weight"), f"SELECT tile, {rnd('w * count(*) OVER () / sum(w) OVER ()')} AS weight FROM (SELECT tile, sum(wt) AS w FROM (SELECT DISTINCT {_ORDER} AS tile, classification FROM pts) JOIN (SELECT classification, 1 / (count(*) / (SELECT count(*) FROM pts) + 1e-6) AS wt FROM pts GROUP BY 1) USING (classification) GROUP BY 1)")


#: The tables have classes 1 to 8 in like shares: weighted by the tile's number, so that every rule has tiles.
_MIX = {2: "share_2 * (1 + tile % 7)", 3: "share_3 * (tile % 6)", 6: "share_6 * (tile % 4) / 2.0", 9: "share_7 * (tile % 3)", 17: "CASE WHEN tile % 11 = 0 THEN share_8 * 0.01 ELSE 0.0 END"}


def _mix(c: int):
    return F.expr(_MIX[c]).cast("double") if c in _MIX else F.lit(0.0)


def _classed(t: Tables) -> DataFrame:
    st = features.tile_stats(t.pts, CLS).join(features.scene_measures(t.pts, least=5), "tile")
    group = features.scene_group(_mix, F.col("relief") / 16, F.col("roof_top") / 4)
    return st.withColumn("environment", features.environment(_mix)).withColumn("scene_group", group).withColumn("priority", features.priority(F.col("points"), F.col("entropy"), F.col("z_span"), _mix))


_CL = f"""ts AS (SELECT tile, count(*) AS points, quantile_cont(z, 0.99) - quantile_cont(z, 0.01) AS span, {', '.join(f'count(*) FILTER (classification = {c}) / count(*) AS share_{c}' for c in CLS)},
  CASE WHEN count(*) FILTER (classification = 2) >= 5 THEN (quantile_cont(z, 0.98) FILTER (classification = 2) - quantile_cont(z, 0.02) FILTER (classification = 2)) / 16 ELSE 1e300 END AS relief, (quantile_cont(z, 0.9) FILTER (classification = 6)) / 4 AS roof_top, {_ENT_RAW} AS entropy FROM pts GROUP BY 1),
cm AS (SELECT *, {', '.join(f'CAST({e} AS DOUBLE) AS p{c}' for c, e in _MIX.items())} FROM ts),
cl AS (SELECT tile, points, CASE WHEN p17 >= 5e-4 THEN 'rare_infrastructure' WHEN p9 >= 0.2 THEN 'water' WHEN p6 >= 0.2 THEN 'urban' WHEN p3 >= 0.55 AND p6 < 0.05 THEN 'dense_vegetation' WHEN p2 >= 0.75 AND p6 < 0.03 THEN 'open_ground' WHEN p6 >= 0.03 THEN 'suburban' ELSE 'mixed' END AS environment,
  CASE WHEN p6 >= 0.15 AND roof_top >= 15 THEN 'Tall-building' WHEN p6 >= 0.15 THEN 'Low-rise built' WHEN p3 >= 0.6 THEN 'Dense canopy' WHEN p2 >= 0.75 AND p3 < 0.05 AND p6 < 0.05 AND relief <= 5 THEN 'Flat bare ground' WHEN p3 >= 0.15 AND p3 < 0.6 AND p2 < 0.75 THEN 'Sparse vegetation' ELSE 'Mixed / other' END AS scene_group,
  {rnd('entropy + 0.1 * ln(1 + points) + 0.02 * span + 0.3 * (CAST(p2 > 0 AS INT) + CAST(p3 > 0 AS INT) + CAST(p6 > 0 AS INT) + CAST(p9 > 0 AS INT) + CAST(p17 > 0 AS INT)) + 20 * p17')} AS priority FROM cm)"""
query("p26_tile_classes", lambda t: r6(_classed(t).select("tile", "environment", "scene_group", "priority"), "priority"), "SELECT tile, environment, scene_group, priority FROM cl", _CL)
query("a21_scene_stats", lambda t: r6(features.scene_stats(_classed(t), "scene_group", regions=["n_1", "n_2"]), "ratio_n_1", "ratio_n_2"), f"SELECT scene_group, count(*) AS tiles, CAST(sum(points) AS BIGINT) AS points, CAST(sum(n1) AS BIGINT) AS n_1, CAST(sum(n2) AS BIGINT) AS n_2, {rnd('sum(n1) / sum(n1 + n2)')} AS ratio_n_1, {rnd('sum(n2) / sum(n1 + n2)')} AS ratio_n_2 FROM cl JOIN (SELECT tile, count(*) FILTER (classification = 1) AS n1, count(*) FILTER (classification = 2) AS n2 FROM pts GROUP BY 1) USING (tile) GROUP BY 1", _CL)


def _greedy(n: int, cap: int, classes: list[str]) -> tuple[str, str]:
    """SQL of the greedy tile selection, a table per step, and the name of the last one."""
    room, best = f"{cap} - (SELECT count(*) FROM %s u WHERE u.block = s.block)", "ORDER BY priority DESC, tile"
    steps = [f"g0 AS MATERIALIZED (SELECT tile, block, environment, 'block' AS reason FROM cand QUALIFY row_number() OVER (PARTITION BY block {best}) = 1)"]
    for c in classes:
        was = f"g{len(steps) - 1}"
        steps.append(f"g{len(steps)} AS MATERIALIZED (SELECT * FROM {was} UNION ALL SELECT tile, block, environment, 'class {c}' FROM (SELECT * FROM cand WHERE {c} > 0 ORDER BY {c} DESC, tile LIMIT 1) s WHERE tile NOT IN (SELECT tile FROM {was}) AND {room % was} > 0)")
    for e, quota in [*((e, max(1, round(n * share))) for e, share in sampling.ENVIRONMENT_SHARES.items()), (None, n)]:
        was, own = f"g{len(steps) - 1}", "true" if e is None else f"environment = '{e}'"
        bound = f"greatest(0, least({quota} - (SELECT count(*) FROM {was} WHERE {own}), {n} - (SELECT count(*) FROM {was})))"
        ranked = f"SELECT *, row_number() OVER (PARTITION BY block {best}) AS r FROM cand WHERE {own} AND tile NOT IN (SELECT tile FROM {was})"
        fits = f"SELECT tile, block, environment, row_number() OVER ({best}) AS place FROM ({ranked}) s WHERE r <= {room % was}"
        steps.append(f"g{len(steps)} AS MATERIALIZED (SELECT * FROM {was} UNION ALL SELECT tile, block, environment, '{'fill' if e is None else 'environment'}' FROM ({fits}) WHERE place <= {bound})")
    return ", ".join(steps), f"g{len(steps) - 1}"


_STEPS, _LAST = _greedy(20, 3, ["n_1", "n_2"])
_CAND = "cand AS MATERIALIZED (SELECT tile, tile % 10 AS block, environment, priority, n_1, n_2 FROM cl JOIN (SELECT tile, count(*) FILTER (classification = 1) AS n_1, count(*) FILTER (classification = 2) AS n_2 FROM pts GROUP BY 1) USING (tile))"
query("t05_select_tiles", lambda t: sampling.select_tiles(r6(_classed(t), "priority").withColumn("source_block", F.col("tile") % 10), 20, 3, classes=["n_1", "n_2"]).select("tile", "reason"), f"SELECT tile, reason FROM {_LAST}", f"{_CL}, {_CAND}, {_STEPS}")
query("a57_dataset_scale", lambda t: r6(features.dataset_scale(t.pts, ["source_block"]), "area", "density").withColumn("classes", F.col("classes").cast("long")), f"SELECT source_block, CAST(sum(n) AS BIGINT) AS points, count(*) AS tiles, {rnd('sum(a)')} AS area, max(k) AS classes, {rnd('sum(n) / sum(a)')} AS density FROM (SELECT source_block, tile, count(*) AS n, (max(x) - min(x)) * (max(y) - min(y)) AS a FROM pts GROUP BY 1, 2) JOIN (SELECT source_block, count(DISTINCT classification) AS k FROM pts GROUP BY 1) USING (source_block) GROUP BY 1")
query("a56_curve_auc", lambda t: r6(sampling.curve_auc(t.pts.groupBy((F.col("tile") % 4).alias("method"), (F.col("return_number") / 4.0).alias("fraction")).agg(F.avg("x").alias("miou"))), "auc"), f"SELECT method, {rnd('auc')} AS auc, CAST(rank() OVER (ORDER BY auc DESC) AS INT) AS place FROM (SELECT method, sum((lx - px) * (m + pm) / 2) / (max(lx) - min(lx)) AS auc FROM (SELECT *, lag(lx) OVER w AS px, lag(m) OVER w AS pm FROM (SELECT tile % 4 AS method, log10(return_number / 4.0::DOUBLE) AS lx, avg(x) AS m FROM pts GROUP BY 1, 2) WINDOW w AS (PARTITION BY method ORDER BY lx)) GROUP BY 1)")
query("t19_rank_by", lambda t: sampling.rank_by(t.pts.groupBy("source_block", "tile").agg(F.count("*").alias("n")), "n", ["source_block"]), "SELECT source_block, tile, count(*) AS n, CAST(rank() OVER (PARTITION BY source_block ORDER BY count(*) DESC) AS INT) AS place FROM pts GROUP BY 1, 2")
query("t04_keep_largest", lambda t: sampling.keep_largest(t.pts.groupBy("tile").agg(F.count("*").alias("n")), 5, ties=["tile"]), "SELECT tile, count(*) AS n FROM pts GROUP BY 1 ORDER BY n DESC, tile LIMIT 5")
query("j18_nation_rollup", lambda t: t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).rollup("r_name", "n_name").agg(F.count("*").alias("n")), "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
