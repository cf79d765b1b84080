"""Segmentation, regression, part and instance metrics from counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-10


def confusion(df: DataFrame, by: list[str] = (), target: str = "target", pred: str = "pred") -> DataFrame:
    """``(by..., target, pred, n, share)``: counts, and their share of the target's row."""
    counts = df.groupBy(*by, target, pred).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by, target)))


def iou_counts(df: DataFrame, classes: int, by: list[str] = (), target: str = "target", pred: str = "pred", ignore: int = -1, weight: str | None = None) -> DataFrame:
    """``(by..., class, intersection, n_pred, n_target, union)`` for the classes that occur.

    Rows with an ignored target count on neither side; predictions outside ``[0, classes)`` count only as missed targets.
    Labels above the range are not folded into the last class.
    """
    counts = df.where(F.col(target) != ignore).groupBy(*by, F.col(target).alias("__t"), F.col(pred).alias("__p")).agg((F.sum(weight) if weight else F.count("*")).alias("__n"))
    n = F.col("__n")
    sides = F.array(F.struct(F.col("__t").alias("class"), F.when(F.col("__t") == F.col("__p"), n).otherwise(0).alias("i"), F.lit(0).cast("long").alias("p"), n.alias("t")), F.struct(F.col("__p").alias("class"), F.lit(0).cast("long").alias("i"), n.alias("p"), F.lit(0).cast("long").alias("t")))
    rows = counts.select(*by, F.explode(sides).alias("s")).where((F.col("s.class") >= 0) & (F.col("s.class") < classes))
    sums = rows.groupBy(*by, F.col("s.class").alias("class")).agg(F.sum("s.i").alias("intersection"), F.sum("s.p").alias("n_pred"), F.sum("s.t").alias("n_target"))
    return sums.withColumn("union", F.col("n_pred") + F.col("n_target") - F.col("intersection"))


def class_metrics(counts: DataFrame) -> DataFrame:
    """IoU, precision, recall and F1 per row of ``iou_counts``, with a small epsilon (an absent class gives 0)."""
    i, p, t, u = (F.col(c).cast("double") for c in ("intersection", "n_pred", "n_target", "union"))
    out = counts.withColumn("iou", i / (u + EPS)).withColumn("precision", i / (p + EPS)).withColumn("recall", i / (t + EPS))
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPS))


def seg_metrics(counts: DataFrame, classes: int, by: list[str] = (), absent: str = "zero") -> DataFrame:
    """``miou, macc, oa, mf1, fwiou, kappa`` per group.

    ``absent="zero"`` divides class means by ``classes``, so classes without rows count 0; ``"skip"`` leaves classes out
    that neither side has.
    """
    per = class_metrics(counts)
    i, p, t, u = (F.col(c).cast("double") for c in ("intersection", "n_pred", "n_target", "union"))
    total = F.sum(t)
    if absent == "skip":
        mean = lambda c: F.avg(F.when(u > 0, c))
    else:
        mean = lambda c: F.sum(c) / F.lit(float(classes))
    agreed = F.sum(i) / (total + EPS)
    chance = F.sum(p * t) / (total * total + EPS)
    return per.groupBy(*by).agg(mean(F.col("iou")).alias("miou"), mean(F.col("recall")).alias("macc"), agreed.alias("oa"), mean(F.col("f1")).alias("mf1"), (F.sum(t * F.col("iou")) / (total + EPS)).alias("fwiou"), ((agreed - chance) / (1 - chance + EPS)).alias("kappa"))


def metrics_by(df: DataFrame, by: list[str], classes: int, target: str = "target", pred: str = "pred", ignore: int = -1) -> DataFrame:
    """Metrics per group and overall (the overall row has nulls in ``by``) from one scan: counts by group, then grouping sets."""
    counts = iou_counts(df, classes, by, target, pred, ignore)
    sums = [F.sum(c).alias(c) for c in ("intersection", "n_pred", "n_target", "union")]
    each = counts.withColumn("overall", F.lit(0))
    overall = counts.groupBy("class").agg(*sums).select(*(F.lit(None).cast(counts.schema[b].dataType).alias(b) for b in by), "class", "intersection", "n_pred", "n_target", "union", F.lit(1).alias("overall"))
    return seg_metrics(each.unionByName(overall), classes, [*by, "overall"])


def binary_metrics(df: DataFrame, focus: list[int], target: str = "target", pred: str = "pred") -> DataFrame:
    """IoU, precision, recall, F1 and support of each focus class against all others; 0 where a denominator is 0."""
    rows = df.select(F.explode(F.array(*map(F.lit, focus))).alias("class"), target, pred)
    t, p = F.col(target) == F.col("class"), F.col(pred) == F.col("class")
    sums = rows.groupBy("class").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    share = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("class", share(tp, tp + fp + fn).alias("iou"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"))


def mismatch_summary(df: DataFrame, keys: list[str], target: str = "target", pred: str = "pred") -> DataFrame:
    """Wrong rows counted over the keys, with a rank by count (most frequent first; ties by the keys)."""
    wrong = df.where(F.col(target) != F.col(pred)).groupBy(*keys, target, pred).agg(F.count("*").alias("n"))
    return wrong.orderBy(F.desc("n"), *keys, target, pred)


def region_profile(df: DataFrame, region: str, dims: list[str], regions: list[int]) -> DataFrame:
    """Region counts and ratios for every grouping set of ``dims`` from the overall row to all of them (rollup)."""
    counts = [F.count_if(F.col(region) == r).alias(f"n_{r}") for r in regions]
    out = df.rollup(*dims).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), *counts)
    return out.withColumns({f"ratio_{r}": F.col(f"n_{r}") / F.col("n") for r in regions})


def pool_folds(counts: DataFrame, classes: int, fold: str = "fold") -> DataFrame:
    """Metrics per fold and pooled over all folds (null fold): counts are summed, not metrics averaged."""
    sums = [F.sum(c).alias(c) for c in ("intersection", "n_pred", "n_target", "union")]
    both = counts.groupingSets([[fold, "class"], ["class"]], fold, "class").agg(F.grouping(fold).alias("pooled"), *sums)
    return seg_metrics(both, classes, [fold, "pooled"])


def vote(probs: DataFrame, keys: list[str], cls: str = "class", p: str = "p") -> DataFrame:
    """Class with the greatest summed probability over fragments; ties to the lowest class."""
    sums = probs.groupBy(*keys, cls).agg(F.sum(p).alias("__p"))
    return sums.groupBy(*keys).agg(F.min_by(cls, F.struct(-F.col("__p"), F.col(cls))).alias("pred"))


def topk_classes(probs: DataFrame, keys: list[str], k: int = 3, cls: str = "class", p: str = "p") -> DataFrame:
    """The ``k`` classes of greatest probability per point, ``rank`` from 1; ties to the lowest class."""
    return probs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(p), cls))).where(F.col("rank") <= k)


def mean_pred(preds: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return preds.groupBy(*keys).agg(F.avg(value).alias(value), F.count(value).alias("n"))


def reg_metrics(df: DataFrame, target: str = "target", pred: str = "pred", tile: str | None = None) -> DataFrame:
    """MAE, RMSE and R². Pooled sums over all rows, or (with ``tile``) the mean of the tiles' own metrics weighted by points."""
    e = F.col(pred) - F.col(target)
    sums = [F.count("*").alias("n"), F.sum(F.abs(e)).alias("ae"), F.sum(e * e).alias("se"), F.sum(target).alias("s"), F.sum(F.col(target) * F.col(target)).alias("ss")]
    per = df.groupBy(*([tile] if tile else [])).agg(*sums)
    total = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    own = per.select("n", (F.col("ae") / F.col("n")).alias("mae"), F.sqrt(F.col("se") / F.col("n")).alias("rmse"), (1 - F.col("se") / F.greatest(total, F.lit(EPS))).alias("r2"))
    if not tile:
        return own
    return own.agg(F.sum("n").alias("n"), *((F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in ("mae", "rmse", "r2")))


def cls_metrics(df: DataFrame, by: list[str] = (), target: str = "target", pred: str = "pred") -> DataFrame:
    """Overall accuracy and the mean of the classes' accuracies."""
    per = df.groupBy(*by, target).agg(F.count("*").alias("n"), F.count_if(F.col(target) == F.col(pred)).alias("hit"))
    return per.groupBy(*by).agg((F.sum("hit") / F.sum("n")).alias("oa"), F.avg(F.col("hit") / F.col("n")).alias("macc"))


def best_run(metrics: DataFrame, run: str, metric: str) -> DataFrame:
    """The run of the greatest metric (ties to the smallest run), and that metric."""
    return metrics.agg(F.min_by(run, F.struct(-F.col(metric), F.col(run))).alias(run), F.max(metric).alias(metric))


def part_iou(df: DataFrame, parts: DataFrame, shape: str = "shape", category: str = "category", target: str = "target", pred: str = "pred") -> DataFrame:
    """``(shape, category, iou)``: the mean over all parts of the shape's category (``parts(category, part)``) of the part's
    IoU; a part that neither side has counts 1."""
    counts = df.groupBy(shape, category, target, pred).agg(F.count("*").alias("n"))
    shapes = counts.select(shape, category).distinct().join(parts, category)
    t = counts.groupBy(shape, F.col(target).alias("part")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col(target) == F.col(pred), F.col("n")).otherwise(0)).alias("i"))
    p = counts.groupBy(shape, F.col(pred).alias("part")).agg(F.sum("n").alias("p"))
    rows = shapes.join(t, [shape, "part"], "left").join(p, [shape, "part"], "left").na.fill(0, ["t", "i", "p"])
    union = F.col("t") + F.col("p") - F.col("i")
    return rows.groupBy(shape, category).agg(F.avg(F.when(union == 0, F.lit(1.0)).otherwise(F.col("i") / union)).alias("iou"))


def part_means(shapes: DataFrame, category: str = "category") -> DataFrame:
    """Instance mean (over shapes) and category mean (over categories' means)."""
    per = shapes.groupBy(category).agg(F.avg("iou").alias("c"), F.sum("iou").alias("s"), F.count("*").alias("n"))
    return per.agg((F.sum("s") / F.sum("n")).alias("instance_iou"), F.avg("c").alias("category_iou"))


# --- instances ---------------------------------------------------------------------------------------------


def match_instances(pred: DataFrame, gt: DataFrame, by: str = "scene", void: int = -1) -> DataFrame:
    """Overlaps of predicted and true instances of one class in a scene.

    ``pred(scene, pred_id, class, score, point_id)``, ``gt(scene, point_id, segment, instance)`` ->
    ``(scene, class, pred_id, score, instance, both, n_pred, n_gt, n_void)``; a prediction that meets no true instance of its
    class has a null instance. Points of segment ``void`` or without an instance are void.
    """
    sizes = pred.groupBy(by, "pred_id").agg(F.first("class").alias("class"), F.first("score").alias("score"), F.count("*").alias("n_pred"))
    real = gt.where((F.col("segment") != void) & (F.col("instance") >= 0))
    n_gt = real.groupBy(by, "segment", "instance").agg(F.count("*").alias("n_gt"))
    joined = pred.select(by, "pred_id", "class", "point_id").join(gt, [by, "point_id"], "left")
    voids = joined.groupBy(by, "pred_id").agg(F.count_if(F.col("segment").isNull() | (F.col("segment") == void) | (F.col("instance") < 0)).alias("n_void"))
    overlap = joined.where((F.col("segment") == F.col("class")) & (F.col("instance") >= 0)).groupBy(by, "pred_id", "segment", "instance").agg(F.count("*").alias("both"))
    out = sizes.join(voids, [by, "pred_id"]).join(overlap, [by, "pred_id"], "left").join(n_gt, [by, "segment", "instance"], "left")
    return out.select(by, "class", "pred_id", "score", "instance", F.coalesce("both", F.lit(0)).alias("both"), "n_pred", "n_gt", "n_void")


THRESHOLDS = (0.25, *(round(0.5 + 0.05 * k, 2) for k in range(9)))


def instance_ap(pred: DataFrame, gt: DataFrame, by: str = "scene", least: int = 100, void: int = -1) -> DataFrame:
    """``(class, threshold, ap)`` over ``THRESHOLDS``.

    True instances with fewer than ``least`` points are ignored. In a scene true instances take, in id order, the
    prediction of the highest score whose IoU exceeds the threshold; further such predictions are false positives with the lower
    score. An unmatched prediction is a false positive unless void and ignored points make more than the threshold of it.
    Matching is sequential inside one scene and class; those are spread over tasks.
    """
    pairs = match_instances(pred, gt, by, void)
    gts = gt.where((F.col("segment") != void) & (F.col("instance") >= 0)).groupBy(by, F.col("segment").alias("class"), "instance").agg(F.count("*").alias("n_gt"))
    columns = [by, "class", "kind", "pred_id", "score", "instance", "both", "n_pred", "n_gt", "n_void"]
    left = pairs.withColumn("kind", F.lit(0)).select(*columns)
    right = gts.select(by, "class", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("pred_id"), F.lit(None).cast("double").alias("score"), "instance", F.lit(0).cast("long").alias("both"), F.lit(0).cast("long").alias("n_pred"), "n_gt", F.lit(0).cast("long").alias("n_void"))
    rows = left.withColumn("score", F.col("score").cast("double")).unionByName(right)

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        cls = frame["class"].iloc[0]
        truth = frame[frame.kind == 1].sort_values("instance")
        sizes = dict(zip(truth.instance.tolist(), truth.n_gt.tolist(), strict=True))
        meets: dict = {g: [] for g in sizes}
        loose: dict = {}
        for r in frame[frame.kind == 0].itertuples():
            void = loose.setdefault(r.pred_id, [r.score, r.n_pred, r.n_void])
            if r.instance in meets:
                meets[r.instance].append((-r.score, r.pred_id, r.both / (r.n_pred + r.n_gt - r.both)))
                if sizes[r.instance] < least:
                    void[2] += r.both
        out = []
        for thr in THRESHOLDS:
            used: set = set()
            for g, n in sizes.items():
                if n < least:
                    continue
                near = sorted(x for x in meets[g] if x[2] > thr and x[1] not in used)
                used.update(x[1] for x in near)
                out += [(cls, thr, -x[0], int(k == 0), 0) for k, x in enumerate(near)] or [(cls, thr, None, 0, 1)]
            out += [(cls, thr, score, 0, 0) for p, (score, n, void) in loose.items() if p not in used and void / n <= thr]
        return pd.DataFrame(out, columns=["class", "threshold", "score", "hit", "missed"])

    events = rows.groupBy(by, "class").applyInPandas(match, "class int, threshold double, score double, hit int, missed int")
    # Scores that tie act together, so the curve needs one row per distinct score.
    steps = events.groupBy("class", "threshold", "score").agg(F.sum("hit").alias("hit"), F.count("score").alias("n"), F.sum("missed").alias("missed"))
    curve = Window.partitionBy("class", "threshold").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("class", "threshold")
    run = steps.withColumn("total", F.sum(F.col("hit") + F.col("missed")).over(whole)).where("score IS NOT NULL OR missed > 0")
    run = run.withColumn("tp", F.sum("hit").over(curve)).withColumn("seen", F.sum("n").over(curve))
    run = run.withColumn("recall", F.when(F.col("total") > 0, F.col("tp") / F.col("total"))).withColumn("precision", F.when(F.col("seen") > 0, F.col("tp") / F.col("seen")).otherwise(1.0))
    step = Window.partitionBy("class", "threshold").orderBy(F.desc("score"))
    area = (F.col("recall") - F.lag("recall", 1, 0.0).over(step)) * (F.col("precision") + F.lag("precision", 1, 1.0).over(step)) / 2
    return run.withColumn("area", area).groupBy("class", "threshold").agg(F.sum("area").alias("ap"))


def ap_summary(ap: DataFrame) -> DataFrame:
    """Mean AP over 0.50 to 0.90, AP50 and AP25 per class."""
    t = F.col("threshold")
    return ap.groupBy("class").agg(F.avg(F.when(t >= 0.5, F.col("ap"))).alias("ap"), F.max(F.when(t == 0.5, F.col("ap"))).alias("ap50"), F.max(F.when(t == 0.25, F.col("ap"))).alias("ap25"))


def cosine_summary(df: DataFrame, value: str = "cosine", by: list[str] = ()) -> DataFrame:
    """Mean, population deviation and the 10/50/90 percentiles (linear interpolation)."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), *(F.percentile(value, q / 100).alias(f"p{q}") for q in (10, 50, 90)))


def context_scores(df: DataFrame, classes: list[str], prefix_t: str = "t_", prefix_p: str = "p_", eps: float = 1e-8) -> DataFrame:
    """Histogram targets against predictions: MAE per class, cross-entropy, target entropy, KL."""
    t, p = ([F.col(f"{pre}{c}") for c in classes] for pre in (prefix_t, prefix_p))
    log = lambda x: F.log(F.greatest(x, F.lit(eps)))
    ce = sum((-a * log(b) for a, b in zip(t, p, strict=True)), F.lit(0.0))
    h = sum((-a * log(a) for a in t), F.lit(0.0))
    return df.agg(*(F.avg(F.abs(a - b)).alias(f"mae_{c}") for a, b, c in zip(t, p, classes, strict=True)), F.avg(ce).alias("cross_entropy"), F.avg(h).alias("entropy"), F.avg(ce - h).alias("kl"))


def pair_predictions(a: DataFrame, b: DataFrame, keys: list[str], target: str = "target", pred: str = "pred") -> DataFrame:
    """Predictions of two methods side by side; fails, naming the keys, if a row is missing on one side or targets differ."""
    x = a.select(*keys, F.col(target).alias("__ta"), F.col(pred).alias("pred_a"), F.lit(True).alias("__a"))
    y = b.select(*keys, F.col(target).alias("__tb"), F.col(pred).alias("pred_b"), F.lit(True).alias("__b"))
    both = x.join(y, keys, "full_outer")
    bad = F.col("__a").isNull() | F.col("__b").isNull() | ~F.col("__ta").eqNullSafe(F.col("__tb"))
    message = F.lit(f"paired tables differ in {', '.join(keys)} or {target}")
    return both.withColumn(target, F.when(bad, F.raise_error(message).cast(a.schema[target].dataType)).otherwise(F.col("__ta"))).select(*keys, target, "pred_a", "pred_b")

