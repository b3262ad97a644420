"""Accuracy, angular-error and data-quality metrics. Each is one aggregation with map-side combine.

``keys=[]`` pools all rows into one result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pointlake.functions.geometry import NORMAL, TRUTH, angle_deg, as_flag, clamp, dot, safe_ratio, sigmoid, unit
from pointlake.operators.tiles import exact_medians, group_sizes, ordered_blocks


def join_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join of per-group results; with no keys both sides hold a single row."""
    if keys:
        return left.join(right, keys)
    one = F.lit(1)
    return left.withColumn("_one", one).join(right.withColumn("_one", one), "_one").drop("_one")


def binary_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, tn, total of (logit, target) rows; predicted positive when the sigmoid exceeds 0.5."""
    p = sigmoid(F.col("logit")) > 0.5
    t = F.col("target") == 1
    return df.groupBy(*keys).agg(
        F.sum(as_flag(p & t)).alias("tp"),
        F.sum(as_flag(p & ~t)).alias("fp"),
        F.sum(as_flag(~p & t)).alias("fn"),
        F.sum(as_flag(~p & ~t)).alias("tn"),
        F.count(F.lit(1)).alias("total"),
    )


def _binary_report(counts: DataFrame, keys: list[str]) -> DataFrame:
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "total"))
    return counts.select(
        *keys,
        safe_ratio(tp + tn, n).alias("accuracy"),
        safe_ratio(tp, tp + fp + fn).alias("iou"),
        safe_ratio(tp, tp + fp).alias("precision"),
        safe_ratio(tp, tp + fn).alias("recall"),
        safe_ratio(tp + fn, n).alias("mean_gt"),
    )


def binary_metrics(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    return _binary_report(binary_counts(df, list(keys)), list(keys))


def flip_invariant_binary_metrics(df: DataFrame, cloud: str = "cloud_id") -> DataFrame:
    """Per cloud the target is complemented when accuracy is below one half; then all clouds are pooled."""
    c = binary_counts(df, [cloud])
    inv = (F.col("tp") + F.col("tn")) * 2 < F.col("total")
    swap = {"tp": "fp", "fp": "tp", "fn": "tn", "tn": "fn"}
    turned = c.select(
        *[F.when(inv, F.col(o)).otherwise(F.col(n)).alias(n) for n, o in swap.items()], "total"
    )
    return _binary_report(turned.groupBy().agg(*[F.sum(n).alias(n) for n in turned.columns]), [])


def unoriented_error(df: DataFrame, keys: list[str] = (), pred=NORMAL, truth=TRUTH) -> DataFrame:
    """Mean and root-mean-square of the unoriented angle in degrees."""
    a = angle_deg(pred, truth, False, 1e-8, True)
    return df.groupBy(*keys).agg(F.avg(a).alias("mean_error"), F.sqrt(F.avg(a * a)).alias("rmse"))


def normal_metrics(df: DataFrame, keys: list[str] = (), pred=NORMAL, truth=TRUTH) -> DataFrame:
    """Angular-error report: lower median, share of points under 5/10/30 degrees, and the oriented RMSE
    after turning the whole group when more than half of it points away."""
    keys = list(keys)
    e = df.select(
        *keys,
        angle_deg(pred, truth, False).alias("_e"),
        angle_deg(pred, truth, True).alias("_o"),
    )
    flipped = F.lit(180.0) - F.col("_o")
    agg = e.groupBy(*keys).agg(
        F.avg("_e").alias("mean_error"),
        *[(F.avg(as_flag(F.col("_e") < t)) * 100).alias(f"pgp{t}") for t in (5, 10, 30)],
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse_unoriented"),
        F.avg(as_flag(F.col("_o") > 90)).alias("_away"),
        F.sqrt(F.avg(F.col("_o") * F.col("_o"))).alias("_as_is"),
        F.sqrt(F.avg(flipped * flipped)).alias("_turned"),
    )
    agg = agg.withColumn("rmse_oriented", F.when(F.col("_away") > 0.5, F.col("_turned")).otherwise(F.col("_as_is")))
    med = exact_medians(e, keys, "_e", True, "median_error")
    return join_on(agg.drop("_away", "_as_is", "_turned"), med, keys)


def accuracy_report(df: DataFrame, oriented: bool, keys: list[str] = (), pred=NORMAL, truth=TRUTH) -> DataFrame:
    """Angular-error report with the interpolated median."""
    keys = list(keys)
    e = df.select(*keys, angle_deg(pred, truth, oriented, 1e-8, True).alias("_e"))
    agg = e.groupBy(*keys).agg(
        F.avg("_e").alias("mean_angle"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        *[(F.avg(as_flag(F.col("_e") < t)) * 100).alias(f"pgp{t}") for t in (5, 10, 30)],
        F.count(F.lit(1)).alias("num_points"),
    )
    return join_on(agg, exact_medians(e, keys, "_e", False, "median_angle"), keys)


def run_summary(reports: DataFrame) -> DataFrame:
    """Summary over per-cloud reports; a row with a non-null ``error`` failed. Means over points where stated."""
    ok = F.col("error").isNull()
    w = F.sum(F.when(ok, F.col("num_points")))

    def weighted(c):
        return F.sum(F.when(ok, F.col(c) * F.col("num_points"))) / w

    return reports.groupBy().agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum(as_flag(ok)).alias("successful_files"),
        F.sum(as_flag(~ok)).alias("failed_files"),
        w.alias("total_points"),
        weighted("mean_angle").alias("avg_mean_angle"),
        *[F.avg(F.when(ok, F.col(c))).alias(f"avg_{c}") for c in ("median_angle", "rmse", "pgp5")],
        weighted("pgp10").alias("avg_pgp10"),
        F.avg(F.when(ok, F.col("pgp30"))).alias("avg_pgp30"),
    )


def edge_accuracy(edges: DataFrame, flips: DataFrame, keys: list[str] = ("cloud_id",)) -> DataFrame:
    """Share of overlapping patch pairs whose predicted relation (a > b: same) is the true one."""
    keys = list(keys)
    fi = flips.select(*keys, F.col("patch_id").alias("i"), F.col("flip").alias("fi"))
    fj = flips.select(*keys, F.col("patch_id").alias("j"), F.col("flip").alias("fj"))
    right = (F.col("fi") == F.col("fj")) == (F.col("a") > F.col("b"))
    e = edges.where((F.col("i") < F.col("j")) & (F.col("a") + F.col("b") > 0))
    known = e.join(fi, keys + ["i"]).join(fj, keys + ["j"]).groupBy(*keys).agg(
        (F.avg(as_flag(right)) * 100).alias("edge_accuracy"), F.count(F.lit(1)).alias("total_edges")
    )
    # A cloud without such pairs has accuracy 0 over 0 edges.
    return flips.select(*keys).distinct().join(known, keys, "left").select(
        *keys, F.coalesce("edge_accuracy", F.lit(0.0)).alias("edge_accuracy"),
        F.coalesce("total_edges", F.lit(0)).cast("long").alias("total_edges"),
    )


def either_way(c: Column) -> Column:
    return F.greatest(c, F.lit(1.0) - c)


def flip_accuracy(flips: DataFrame, truth: DataFrame, keys: list[str] = ("cloud_id",)) -> DataFrame:
    """Share of right flip bits, up to turning the whole cloud."""
    keys = list(keys)
    t = truth.select(*keys, "patch_id", F.col("flip").alias("_gt"))
    same = F.avg(as_flag(F.col("flip") == F.col("_gt")))
    return flips.join(t, keys + ["patch_id"]).groupBy(*keys).agg(either_way(same).alias("flip_accuracy"))


def patch_point_accuracy(members: DataFrame, keys: list[str] = ("cloud_id",), pred=NORMAL, truth=TRUTH):
    """(per patch, per cloud) point accuracy when every patch may choose its better direction."""
    keys = list(keys)
    d = dot(pred, truth)
    patch = members.groupBy(*keys, "patch_id").agg(
        F.count(F.lit(1)).alias("num_points"),
        F.sum(as_flag(d > 0)).alias("num_correct"),
        F.sum(as_flag(d < 0)).alias("num_error"),
    )
    best = F.greatest("num_correct", "num_error")
    cloud = patch.groupBy(*keys).agg((F.sum(best) / F.sum("num_points")).alias("point_accuracy"))
    return patch.withColumn("patch_accuracy", best / F.col("num_points")), cloud


def final_accuracy(points: DataFrame, keys: list[str] = ("cloud_id",), pred=NORMAL, truth=TRUTH) -> DataFrame:
    share = F.avg(as_flag(dot(pred, truth) > 0))
    return points.groupBy(*keys).agg(either_way(share).alias("final_accuracy"))


def patch_report(members: DataFrame, flips: DataFrame, pred=NORMAL, truth=TRUTH) -> DataFrame:
    """Per patch: counts, inverse-invariant accuracy, error rate, flip bits and angular errors after the flip."""
    keys = ["cloud_id", "patch_id"]
    sign = F.when(F.col("flip") == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    m = members.join(flips.select(*keys, "flip"), keys)
    m = m.select(*keys, "flip", *[(sign * F.col(c)).alias(c) for c in pred], *truth)
    d = dot(pred, truth)
    share = F.avg(as_flag(d > 0))
    acc = F.greatest(share, F.lit(1.0) - share)
    base = m.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_points"),
        F.sum(as_flag(d > 0)).alias("num_correct"),
        F.sum(as_flag(d < 0)).alias("num_error"),
        acc.alias("accuracy_inv"),
        (F.lit(1.0) - acc).alias("error_rate"),
        F.max("flip").alias("flip_pred"),
        as_flag(F.sum(as_flag(d < 0)) * 2 > F.count(F.lit(1))).alias("gt_flip"),
    )
    return base.join(normal_metrics(m, keys, pred, truth), keys)


def consistency_stats(df: DataFrame, keys: list[str] = (), pred=NORMAL, truth=TRUTH) -> DataFrame:
    """Mean/min/max/median of the signed consistency and the mean of the unsigned one."""
    keys = list(keys)
    c = clamp(dot(unit(pred, 1e-8, True), unit(truth, 1e-8, True)))
    rows = df.select(*keys, c.alias("_c"))
    agg = rows.groupBy(*keys).agg(
        F.avg("_c").alias("mean_consistency"),
        F.avg(F.abs("_c")).alias("mean_unoriented"),
        F.min("_c").alias("min_consistency"),
        F.max("_c").alias("max_consistency"),
    )
    return join_on(agg, exact_medians(rows, keys, "_c", False, "median_consistency"), keys)


def confusion_matrix(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """Counts per (true, predicted) label and the share inside each true label; small by construction."""
    c = df.groupBy(F.col(true_col).alias("true_label"), F.col(pred_col).alias("pred_label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("true_label")))


def scale_patch_stats(patches: DataFrame) -> DataFrame:
    """Per scale: number of patches, mean size, mean accuracy, mean flip."""
    return patches.groupBy("scale_idx").agg(
        F.count(F.lit(1)).alias("num_patches"),
        F.avg("num_points").alias("mean_points"),
        F.avg("accuracy").alias("mean_accuracy"),
        F.avg("gt_flip").alias("mean_gt"),
    )


def cleaning_report(stats: DataFrame) -> DataFrame:
    return stats.groupBy().agg(
        F.count(F.lit(1)).alias("num_files"),
        F.avg("retention").alias("mean_retention"),
        F.avg("num_components").alias("mean_components"),
        F.sum("n_in").alias("points_in"),
        F.sum("n_out").alias("points_out"),
    )


def quality_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: NaN and infinite counts, and statistics over the finite values, from a single pass."""
    inf = float("inf")
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        bad = F.isnan(v) | F.abs(v).isin(inf)
        good = F.when(~bad, v)
        aggs += [
            F.struct(
                F.lit(c).alias("name"),
                F.count(v).alias("total"),
                F.sum(as_flag(F.isnan(v))).alias("nan_count"),
                F.sum(as_flag(F.abs(v).isin(inf))).alias("inf_count"),
                F.min(good).alias("min"),
                F.max(good).alias("max"),
                F.avg(good).alias("mean"),
                F.stddev_samp(good).alias("std"),
                F.sqrt(F.sum(good * good)).alias("l2"),
            ).alias(f"p_{c}")
        ]
    wide = df.agg(*aggs)
    out = wide.select(F.inline(F.array(*[F.col(f"p_{c}") for c in columns])))
    return out.withColumn("has_nan", as_flag(F.col("nan_count") > 0))


def quality_rollup(profile: DataFrame) -> DataFrame:
    bad = (F.col("nan_count") + F.col("inf_count")) > 0
    return profile.groupBy().agg(
        F.count(F.lit(1)).alias("columns"),
        F.sum("total").alias("total"),
        F.sum("nan_count").alias("nan_total"),
        F.sum("inf_count").alias("inf_total"),
        F.concat_ws(",", F.array_sort(F.collect_list(F.when(bad, F.col("name"))))).alias("affected"),
    )


def cloud_offsets(points: DataFrame, keys: str = "cloud_id") -> DataFrame:
    """Points per cloud and the cumulative end offsets of the clouds laid out one after the other in id order.

    The running total over clouds is taken in two steps, ordered blocks of clouds first, so that no single task
    sees the list of all clouds. Ids may be of any type that has an order.
    """
    sizes = ordered_blocks(group_sizes(points, [keys], "n"), keys)
    blocks = sizes.groupBy("_block").agg(F.sum("n").alias("_bn"))
    wb = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_bn").over(wb), F.lit(0))).drop("_bn")
    w = Window.partitionBy("_block").orderBy(keys)
    return (
        sizes.join(blocks, "_block")
        .withColumn("end_offset", F.col("_before") + F.sum("n").over(w))
        .select(keys, "n", "end_offset")
    )


def offsets_to_counts(offsets: DataFrame, keys: str = "cloud_id") -> DataFrame:
    """Counts back from end offsets: the difference to the previous cloud's end, in ordered blocks of clouds."""
    o = ordered_blocks(offsets.select(keys, "end_offset"), keys)
    wb = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = o.groupBy("_block").agg(F.max("end_offset").alias("_end"))
    ends = ends.withColumn("_before", F.coalesce(F.max("_end").over(wb), F.lit(0))).drop("_end")
    w = Window.partitionBy("_block").orderBy("end_offset")
    return o.join(ends, "_block").select(
        keys, (F.col("end_offset") - F.coalesce(F.lag("end_offset").over(w), F.col("_before"))).alias("n")
    )
