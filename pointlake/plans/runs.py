"""Run bookkeeping: training history, summaries, reports and exports as tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pointlake.functions.geometry import NORMAL, TRUTH, XYZ
from pointlake.operators import sampling
from pointlake.operators.transforms import colour_correctness, colour_labels
from pointlake.session import cut, is_empty
from pointlake.sources import ply

# The columns of the summary file, in order.
SUMMARY_COLUMNS = [
    "model_name", "scene_name", "input_path", "output_dir", "status", "num_points", "num_patches", "pipeline_type",
    "point_accuracy", "final_accuracy", "flip_accuracy", "mean_error", "time_total", "error_message",
]


def epoch_rollup(history: DataFrame, means: list[str] = ("loss", "accuracy")) -> DataFrame:
    """Means per epoch and the learning rate of its last batch."""
    return history.groupBy("epoch").agg(
        *[F.avg(c).alias(c) for c in means], F.max_by("learning_rate", "batch").alias("learning_rate")
    )


def validation_epochs(history: DataFrame, every: int) -> DataFrame:
    return history.where(F.col("epoch") % every == 0)


def running_best(epochs: DataFrame, metric: str, keys: list[str] = (), start: float = 0.0) -> DataFrame:
    """Best value so far and whether the epoch beats everything before it. One row per epoch: runs have at most
    thousands, so a window per run is small."""
    before = Window.partitionBy(*keys).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.greatest(F.lit(start), F.coalesce(F.max(metric).over(before), F.lit(start)))
    return epochs.withColumn("is_best", (F.col(metric) > prev).cast("long")).withColumn(
        "best_so_far", F.greatest(prev, F.col(metric))
    )


def keep_last(saved: DataFrame, n: int, keys: list[str], order: str = "step") -> DataFrame:
    """Items to delete when each run keeps its n newest (``order`` is unique inside a run).

    Only the n newest of a run are ranked, which Spark limits before the shuffle; the rest is compared with the
    oldest of them.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    kept = saved.select(*keys, order).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    oldest = kept.groupBy(*keys).agg(F.min(order).alias("_oldest"))
    return saved.join(oldest, keys).where(F.col(order) < F.col("_oldest")).drop("_oldest")


def improvement(history: DataFrame, metric: str, keys: list[str], order: str) -> DataFrame:
    """Metric at the first and at the last iteration of every run; an aggregation, so long runs do not matter."""
    return history.groupBy(*keys).agg(
        F.min_by(metric, order).alias("first"), F.max_by(metric, order).alias("last")
    ).withColumn("gain", F.col("last") - F.col("first"))


def largest_batch(batches: DataFrame, sample: int, order: str = "batch", size: str = "num_points") -> DataFrame:
    """The largest of the first ``sample`` batches; of equal ones the first."""
    first = batches.orderBy(order).limit(sample)
    return first.agg(F.max_by(F.struct(order, size), F.struct(F.col(size), -F.col(order))).alias("_m")).select("_m.*")


def run_report(validation: DataFrame, training: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Last epoch, number of steps, metrics of the best epoch by IoU (the first of equal ones) and of the last."""
    cols = ["loss", "accuracy", "iou"]
    best = F.max_by(F.struct("epoch", *cols), F.struct(F.col("iou"), -F.col("epoch")))
    last = F.max_by(F.struct(*cols), "epoch")
    v = validation.groupBy(*keys).agg(F.max("epoch").alias("total_epochs"), best.alias("_b"), last.alias("_f"))
    steps = training.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_steps"))
    joined = v.join(steps, list(keys)) if keys else v.withColumn("total_steps", steps.scalar())
    return joined.select(
        *keys, "total_epochs", "total_steps", F.col("_b.epoch").alias("best_epoch"),
        *[F.col(f"_b.{c}").alias(f"best_{c}") for c in cols], *[F.col(f"_f.{c}").alias(f"final_{c}") for c in cols],
    )


def summary_rows(results: DataFrame) -> DataFrame:
    """One row per input with all summary columns; failed and skipped inputs carry only their names and the error.

    Accuracies become percentages; an absent or zero accuracy stays empty.
    """
    ok = ~F.col("status").isin("failed", "skipped")

    def pct(c: str):
        return F.when(ok & (F.col(c) != 0), F.col(c) * 100)

    out = {
        "status": F.when(ok, F.lit("success")).otherwise(F.col("status")),
        "point_accuracy": pct("point_accuracy"), "final_accuracy": pct("final_accuracy"), "flip_accuracy": pct("flip_accuracy"),
        "error_message": F.when(ok, F.lit("")).otherwise(F.coalesce("error_message", F.lit(""))),
    }
    for c in ("num_points", "num_patches", "pipeline_type", "mean_error", "time_total"):
        out[c] = F.when(ok, F.col(c))
    return results.select(*[out.get(c, F.col(c)).alias(c) for c in SUMMARY_COLUMNS])


def write_summary(results: DataFrame, path: str) -> None:
    summary_rows(results).write.mode("overwrite").option("header", True).csv(path)


def metrics_json(report: DataFrame) -> DataFrame:
    """(cloud_id, json): the nested report of one cloud per row."""
    accuracy = F.struct("point_accuracy", "final_accuracy", "flip_accuracy", "edge_accuracy", "total_edges")
    overall = F.struct("mean_error", "median_error", "pgp5", "pgp10", "pgp30", "rmse_unoriented", "rmse_oriented")
    body = F.struct("num_points", "num_patches", accuracy.alias("accuracy"), overall.alias("overall_metrics"))
    return report.select("cloud_id", F.to_json(body).alias("json"))


def patches_to_save(report: DataFrame, min_error_rate: float | None = None, max_error_rate: float | None = None) -> DataFrame:
    """Patches to export: all, or by error rate (the lower bound counts when both are given)."""
    if min_error_rate is not None:
        return report.where(F.col("error_rate") >= min_error_rate)
    return report if max_error_rate is None else report.where(F.col("error_rate") <= max_error_rate)


def export_patches(members: DataFrame, chosen: DataFrame, path: str, buckets: int = 64) -> None:
    """Points of the chosen patches with correctness colours, in ``buckets`` folders by cloud and patch.

    A patch lies sorted within one folder, whose files' statistics let a reader of one patch skip the others; the number of
    folders does not grow with that of patches.
    """
    rows = members.join(chosen.select("cloud_id", "patch_id"), ["cloud_id", "patch_id"], "left_semi")
    rows = colour_correctness(rows) if set(TRUTH) <= set(rows.columns) else rows
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("cloud_id", "patch_id"), F.lit(buckets)).cast("int"))
    rows = rows.repartition("bucket", "cloud_id", "patch_id").sortWithinPartitions("bucket", "cloud_id", "patch_id")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_patch(spark: SparkSession, path: str, cloud, patch, buckets: int = 64) -> DataFrame:
    """The points of one exported patch, read from its bucket only."""
    one = spark.createDataFrame([(cloud, patch)], spark.read.parquet(path).select("cloud_id", "patch_id").schema)
    bucket = one.select(F.pmod(F.xxhash64("cloud_id", "patch_id"), F.lit(buckets))).first()[0]
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col("cloud_id") == cloud) & (F.col("patch_id") == patch)).drop("bucket")


def patch_info(report: DataFrame, chosen: DataFrame) -> DataFrame:
    """Total and saved patches per cloud."""
    total = report.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("total_patches"))
    saved = chosen.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("saved_patches"))
    return total.join(saved, "cloud_id", "left").withColumn("saved_patches", F.coalesce("saved_patches", F.lit(0).cast("long")))


def prediction_rows(points: DataFrame, predictions: DataFrame, truth: DataFrame, num_classes: int,
                    clouds: DataFrame | None = None) -> DataFrame:
    """Points with predicted and true label and palette colours; only points known to all three inputs.

    A prediction given as an array of scores becomes the position of its largest one. With ``clouds``
    (cloud_id), only these are exported.
    """
    on = ["cloud_id", "point_id"]
    p = predictions
    if dict(p.dtypes)["prediction"].startswith("array"):
        best = F.array_position("prediction", F.array_max("prediction")) - 1
        p = p.withColumn("prediction", best.cast("long"))
    rows = points.select(*on, *XYZ).join(p.select(*on, "prediction"), on).join(truth.select(*on, "ground_truth"), on)
    if clouds is not None:
        rows = rows.join(clouds.select("cloud_id"), "cloud_id", "left_semi")
    rows = colour_labels(rows, "prediction", num_classes, ("pr", "pg", "pb"))
    return colour_labels(rows, "ground_truth", num_classes, ("tr", "tg", "tb"))


def comparison_json(rows: DataFrame) -> DataFrame:
    """One JSON line per point instead of one document per cloud, so large clouds export in parallel."""
    return rows.select("cloud_id", F.to_json(F.struct("point_id", *XYZ, "prediction", "ground_truth")).alias("json"))


def write_comparison(rows: DataFrame, path: str) -> None:
    """The comparison as lines of JSON, each with the id of its cloud."""
    line = F.to_json(F.struct("cloud_id", "point_id", *XYZ, "prediction", "ground_truth"))
    rows.select(line.alias("value")).write.mode("overwrite").text(path)


def _reason(problem: Exception) -> str:
    """Class and text of what was raised; of errors in Python tasks, that of the task."""
    found = re.findall(r"^(?:[\w.]+\.)?(\w+(?:Error|Exception|Exit|Warning): [^\n]*)", str(problem), re.M)
    return found[-1].strip() if found else f"{type(problem).__name__}: {problem}".split("\n")[0]


def _isolated(todo: DataFrame, work: Callable[[DataFrame], DataFrame], level: int = 0) -> DataFrame:
    """Rows (cloud_id, error) of ``work``; a batch that raises is halved until the clouds that raise stand alone."""
    try:
        return cut(work(todo).select("cloud_id", "error"))
    except Exception as problem:
        reason = _reason(problem)
    alone = todo.agg(F.count(F.lit(1)), F.count_distinct("cloud_id")).first()
    if alone[1] <= 1:
        return todo.select("cloud_id", F.lit(reason).alias("error"))
    side = F.pmod(F.xxhash64(F.lit(level), "cloud_id"), F.lit(2))
    halves = [cut(todo.where(side == s)) for s in (0, 1)]
    done = [_isolated(half, work, level + 1) for half in halves if not is_empty(half)]
    return done[0] if len(done) == 1 else done[0].unionByName(done[1])


def run_with_status(targets: DataFrame, work: Callable[[DataFrame], DataFrame], finished: DataFrame | None = None) -> DataFrame:
    """Batch run that never aborts as a whole: (cloud_id, status, error).

    ``targets(cloud_id, error)``: rows with an error are passed on as skipped, clouds in ``finished`` as skipped
    with the reason, and the rest goes to ``work``, which returns (cloud_id, error) with a null error on success. If
    ``work`` itself raises, the batch is halved and run again, so that only the clouds that make it raise fail.
    """
    bad = targets.where(F.col("error").isNotNull()).select("cloud_id", F.lit("skipped").alias("status"), "error")
    todo = targets.where(F.col("error").isNull()).select("cloud_id")
    out = bad
    if finished is not None:
        done = todo.join(finished, "cloud_id", "left_semi")
        out = out.unionByName(done.select("cloud_id", F.lit("skipped").alias("status"), F.lit("output exists").alias("error")))
        todo = todo.join(finished, "cloud_id", "left_anti")
    ran = _isolated(cut(todo), work)
    status = F.when(F.col("error").isNull(), F.lit("success")).otherwise(F.lit("failed"))
    return out.unionByName(ran.select("cloud_id", status.alias("status"), "error"))


def downsample_files(spark: SparkSession, source: str, target: str, ratio: float | None = None, target_points: int | None = None,
                     seed: int = 42, method: str = "random", binary: bool = False) -> DataFrame:
    """Sample every cloud of a folder of PLY files, write the samples as PLY and return what was done per cloud.

    (cloud_id, status, error, n_in, n_out, actual_ratio, has_normals, has_colors): the numbers are those of the files, read
    and written; an unreadable file is a row with its error. ``method`` ``voxel`` keeps about ``ratio`` of the points.
    """
    files = cut(ply.ply_status(spark, source))
    broken = files.where(F.col("error").isNotNull()).groupBy("cloud_id").agg(F.min("error").alias("error"))
    points = ply.read_ply(spark, source, skip_broken=True).drop("path").join(broken.select("cloud_id"), "cloud_id", "left_anti")
    if method == "voxel":
        sample = sampling.rate_voxel_downsample(points, ratio, extra=[*NORMAL, "r", "g", "b"])
        place = F.shiftleft("vx", 42).bitwiseOR(F.shiftleft("vy", 21)).bitwiseOR(F.col("vz"))  # only an order
        sample = sample.withColumn("point_id", place)
    else:
        sample = sampling.random_downsample(points, ratio=ratio, target_points=target_points, seed=seed)
    sample = cut(sample)
    has = points.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n_in"), F.max(F.col("nx").isNotNull()).cast("long").alias("has_normals"), F.max(F.col("r").isNotNull()).cast("long").alias("has_colors"))
    has = cut(has)
    written = None
    for normals in (0, 1):
        for colours in (0, 1):
            mine = has.where((F.col("has_normals") == normals) & (F.col("has_colors") == colours)).select("cloud_id")
            if is_empty(mine):
                continue
            part = ply.write_ply(sample.join(mine, "cloud_id", "left_semi"), target, binary, bool(normals), bool(colours))
            written = part if written is None else written.unionByName(part)
    names = ["cloud_id", "status", "error", "n_in", "n_out", "actual_ratio", "has_normals", "has_colors"]
    skipped = broken.select(
        "cloud_id", F.lit("failed").alias("status"), "error", *(F.lit(None).cast(t).alias(c) for c, t in zip(names[3:], ["long", "long", "double", "long", "long"]))
    )
    if written is None:
        return skipped
    done = has.join(written.groupBy("cloud_id").agg(F.sum("rows").alias("n_out")), "cloud_id")
    done = done.withColumns({"status": F.lit("success"), "error": F.lit(None).cast("string"), "actual_ratio": F.col("n_out") / F.col("n_in")})
    return done.select(*names).unionByName(skipped)


def union_clouds(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Concatenate batches of clouds by column name."""
    for o in others:
        first = first.unionByName(o)
    return first


def missing_and_existing(wanted: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    return wanted.subtract(present), wanted.intersect(present)


