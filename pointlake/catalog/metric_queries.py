"""Metrics and losses over the test tables."""

from pyspark.sql import functions as F

from pointlake.catalog.registry import query, rnd, rounded
from pointlake.catalog.toy import (
    EDGES, GT_FLIPS, PN, patch_flips, patch_normals, sql_angle, sql_cos, sql_dot,
)
from pointlake.fixtures import EMB, EVT, SCORED, emb_points, event_points, scored_labels, table
from pointlake.operators import losses, metrics, orient
from pointlake.functions.geometry import dot, NORMAL, TRUTH

_COUNTS = """
  sum(CASE WHEN p AND t THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p AND NOT t THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN NOT p AND t THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN NOT p AND NOT t THEN 1 ELSE 0 END) AS tn,
  count(*) AS total"""
_RATIOS = """
  round((tp + tn) / total, 6) AS accuracy,
  round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END, 6) AS iou,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round((tp + fn) / total, 6) AS mean_gt"""
_PRED = "SELECT *, 1.0 / (1.0 + exp(-logit)) > 0.5 AS p, target = 1 AS t FROM scored"


@query("binary_metrics", f"""WITH {SCORED}, pr AS ({_PRED}), c AS (SELECT cloud_id, {_COUNTS} FROM pr GROUP BY 1)
SELECT cloud_id, {_RATIOS} FROM c""")
def _(spark, sf):
    return rounded(metrics.binary_metrics(scored_labels(spark, sf), ["cloud_id"]))


@query("binary_metrics_flip_invariant", f"""WITH {SCORED}, pr AS ({_PRED}),
c0 AS (SELECT cloud_id, {_COUNTS} FROM pr GROUP BY 1),
c1 AS (SELECT *, (tp + tn) * 2 < total AS inv FROM c0),
c AS (SELECT sum(CASE WHEN inv THEN fp ELSE tp END) AS tp, sum(CASE WHEN inv THEN tp ELSE fp END) AS fp,
  sum(CASE WHEN inv THEN tn ELSE fn END) AS fn, sum(CASE WHEN inv THEN fn ELSE tn END) AS tn, sum(total) AS total FROM c1)
SELECT {_RATIOS} FROM c""")
def _(spark, sf):
    return rounded(metrics.flip_invariant_binary_metrics(scored_labels(spark, sf)))


@query("unoriented_error", f"""WITH {EMB}, e AS (SELECT cloud_id, {sql_angle(False, True)} AS a FROM emb)
SELECT cloud_id, round(avg(a), 6) AS mean_error, round(sqrt(avg(a * a)), 6) AS rmse FROM e GROUP BY cloud_id""")
def _(spark, sf):
    return rounded(metrics.unoriented_error(emb_points(spark, sf), ["cloud_id"]))


NORMAL_METRICS = """
  round(avg(e), 6) AS mean_error, round(quantile_disc(e, 0.5), 6) AS median_error,
  round(avg(CASE WHEN e < 5 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pgp5,
  round(avg(CASE WHEN e < 10 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pgp10,
  round(avg(CASE WHEN e < 30 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pgp30,
  round(sqrt(avg(e * e)), 6) AS rmse_unoriented,
  round(CASE WHEN avg(CASE WHEN o > 90 THEN 1.0 ELSE 0.0 END) > 0.5 THEN sqrt(avg((180 - o) * (180 - o)))
    ELSE sqrt(avg(o * o)) END, 6) AS rmse_oriented"""


@query("normal_metrics", f"""WITH {EMB},
e AS (SELECT cloud_id, {sql_angle(False, False)} AS e, {sql_angle(True, False)} AS o FROM emb)
SELECT cloud_id, {NORMAL_METRICS} FROM e GROUP BY cloud_id""")
def _(spark, sf):
    return rounded(metrics.normal_metrics(emb_points(spark, sf), ["cloud_id"]))


@query("normal_metrics_pooled", f"""WITH {EMB},
e AS (SELECT {sql_angle(False, False)} AS e, {sql_angle(True, False)} AS o FROM emb)
SELECT {NORMAL_METRICS} FROM e""")
def _(spark, sf):
    return rounded(metrics.normal_metrics(emb_points(spark, sf)))


def _report_sql(oriented):
    return f"""SELECT cloud_id, round(avg(a), 6) AS mean_angle, round(sqrt(avg(a * a)), 6) AS rmse,
  round(median(a), 6) AS median_angle, round(avg(CASE WHEN a < 5 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pgp5,
  round(avg(CASE WHEN a < 10 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pgp10,
  round(avg(CASE WHEN a < 30 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pgp30, count(*) AS num_points
FROM (SELECT cloud_id, {sql_angle(oriented, True)} AS a FROM emb) GROUP BY cloud_id"""


@query("accuracy_report_pooled", f"WITH {EMB} SELECT * EXCLUDE (cloud_id) FROM ({_report_sql(True).replace('FROM emb', 'FROM (SELECT * REPLACE (0 AS cloud_id) FROM emb)')})")
def _(spark, sf):
    """One report over all points."""
    return rounded(metrics.accuracy_report(emb_points(spark, sf), True))


@query("edge_accuracy_without_edges", f"WITH {PN} SELECT DISTINCT cloud_id, CAST(0 AS DOUBLE) AS edge_accuracy, CAST(0 AS BIGINT) AS total_edges FROM flips")
def _(spark, sf):
    """Clouds whose patches never overlap have accuracy 0 over 0 edges."""
    pn = patch_normals(spark, sf)
    return rounded(metrics.edge_accuracy(orient.overlap_relation(pn).where("a + b < 0"), orient.majority_flips(pn)))


@query("cloud_offsets_text_ids", f"""WITH {EVT}, t AS (SELECT 'c' || CAST(cloud_id AS VARCHAR) AS cloud_id FROM evt), n AS (SELECT cloud_id, count(*) AS n FROM t GROUP BY 1)
SELECT cloud_id, n, CAST(sum(n) OVER (ORDER BY cloud_id) AS BIGINT) AS end_offset FROM n""")
def _(spark, sf):
    """Ids as the file reader delivers them."""
    p = event_points(spark, sf).withColumn("cloud_id", F.concat(F.lit("c"), F.col("cloud_id").cast("string")))
    return rounded(metrics.cloud_offsets(p))


@query("accuracy_report_unoriented", f"WITH {EMB} {_report_sql(False)}")
def _(spark, sf):
    return rounded(metrics.accuracy_report(emb_points(spark, sf), False, ["cloud_id"]))


@query("accuracy_report_oriented", f"WITH {EMB} {_report_sql(True)}")
def _(spark, sf):
    return rounded(metrics.accuracy_report(emb_points(spark, sf), True, ["cloud_id"]))


@query("run_summary", f"""WITH {EMB}, rep AS ({_report_sql(False)}),
r AS (SELECT *, CASE WHEN cloud_id % 4 = 3 THEN 'failed' END AS error FROM rep)
SELECT count(*) AS total_files, count(*) FILTER (WHERE error IS NULL) AS successful_files,
  count(*) FILTER (WHERE error IS NOT NULL) AS failed_files,
  CAST(sum(num_points) FILTER (WHERE error IS NULL) AS BIGINT) AS total_points,
  round(sum(mean_angle * num_points) FILTER (WHERE error IS NULL) / sum(num_points) FILTER (WHERE error IS NULL), 6) AS avg_mean_angle,
  round(avg(median_angle) FILTER (WHERE error IS NULL), 6) AS avg_median_angle,
  round(avg(rmse) FILTER (WHERE error IS NULL), 6) AS avg_rmse, round(avg(pgp5) FILTER (WHERE error IS NULL), 6) AS avg_pgp5,
  round(sum(pgp10 * num_points) FILTER (WHERE error IS NULL) / sum(num_points) FILTER (WHERE error IS NULL), 6) AS avg_pgp10,
  round(avg(pgp30) FILTER (WHERE error IS NULL), 6) AS avg_pgp30 FROM r""")
def _(spark, sf):
    rep = rounded(metrics.accuracy_report(emb_points(spark, sf), False, ["cloud_id"]))
    rep = rep.withColumn("error", F.when(F.col("cloud_id") % 4 == 3, F.lit("failed")))
    return rounded(metrics.run_summary(rep))


@query("edge_accuracy", f"""WITH {PN}, {EDGES}, {GT_FLIPS}
SELECT e.cloud_id, round(avg(CASE WHEN (fi.flip = fj.flip) = (a > b) THEN 1.0 ELSE 0.0 END) * 100, 6) AS edge_accuracy,
  count(*) AS total_edges
FROM edges e JOIN gtf fi ON fi.cloud_id = e.cloud_id AND fi.patch_id = e.i
  JOIN gtf fj ON fj.cloud_id = e.cloud_id AND fj.patch_id = e.j
WHERE a + b > 0 GROUP BY 1""")
def _(spark, sf):
    pn = patch_normals(spark, sf)
    return rounded(metrics.edge_accuracy(orient.overlap_relation(pn), orient.majority_flips(pn)))


@query("flip_accuracy", f"""WITH {PN}, {GT_FLIPS}
SELECT f.cloud_id, round(greatest(avg(CASE WHEN f.flip = g.flip THEN 1.0 ELSE 0.0 END),
  1 - avg(CASE WHEN f.flip = g.flip THEN 1.0 ELSE 0.0 END)), 6) AS flip_accuracy
FROM flips f JOIN gtf g USING (cloud_id, patch_id) GROUP BY 1""")
def _(spark, sf):
    return rounded(metrics.flip_accuracy(patch_flips(spark, sf), orient.majority_flips(patch_normals(spark, sf))))


_PATCH_COUNTS = f"""pc AS (SELECT cloud_id, patch_id, count(*) AS num_points,
  sum(CASE WHEN {sql_dot()} > 0 THEN 1 ELSE 0 END) AS num_correct,
  sum(CASE WHEN {sql_dot()} < 0 THEN 1 ELSE 0 END) AS num_error FROM pn GROUP BY 1, 2)"""


@query("point_accuracy", f"""WITH {PN}, {_PATCH_COUNTS}
SELECT cloud_id, round(sum(greatest(num_correct, num_error)) / sum(num_points), 6) AS point_accuracy FROM pc GROUP BY 1""")
def _(spark, sf):
    return rounded(metrics.patch_point_accuracy(patch_normals(spark, sf))[1])


@query("point_accuracy_per_patch", f"""WITH {PN}, {_PATCH_COUNTS}
SELECT cloud_id, patch_id, num_points, CAST(num_correct AS BIGINT) AS num_correct, CAST(num_error AS BIGINT) AS num_error,
  round(greatest(num_correct, num_error) / num_points, 6) AS patch_accuracy FROM pc""")
def _(spark, sf):
    return rounded(metrics.patch_point_accuracy(patch_normals(spark, sf))[0])


MERGED = """ranks AS (SELECT cloud_id, patch_id, row_number() OVER (PARTITION BY cloud_id ORDER BY count(*) DESC, patch_id) AS rk
  FROM pn GROUP BY 1, 2),
merged AS (SELECT pn.cloud_id, pn.point_id, arg_max(CASE WHEN {flip} = 1 THEN -nx ELSE nx END, rk) AS nx,
  arg_max(CASE WHEN {flip} = 1 THEN -ny ELSE ny END, rk) AS ny, arg_max(CASE WHEN {flip} = 1 THEN -nz ELSE nz END, rk) AS nz,
  any_value(gx) AS gx, any_value(gy) AS gy, any_value(gz) AS gz
  FROM pn JOIN ranks USING (cloud_id, patch_id) JOIN {table} f USING (cloud_id, patch_id) GROUP BY 1, 2)"""
_FINAL = f"""SELECT cloud_id, round(greatest(avg(CASE WHEN {sql_dot()} > 0 THEN 1.0 ELSE 0.0 END),
  1 - avg(CASE WHEN {sql_dot()} > 0 THEN 1.0 ELSE 0.0 END)), 6) AS final_accuracy FROM merged GROUP BY 1"""


@query("final_accuracy", f"WITH {PN}, {MERGED.format(flip='f.flip', table='flips')} {_FINAL}")
def _(spark, sf):
    pn = patch_normals(spark, sf)
    merged = orient.merge_patches(pn, patch_flips(spark, sf))
    truth = emb_points(spark, sf).select("cloud_id", "point_id", *TRUTH)
    return rounded(metrics.final_accuracy(merged.join(truth, ["cloud_id", "point_id"])))


@query("final_accuracy_upper_bound", f"WITH {PN}, {GT_FLIPS}, {MERGED.format(flip='f.flip', table='gtf')} {_FINAL}")
def _(spark, sf):
    pn = patch_normals(spark, sf)
    merged = orient.merge_patches(pn, orient.majority_flips(pn))
    truth = emb_points(spark, sf).select("cloud_id", "point_id", *TRUTH)
    return rounded(metrics.final_accuracy(merged.join(truth, ["cloud_id", "point_id"])))


@query("patch_report", f"""WITH {PN},
s AS (SELECT cloud_id, patch_id, flip, CASE WHEN flip = 1 THEN -1.0 ELSE 1.0 END AS s, nx AS mx, ny AS my, nz AS mz, gx, gy, gz
  FROM pn JOIN flips USING (cloud_id, patch_id)),
t AS (SELECT cloud_id, patch_id, flip, s * mx AS nx, s * my AS ny, s * mz AS nz, gx, gy, gz FROM s),
e AS (SELECT *, {sql_angle(False, False)} AS e, {sql_angle(True, False)} AS o, {sql_dot()} AS d FROM t)
SELECT cloud_id, patch_id, count(*) AS num_points, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS num_correct,
  CAST(sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) AS BIGINT) AS num_error,
  round(greatest(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END), 1 - avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END)), 6) AS accuracy_inv,
  round(1 - greatest(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END), 1 - avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END)), 6) AS error_rate,
  max(flip) AS flip_pred, CAST(sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) * 2 > count(*) AS BIGINT) AS gt_flip,
  {NORMAL_METRICS} FROM e GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(metrics.patch_report(patch_normals(spark, sf), patch_flips(spark, sf)))


@query("consistency_stats", f"""WITH {EMB}, c AS (SELECT cloud_id, {sql_cos(True)} AS c FROM emb)
SELECT cloud_id, round(avg(c), 6) AS mean_consistency, round(avg(abs(c)), 6) AS mean_unoriented,
  round(min(c), 6) AS min_consistency, round(max(c), 6) AS max_consistency, round(median(c), 6) AS median_consistency
FROM c GROUP BY 1""")
def _(spark, sf):
    return rounded(metrics.consistency_stats(emb_points(spark, sf), ["cloud_id"]))


@query("confusion_matrix", f"""WITH {SCORED}, c AS (
  SELECT target AS true_label, CAST(logit > 0 AS BIGINT) AS pred_label, count(*) AS n FROM scored GROUP BY 1, 2)
SELECT true_label, pred_label, n, round(n / sum(n) OVER (PARTITION BY true_label), 6) AS share FROM c""")
def _(spark, sf):
    df = scored_labels(spark, sf).withColumn("pred", (F.col("logit") > 0).cast("long"))
    return rounded(metrics.confusion_matrix(df, "target", "pred"))


_BCE = "(greatest({z}, 0.0) - {z} * {t} + ln(1.0 + exp(-abs({z}))))"


def _loss_sql(z, t):
    bce = _BCE.format(z=z, t=t)
    p = f"(1.0 / (1.0 + exp(-{z})))"
    return {
        "bce": f"avg({bce})",
        "focal": f"avg(0.25 * power(1.0 - exp(-{bce}), 2.0) * {bce})",
        "dice": f"(1.0 - (2.0 * sum({p} * {t}) + 1.0) / (sum({p}) + sum({t}) + 1.0))",
    }


_L1, _L2 = _loss_sql("logit", "CAST(target AS DOUBLE)"), _loss_sql("logit", "(1.0 - target)")


@query("label_losses", f"""WITH {SCORED}, per AS (SELECT cloud_id, count(*) AS n, {_L1['bce']} AS bce, {_L1['focal']} AS focal,
  {_L1['dice']} AS dice, least({_L1['bce']}, {_L2['bce']}) AS flip_bce, least({_L1['focal']}, {_L2['focal']}) AS flip_focal,
  least({_L1['dice']}, {_L2['dice']}) AS flip_dice FROM scored GROUP BY 1)
SELECT round(sum(bce * n) / sum(n), 6) AS bce, round(sum(focal * n) / sum(n), 6) AS focal, round(sum(dice * n) / sum(n), 6) AS dice,
  round(sum(flip_bce * n) / sum(n), 6) AS flip_bce, round(sum(flip_focal * n) / sum(n), 6) AS flip_focal,
  round(sum(flip_dice * n) / sum(n), 6) AS flip_dice, round(sum(flip_focal * n) / sum(n), 6) AS bifocal FROM per""")
def _(spark, sf):
    return rounded(losses.evaluate_label_losses(scored_labels(spark, sf)))


@query("normal_losses", f"""WITH {EMB},
u AS (SELECT cloud_id, nx, ny, nz, gx / greatest(sqrt(gx*gx+gy*gy+gz*gz), 1e-12) AS gx,
  gy / greatest(sqrt(gx*gx+gy*gy+gz*gz), 1e-12) AS gy, gz / greatest(sqrt(gx*gx+gy*gy+gz*gz), 1e-12) AS gz FROM emb),
d AS (SELECT *, {sql_dot()} AS d, sqrt(nx*nx+ny*ny+nz*nz) AS len,
  sqrt((ny*gz-nz*gy)*(ny*gz-nz*gy)+(nz*gx-nx*gz)*(nz*gx-nx*gz)+(nx*gy-ny*gx)*(nx*gy-ny*gx)) AS s FROM u),
t AS (SELECT cloud_id, avg(1 - d) AS oriented, avg(1 - abs(d)) AS absolute,
  avg(abs(nx - gx * sign(d)) + abs(ny - gy * sign(d)) + abs(nz - gz * sign(d))) / 3 AS inline,
  avg((len - 1) * (len - 1)) AS eikonal, avg(s) AS sine,
  avg((nx-gx)*(nx-gx)+(ny-gy)*(ny-gy)+(nz-gz)*(nz-gz)) / 3 AS mse FROM d GROUP BY 1)
SELECT cloud_id, round(oriented, 6) AS oriented, round(absolute, 6) AS absolute, round(inline, 6) AS inline,
  round(eikonal, 6) AS eikonal, round(sine, 6) AS sine, round(mse, 6) AS mse,
  round(absolute + inline + eikonal, 6) AS unoriented,
  round(0.5 * oriented + 0.5 * (absolute + inline + eikonal), 6) AS combined, round(mse + sine, 6) AS mse_sine FROM t""")
def _(spark, sf):
    return rounded(losses.evaluate_normal_losses(emb_points(spark, sf), ["cloud_id"]))


@query("loss_by_name", f"""WITH {SCORED}, per AS (SELECT cloud_id, count(*) AS n, least({_L1['focal']}, {_L2['focal']}) AS v FROM scored GROUP BY 1)
SELECT round(sum(v * n) / sum(n), 6) AS loss FROM per""")
def _(spark, sf):
    return rounded(losses.loss_by_name("flip_focal")(scored_labels(spark, sf)))


@query("scale_patch_stats", f"""WITH {PN}, {_PATCH_COUNTS}, {GT_FLIPS},
s AS (SELECT cloud_id % 2 AS scale_idx, num_points, greatest(num_correct, num_error) / num_points AS accuracy, gtf.flip AS gt_flip
  FROM pc JOIN gtf USING (cloud_id, patch_id))
SELECT scale_idx, count(*) AS num_patches, round(avg(num_points), 6) AS mean_points, round(avg(accuracy), 6) AS mean_accuracy,
  round(avg(gt_flip), 6) AS mean_gt FROM s GROUP BY 1""")
def _(spark, sf):
    pn = patch_normals(spark, sf)
    per = metrics.patch_point_accuracy(pn)[0].join(orient.majority_flips(pn), ["cloud_id", "patch_id"])
    per = per.select((F.col("cloud_id") % 2).alias("scale_idx"), "num_points",
                     F.col("patch_accuracy").alias("accuracy"), F.col("flip").alias("gt_flip"))
    return rounded(metrics.scale_patch_stats(per))


_DIRTY = """dirty AS (SELECT CASE WHEN l_linenumber = 7 THEN CAST('nan' AS DOUBLE) ELSE CAST(l_quantity AS DOUBLE) END AS q,
  CASE WHEN l_linenumber = 6 THEN CAST('inf' AS DOUBLE) ELSE CAST(l_extendedprice AS DOUBLE) / 1000 END AS p,
  CAST(l_tax AS DOUBLE) AS t FROM lineitem)"""


def _profile_sql(c):
    good = f"CASE WHEN NOT isnan({c}) AND NOT isinf({c}) THEN {c} END"
    return f"""SELECT '{c}' AS name, count({c}) AS total, count(*) FILTER (WHERE isnan({c})) AS nan_count,
  count(*) FILTER (WHERE isinf({c})) AS inf_count, min({good}) AS min, max({good}) AS max, avg({good}) AS mean,
  stddev_samp({good}) AS std, sqrt(sum(({good}) * ({good}))) AS l2 FROM dirty"""


_PROFILE = "prof AS (" + " UNION ALL ".join(_profile_sql(c) for c in "qpt") + ")"


def _dirty(spark, sf):
    li = table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    return li.select(
        F.when(n == 7, F.lit(float("nan"))).otherwise(F.col("l_quantity").cast("double")).alias("q"),
        F.when(n == 6, F.lit(float("inf"))).otherwise(F.col("l_extendedprice").cast("double") / 1000).alias("p"),
        F.col("l_tax").cast("double").alias("t"),
    )


@query("quality_profile", f"""WITH {_DIRTY}, {_PROFILE}
SELECT name, total, nan_count, inf_count, round(min, 6) AS min, round(max, 6) AS max, round(mean, 6) AS mean, round(std, 6) AS std,
  round(l2, 3) AS l2, CAST(nan_count > 0 AS BIGINT) AS has_nan FROM prof""")
def _(spark, sf):
    return rounded(metrics.quality_profile(_dirty(spark, sf), ["q", "p", "t"])).withColumn("l2", rnd("l2", 3))


@query("quality_rollup", f"""WITH {_DIRTY}, {_PROFILE}
SELECT count(*) AS columns, CAST(sum(total) AS BIGINT) AS total, CAST(sum(nan_count) AS BIGINT) AS nan_total,
  CAST(sum(inf_count) AS BIGINT) AS inf_total,
  string_agg(name, ',' ORDER BY name) FILTER (WHERE nan_count + inf_count > 0) AS affected FROM prof""")
def _(spark, sf):
    return rounded(metrics.quality_rollup(metrics.quality_profile(_dirty(spark, sf), ["q", "p", "t"])))


_OFFSETS = f"""WITH {EVT}, s AS (SELECT cloud_id, count(*) AS n FROM evt GROUP BY 1)
SELECT cloud_id, n, CAST(sum(n) OVER (ORDER BY cloud_id) AS BIGINT) AS end_offset FROM s"""


@query("cloud_offsets", _OFFSETS)
def _(spark, sf):
    return rounded(metrics.cloud_offsets(event_points(spark, sf)))


@query("offsets_to_counts", f"WITH {EVT} SELECT cloud_id, count(*) AS n FROM evt GROUP BY 1")
def _(spark, sf):
    return rounded(metrics.offsets_to_counts(metrics.cloud_offsets(event_points(spark, sf))))


@query("gt_flip_and_soft_labels", f"""WITH {EMB}, d AS (SELECT *, {sql_dot()} AS d FROM emb)
SELECT cloud_id, point_id, CAST(d < 0 AS BIGINT) AS gt_flip,
  round(CASE WHEN d < 0 THEN 0.5 + abs(d) / 2 ELSE 0.5 - abs(d) / 2 END, 6) AS soft_label FROM d""")
def _(spark, sf):
    from pointlake.operators.normals import flip_bits, soft_labels

    return rounded(soft_labels(flip_bits(emb_points(spark, sf))).select("cloud_id", "point_id", "gt_flip", "soft_label"))
