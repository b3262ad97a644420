"""Sources, sinks, run bookkeeping and streams over the test tables."""

import uuid

from pyspark.sql import functions as F

from pointlake.catalog.patch_queries import _MULTI, _SCALES, _multi
from pointlake.catalog.metric_queries import MERGED, NORMAL_METRICS
from pointlake.catalog.registry import ORACLES, query, rounded
from pointlake.catalog.toy import PN, patch_flips, patch_normals, sql_angle, sql_dot
from pointlake.fixtures import (
    EMB, EVT, HIST, emb_points, event_points, history_of_events, points_of_events, table, train_history,
)
from pointlake.functions.geometry import NORMAL, TRUTH, XYZ
from pointlake.operators import metrics, normals, orient
from pointlake.plans import runs
from pointlake.session import cut, shared_dir
from pointlake.sources import discovery, ply, tables
from pointlake.streaming import stream


def scratch(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _local(path):
    return path[5:] if path.startswith("file:") else path


_PATHS_SQL = """paths AS (SELECT '/data/' || d || '/' || CASE doc_id % 4 WHEN 0 THEN d || '_raw_pointcloud.ply' WHEN 1 THEN d || '_b' || doc_id || '.ply'
    WHEN 2 THEN 'other' || doc_id || '.ply' ELSE 'note' || doc_id || '.txt' END AS path
  FROM (SELECT doc_id, 'scene' || CAST(doc_id % 211 AS VARCHAR) AS d FROM documents)),
parts AS (SELECT path, regexp_extract(path, '([^/]+)/[^/]+$', 1) AS dir, regexp_extract(path, '([^/]+)$', 1) AS file,
    regexp_extract(path, '([^/]+)\\.[^./]*$', 1) AS stem FROM paths WHERE lower(path) LIKE '%.ply')"""


def _paths(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    scene = F.concat(F.lit("scene"), (F.col("doc_id") % 211).cast("string"))
    num = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 4
    name = (
        F.when(kind == 0, F.concat(scene, F.lit("_raw_pointcloud.ply"))).when(kind == 1, F.concat(scene, F.lit("_b"), num, F.lit(".ply")))
        .when(kind == 2, F.concat(F.lit("other"), num, F.lit(".ply"))).otherwise(F.concat(F.lit("note"), num, F.lit(".txt")))
    )
    return d.select(F.concat(F.lit("/data/"), scene, F.lit("/"), name).alias("path"))


@query("file_filter", f"WITH {_PATHS_SQL} SELECT path FROM parts")
def _(spark, sf):
    return _paths(spark, sf).where(F.lower("path").endswith(".ply"))


_SCENES = f"""WITH {_PATHS_SQL}, c AS (SELECT *, CASE WHEN file = dir || '_raw_pointcloud.ply' THEN 0 WHEN starts_with(stem, dir) THEN 1 ELSE 2 END AS c FROM parts),
g AS (SELECT dir, count(*) AS n_files, count(*) FILTER (WHERE c = 0) AS n0, count(*) FILTER (WHERE starts_with(stem, dir)) AS n1,
  arg_min(path, CAST(c AS VARCHAR) || path) AS first FROM c GROUP BY 1),
e AS (SELECT *, CASE WHEN n0 > 1 THEN 'several files named after the scene' WHEN n0 = 1 THEN NULL WHEN n1 > 1 THEN 'several scene-matched files'
  WHEN n1 = 1 THEN NULL WHEN n_files > 1 THEN 'several matching files' END AS error FROM g),
s AS (SELECT dir AS scene_name, CASE WHEN error IS NULL THEN first END AS path, CASE WHEN error IS NULL THEN 'ready' ELSE 'skipped' END AS status, error, n_files FROM e)"""


def _scenes(spark, sf):
    p = _paths(spark, sf).where(F.lower("path").endswith(".ply"))
    return discovery.resolve_scenes(p)


@query("resolve_scenes", f"{_SCENES} SELECT * FROM s")
def _(spark, sf):
    return _scenes(spark, sf)


@query("file_targets", f"""WITH {_PATHS_SQL} SELECT path, CASE WHEN starts_with(stem, dir) THEN dir END AS scene_name,
  CASE WHEN starts_with(stem, dir) THEN dir ELSE stem END AS output_name FROM parts""")
def _(spark, sf):
    return discovery.file_targets(_paths(spark, sf))


@query("preview_targets", f"""{_SCENES}, r AS (SELECT * FROM s WHERE n_files > 0)
SELECT scene_name, error, greatest(0, (SELECT count(*) FROM r) - 10) AS n_more FROM r ORDER BY scene_name LIMIT 10""")
def _(spark, sf):
    r = _scenes(spark, sf).where("n_files > 0").withColumn("path", F.col("scene_name"))
    return rounded(discovery.preview(r).select("scene_name", "error", "n_more"))


_PTS = "SELECT cloud_id, point_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, round(nx, 6) + 0.0 AS nx"


def _round_trip(spark, sf, binary):
    """Export all clouds, some of them in parts, and read the files back with the data source."""
    p = emb_points(spark, sf)
    if not binary:
        p = p.withColumns({c: F.round(c, 6) for c in (*XYZ, *NORMAL)})
    folder = scratch(spark, "ply")
    ply.write_ply(p, folder, binary=binary, normals=True, rows_per_file=30).count()
    back = ply.read_ply(spark, _local(folder), ["x", "y", "z", "nx", "ny", "nz"])
    return rounded(back.select(F.col("cloud_id").cast("long").alias("cloud_id"), F.col("point_id").alias("place"), *XYZ, *NORMAL), 6 if binary else 4)


def _round_trip_sql(value):
    columns = ", ".join(f"{value.format(c)} + 0.0 AS {c}" for c in (*XYZ, *NORMAL))
    return f"""WITH {EMB} SELECT cloud_id, row_number() OVER (PARTITION BY cloud_id ORDER BY point_id) - 1 AS place, {columns} FROM emb"""


@query("ply_round_trip_binary", _round_trip_sql("round({}, 6)"))
def _(spark, sf):
    return _round_trip(spark, sf, True)


@query("ply_round_trip_ascii", _round_trip_sql("round(CAST(round({}, 6) AS FLOAT)::DOUBLE, 4)"))
def _(spark, sf):
    return _round_trip(spark, sf, False)


@query("ply_same_stem", f"""WITH {EMB} SELECT f AS folder, 'f' || f || '/all' AS cloud_id, count(*) AS n, CAST(count(DISTINCT point_id) AS BIGINT) AS ids
FROM (SELECT cloud_id % 3 AS f, point_id FROM emb) GROUP BY 1""")
def _(spark, sf):
    """Files of the same name in several folders are several clouds."""
    p = emb_points(spark, sf).withColumn("folder", F.col("cloud_id") % 3)
    folder = scratch(spark, "ply")
    for f in range(3):
        part = p.where(F.col("folder") == f).withColumn("cloud_id", F.lit("all"))
        files = spark._jvm.org.apache.hadoop.fs
        store = files.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(files.Path(f"{folder}/all/f{f}"))
        ply.join_parts(ply.write_ply(part, f"{folder}/raw{f}").withColumn("file", F.lit("all.ply")), f"{folder}/all/f{f}")
    back = ply.read_ply(spark, f"{folder}/all", ["x"]).groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("point_id").alias("ids"))
    return back.select(F.substring("cloud_id", 2, 1).cast("long").alias("folder"), "cloud_id", "n", "ids")


@query("ply_names_round_trip", f"""WITH {EMB}, t AS (SELECT ['a b', 'a_b', 'a:b', 'a/b', 'ä%20', '..', '007'][cloud_id % 7 + 1] AS cloud_id FROM emb)
SELECT cloud_id, count(*) AS n FROM t GROUP BY 1""")
def _(spark, sf):
    """Names that only differ in characters which file names do not bear."""
    names = F.array(*map(F.lit, ["a b", "a_b", "a:b", "a/b", "ä%20", "..", "007"]))
    p = emb_points(spark, sf).withColumn("cloud_id", names[(F.col("cloud_id") % 7).cast("int")])
    folder = scratch(spark, "ply")
    ply.write_ply(p, folder, binary=True).count()
    return ply.read_ply(spark, folder, ["x"]).groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))


@query("points_files_fallback", f"WITH {EMB} SELECT CAST(cloud_id AS VARCHAR) AS cloud_id, count(*) AS n FROM emb GROUP BY 1")
def _(spark, sf):
    """Raw files are read where the preprocessed table is missing."""
    folder = scratch(spark, "ply")
    ply.write_ply(emb_points(spark, sf), folder).count()
    return ply.read_points(spark, f"{folder}-missing", folder).groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))


@query("ply_manifest", f"""WITH {EMB}, r AS (SELECT cloud_id, (row_number() OVER (PARTITION BY cloud_id ORDER BY point_id) - 1) // 30 AS part FROM emb)
SELECT cloud_id, CAST(part AS BIGINT) AS part, count(*) AS rows FROM r GROUP BY 1, 2""")
def _(spark, sf):
    m = ply.write_ply(emb_points(spark, sf), scratch(spark, "ply"), rows_per_file=30)
    return rounded(m.select("cloud_id", "part", "rows"))


@query("ply_lines", f"""WITH {EMB} SELECT cloud_id, point_id, printf('%.6f %.6f %.6f %.6f %.6f %.6f %d %d %d', x, y, z, nx, ny, nz,
  CAST(point_id % 256 AS INT), CAST(7 AS INT), CAST(255 AS INT)) AS line FROM emb""")
def _(spark, sf):
    p = emb_points(spark, sf).withColumns({"r": F.col("point_id") % 256, "g": F.lit(7), "b": F.lit(255)})
    return ply.ascii_lines(p, True, True).select("cloud_id", "point_id", "line")


@query("points_table_or_files", f"WITH {EVT} SELECT cloud_id, count(*) AS n FROM evt GROUP BY 1")
def _(spark, sf):
    path = scratch(spark, "points")
    event_points(spark, sf).write.parquet(path)
    return ply.read_points(spark, path, None).groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))


@query("text_ids_table", f"WITH {EVT} SELECT '00' || CAST(cloud_id AS VARCHAR) AS cloud_id, count(*) AS n FROM evt GROUP BY 1")
def _(spark, sf):
    """Ids that look like numbers survive a partitioned table, and a second write replaces the first."""
    p = event_points(spark, sf).withColumn("cloud_id", F.concat(F.lit("00"), F.col("cloud_id").cast("string")))
    counts = p.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))
    root = scratch(spark, "tables")
    tables.write_table(counts.where("n > 70"), root, {"k": 1}, ["n"])
    tables.write_table(counts, root, {"k": 1}, ["cloud_id"])
    return tables.read_table(spark, root, {"k": 1}).select("cloud_id", "n")


@query("membership_table", f"{_MULTI} SELECT cloud_id, patch_id, point_id FROM ms WHERE scale_idx = 0")
def _(spark, sf):
    """Write the memberships below the address of their scales, then read one scale by partition pruning."""
    root = scratch(spark, "members")
    config = {"scales": _SCALES}
    tables.write_table(_multi(spark, sf), root, config, ["cloud_id", "scale_idx"])
    back = tables.read_table(spark, root, config).where("scale_idx = 0")
    return back.select(F.col("cloud_id").cast("long"), "patch_id", "point_id")


@query("membership_integrity", f"""{_MULTI} SELECT cloud_id, scale_idx, CAST(cloud_id % 3 <> 1 AS BIGINT) AS valid
FROM (SELECT DISTINCT cloud_id, scale_idx FROM ms)""")
def _(spark, sf):
    """A manifest that expects one row too many for every third cloud must not validate there."""
    m = _multi(spark, sf)
    keys = ["cloud_id", "scale_idx"]
    n = m.groupBy(*keys).agg(F.count_distinct("patch_id").alias("n_patches"), F.count(F.lit(1)).alias("n_rows"))
    n = n.withColumn("n_rows", F.col("n_rows") + F.when(F.col("cloud_id") % 3 == 1, 1).otherwise(0))
    return rounded(tables.membership_integrity(m, n))


@query("feature_table", """SELECT CAST(label AS BIGINT) AS cloud_id, CAST(vec_id AS BIGINT) AS patch_id, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS f0
FROM embeddings WHERE vec_id % 3 = 1""")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    f = e.select(F.col("label").cast("long").alias("cloud_id"), F.col("vec_id").cast("long").alias("patch_id"),
                 F.col("embedding").alias("feature"), (F.col("vec_id") % 3).alias("scale_idx"))
    root = scratch(spark, "features")
    tables.write_table(f, root, {"kind": "features"}, ["scale_idx"])
    back = tables.read_table(spark, root, {"kind": "features"}).where("scale_idx = 1")
    return rounded(back.select("cloud_id", "patch_id", F.col("feature")[0].alias("f0")))


_BITS = "CAST(CAST(CAST(CAST({c} + 0.0 AS DOUBLE) AS BIT) AS BIGINT) AS VARCHAR)"
_MARK = f"""bit_xor(CAST(('0x' || substr(md5(CAST(point_id AS VARCHAR) || '|' || {_BITS.format(c='x')} || '|' || {_BITS.format(c='y')} || '|' ||
  {_BITS.format(c='z')}), 1, 13)) AS BIGINT))"""


@query("cloud_fingerprint", f"WITH {EMB} SELECT cloud_id, count(*) AS n, {_MARK} AS mark FROM emb GROUP BY 1")
def _(spark, sf):
    return tables.fingerprint(emb_points(spark, sf))


@query("reusable_results", f"WITH {EMB} SELECT DISTINCT cloud_id FROM emb WHERE cloud_id % 2 = 0")
def _(spark, sf):
    """Clouds whose coordinates did not change: the odd ones are moved by less than a millionth of a millionth."""
    p = emb_points(spark, sf)
    moved = p.withColumn("x", F.col("x") + F.when(F.col("cloud_id") % 2 == 1, 1e-13).otherwise(0.0))
    return tables.reusable(tables.fingerprint(moved), tables.fingerprint(p))


_CONF = """conf AS (SELECT p_partkey, '{"k":' || CAST(p_size AS VARCHAR) || ',"method":"' || p_brand || '"}' AS text FROM part)"""


@query("config_address", f"WITH {_CONF} SELECT p_partkey, substr(md5(text), 1, 8) AS hash FROM conf")
def _(spark, sf):
    p = table(spark, sf, "part")
    text = F.to_json(F.struct(F.col("p_size").alias("k"), F.col("p_brand").alias("method")))
    return p.select("p_partkey", tables.config_hash_column(text).alias("hash"))


@query("stale_and_valid_tables", f"""WITH {_CONF}, h AS (SELECT DISTINCT substr(md5(text), 1, 8) AS hash FROM conf)
SELECT hash, CASE WHEN substr(hash, 1, 1) < '8' THEN 'valid' ELSE 'missing' END AS state FROM h""")
def _(spark, sf):
    p = table(spark, sf, "part")
    text = F.to_json(F.struct(F.col("p_size").alias("k"), F.col("p_brand").alias("method")))
    want = p.select(tables.config_hash_column(text).alias("hash")).distinct()
    have = want.where(F.substring("hash", 1, 1) < "8")
    missing, valid = runs.missing_and_existing(want, have)
    return valid.withColumn("state", F.lit("valid")).unionByName(missing.withColumn("state", F.lit("missing")))


@query("unfinished_clouds", """SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)""")
def _(spark, sf):
    todo = table(spark, sf, "orders").select("o_custkey").distinct()
    done = table(spark, sf, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    return tables.unfinished(todo, done, ["o_custkey"])


@query("union_clouds", f"WITH {EMB}, {EVT} SELECT cloud_id, count(*) AS n FROM (SELECT cloud_id FROM emb UNION ALL SELECT cloud_id FROM evt) GROUP BY 1")
def _(spark, sf):
    both = runs.union_clouds(emb_points(spark, sf).select("cloud_id", "point_id", *XYZ), event_points(spark, sf))
    return both.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))


_RES = """res AS (SELECT o_orderkey, 'm' || CAST(o_orderkey AS VARCHAR) AS model_name, 's' || CAST(o_custkey AS VARCHAR) AS scene_name,
  CASE WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderkey % 11 = 0 THEN 'skipped' ELSE 'success' END AS status,
  o_custkey AS num_points, (o_orderkey % 50) / 50.0 AS acc FROM orders)"""


_SUMMARY = f"""WITH {_RES}, s AS (SELECT *, status = 'success' AS ok FROM res)
SELECT model_name, scene_name, '/in' AS input_path, '/out' AS output_dir, status, CASE WHEN ok THEN CAST(num_points AS BIGINT) END AS num_points,
  CASE WHEN ok THEN CAST(3 AS BIGINT) END AS num_patches, CASE WHEN ok THEN 'optimize' END AS pipeline_type,
  CASE WHEN ok AND acc <> 0 THEN round(acc * 100, 6) END AS point_accuracy, CASE WHEN ok AND acc <> 0 THEN round(acc * 100, 6) END AS final_accuracy,
  CAST(NULL AS DOUBLE) AS flip_accuracy, CASE WHEN ok THEN round(acc * 90, 6) END AS mean_error, CASE WHEN ok THEN CAST(1.5 AS DOUBLE) END AS time_total,
  CASE WHEN ok THEN '' ELSE 'boom' END AS error_message FROM s"""


def _results(spark, sf):
    o = table(spark, sf, "orders")
    key, acc = F.col("o_orderkey"), (F.col("o_orderkey") % 50) / F.lit(50.0)
    r = o.select(
        F.concat(F.lit("m"), key.cast("string")).alias("model_name"), F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("scene_name"),
        F.lit("/in").alias("input_path"), F.lit("/out").alias("output_dir"),
        F.when(key % 7 == 0, "failed").when(key % 11 == 0, "skipped").otherwise("success").alias("status"),
        F.col("o_custkey").cast("long").alias("num_points"), F.lit(3).cast("long").alias("num_patches"), F.lit("optimize").alias("pipeline_type"),
        acc.alias("point_accuracy"), acc.alias("final_accuracy"), F.lit(0.0).alias("flip_accuracy"), (acc * 90).alias("mean_error"),
        F.lit(1.5).alias("time_total"), F.lit("boom").alias("error_message"),
    )
    return r


@query("run_summary_rows", _SUMMARY)
def _(spark, sf):
    return rounded(runs.summary_rows(_results(spark, sf)))


@query("summary_file", _SUMMARY)
def _(spark, sf):
    """The same rows from the file, in which the empty message of a success is an empty field."""
    path = scratch(spark, "summary")
    runs.write_summary(_results(spark, sf), path)
    back = spark.read.schema(runs.summary_rows(_results(spark, sf)).schema).option("header", True).csv(path)
    return rounded(back.withColumn("error_message", F.coalesce("error_message", F.lit(""))))


def _spoil(manifest):
    """Breaks the written files of clouds 1 (cut short), 2 (no PLY file) and 3 (an unknown type)."""
    def run(batches):
        for pdf in batches:
            for cloud, path in zip(pdf["cloud_id"], pdf["path"]):
                with open(path, "rb") as f:
                    data = f.read()
                data = {1: data[:-9], 2: b"xyz" + data[3:], 3: data.replace(b"property double", b"property dubble")}.get(int(cloud), data)
                with open(path, "wb") as f:
                    f.write(data)
            yield pdf

    return manifest.where("cloud_id IN (1, 2, 3)").mapInPandas(run, manifest.schema).count()


@query("batch_status", f"""WITH {EMB}, n AS (SELECT cloud_id, count(*) AS n FROM emb GROUP BY 1)
SELECT CAST(cloud_id AS VARCHAR) AS cloud_id,
  CASE WHEN cloud_id IN (1, 2, 3, 5) THEN 'skipped' WHEN cloud_id = 4 THEN 'failed' ELSE 'success' END AS status,
  CASE cloud_id WHEN 1 THEN 'ValueError: PLY file is shorter than its header says' WHEN 2 THEN 'ValueError: not a PLY file' WHEN 3 THEN 'KeyError: ' || chr(39) || 'dubble' || chr(39)
    WHEN 4 THEN 'ValueError: coordinates are not finite' WHEN 5 THEN 'output exists' END AS error,
  CASE WHEN cloud_id NOT IN (1, 2, 3, 4, 5) THEN n END AS normals FROM n""")
def _(spark, sf):
    """Normals of a folder of PLY files, three of them broken, one with a coordinate that is no number, one finished."""
    p = emb_points(spark, sf).select("cloud_id", "point_id", *XYZ)
    p = p.withColumn("x", F.when((F.col("cloud_id") == 4) & (F.col("point_id") % 3 == 0), F.lit(float("nan"))).otherwise(F.col("x")))
    folder = scratch(spark, "batch")
    _spoil(ply.write_ply(p, folder, binary=True))
    found = {}

    def work(todo):
        points = ply.read_ply(spark, folder, ["x", "y", "z"], skip_broken=True).join(todo, "cloud_id", "left_semi")
        good, errors = normals.cloud_normals(points, 10)
        found["normals"] = cut(good.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("normals")))
        return found["normals"].select("cloud_id", F.lit(None).cast("string").alias("error")).unionByName(errors)

    targets = ply.ply_status(spark, folder).groupBy("cloud_id").agg(F.min("error").alias("error"))
    finished = targets.select("cloud_id").where("cloud_id = '5'")
    return runs.run_with_status(targets, work, finished).join(found["normals"], "cloud_id", "left")


@query("downsample_files", f"""WITH {EMB}, s AS (SELECT cloud_id, count(*) AS n FROM emb GROUP BY 1)
SELECT CAST(cloud_id AS VARCHAR) AS cloud_id, CASE WHEN cloud_id IN (1, 2, 3) THEN 'failed' ELSE 'success' END AS status,
  CASE cloud_id WHEN 1 THEN 'ValueError' WHEN 2 THEN 'ValueError' WHEN 3 THEN 'KeyError' END AS error,
  CASE WHEN cloud_id NOT IN (1, 2, 3) THEN n END AS n_in, CASE WHEN cloud_id NOT IN (1, 2, 3) THEN CAST(greatest(1, floor(n * 0.25)) AS BIGINT) END AS n_out,
  CASE WHEN cloud_id NOT IN (1, 2, 3) THEN round(greatest(1, floor(n * 0.25)) / n, 6) END AS actual_ratio,
  CASE WHEN cloud_id NOT IN (1, 2, 3) THEN CAST(cloud_id % 2 AS BIGINT) END AS has_normals, CASE WHEN cloud_id NOT IN (1, 2, 3) THEN CAST(0 AS BIGINT) END AS has_colors,
  CASE WHEN cloud_id NOT IN (1, 2, 3) THEN CAST(greatest(1, floor(n * 0.25)) AS BIGINT) END AS n_original FROM s""")
def _(spark, sf):
    """Files sampled to files: the odd clouds have normals, three files are broken; every written point is one of the read ones."""
    p = emb_points(spark, sf).select("cloud_id", "point_id", *XYZ, *NORMAL)
    source, target = scratch(spark, "dense"), scratch(spark, "thin")
    bare = ply.write_ply(p.where("cloud_id % 2 = 0"), source, binary=True)
    _spoil(bare.unionByName(ply.write_ply(p.where("cloud_id % 2 = 1"), source, binary=True, normals=True)))
    stats = runs.downsample_files(spark, source, target, ratio=0.25, binary=True)
    known = p.select(F.col("cloud_id").cast("string").alias("cloud_id"), *XYZ)
    again = ply.read_ply(spark, target).select("cloud_id", *XYZ).join(known, ["cloud_id", *XYZ], "left_semi")
    again = again.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n_original"))
    return rounded(stats.withColumn("error", F.split("error", ":")[0]).join(again, "cloud_id", "left"))


_RATE = f"""rep AS (SELECT cloud_id, patch_id, 1 - greatest(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END), 1 - avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END)) AS error_rate
  FROM (SELECT cloud_id, patch_id, {sql_dot()} AS d FROM pn) GROUP BY 1, 2)"""


def _patch_rep(spark, sf):
    return metrics.patch_report(patch_normals(spark, sf), patch_flips(spark, sf))


@query("patches_to_save", f"WITH {PN}, {_RATE} SELECT cloud_id, patch_id FROM rep WHERE error_rate >= 0.3")
def _(spark, sf):
    return runs.patches_to_save(_patch_rep(spark, sf), min_error_rate=0.3).select("cloud_id", "patch_id")


@query("patch_info", f"""WITH {PN}, {_RATE} SELECT cloud_id, count(*) AS total_patches, count(*) FILTER (WHERE error_rate <= 0.3) AS saved_patches
FROM rep GROUP BY 1""")
def _(spark, sf):
    rep = _patch_rep(spark, sf)
    return rounded(runs.patch_info(rep, runs.patches_to_save(rep, max_error_rate=0.3)))


_JSON = {
    "num_points": "", "num_patches": "", "point_accuracy": "accuracy.", "final_accuracy": "accuracy.", "flip_accuracy": "accuracy.", "edge_accuracy": "accuracy.",
    "total_edges": "accuracy.", "mean_error": "overall_metrics.", "median_error": "overall_metrics.", "pgp5": "overall_metrics.", "pgp10": "overall_metrics.",
    "pgp30": "overall_metrics.", "rmse_unoriented": "overall_metrics.", "rmse_oriented": "overall_metrics.",
}
_REPORT = f"""SELECT * FROM ({ORACLES['point_accuracy']}) JOIN ({ORACLES['final_accuracy']}) USING (cloud_id) JOIN ({ORACLES['flip_accuracy']}) USING (cloud_id)
JOIN ({ORACLES['edge_accuracy']}) USING (cloud_id) JOIN (WITH {PN}, {MERGED.format(flip='f.flip', table='flips')}, e AS (SELECT cloud_id, {sql_angle(False, False)} AS e,
  {sql_angle(True, False)} AS o FROM merged) SELECT cloud_id, count(*) AS num_points, {NORMAL_METRICS} FROM e GROUP BY cloud_id) USING (cloud_id)
JOIN (WITH {PN} SELECT cloud_id, count(*) AS num_patches FROM flips GROUP BY 1) USING (cloud_id)"""


@query("metrics_json", f"SELECT cloud_id, {', '.join(_JSON)} FROM ({_REPORT})")
def _(spark, sf):
    """The nested report of every cloud with all its fields, read back by path."""
    pn, flips = patch_normals(spark, sf), patch_flips(spark, sf)
    truth = emb_points(spark, sf).select("cloud_id", "point_id", *TRUTH)
    final, true_flips = orient.merge_patches(pn, flips).join(truth, ["cloud_id", "point_id"]), orient.majority_flips(pn)
    out = final.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("num_points"))
    for part in (
        metrics.normal_metrics(final, ["cloud_id"]), flips.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("num_patches")),
        metrics.patch_point_accuracy(pn)[1], metrics.final_accuracy(final), metrics.flip_accuracy(flips, true_flips),
        metrics.edge_accuracy(orient.overlap_relation(pn), true_flips),
    ):
        out = out.join(part.select("cloud_id", *(c for c in part.columns if c not in out.columns)), "cloud_id")
    kind = {c: "long" if c.startswith(("num_", "total_")) else "double" for c in _JSON}
    return rounded(runs.metrics_json(out).select("cloud_id", *(F.get_json_object("json", f"$.{at}{c}").cast(kind[c]).alias(c) for c, at in _JSON.items())))


@query("export_patches", f"""WITH {PN}, {_RATE}, k AS (SELECT cloud_id, patch_id FROM rep WHERE error_rate >= 0.3)
SELECT cloud_id, patch_id, point_id, round(x, 6) + 0.0 AS x, CAST(CASE WHEN {sql_dot()} > 0 THEN 0 ELSE 255 END AS BIGINT) AS r, CAST(CASE WHEN {sql_dot()} > 0 THEN 255 ELSE 0 END AS BIGINT) AS g
FROM pn SEMI JOIN k USING (cloud_id, patch_id)""")
def _(spark, sf):
    """Patches with many errors written with the colours of their points and read back."""
    chosen = runs.patches_to_save(_patch_rep(spark, sf), min_error_rate=0.3)
    path = scratch(spark, "segments")
    runs.export_patches(patch_normals(spark, sf), chosen, path, buckets=8)
    return rounded(spark.read.parquet(path).select("cloud_id", "patch_id", "point_id", "x", "r", "g"))


_PREDICTED = f"""{EMB}, t AS (SELECT *, CASE WHEN nx >= ny AND nx >= nz THEN 0 WHEN ny >= nz THEN 1 ELSE 2 END AS p, point_id % 3 AS t FROM emb
  WHERE point_id % 10 > 0)"""


def _predicted(spark, sf):
    p = emb_points(spark, sf)
    pred = p.where("point_id % 10 > 0").select("cloud_id", "point_id", F.array(*NORMAL).alias("prediction"))
    truth = p.select("cloud_id", "point_id", (F.col("point_id") % 3).alias("ground_truth"))
    return runs.prediction_rows(p, pred, truth, 3)


@query("prediction_rows", f"""WITH {_PREDICTED}
SELECT cloud_id, point_id, CAST(p AS BIGINT) AS prediction, t AS ground_truth, CAST([128, 255, 0][p + 1] AS BIGINT) AS pr, CAST([128, 255, 0][t + 1] AS BIGINT) AS tr FROM t""")
def _(spark, sf):
    """Predicted and true labels of all clouds with their colours; a tenth of the points have no prediction."""
    return rounded(_predicted(spark, sf).select("cloud_id", "point_id", "prediction", "ground_truth", "pr", "tr"))


@query("comparison_export", f"""WITH {_PREDICTED}
SELECT cloud_id, point_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, CAST(p AS BIGINT) AS prediction, t AS ground_truth FROM t""")
def _(spark, sf):
    """The comparison of predicted and true labels, written as JSON lines and read back."""
    path = scratch(spark, "comparison")
    runs.write_comparison(_predicted(spark, sf), path)
    schema = "cloud_id long, point_id long, x double, y double, z double, prediction long, ground_truth long"
    return rounded(spark.read.schema(schema).json(path))


@query("epoch_rollup", f"""WITH {HIST} SELECT epoch, round(avg(loss), 6) AS loss, round(avg(accuracy), 6) AS accuracy, round(arg_max(learning_rate, batch), 6) AS learning_rate
FROM hist GROUP BY 1""")
def _(spark, sf):
    return rounded(runs.epoch_rollup(train_history(spark, sf)))


_EP = f"{HIST}, ep AS (SELECT epoch, round(avg(accuracy), 6) AS accuracy FROM hist WHERE epoch % 2 = 0 GROUP BY 1)"


@query("running_best", f"""WITH {_EP}, b AS (SELECT *, greatest(0, coalesce(max(accuracy) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS prev FROM ep)
SELECT epoch, accuracy, CAST(accuracy > prev AS BIGINT) AS is_best, greatest(prev, accuracy) AS best_so_far FROM b""")
def _(spark, sf):
    ep = rounded(runs.epoch_rollup(runs.validation_epochs(train_history(spark, sf), 2)).select("epoch", "accuracy"))
    return rounded(runs.running_best(ep, "accuracy"))


@query("retention", f"""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r > 3""")
def _(spark, sf):
    return runs.keep_last(table(spark, sf, "events").select("user_id", "event_id"), 3, ["user_id"], "event_id")


@query("run_improvement", """SELECT user_id, round(arg_min(value, event_id), 6) AS first, round(arg_max(value, event_id), 6) AS last,
  round(arg_max(value, event_id) - arg_min(value, event_id), 6) + 0.0 AS gain FROM events GROUP BY 1""")
def _(spark, sf):
    return rounded(runs.improvement(table(spark, sf, "events"), "value", ["user_id"], "event_id"))


@query("largest_batch", f"""WITH {EVT}, b AS (SELECT cloud_id AS batch, count(*) AS num_points FROM evt GROUP BY 1 ORDER BY 1 LIMIT 10)
SELECT batch, num_points FROM b ORDER BY num_points DESC, batch LIMIT 1""")
def _(spark, sf):
    b = event_points(spark, sf).groupBy(F.col("cloud_id").alias("batch")).agg(F.count(F.lit(1)).alias("num_points"))
    return runs.largest_batch(b, 10)


@query("run_report", f"""WITH {HIST}, v AS (SELECT epoch, round(avg(loss), 6) AS loss, round(avg(accuracy), 6) AS accuracy, round(max(accuracy), 6) AS iou FROM hist GROUP BY 1),
b AS (SELECT * FROM v ORDER BY iou DESC, epoch LIMIT 1), f AS (SELECT * FROM v ORDER BY epoch DESC LIMIT 1)
SELECT f.epoch AS total_epochs, (SELECT count(*) FROM hist) AS total_steps, b.epoch AS best_epoch, b.loss AS best_loss, b.accuracy AS best_accuracy,
  b.iou AS best_iou, f.loss AS final_loss, f.accuracy AS final_accuracy, f.iou AS final_iou FROM b, f""")
def _(spark, sf):
    h = train_history(spark, sf)
    v = rounded(h.groupBy("epoch").agg(F.avg("loss").alias("loss"), F.avg("accuracy").alias("accuracy"), F.max("accuracy").alias("iou")))
    return rounded(runs.run_report(v, h))


def _events_schema(spark, sf):
    return table(spark, sf, "events").schema


@query("stream_epoch_rollup", f"""WITH {HIST} SELECT epoch, round(avg(loss), 6) AS loss, round(avg(accuracy), 6) AS accuracy, round(arg_max(learning_rate, batch), 6) AS learning_rate
FROM hist GROUP BY 1""")
def _(spark, sf):
    """Training history as a stream of several files; the rolled-up epochs equal those of the batch job."""
    folder, sink = scratch(spark, "history"), scratch(spark, "epochs")
    table(spark, sf, "events").repartition(5, "event_id").write.parquet(folder)
    events = spark.readStream.schema(_events_schema(spark, sf)).option("maxFilesPerTrigger", 2).parquet(folder)
    stream.rollup_stream(history_of_events(events), sink, scratch(spark, "stream")).awaitTermination()
    return rounded(stream.read_rollup(spark, sink))


@query("stream_pieces", f"""WITH {EVT}, g AS (SELECT cloud_id, count(*) AS n, sum(point_id) AS ids, round(sum(x), 6) + 0.0 AS sx FROM evt GROUP BY 1)
SELECT cloud_id, CASE WHEN cloud_id % 7 = 0 THEN 'incomplete' ELSE 'ok' END AS status, n, CASE WHEN cloud_id % 7 > 0 THEN CAST(ids AS BIGINT) END AS ids,
  CASE WHEN cloud_id % 7 > 0 THEN sx END AS sx FROM g""")
def _(spark, sf):
    """Clouds whose points arrive in six files in no order; every seventh request declares a point too many and times out."""
    folder, sink = scratch(spark, "pieces"), scratch(spark, "whole")
    p = event_points(spark, sf).select("cloud_id", "point_id", *XYZ)
    p.repartition(6, F.xxhash64("point_id")).write.parquet(folder)
    sizes = p.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))
    requests = sizes.select("cloud_id", (F.col("n") + (F.col("cloud_id") % 7 == 0).cast("int")).alias("data_size"))
    sums = lambda df: df.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"), F.sum("point_id").alias("ids"), F.sum("x").alias("sx"))
    stream.collect_stream(spark, folder, p.schema, sink, scratch(spark, "stream"), requests, patience=5, files_per_batch=1, interval=None, work=sums).awaitTermination()
    done = spark.read.parquet(sink).select("cloud_id", F.lit("ok").alias("status"), "n", "ids", "sx")
    late = spark.read.parquet(f"{sink}_errors").groupBy("cloud_id").agg(F.min("message").alias("status"), F.sum("received").alias("n"))
    waiting = spark.read.parquet(f"{sink}_pending").where("batch = 5").groupBy("cloud_id").agg(F.lit("incomplete").alias("status"), F.count(F.lit(1)).alias("n"))
    late = late.unionByName(waiting).groupBy("cloud_id").agg(F.min("status").alias("status"), F.sum("n").alias("n"))
    return rounded(done.unionByName(late.withColumns({"ids": F.lit(None).cast("long"), "sx": F.lit(None).cast("double")}).select(done.columns)))


@query("stream_orientation", f"WITH {EVT} SELECT cloud_id, count(*) AS n, CAST(1 AS BIGINT) AS unit FROM evt GROUP BY 1")
def _(spark, sf):
    """Orient the arriving clouds; every point comes back with a unit normal."""
    sink = scratch(spark, "oriented")
    q = stream.orient_stream(spark, f"{sf}/event[s].parquet", _events_schema(spark, sf), sink, scratch(spark, "stream"), interval=None,
                             work=lambda b: stream.orient_batch(points_of_events(b)))
    q.awaitTermination()
    out = spark.read.parquet(sink)
    n2 = F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")
    return out.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"), F.min((F.abs(n2 - 1) < 1e-6).cast("long")).alias("unit"))


@query("request_validation", f"""WITH {EVT}, g AS (SELECT cloud_id, count(*) AS received FROM evt GROUP BY 1),
r AS (SELECT cloud_id, received + CASE WHEN cloud_id % 5 = 0 THEN 1 ELSE 0 END AS data_size, received, cloud_id % 3 > 0 AS known FROM g)
SELECT cloud_id, data_size, received, 'direct_orientation' AS function_name,
  CASE WHEN received <> data_size THEN 'error' WHEN NOT known THEN 'warning' ELSE 'ok' END AS status,
  CASE WHEN received <> data_size THEN 'size mismatch' WHEN NOT known THEN 'unknown function' ELSE '' END AS message FROM r""")
def _(spark, sf):
    p = event_points(spark, sf)
    r = p.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("data_size")).select(
        "cloud_id", (F.col("data_size") + F.when(F.col("cloud_id") % 5 == 0, 1).otherwise(0)).alias("data_size"),
        F.when(F.col("cloud_id") % 3 > 0, F.lit("direct_orientation")).otherwise(F.lit("unknown")).alias("function_name"))
    return rounded(stream.validate_requests(p, r))
