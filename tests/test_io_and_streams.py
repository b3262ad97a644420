import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointlake.functions.curves import hilbert_coords, hilbert_index
from pointlake.operators import orient, sampling
from pointlake.operators.metrics import edge_accuracy, normal_metrics
from pointlake.operators.patches import extract_patches, grid_patches, patch_statistics
from pointlake.operators.transforms import fourier_features, norm_params, normalise
from pointlake.plans import edge_model
from pointlake.sources import discovery, ply, tables
from pointlake.streaming import stream
from tests.test_knn import cloud

HEAD = "ply\nformat {f} 1.0\ncomment test\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"


def test_ply_encodings_and_small_splits(spark, tmp_path):
    rec = np.array([(0.5, 1.5, -2.0, 1, 2, 3), (3.0, 4.0, 5.0, 4, 5, 6), (6.0, 7.0, 8.0, 7, 8, 9)], dtype="f4,f4,f4,u1,u1,u1")
    for name, order, fmt in (("le", "<", "binary_little_endian"), ("be", ">", "binary_big_endian")):
        body = rec.astype([(n, order + "f4") for n in ("x", "y", "z")] + [(n, "u1") for n in "rgb"])
        (tmp_path / f"{name}.ply").write_bytes(HEAD.format(f=fmt).encode() + body.tobytes() + b"\x03" + b"\0" * 12)
    text = "\n".join(" ".join(str(v) for v in r) for r in rec.tolist()) + "\n3 0 1 2\n"
    (tmp_path / "text.ply").write_text(HEAD.format(f="ascii") + text)
    ply.register(spark)
    df = spark.read.format("ply").option("splitBytes", "64").load(str(tmp_path))
    got = df.toPandas().sort_values(["cloud_id", "point_id"])
    assert got.groupby("cloud_id").size().to_dict() == {"be": 3, "le": 3, "text": 3}
    for _, g in got.groupby("cloud_id"):
        assert g["point_id"].tolist() == [0, 1, 2]
        assert g[["x", "y", "z", "r", "g", "b"]].to_numpy().tolist() == [list(r) for r in rec.tolist()]
        assert g["nx"].isna().all()
    with pytest.raises(Exception, match="no normals"):
        ply.read_ply(spark, str(tmp_path), require_normals=True).count()


def test_discovery_modes(spark, tmp_path):
    for d, files in {"a": ["a_raw_pointcloud.ply", "x_raw_pointcloud.ply"], "b": ["x_raw_pointcloud.ply", "y_raw_pointcloud.ply"], "c": []}.items():
        (tmp_path / d).mkdir()
        for f in files:
            (tmp_path / d / f).write_text("ply\n")
    rows = {r.scene_name: (r.status, r.error) for r in discovery.resolve_targets(spark, str(tmp_path)).collect()}
    assert rows == {"a": ("ready", None), "b": ("skipped", "several matching files"), "c": ("skipped", "no matching files")}
    one = discovery.resolve_targets(spark, str(tmp_path / "a")).collect()
    assert len(one) == 1 and one[0].path.endswith("a/a_raw_pointcloud.ply")


def test_table_of_another_configuration_is_not_used(spark, tmp_path):
    df = spark.range(5).withColumn("s", F.lit(1))
    tables.write_table(df, str(tmp_path), {"k": 1}, ["s"])
    assert tables.read_table(spark, str(tmp_path), {"k": 1}).count() == 5
    assert tables.read_table(spark, str(tmp_path), {"k": 2}) is None
    assert tables.config_hash({"b": 1, "a": 2}) == tables.config_hash({"a": 2, "b": 1, "c": 3}, ["a", "b"])


def test_the_files_of_a_table_do_not_grow_with_its_partition_values(spark, tmp_path):
    """More values than folders: few files, each with its own stretch of ids, and a hot id in several of them."""
    df = spark.range(6000).selectExpr("concat('00', if(id < 3000, id, 7)) AS s", "id AS n")
    df = df.unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS s, -1L AS n"))
    path = tables.write_table(df, str(tmp_path), {"k": 1}, ["s"])
    assert len(list((tmp_path / path.rsplit("/", 1)[-1]).rglob("part-*.parquet"))) <= 8
    back = tables.read_table(spark, str(tmp_path), {"k": 1})
    assert sorted((r.s or "", r.n) for r in back.collect()) == sorted((r.s or "", r.n) for r in df.collect())
    assert back.where("s = '007'").count() == 3001
    tables.write_table(df.where("n < 5"), str(tmp_path), {"k": 1}, ["s"])
    assert tables.read_table(spark, str(tmp_path), {"k": 1}).count() == 6


def test_stream_equals_batch(spark, tmp_path):
    pdf = pd.concat([cloud(40, s).assign(cloud_id=s) for s in range(6)])
    df = spark.createDataFrame(pdf)
    src = tmp_path / "in"
    for s in range(6):
        df.where(F.col("cloud_id") == s).coalesce(1).write.mode("append").parquet(str(src))
    req = df.groupBy("cloud_id").agg(F.count("*").alias("data_size")).select(
        "cloud_id", (F.col("data_size") + (F.col("cloud_id") == 5).cast("long")).alias("data_size"), F.lit("other").alias("function_name"))
    q = stream.orient_stream(spark, str(src), df.schema, str(tmp_path / "out"), str(tmp_path / "cp"), interval=None, requests=req)
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch").toPandas().sort_values(["cloud_id", "point_id"])
    want = stream.orient_batch(df.where("cloud_id < 5")).toPandas().sort_values(["cloud_id", "point_id"])
    cols = ["cloud_id", "point_id", "nx", "ny", "nz", "confidence"]
    assert np.allclose(got[cols], want[cols])
    assert [r.cloud_id for r in spark.read.parquet(str(tmp_path / "out_errors")).collect()] == [5]


def test_hilbert_is_a_walk():
    code = np.arange(1 << 12)
    xyz = hilbert_coords(code, 3, 4)
    assert (np.abs(np.diff(xyz, axis=1)).sum(axis=0) == 1).all()
    assert (hilbert_index(xyz, 4) == code).all()


def test_edge_cases(spark):
    same = spark.createDataFrame([(1, i, 2.0, 2.0, 2.0) for i in range(4)], "cloud_id long, point_id long, x double, y double, z double")
    assert norm_params(same).first().scale == 1.0
    assert same.transform(normalise()).select("x").distinct().collect()[0][0] == 0.0
    assert grid_patches(same, 2).select("patch_id").distinct().count() == 1
    assert patch_statistics(grid_patches(same.limit(0), 2)).count() == 0
    with pytest.raises(ValueError):
        sampling.random_downsample(same, 0.5, 3)
    with pytest.raises(ValueError):
        extract_patches(same, "nothing", num_per_patch=3)
    far = same.withColumn("x", F.lit(3.0))
    with pytest.raises(Exception, match="must lie in"):
        far.transform(fourier_features([[1.0], [1.0], [1.0]], ["x", "y", "z"])).collect()


def test_points_in_three_patches(spark):
    rows = [(1, p, 7, 1.0, 0.0, 0.0) for p in (1, 2, 3)] + [(1, 1, 8, 1.0, 0.0, 0.0), (1, 2, 8, 0.0, 1.0, 0.0)]
    m = spark.createDataFrame(rows, "cloud_id long, patch_id long, point_id long, nx double, ny double, nz double")
    every = {(r.i, r.j): (r.a, r.b) for r in orient.overlap_relation(m).collect()}
    assert every == {(1, 2): (1.0, 0.0), (1, 3): (1.0, 0.0), (2, 3): (1.0, 0.0)}
    assert [(r.i, r.j, r.a) for r in orient.two_patch_relation(m).where("a > 0").collect()] == [(1, 3, 1.0)]


def test_equal_agreement_predicts_different(spark):
    e = spark.createDataFrame([(1, 1, 2, 2.0, 2.0)], "cloud_id long, i long, j long, a double, b double")
    f = spark.createDataFrame([(1, 1, 0), (1, 2, 1)], "cloud_id long, patch_id long, flip long")
    assert edge_accuracy(e, f).first().edge_accuracy == 100.0


def test_metrics_do_not_depend_on_rotation_or_order(spark):
    from pointlake.operators.transforms import rotate

    rng = np.random.default_rng(3)
    a = rng.normal(size=(50, 9))
    pdf = pd.DataFrame(a, columns=["x", "y", "z", "nx", "ny", "nz", "gx", "gy", "gz"]).assign(cloud_id=1, point_id=range(50))
    df = spark.createDataFrame(pdf)
    base = normal_metrics(df, ["cloud_id"]).toPandas().iloc[0]
    turned = normal_metrics(df.transform(rotate(180.0, "xyz")).repartition(5), ["cloud_id"]).toPandas().iloc[0]
    assert np.allclose(base.astype(float), turned.astype(float), atol=1e-6)


@pytest.mark.parametrize("kind", ["logistic", "mlp"])
def test_edge_model_learns(spark, kind):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(300):
        f = rng.normal(size=4) + 2
        label = int(rng.integers(0, 2))
        rows.append((1, i, i + 1, f.tolist(), (-f if label else f).tolist(), 0.0, 0.0, 0.0, label))
    s = spark.createDataFrame(rows, "cloud_id long, i long, j long, fa array<double>, fb array<double>, dx double, dy double, dz double, label long")
    model = edge_model.fit(s, kind, max_iter=40)
    assert edge_model.evaluate(model, s).first().accuracy > 0.9


def test_a_broken_file_is_a_row_and_not_the_end(spark, tmp_path):
    good = "ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n"
    (tmp_path / "good.ply").write_text(good)
    (tmp_path / "short.ply").write_text(good[:-6])
    (tmp_path / "none.ply").write_text("no header")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "good.ply").write_text(good)
    (tmp_path / "sub" / "cut.ply").write_bytes(b"ply\nformat binary_little_endian 1.0\nelement vertex 9\nproperty float x\nproperty float y\nproperty float z\nend_header\n" + b"\0" * 40)
    status = {r.cloud_id: (r.rows, r.error) for r in ply.ply_status(spark, str(tmp_path)).collect()}
    assert status["good"] == (2, None) and status["sub/good"] == (2, None)
    assert {c for c, (_, e) in status.items() if e} == {"short", "none", "sub/cut"} and status["none"][1].startswith("ValueError")
    read = ply.read_ply(spark, str(tmp_path), skip_broken=True)
    assert {(r.cloud_id, r.n) for r in read.groupBy("cloud_id").agg(F.count("*").alias("n")).collect()} == {("good", 2), ("sub/good", 2)}


def test_patches_of_a_cloud_do_not_depend_on_its_batch(spark):
    small, large = cloud(40, 3), cloud(300, 4)
    large["cloud_id"], large["point_id"] = 2, large["point_id"] + 1000
    both = pd.concat([small, large], ignore_index=True)
    for method, given in (("kdtree", {"patch_count": 4}), ("grid", {"patch_count": 4}), ("bfs", {"num_per_patch": 10}), ("fps", {"num_per_patch": 10}), ("knn", {"patch_count": 4}), ("fps_cpu", {"num_per_patch": 10})):
        alone = extract_patches(spark.createDataFrame(small), method, **given)
        batch = extract_patches(spark.createDataFrame(both), method, **given).where("cloud_id = 1")
        rows = lambda df: sorted((r.patch_id, r.point_id) for r in df.select("patch_id", "point_id").collect())
        assert rows(alone) == rows(batch), method


def test_only_clouds_that_raise_fail(spark):
    """A job that raises is halved until the culprits stand alone; the other clouds succeed."""
    from pointlake.plans import runs

    targets = spark.createDataFrame([(f"c{i}", "no file" if i == 9 else None) for i in range(12)], "cloud_id string, error string")
    asked = []

    def work(todo):
        asked.append(todo.count())

        def run(batches):
            for pdf in batches:
                if set(pdf["cloud_id"]) & {"c3", "c7"}:
                    raise ZeroDivisionError("no scorer")
                yield pdf.assign(error=["weak" if c == "c5" else None for c in pdf["cloud_id"]])

        return todo.mapInPandas(run, "cloud_id string, error string")

    got = {r.cloud_id: (r.status, r.error) for r in runs.run_with_status(targets, work, spark.createDataFrame([("c1",)], "cloud_id string")).collect()}
    assert got["c3"] == got["c7"] == ("failed", "ZeroDivisionError: no scorer") and got["c5"] == ("failed", "weak")
    assert got["c9"] == ("skipped", "no file") and got["c1"] == ("skipped", "output exists")
    assert all(got[f"c{i}"] == ("success", None) for i in (0, 2, 4, 6, 8, 10, 11)) and asked[0] == 10


def test_groups_that_raise_are_rows(spark):
    from pointlake.operators.grouped import map_groups, split_errors

    def work(g):
        if g["k"][0] % 3 == 0:
            raise KeyError(f"group {g['k'][0]}")
        return {"n": [len(g["v"])], "name": ["x"], "far": [0.5]}

    df = spark.range(60).selectExpr("id % 10 AS k", "id AS v")
    good, bad = split_errors(map_groups(df, ["k"], work, "k bigint, n int, name string, far double", errors=True), ["k"])
    assert {(r.k, r.n, r.name, r.far) for r in good.collect()} == {(k, 6, "x", 0.5) for k in (1, 2, 4, 5, 7, 8)}
    assert {r.k: r.error for r in bad.collect()} == {k: f"KeyError: 'group {k}'" for k in (0, 3, 6, 9)}


@pytest.mark.parametrize("method", ["random", "voxel"])
def test_files_are_sampled_to_files(spark, tmp_path, method):
    from pointlake.plans import runs

    pdf = cloud(200, 3).assign(nx=0.0, ny=0.0, nz=1.0, r=7, g=8, b=9)
    ply.write_ply(spark.createDataFrame(pdf), str(tmp_path / "in"), normals=True, colours=True)
    (tmp_path / "in" / "bad.ply").write_text("nothing")
    out = {r.cloud_id: r for r in runs.downsample_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), ratio=0.3, method=method).collect()}
    assert out["bad"].status == "failed" and out["bad"].error.startswith("ValueError")
    one, rows = out["1"], ply.read_ply(spark, str(tmp_path / "out")).collect()
    assert one.n_in == 200 and one.n_out == len(rows) and abs(one.actual_ratio - 0.3) < 0.035 and (one.has_normals, one.has_colors) == (1, 1)
    assert {(r.nz, r.r, r.g, r.b) for r in rows} == {(1.0, 7, 8, 9)}


def test_one_exported_patch_is_read_from_its_bucket(spark, tmp_path):
    from pointlake.plans import runs

    rows = [(c, p, 10 * p + i, float(i), 0.0, 0.0) for c in (1, 2) for p in range(30) for i in range(3)]
    members = spark.createDataFrame(rows, "cloud_id long, patch_id long, point_id long, x double, y double, z double")
    chosen = members.where("patch_id % 2 = 0").select("cloud_id", "patch_id").distinct()
    runs.export_patches(members, chosen, str(tmp_path / "p"), buckets=4)
    assert len([f for f in (tmp_path / "p").iterdir() if f.name.startswith("bucket=")]) == 4
    assert sorted(r.point_id for r in runs.read_patch(spark, str(tmp_path / "p"), 2, 4, buckets=4).collect()) == [40, 41, 42]
    assert runs.read_patch(spark, str(tmp_path / "p"), 2, 5, buckets=4).count() == 0


def test_a_text_file_is_read_by_many_tasks(spark, tmp_path):
    """Ranges that begin anywhere in a line, blank lines, other elements before and behind, lines longer than a range."""
    rng = np.random.default_rng(6)
    pts = [f"{a:.3f} {b:.3f} {c:.3f}" for a, b, c in rng.normal(size=(300, 3))]
    pts[17] += " " * 400
    body = ["9 9", "8 8", *pts[:50], "", "  ", *pts[50:], "3 0 1 2"]
    head = "ply\nformat ascii 1.0\nelement camera 2\nproperty float u\nproperty float v\nelement vertex 300\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "text.ply").write_text(head + "\n".join(body) + "\n")
    (tmp_path / "small.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3")
    want = sorted((r.cloud_id, r.point_id, r.x, r.y, r.z) for r in ply.read_ply(spark, str(tmp_path)).collect())
    assert len(want) == 301
    for split in (180, 333, 1000):
        df = ply.read_ply(spark, str(tmp_path), split_bytes=split)
        assert df.rdd.getNumPartitions() > 5 * 180 // split
        assert sorted((r.cloud_id, r.point_id, r.x, r.y, r.z) for r in df.collect()) == want
    (tmp_path / "short.ply").write_text(head + "\n".join(body[:200]) + "\n")
    with pytest.raises(Exception, match="shorter than its header"):
        ply.read_ply(spark, str(tmp_path), split_bytes=180).count()


def test_only_the_commit_gives_files_their_names(spark, tmp_path):
    """A job that dies leaves nothing; of two attempts of a task the committed one counts."""
    good = spark.createDataFrame(cloud(50, 4))
    bad = good.withColumn("x", F.when(F.col("point_id") == 49, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        ply.write_ply(bad, str(tmp_path / "out"), rows_per_file=5)
    assert not list(tmp_path.rglob("*.ply")) and not list(tmp_path.rglob("*.tmp"))
    import pyarrow as pa

    writer = ply.PlyWriter({"path": str(tmp_path / "two"), "binary": "true"})
    rows = pa.RecordBatch.from_pydict({"_file": ["a/p", "a/p", "b/p"], "_rn": [1, 2, 1], "x": [1.0, 2.0, 3.0], "y": [0.0] * 3, "z": [0.0] * 3})
    attempts = [writer.write(iter([rows])) for _ in range(2)]
    assert len(list((tmp_path / "two").rglob("*.tmp"))) == 4 and not list((tmp_path / "two").rglob("*.ply"))
    writer.commit(attempts[1:])
    assert sorted(str(f.relative_to(tmp_path / "two")) for f in (tmp_path / "two").rglob("*") if f.is_file()) == ["a/p.ply", "b/p.ply"]
    got = ply.read_ply(spark, str(tmp_path / "two")).collect()
    assert sorted((r.cloud_id, r.x) for r in got) == [("a/p", 1.0), ("a/p", 2.0), ("b/p", 3.0)]


def test_a_cluster_exports_to_the_folder_that_its_executors_share(spark, tmp_path, monkeypatch):
    """Elsewhere a path of the machine's own file system is refused, also one that only begins like the shared folder."""
    from pointlake.session import shared_dir

    shared = shared_dir(spark)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    ply.write_ply(spark.createDataFrame(cloud(20, 4)), f"{shared}/ply", binary=True).count()
    assert ply.read_ply(spark, f"{shared}/ply").count() == 20
    root = spark.conf.get("spark.checkpoint.dir", None) or shared
    for place in (str(tmp_path), f"{root}-else/ply", f"{root}/../ply"):
        with pytest.raises(ValueError, match="local path"):
            ply.read_ply(spark, place)


@pytest.mark.parametrize("name", [
    "downsample_files", "ply_manifest", "ply_names_round_trip", "ply_round_trip_ascii", "ply_round_trip_binary", "ply_same_stem",
])
def test_file_queries_on_a_cluster(spark, sf, monkeypatch, name):
    """The queries write and read below the folder that executors share, so they give their rows under a master that is not local."""
    import __spark_entry__ as entry
    from tests.oracle_tool import compare, connect

    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    n, problem = compare(spark, connect(sf), name, entry.queries(), entry.oracle_sql(), sf)
    assert n > 0 and not problem


@pytest.mark.parametrize("binary", [False, True])
def test_parts_of_a_cloud_become_one_file(spark, tmp_path, binary):
    pdf = pd.concat([cloud(23, 4), cloud(5, 5).assign(cloud_id=2)], ignore_index=True).round(3)
    parts = ply.write_ply(spark.createDataFrame(pdf), str(tmp_path / "in"), binary=binary, rows_per_file=4)
    done = ply.join_parts(parts.withColumn("file", F.concat(F.col("cloud_id").cast("string"), F.lit("/all.ply"))), str(tmp_path / "out"))
    assert sorted((r.path, r.rows) for r in done.collect()) == [(str(tmp_path / "out" / c / "all.ply"), n) for c, n in (("1", 23), ("2", 5))]
    assert sorted(f.name for f in (tmp_path / "out").rglob("*") if f.is_file()) == ["all.ply", "all.ply"]
    back = ply.read_ply(spark, str(tmp_path / "out"), split_bytes=200).toPandas().sort_values(["cloud_id", "point_id"])
    for c, g in back.groupby("cloud_id"):
        mine = pdf[pdf.cloud_id == int(c[0])].sort_values("point_id")
        assert c[1:] == "/all" and g.point_id.tolist() == list(range(len(mine)))
        assert np.allclose(g[["x", "y", "z"]], mine[["x", "y", "z"]], atol=1e-6)


def test_same_stem_keeps_clouds_of_several_parts_whole(spark, sf, monkeypatch):
    from functools import partial

    import __spark_entry__ as entry
    from tests.oracle_tool import compare, connect

    monkeypatch.setattr(ply, "write_ply", partial(ply.write_ply, rows_per_file=40))
    n, problem = compare(spark, connect(sf), "ply_same_stem", entry.queries(), entry.oracle_sql(), sf)
    assert n == 3 and not problem


def test_clouds_in_pieces_and_a_restart(spark, tmp_path):
    """Points dealt at random to twelve files; the stream stops half way and goes on from its checkpoint."""
    pdf = pd.concat([cloud(30 + 7 * c, c).assign(cloud_id=c) for c in range(5)], ignore_index=True)
    pdf["point_id"] = np.arange(len(pdf))
    df = spark.createDataFrame(pdf)
    sizes = pdf.groupby("cloud_id").size()
    requests = spark.createDataFrame([(c, int(sizes[c]) + (c == 2) - (c == 3)) for c in range(4)], "cloud_id long, data_size long")
    pieces = np.random.default_rng(1).integers(0, 12, len(pdf))
    for half in (0, 1):
        for k in range(6 * half, 6 * half + 6):
            spark.createDataFrame(pdf[pieces == k]).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
        q = stream.collect_stream(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "at"), requests, patience=100, files_per_batch=2, interval=None, work=lambda d: d.withColumn("seen", F.lit(1)))
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    want = pdf[pdf.cloud_id.isin([0, 1])]
    assert sorted(got.point_id) == sorted(want.point_id) and np.isclose(got.x.sum(), want.x.sum())
    errors = {(r.cloud_id, r.message) for r in spark.read.parquet(str(tmp_path / "out_errors")).collect()}
    assert errors == {(4, "no request"), (3, "more points than declared")}
    last = spark.read.parquet(str(tmp_path / "out_pending")).where("batch = 5").toPandas()
    assert set(last.cloud_id) == {2} and len(last) == sizes[2]
