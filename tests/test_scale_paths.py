"""The ways taken by oversized clouds, graphs and groups, forced by small limits, against plain procedures."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pointlake.operators import graph, orient, patches, sampling
from pointlake.operators.curve import serialise
from pointlake.operators.knn import knn_graph
from pointlake.operators.normals import pca_normals
from tests.test_knn import cloud


def two_clouds(n=150, seed=11):
    a, b = cloud(n, seed), cloud(n // 3, seed + 1)
    b["cloud_id"], b["point_id"] = 2, b["point_id"] + 10_000
    return pd.concat([a, b], ignore_index=True)


def naive_fps(pdf, count):
    pdf = pdf.sort_values("point_id")
    xyz, ids = pdf[["x", "y", "z"]].to_numpy(), pdf["point_id"].to_numpy()
    chosen, gap = [0], np.full(len(ids), np.inf)
    while len(chosen) < min(count, len(ids)):
        gap = np.minimum(gap, ((xyz - xyz[chosen[-1]]) ** 2).sum(axis=1))
        gap[chosen] = -1
        chosen.append(int(gap.argmax()))
    return ids[chosen].tolist()


def test_farthest_points_in_passes_equal_one_by_one(spark):
    pdf = two_clouds()
    got = sampling.farthest_points(spark.createDataFrame(pdf), 12, pool=40).toPandas()
    for c in (1, 2):
        mine = got[got.cloud_id == c].sort_values("center")["point_id"].tolist()
        assert mine == naive_fps(pdf[pdf.cloud_id == c], 12)


def estimate_digits(df):
    return len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_passes_of_farthest_points_do_not_inflate_the_estimated_size(spark):
    pdf = two_clouds(300)
    got = sampling.farthest_points(spark.createDataFrame(pdf), F.floor(F.col("_n") / 12), pool=60)
    assert estimate_digits(got) < 120
    rows = got.toPandas()
    for c, n in ((1, 25), (2, 8)):
        assert rows[rows.cloud_id == c].sort_values("center")["point_id"].tolist() == naive_fps(pdf[pdf.cloud_id == c], n)


def test_scales_without_a_count_in_passes(spark, monkeypatch):
    """As many patches as the size of each cloud says, also where a cloud is sampled in passes; every point in two, without patches of one."""
    monkeypatch.setattr(sampling.farthest_points, "__defaults__", (None, 60))
    pdf = two_clouds(300)
    out = patches.multi_scale_patches(spark.createDataFrame(pdf), [dict(method="fps", num_per_patch=12, overlap_rate=0.5)])
    assert estimate_digits(out) < 120
    got = out.toPandas()
    for c, n in ((1, 25), (2, 8)):
        mine, xyz = got[got.cloud_id == c], pdf[pdf.cloud_id == c].set_index("point_id")[["x", "y", "z"]]
        centres = xyz.loc[naive_fps(pdf[pdf.cloud_id == c], n)].to_numpy()
        near = np.argsort(((xyz.to_numpy()[:, None] - centres[None]) ** 2).sum(axis=2), axis=1)[:, :2]
        several = np.bincount(near.ravel(), minlength=n) > 1
        want = sorted((int(p), int(i)) for p, two in zip(xyz.index, near) for i in two if several[i])
        assert sorted((r.point_id, r.patch_id) for r in mine.itertuples()) == want


def test_farthest_points_in_passes_with_repeated_rows(spark):
    """Each row of a repeated id can be picked once; rows do not multiply from pass to pass."""
    pdf = two_clouds(60)
    pdf = pd.concat([pdf, pdf[pdf.point_id % 3 == 0]], ignore_index=True)
    got = sampling.farthest_points(spark.createDataFrame(pdf), 1000, pool=30).toPandas()
    for c in (1, 2):
        mine, want = (sorted(t[t.cloud_id == c].point_id) for t in (got, pdf))
        assert mine == want
        order = got[got.cloud_id == c].sort_values("center")
        assert order.center.tolist() == list(range(len(want)))
        distinct = order.point_id.nunique()
        assert order.point_id.tolist()[:distinct] == naive_fps(pdf[pdf.cloud_id == c].drop_duplicates(), distinct)


def test_picks_in_blocks_equal_one_by_one():
    rng = np.random.default_rng(0)
    grid = rng.integers(0, 9, (2000, 3)).astype(float)  # ties and copies
    for xyz in (rng.normal(size=(1500, 3)), grid, np.full((1100, 3), 2.0), rng.normal(size=(1300, 3)) * [1, 0, 0]):
        ids = rng.permutation(len(xyz))
        gap = np.where(ids == 0, np.inf, 1e300)
        pdf = pd.DataFrame(xyz, columns=["x", "y", "z"]).assign(point_id=ids)
        assert ids[sampling._pick_farthest(xyz, ids, gap, len(xyz) // 2, -1.0)].tolist() == naive_fps(pdf, len(xyz) // 2)


def sequential_labels(ids, edges):
    label, out = {}, {}
    for s, d in edges:
        out.setdefault(s, []).append(d)
    for v in sorted(ids):
        if v in label:
            continue
        queue = [v]
        label[v] = v
        while queue:
            for w in out.get(queue.pop(), []):
                if w not in label:
                    label[w] = v
                    queue.append(w)
    return label


def test_directed_components_both_ways(spark):
    pdf = two_clouds(90)
    df = spark.createDataFrame(pdf)
    g = knn_graph(df, 2)
    v = df.select("cloud_id", F.col("point_id").alias("v"))
    edges = [(r.src, r.dst) for r in g.collect()]
    want = sequential_labels(pdf.point_id.tolist(), edges)
    for limit in (10, 200_000):
        got = {r.v: r.label for r in graph.reach_labels(v, g, ["cloud_id"], limit=limit).collect()}
        assert got == want


def random_graph(spark, n=40, m=90, seed=3):
    rng = np.random.default_rng(seed)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, n, (m, 2)).tolist() if p[0] != p[1]}
    rows = [(1, i, j, float(rng.integers(0, 9)), float(rng.integers(0, 9))) for i, j in sorted(pairs)]
    return spark.createDataFrame(rows, "cloud_id long, i long, j long, a double, b double"), rows


def test_spanning_forest_both_ways(spark):
    e, rows = random_graph(spark)
    v = graph.graph_vertices(e, ["cloud_id"])
    seen = []
    for limit in (5, 200_000):
        f, s = graph.spanning_forest(v, e, ["cloud_id"], graph.confidence_weight(), limit=limit)
        edges = sorted((r.i, r.j, r.differ) for r in f.collect())
        parity = {r.v: r.parity for r in s.collect()}
        roots = {r.v: r.root for r in s.collect()}
        assert len(edges) == len(parity) - len(set(roots.values()))
        assert all((parity[i] ^ parity[j]) == d for i, j, d in edges)
        seen.append(edges)
    assert seen[0] == seen[1]
    best = {(r[1], r[2]): abs(r[3] - r[4]) for r in rows}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    total = 0
    for (i, j), w in sorted(best.items(), key=lambda t: -t[1]):
        if find(i) != find(j):
            parent[find(i)] = find(j)
            total += w
    assert total == sum(best[i, j] for i, j, _ in seen[0])


def test_local_search_both_ways(spark):
    e, _ = random_graph(spark, seed=5)
    v = graph.graph_vertices(e, ["cloud_id"]).select("cloud_id", F.col("v").alias("patch_id"), F.lit(0).cast("long").alias("flip"))
    start = orient.objective(e, v).first().objective
    results = []
    for limit in (5, 200_000):
        out = orient.improve_flips(e, v, limit=limit)
        assert orient.objective(e, out).first().objective >= start
        results.append({r.patch_id: r.flip for r in out.collect()})
    assert results[0] == results[1]


def test_complement_of_flips_keeps_the_objective(spark):
    e, _ = random_graph(spark, seed=6)
    lab = orient.forest_flips(e)
    other = lab.withColumn("flip", 1 - F.col("flip"))
    assert orient.objective(e, lab).collect() == orient.objective(e, other).collect()


def test_redundant_patches_like_the_greedy_order(spark):
    rng = np.random.default_rng(8)
    sets = {p: set(rng.choice(30, rng.integers(3, 12), replace=False).tolist()) for p in range(25)}
    rows = [(1, p, x) for p, s in sets.items() for x in s]
    m = spark.createDataFrame(rows, "cloud_id long, patch_id long, point_id long")
    for keep in (1, 18):
        cover = pd.Series([r[2] for r in rows]).value_counts().to_dict()
        alive, left = dict(sets), len(sets)
        for p in sorted(sets, key=lambda q: (len(sets[q]), q)):
            if left <= keep:
                break
            if len(sets[p]) < 9 and min(cover[x] for x in sets[p]) > 1:
                for x in sets[p]:
                    cover[x] -= 1
                del alive[p]
                left -= 1
        got = {r.patch_id for r in patches.drop_redundant(m, 9, keep).select("patch_id").distinct().collect()}
        assert got == set(alive)


def test_kd_leaves_are_small_and_cover_everything(spark):
    pdf = two_clouds()
    got = patches.kd_patches(spark.createDataFrame(pdf), 10).toPandas()
    assert sorted(got.point_id) == sorted(pdf.point_id)
    assert got.groupby(["cloud_id", "patch_id"]).size().max() <= 10


def test_ranks_along_a_curve_with_a_hot_code(spark, monkeypatch):
    from pointlake.operators import tiles

    monkeypatch.setattr(tiles.ranked, "__defaults__", ("rn", 20))
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"cloud_id": 1, "point_id": np.arange(200), "code_z": rng.integers(0, 50, 200)})
    pdf.loc[:100, "code_z"] = 7
    got = serialise(spark.createDataFrame(pdf), ["z"]).toPandas().sort_values(["code_z", "point_id"])
    assert got["rank_z"].tolist() == list(range(200))


def test_plane_and_sphere_normals(spark):
    rng = np.random.default_rng(2)
    xy = rng.random((80, 2))
    plane = pd.DataFrame({"cloud_id": 1, "point_id": range(80), "x": xy[:, 0], "y": xy[:, 1], "z": 0.0})
    n = pca_normals(spark.createDataFrame(plane), 8).toPandas()
    assert np.allclose(n[["nx", "ny", "nz"]], [0, 0, 1], atol=1e-9) and np.allclose(n.e0, 0, atol=1e-12)
    lone = pca_normals(spark.createDataFrame(plane.head(1)), 8).first()
    assert (lone.nx, lone.ny, lone.nz) == (1.0, 0.0, 0.0)

    v = rng.normal(size=(400, 3))
    v /= np.linalg.norm(v, axis=1)[:, None]
    ball = pd.DataFrame({"cloud_id": 1, "point_id": range(400), "x": v[:, 0], "y": v[:, 1], "z": v[:, 2]})
    out = orient.tangent_plane_orientation(spark.createDataFrame(ball), 10, 1.0).toPandas().sort_values("point_id")
    side = np.sign((out[["nx", "ny", "nz"]].to_numpy() * v).sum(axis=1))
    assert abs(side.sum()) == 400


def test_end_to_end_orientation_of_a_sphere(spark):
    from pointlake.plans.orientation import orient_clouds, report

    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 3))
    v /= np.linalg.norm(v, axis=1)[:, None]
    pdf = pd.DataFrame({"cloud_id": 1, "point_id": range(600), "x": v[:, 0], "y": v[:, 1], "z": v[:, 2],
                        "gx": v[:, 0], "gy": v[:, 1], "gz": v[:, 2]})
    df = spark.createDataFrame(pdf)
    run = orient_clouds(df, method="fps", patch_count=20, overlap_rate=0.5, solver="vote", solver_options={"runs": 3})
    r = report(run, df).first()
    assert r.final_accuracy > 0.95 and r.mean_error < 15 and r.num_points == 600


def test_no_all_pairs_plans(spark):
    df = spark.createDataFrame(two_clouds())
    for out in (knn_graph(df, 3), knn_graph(df, 3, tile_points=16)):
        plan = out._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_rooted_trees_of_any_depth(spark):
    """A chain, a star, a lone root and a tree without a root, which is left out."""
    edges = [(1, i, i + 1) for i in range(100)] + [(2, 5, i) for i in range(10, 60)] + [(4, 1, 2), (4, 2, 3)]
    df = spark.createDataFrame(edges, "cloud_id long, i long, j long")
    roots = spark.createDataFrame([(1, 40), (2, 5), (3, 9)], "cloud_id long, v long")
    got = {(r.cloud_id, r.v): (r.parent, r.level) for r in graph.rooted_tree(df, roots).collect()}
    want = {(1, v): (None if v == 40 else v - 1 if v > 40 else v + 1, abs(v - 40)) for v in range(101)}
    want |= {(2, v): (5, 1) for v in range(10, 60)} | {(2, 5): (None, 0), (3, 9): (None, 0)}
    assert got == want


def test_rounds_of_joins_do_not_inflate_the_estimated_size(spark):
    """Planning a join reads the sizes of both sides; they must not grow with the rounds that made them."""
    chain = spark.createDataFrame([(1, i, i + 1) for i in range(40)], "cloud_id long, i long, j long")
    tree = graph.rooted_tree(chain, spark.createDataFrame([(1, 0)], "cloud_id long, v long"))
    links = chain.select("cloud_id", F.col("j").alias("root"), F.col("i").alias("up"), F.lit(1).cast("long").alias("x"))
    top = spark.createDataFrame([(1, 0, 0, 0)], links.schema)
    vertices = tree.select("cloud_id", "v")
    edges = chain.select("cloud_id", F.col("i").alias("src"), F.col("j").alias("dst"))
    for out in (tree, graph._shortcut(links.unionByName(top), ["cloud_id"]), graph._reach_rounds(vertices, edges, ["cloud_id"])):
        assert len(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 120


def naive_kd(pdf, limit):
    """(point, leaf) by halving one node after the other."""
    out, todo = {}, [(pdf, 1)]
    while todo:
        rows, node = todo.pop()
        if len(rows) > limit:
            var = rows[["x", "y", "z"]].var()
            axis = "x" if var.x >= max(var.y, var.z) else "y" if var.y >= var.z else "z"
            cut = rows.sort_values([axis, "point_id"])[axis].iloc[len(rows) // 2]
            if (rows[axis] > cut).any():
                todo += [(rows[rows[axis] <= cut], 2 * node), (rows[rows[axis] > cut], 2 * node + 1)]
                continue
        out.update({p: node for p in rows.point_id})
    return out


def test_kd_by_counts_equals_halving(spark):
    """Half of one cloud has one and the same coordinate; a third cloud is a single position."""
    pdf = two_clouds(200)
    pdf.loc[:99, "x"] = 0.25
    flat = pdf.head(40).assign(cloud_id=3, x=1.0, y=1.0, z=1.0)
    flat["point_id"] += 50_000
    pdf = pd.concat([pdf, flat], ignore_index=True)
    df = spark.createDataFrame(pdf)
    for task_rows in (15, 200_000):
        got = {r.point_id: r.patch_id for r in patches.kd_patches(df, 6, task_rows=task_rows).collect()}
        want = {}
        for c in (1, 2, 3):
            want.update(naive_kd(pdf[pdf.cloud_id == c], 6))
        assert got == want
    got = {r.point_id: r.patch_id for r in patches.kd_patches(df, F.floor(F.col("_n") / 10), task_rows=30).collect()}
    assert got == {p: leaf for c in (1, 2, 3) for p, leaf in naive_kd(pdf[pdf.cloud_id == c], (pdf.cloud_id == c).sum() // 10).items()}


def test_selection_by_counts(spark, monkeypatch):
    """Values that most rows hold, infinities, NaN and ranges that overflow."""
    from pointlake.operators import tiles

    monkeypatch.setattr(tiles, "BUCKETS", 3)
    rng = np.random.default_rng(5)
    groups = {
        1: rng.normal(size=101), 2: np.concatenate([np.full(90, 2.5), rng.normal(size=10)]), 3: np.full(50, -1.0),
        4: np.concatenate([rng.normal(size=20), [np.inf] * 15, [-np.inf] * 12, [np.nan] * 9]), 5: np.array([1e308, -1e308, 3.0, 1e-300, -1e-300] * 9),
        6: 2.0 ** rng.integers(-1000, 1000, 77), 7: np.array([4.0]),
    }
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [(8, None)]
    df = spark.createDataFrame(rows, "k long, v double")
    order = {k: sorted(v, key=lambda x: (np.isnan(x), x)) for k, v in groups.items()}
    targets = [(k, r) for k, v in groups.items() for r in {1, len(v) // 3 + 1, len(v) // 2 + 1, len(v)}]
    got = tiles.nth_values(df, ["k"], "v", spark.createDataFrame(targets, "k long, _rank long"), limit=4).collect()
    assert len(got) == len(targets)
    assert all(np.array_equal(r.v, order[r.k][r._rank - 1], equal_nan=True) for r in got)
    finite = df.where("k NOT IN (4, 8)")
    for limit in (4, 60, 1000):
        low = {r.k: r.m for r in tiles.exact_medians(finite, ["k"], "v", True, "m", limit).collect()}
        mean = {r.k: r.m for r in tiles.exact_medians(finite, ["k"], "v", False, "m", limit).collect()}
        for k in (1, 2, 3, 5, 6, 7):
            n = len(order[k])
            assert low[k] == order[k][(n + 1) // 2 - 1]
            assert np.isclose(mean[k], (order[k][(n - 1) // 2] + order[k][n // 2]) / 2)


def test_signs_inside_groups_both_ways(spark):
    pdf = two_clouds(120)
    rng = np.random.default_rng(4)
    n = rng.normal(size=(len(pdf), 3))
    pdf[["nx", "ny", "nz"]] = n / np.linalg.norm(n, axis=1, keepdims=True)
    pdf = pd.concat([pdf, pdf.head(1).assign(cloud_id=3), pdf.iloc[5:7].assign(cloud_id=4)], ignore_index=True)
    df = spark.createDataFrame(pdf)
    want = {(r.cloud_id, r.point_id): (r.nx, r.ny, r.nz, r.root) for r in orient.propagate_signs(df, knn_graph(df, 6)).collect()}
    for limit in (60, 10_000):
        got = {(r.cloud_id, r.point_id): (r.nx, r.ny, r.nz, r.root) for r in orient.agree_inside(df, 6, limit=limit).collect()}
        assert got == want


def test_many_small_groups_share_a_call(spark):
    """Moments, signs and flips of 300 groups come from a few calls, one per batch, and are those of each group alone."""
    from pointlake.operators.grouped import map_groups
    from pointlake.operators.knn import nearest_inside, nearest_rows

    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 40, 300)
    group = np.repeat(np.arange(300), sizes)
    ids = np.concatenate([rng.permutation(99)[:n] for n in sizes])
    xyz = rng.integers(0, 5, (len(ids), 3)) / 2.0  # many equal distances
    rows, cols, dist, rank = nearest_inside(xyz, ids, group, 6)
    found = np.lexsort((rank, rows))
    want = [[], [], [], []]
    for s, n in zip(np.cumsum(sizes) - sizes, sizes):
        one = nearest_rows(xyz[s : s + n], ids[s : s + n], xyz[s : s + n], ids[s : s + n], 6, True)
        for out, part, shift in zip(want, one, (s, s, 0, 0)):
            out.append(part + shift)
    for got, parts in zip((rows, cols, dist, rank), want):
        assert (got[found] == np.concatenate(parts)).all()

    def work(g, of):
        return {"_group": of, "point_id": g["point_id"], "call": np.full(len(of), g["point_id"][0])}

    df = spark.createDataFrame(pd.DataFrame({"cloud_id": group, "point_id": np.arange(len(ids))}))
    calls = map_groups(df, ["cloud_id"], work, "cloud_id long, point_id long, call long", many=True).toPandas()
    assert sorted(zip(calls.cloud_id, calls.point_id)) == list(zip(group, range(len(ids))))
    assert calls.call.nunique() <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_signs_of_repeated_rows_and_positions(spark):
    pdf = two_clouds(30).assign(nx=0.0, ny=0.0, nz=1.0)
    pdf.loc[::3, "nz"] = -1.0
    once = orient.agree_inside(spark.createDataFrame(pdf), 4, positions=True).toPandas()
    twice = orient.agree_inside(spark.createDataFrame(pd.concat([pdf, pdf])), 8, positions=True).toPandas()
    assert list(once.columns) == ["cloud_id", "point_id", "x", "y", "z", "nx", "ny", "nz", "root"]
    assert len(twice) == 2 * len(once)
    assert sorted(map(tuple, once.iloc[:, :5].values)) == sorted(map(tuple, pdf[["cloud_id", "point_id", "x", "y", "z"]].values))
    assert (twice.groupby(["cloud_id", "root"]).nz.nunique() == 1).all()


def test_flip_solver_both_ways_at_any_scale_of_weights(spark):
    """Weights of 1e-9 and of 1e15 alike; the seeds of a vote are graphs of their own."""
    e, _ = random_graph(spark, seed=7)
    results = []
    for factor in (1e-9, 1.0, 1e15):
        scaled = e.withColumns({c: F.col(c) * factor for c in "ab"})
        for limit in (5, 200_000):
            results.append({r.patch_id: r.flip for r in orient.forest_flips(scaled, limit=limit).collect()})
    assert all(r == results[2] for r in results[2:4]) and results[0] == results[1] and results[4] == results[5]
    best = {orient.objective(e, spark.createDataFrame([(1, p, f) for p, f in r.items()], "cloud_id long, patch_id long, flip long")).first().objective for r in results}
    start = orient.objective(e, orient.forest_flips(e, local_search=False)).first().objective
    assert min(best) >= start


def test_many_neighbours_by_counts(spark):
    """Numbers of neighbours that no task should hold, next to small ones; copies of a position tie."""
    pdf = two_clouds(150)
    pdf.loc[20:60, ["x", "y", "z"]] = pdf.loc[20, ["x", "y", "z"]].to_numpy()
    df = spark.createDataFrame(pdf)
    wanted = F.when(F.col("cloud_id") == 1, F.lit(70)).otherwise(F.lit(5))
    whole = {(r.cloud_id, r.patch_id, r.point_id, r.rank) for r in patches.knn_patches(df, 4, F.floor(F.col("_n") * 0.4)).collect()}
    assert len(whole) == 4 * (60 + 20)
    for limit in (30, 10):
        assert {(r.cloud_id, r.patch_id, r.point_id, r.rank) for r in patches.knn_patches(df, 4, F.floor(F.col("_n") * 0.4), task_neighbours=limit).collect()} == whole
    from pointlake.operators.knn import knn_join, nearest_many

    seeds = df.where("point_id % 40 = 25")
    limits = df.select("cloud_id").distinct().withColumn("_limit", wanted.cast("long"))
    got = {tuple(r) for r in nearest_many(seeds, df, limits, task_rows=20).collect()}
    want = {tuple(r) for r in knn_join(seeds, df, 70).collect() if r.nn_rank <= (70 if r.cloud_id == 1 else 5)}
    assert {g[:4] for g in got} == {w[:4] for w in want} and len(got) == len(want)


def test_pair_classifier_searches_neighbours_once(spark):
    """Samples read a stored neighbour graph, however often they are read; the inputs are the features, their products and the offset."""
    from pointlake.plans import edge_model

    pdf = two_clouds(12).rename(columns={"point_id": "patch_id"}).assign(gt_flip=0)
    df = spark.createDataFrame(pdf[["cloud_id", "patch_id", "x", "y", "z", "gt_flip"]])
    f = F.array("x", "y")
    s = orient.edge_samples(df.withColumns({"feature": f, "inv_feature": F.transform(f, lambda v: -v)}), 3)
    assert any("/staged-" in path for path in s.inputFiles())
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    assert "InPandas" not in plan
    key = ["cloud_id", "i", "j", "variant"]
    rows = edge_model._inputs(s).drop("label", "dx", "dy", "dz").join(s, key).collect()
    assert len(rows) == s.count() > 0
    for r in rows:
        a, b = np.array(r.fa), np.array(r.fb)
        assert (r._v.toArray() == [*a, *b, *(a * b), r.dx, r.dy, r.dz]).all()
