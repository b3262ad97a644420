import numpy as np
import pandas as pd
import pytest

from pointlake.operators.knn import knn_graph, knn_join, knn_moments, radius_join
from pointlake.operators.tiles import exact_medians, ranked


def cloud(n, seed, copies=0):
    rng = np.random.default_rng(seed)
    xyz = rng.normal(size=(n, 3))
    xyz[: n // 3] *= 0.01  # one dense corner
    xyz[n // 2 : n // 2 + copies] = xyz[n // 2]
    return pd.DataFrame({"cloud_id": 1, "point_id": np.arange(n), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})


def brute(q, t, k, exclude_self):
    out = set()
    for r in q.itertuples():
        d = sorted(
            ((r.x - s.x) ** 2 + (r.y - s.y) ** 2 + (r.z - s.z) ** 2, s.point_id)
            for s in t.itertuples()
            if not (exclude_self and s.point_id == r.point_id)
        )
        out |= {(r.point_id, p, i + 1) for i, (_, p) in enumerate(d[:k])}
    return out


def rows(df):
    return {(r.src, r.dst, r.nn_rank) for r in df.select("src", "dst", "nn_rank").collect()}


@pytest.mark.parametrize("copies", [0, 60])
def test_knn_graph_over_many_tiles_equals_brute_force(spark, copies):
    pdf = cloud(240, 1, copies)
    df = spark.createDataFrame(pdf)
    got = rows(knn_graph(df, 4, tile_points=16))
    assert got == brute(pdf, pdf, 4, True)


def test_knn_join_of_other_queries_over_many_tiles(spark):
    t, q = cloud(200, 2), cloud(60, 3)
    q["x"] *= 3
    got = rows(knn_join(spark.createDataFrame(q), spark.createDataFrame(t), 3, tile_points=16))
    assert got == brute(q, t, 3, False)


def test_small_clouds_clamp_k(spark):
    pdf = cloud(3, 4)
    assert rows(knn_graph(spark.createDataFrame(pdf), 10)) == brute(pdf, pdf, 10, True)
    assert knn_graph(spark.createDataFrame(pdf.head(1)), 10).count() == 0
    assert knn_graph(spark.createDataFrame(pdf).limit(0), 10).count() == 0


def test_radius_join_equals_brute_force(spark):
    t, q = cloud(150, 5), cloud(40, 6)
    got = {(r.src, r.dst) for r in radius_join(spark.createDataFrame(q), spark.createDataFrame(t), 0.7).collect()}
    want = {
        (a.point_id, b.point_id)
        for a in q.itertuples()
        for b in t.itertuples()
        if (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 0.7 * 0.7
    }
    assert got == want


def test_distributed_rank_equals_window(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 300), "v": rng.integers(0, 20, 300), "i": np.arange(300)})
    pdf.loc[:120, ["g", "v"]] = 1, 7
    got = ranked(spark.createDataFrame(pdf), ["g"], ["v", "i"], ["v", "i"], limit=10).toPandas()
    want = pdf.sort_values(["g", "v", "i"])
    want["rn"] = want.groupby("g").cumcount() + 1
    assert got.sort_values("i")["rn"].tolist() == want.sort_values("i")["rn"].tolist()


def test_exact_medians(spark):
    pdf = pd.DataFrame({"g": [1] * 40 + [2] * 41, "v": np.arange(81.0)})
    df = spark.createDataFrame(pdf)
    low = dict(exact_medians(df, ["g"], "v", True, "m", limit=5).collect())
    mid = dict(exact_medians(df, ["g"], "v", False, "m", limit=5).collect())
    assert low == {1: 19.0, 2: 60.0} and mid == {1: 19.5, 2: 60.0}


@pytest.mark.parametrize("n,copies,tile", [(70, 0, 512), (220, 0, 24), (160, 60, 24), (1, 0, 512), (3, 0, 512)])
def test_moments_equal_neighbours(spark, n, copies, tile):
    """Moments from the tiles' tasks against the covariance of brute-force neighbours; every point has a row."""
    pdf = cloud(n, 21, copies)
    df = spark.createDataFrame(pd.concat([pdf, pdf.assign(cloud_id=2)]))
    k = 7
    xyz = pdf[["x", "y", "z"]].to_numpy()
    got = knn_moments(df, k, tile_points=tile).collect()
    assert len(got) == 2 * n and {(r.cloud_id, r.point_id) for r in got} == {(c, p) for c in (1, 2) for p in range(n)}
    near = {}
    for src, dst, _ in brute(pdf, pdf, k, True):
        near.setdefault(src, []).append(dst)
    for r in got:
        mine = xyz[sorted(near.get(r.point_id, []))]
        assert r.k == len(mine)
        if len(mine):
            want = np.cov(mine.T, ddof=0).reshape(3, 3) if len(mine) > 1 else np.zeros((3, 3))
            assert np.allclose([r.cxx, r.cxy, r.cxz, r.cyy, r.cyz, r.czz], [want[0, 0], want[0, 1], want[0, 2], want[1, 1], want[1, 2], want[2, 2]], atol=1e-12)
