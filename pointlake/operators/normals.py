"""Normal estimation from neighbourhoods and per-point sign refinement."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from pointlake.functions.geometry import NORMAL, TRUTH, XYZ, as_flag, dot, sigmoid
from pointlake.operators.grouped import map_groups, split_errors
from pointlake.operators.knn import MOMENTS, knn_graph, knn_moments, own_moments
from pointlake.session import cut

def neighbourhood_moments(points: DataFrame, k: int, keys: list[str] = ("cloud_id",)) -> DataFrame:
    """Covariance of the k nearest neighbours (the point left out) around their own mean, per point that has any."""
    return knn_moments(points, k, keys).where(F.col("k") > 0)


_EIGEN_TYPE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("nx", "ny", "nz", "e0", "e1", "e2")])


@pandas_udf(_EIGEN_TYPE)
def _eigen(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
    m = np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -2)
    ok = np.isfinite(m).all(axis=(1, 2))
    values, vectors = np.linalg.eigh(np.where(ok[:, None, None], m, np.eye(3)))
    n = vectors[:, :, 0]
    lead = np.take_along_axis(n, np.abs(n).argmax(axis=1)[:, None], axis=1)
    n = np.where(lead < 0, -n, n)
    n[~ok], values[~ok] = (0.0, 0.0, 1.0), np.nan
    return pd.DataFrame(np.hstack([n, values]), columns=["nx", "ny", "nz", "e0", "e1", "e2"])


def pca_normals(points: DataFrame, k: int = 10, keys: list[str] = ("cloud_id",), positions: bool = False) -> DataFrame:
    """Unsigned normal of every point: direction of least variance, largest component positive.

    A point without neighbours gets (1, 0, 0). Returns keys, point_id, nx, ny, nz and the eigenvalues; ``positions`` adds
    x, y, z, which saves a join back to the points.
    """
    keys, own_xyz = list(keys), XYZ if positions else ()
    m = knn_moments(points, k, keys, positions=positions)
    e = m.select(*keys, "point_id", *own_xyz, "k", _eigen(*[F.col(f"c{a}{b}") for a, b in MOMENTS]).alias("_e"))
    lone = {"nx": 1.0, "ny": 0.0, "nz": 0.0, "e0": 0.0, "e1": 0.0, "e2": 0.0}
    return e.select(*keys, "point_id", *own_xyz, *[F.when(F.col("k") > 0, F.col(f"_e.{c}")).otherwise(F.lit(v)).alias(c) for c, v in lone.items()])


def cloud_normals(points: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(normals, errors): PCA normals of all sound clouds, and (cloud_id, error) of the others.

    A cloud whose points cannot be worked on is a row with its error; it does not end the job of the other clouds.
    """
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in XYZ]
    sound = points.groupBy("cloud_id").agg(F.min(finite[0] & finite[1] & finite[2]).alias("_sound"))
    broken = points.join(sound.where(~F.col("_sound")), "cloud_id", "left_semi")
    rows = broken.select("cloud_id", F.col("point_id").alias("_id"), *[F.col(c).cast("double").alias(c) for c in XYZ], F.lit("").alias("_node"))
    types = dict(points.dtypes)
    schema = f"cloud_id {types['cloud_id']}, point_id {types['point_id']}, k bigint"
    # What is wrong with a cloud is what the estimation raises for it; one part of it is enough.
    part = F.pmod(F.xxhash64("_id"), F.lit(64))
    moments = own_moments(k)

    def alone(g: dict) -> dict:
        return moments(g, np.zeros(len(g["_id"]), np.int64))

    _, errors = split_errors(map_groups(rows.withColumn("_part", part), ["cloud_id", "_part"], alone, f"_part bigint, {schema}", errors=True), ["cloud_id"])
    return pca_normals(points.join(errors.select("cloud_id"), "cloud_id", "left_anti"), k), errors


def flip_bits(df: DataFrame, normal=NORMAL, truth=TRUTH) -> DataFrame:
    """True flip bit: 1 where the normal points against the truth."""
    return df.withColumn("gt_flip", as_flag(dot(normal, truth) < 0))


def soft_labels(df: DataFrame, normal=NORMAL, truth=TRUTH) -> DataFrame:
    """Labels that fade to one half where the normal is perpendicular to the truth."""
    d = dot(normal, truth)
    half = F.abs(d) / F.lit(2.0)
    return df.withColumn("soft_label", F.when(d < 0, F.lit(0.5) + half).otherwise(F.lit(0.5) - half))


Scorer = Callable[[DataFrame], DataFrame]


def neighbour_scorer(points: DataFrame, k: int, keys: list[str] = ("cloud_id",)) -> Scorer:
    """Built-in scorer: a point should flip when its neighbours disagree with it on balance.

    The neighbour graph is computed once; a round costs two equi-joins and one aggregation.
    """
    keys = list(keys)
    graph = cut(knn_graph(points, k, keys).select(*keys, "src", "dst"))

    def score(state: DataFrame) -> DataFrame:
        here = state.select(*keys, F.col("point_id").alias("src"), *[F.col(c).alias(f"s{c}") for c in NORMAL])
        there = state.select(*keys, F.col("point_id").alias("dst"), *NORMAL)
        e = graph.join(here, keys + ["src"]).join(there, keys + ["dst"])
        d = dot(NORMAL, [f"s{c}" for c in NORMAL])
        return e.groupBy(*keys, F.col("src").alias("point_id")).agg((-F.sum(F.signum(d))).alias("logit"))

    return score


def patch_scorer(fn: Callable[[pd.DataFrame], np.ndarray], group: list[str], pointwise: bool = False) -> Scorer:
    """Plug in a model: ``fn`` maps the rows of one patch (position, normal, confidence) to logits.

    A patch is always handed over whole; the extractor's patch size bounds it. A model that looks at single rows says
    ``pointwise`` and gets them as they come, in batches.
    """

    def score(state: DataFrame) -> DataFrame:
        types = dict(state.dtypes)
        schema = ", ".join(f"{c} {types[c]}" for c in [*group, "point_id"]) + ", logit double"

        def work(pdf: pd.DataFrame) -> pd.DataFrame:
            out = pdf[[*group, "point_id"]].copy()
            out["logit"] = np.asarray(fn(pdf), dtype="float64")
            return out

        if pointwise:
            return state.mapInPandas(lambda batches: map(work, batches), schema)
        return state.groupBy(*group).applyInPandas(work, schema)

    return score


def refine_flips(state: DataFrame, scorer: Scorer, rounds: int, keys: list[str] = ("cloud_id",)) -> DataFrame:
    """T rounds of score -> probability -> flip above one half; the confidence 2|p - 0.5| feeds the next round."""
    on = list(keys) + ["point_id"]
    state = state.withColumn("confidence", F.lit(0.0))
    for _ in range(rounds):
        scores = scorer(state).select(*on, F.col("logit").alias("_z"))
        p = sigmoid(F.coalesce("_z", F.lit(0.0)))
        nxt = state.join(scores, on, "left").withColumn("_p", p)
        for c in NORMAL:
            nxt = nxt.withColumn(c, F.when(F.col("_p") > 0.5, -F.col(c)).otherwise(F.col(c)))
        state = cut(
            nxt.withColumn("confidence", F.lit(2.0) * F.abs(F.col("_p") - 0.5)).drop("_p", "_z")
        )
    return state


def point_features(df: DataFrame, width: int = 7) -> DataFrame:
    """[position, normal, confidence] (7 wide) or [position, normal] (6 wide), and the twin with normals negated."""
    tail = ["confidence"] if width == 7 else []
    if width not in (6, 7):
        raise ValueError("features are 6 or 7 wide")
    xyz, extra = [F.col(c) for c in XYZ], [F.col(c) for c in tail]
    n = [F.col(c) for c in NORMAL]
    return df.withColumn("feature", F.array(*xyz, *n, *extra)).withColumn(
        "inv_feature", F.array(*xyz, *[-c for c in n], *extra)
    )
