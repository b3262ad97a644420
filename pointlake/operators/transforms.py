"""Point transforms: each is a function DataFrame -> DataFrame, so pipelines are chains of ``df.transform``."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from pointlake.functions.geometry import NORMAL, TRUTH, XYZ, as_flag, clamp, dot, unit
from pointlake.operators.knn import knn_join
from pointlake.operators.sampling import cloud_bounds, hash_order

# Colours of the segmentation classes, 0 to 255.
PALETTE = [
    (128, 128, 128), (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0),
    (255, 0, 255), (0, 255, 255), (255, 128, 0), (128, 255, 0), (255, 0, 128),
    (128, 0, 255), (0, 128, 255), (255, 255, 128), (128, 255, 255), (255, 128, 255),
    (128, 128, 255), (255, 128, 128), (128, 255, 128), (64, 64, 64), (192, 192, 192),
]
GREEN, RED, MAGENTA, GRAY, BLUE = (0, 255, 0), (255, 0, 0), (255, 0, 255), (128, 128, 128), (0, 0, 255)
GOLD = (255, 215, 0)
RGB = ("r", "g", "b")


def norm_params(points: DataFrame, method: str = "unit_sphere", center: bool = True) -> DataFrame:
    """Per cloud: middle and extent of the bounding box and the scale; one row per cloud, kept to invert."""
    b = cloud_bounds(points)
    mid = {c: (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 for c in XYZ}
    if method == "unit_sphere":
        shift = mid if center else {c: F.lit(0.0) for c in XYZ}
        scale = F.greatest(
            *[F.greatest(F.abs(F.col(f"min_{c}") - shift[c]), F.abs(F.col(f"max_{c}") - shift[c])) for c in XYZ]
        )
    elif method in ("zero_one", "unit_cube"):
        scale = F.greatest(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in XYZ])
    else:
        raise ValueError(f"unknown normalisation {method}")
    zero = F.lit(0.0)
    moved = {
        c: ((mid[c] if center else zero) - ((F.col(f"max_{c}") - F.col(f"min_{c}")) / 2 if method == "zero_one" else zero))
        for c in XYZ
    }
    plain = {c: (mid[c] if center else zero) for c in XYZ}
    return b.select(
        "cloud_id", *[F.when(scale > 0, moved[c]).otherwise(plain[c]).alias(f"shift_{c}") for c in XYZ],
        F.when(scale > 0, scale).otherwise(F.lit(1.0)).alias("scale"), F.lit(method).alias("method"),
    )


def apply_norm(points: DataFrame, params: DataFrame) -> DataFrame:
    p = points.join(params.drop("method"), "cloud_id")
    p = p.withColumns({c: (F.col(c) - F.col(f"shift_{c}")) / F.col("scale") for c in XYZ})
    return p.drop("scale", *[f"shift_{c}" for c in XYZ])


def undo_norm(points: DataFrame, params: DataFrame) -> DataFrame:
    p = points.join(params.drop("method"), "cloud_id")
    p = p.withColumns({c: F.col(c) * F.col("scale") + F.col(f"shift_{c}") for c in XYZ})
    return p.drop("scale", *[f"shift_{c}" for c in XYZ])


def normalise(method: str = "unit_sphere", center: bool = True) -> Callable[[DataFrame], DataFrame]:
    return lambda df: apply_norm(df, norm_params(df, method, center))


def unit_normals(names=NORMAL, eps: float = 1e-12, additive: bool = False) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns(dict(zip(names, unit(names, eps, additive))))


def random_angle(seed: int, axis: str, max_angle: float) -> Column:
    """Reproducible angle per cloud, uniform in [-max_angle, max_angle] degrees, as radians."""
    u = hash_order(seed * 10 + "xyz".index(axis), "cloud_id") / F.lit(float(16**13))
    return F.radians((u * 2 - 1) * F.lit(float(max_angle)))


def rotation_rows(angles: dict[str, Column]) -> list[list[Column]]:
    """Product of the rotations about z, y and x, in that order from the left."""
    cos = {a: F.cos(angles.get(a, F.lit(0.0))) for a in "xyz"}
    sin = {a: F.sin(angles.get(a, F.lit(0.0))) for a in "xyz"}
    cx, cy, cz, sx, sy, sz = cos["x"], cos["y"], cos["z"], sin["x"], sin["y"], sin["z"]
    return [
        [cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx],
        [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx],
        [-sy, cy * sx, cy * cx],
    ]


def rotate(max_angle: float = 180.0, axes: str = "z", seed: int = 42, triples=(XYZ, NORMAL, TRUTH)):
    """Rotate positions and normals of every cloud by its own random rotation; normals are re-normalised."""

    def run(df: DataFrame) -> DataFrame:
        m = rotation_rows({a: random_angle(seed, a, max_angle) for a in axes})
        df = df.withColumn("_m", F.array(*[F.array(*row) for row in m]))
        for t in triples:
            if not set(t) <= set(df.columns):
                continue
            turned = [sum((F.col("_m")[r][c] * F.col(t[c]) for c in range(1, 3)), F.col("_m")[r][0] * F.col(t[0]))
                      for r in range(3)]
            df = df.withColumns(dict(zip([f"_t{i}" for i in range(3)], turned)))
            names = [f"_t{i}" for i in range(3)]
            final = [F.col(n) for n in names] if t == XYZ else unit(names)
            df = df.withColumns(dict(zip(t, final))).drop(*names)
        return df.drop("_m")

    return run


def jitter(mean: float = 0.0, max_std: float = 0.005, seed: int = 42) -> Callable[[DataFrame], DataFrame]:
    """Gaussian noise on positions only; the spread is drawn once per cloud from [0, max_std].

    The normal deviates come from the id through md5 (Box-Muller), so they do not depend on partitioning.
    """

    def run(df: DataFrame) -> DataFrame:
        std = hash_order(seed, "cloud_id") / F.lit(float(16**13)) * F.lit(max_std)
        for i, c in enumerate(XYZ):
            u1 = (hash_order(seed + 100 + i) + 1) / F.lit(float(16**13 + 1))
            u2 = hash_order(seed + 200 + i) / F.lit(float(16**13))
            z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)
            df = df.withColumn(f"_j{c}", F.col(c) + z * std + F.lit(mean))
        return df.withColumns({c: F.col(f"_j{c}") for c in XYZ}).drop(*[f"_j{c}" for c in XYZ])

    return run


def flip_normals(flag: str, names=NORMAL) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns(
        {c: F.when(F.col(flag) == 1, -F.col(c)).otherwise(F.col(c)) for c in names}
    )


def compose(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run


def _paint(df: DataFrame, condition: Column, yes, no, names=RGB) -> DataFrame:
    return df.withColumns(
        {n: F.when(condition, F.lit(a)).otherwise(F.lit(b)).cast("long") for n, a, b in zip(names, yes, no)}
    )


def colour_correctness(df: DataFrame, pred=NORMAL, truth=TRUTH) -> DataFrame:
    """Green where the normal agrees with the truth, red elsewhere."""
    return _paint(df, dot(pred, truth) > 0, GREEN, RED)


def colour_labels(df: DataFrame, label: str, num_classes: int, names=RGB) -> DataFrame:
    """Palette colour of the label clipped to the known classes; classes beyond the palette get one from a hash."""
    known = PALETTE[:num_classes]
    idx = F.greatest(F.lit(0), F.least(F.lit(num_classes - 1), F.col(label))).cast("int")
    table = F.array(*[F.array(*[F.lit(v) for v in rgb]) for rgb in known])

    def value(i: int) -> Column:
        own = F.get(F.get(table, idx), F.lit(i)).cast("long")
        return own if num_classes <= len(PALETTE) else F.coalesce(own, F.pmod(F.xxhash64(idx, F.lit(i)), F.lit(256)))

    return df.withColumns({n: value(i) for i, n in enumerate(names)})


def colour_normals(df: DataFrame, normal=NORMAL) -> DataFrame:
    return df.withColumns({n: (F.col(c) + 1) / 2 for n, c in zip(RGB, normal)})


def colour_training_sets(df: DataFrame) -> DataFrame:
    """Correctness and true-flip colours of (prediction, ground_truth, highlight) rows; highlighted points magenta."""
    df = _paint(df, F.col("prediction") == F.col("ground_truth"), GREEN, RED, ("cr", "cg", "cb"))
    df = _paint(df, F.col("ground_truth") != 0, GRAY, BLUE, ("fr", "fg", "fb"))
    lit = {n: F.when(F.col("highlight") == 1, F.lit(v)).otherwise(F.col(n)) for n, v in zip(("cr", "cg", "cb"), MAGENTA)}
    return df.withColumns(lit)


def highlight_near(df: DataFrame, queries: DataFrame, radius: float = 0.05, names=RGB, colour=GOLD) -> DataFrame:
    """Paint the points within ``radius`` of any of the cloud's query points (cloud_id, point_id, x, y, z)."""
    # A point needs its nearest query point only.
    near = knn_join(df.select("cloud_id", "point_id", *XYZ), queries, 1).where(F.col("d2") <= radius * radius)
    hits = near.select("cloud_id", F.col("src").alias("point_id"))
    marked = df.join(hits.withColumn("_hit", F.lit(True)), ["cloud_id", "point_id"], "left")
    paint = {n: F.when(F.col("_hit"), F.lit(v)).otherwise(F.col(n)).cast("long") for n, v in zip(names, colour)}
    return marked.withColumns(paint).drop("_hit")


def consistency_score(df: DataFrame, pred=NORMAL, truth=TRUTH) -> DataFrame:
    """Signed and unsigned agreement with the truth, and the ramp value in [0, 1]."""
    c = clamp(dot(unit(pred, 1e-8, True), unit(truth, 1e-8, True)))
    return df.withColumn("consistency", c).withColumn("unoriented", F.abs(c)).withColumn("ramp", (c + 1) / 2)


def fourier_matrix(dims: int, features: int, scale: float = 1.0, seed: int = 42) -> list[list[float]]:
    return (scale * np.random.default_rng(seed).standard_normal((dims, features))).tolist()


def fourier_features(matrix: list[list[float]], inputs: list[str], name: str = "fourier"):
    """[sin(2 pi x G), cos(2 pi x G)] of inputs in [-1, 1]; more inputs than G has rows are cut to its first rows."""

    def run(df: DataFrame) -> DataFrame:
        used = [F.col(c) for c in inputs[: len(matrix)]]
        bad = F.greatest(*[F.abs(c) for c in used]) > F.lit(1.0 + 1e-6)
        phases = []
        for j in range(len(matrix[0])):
            p = used[0] * F.lit(matrix[0][j])
            for i in range(1, len(used)):
                p = p + used[i] * F.lit(matrix[i][j])
            phases.append(F.lit(2 * math.pi) * p)
        out = F.array(*[F.sin(p) for p in phases], *[F.cos(p) for p in phases])
        guard = F.raise_error(F.lit("coordinates must lie in [-1, 1]"))
        return df.withColumn(name, F.when(bad, guard).otherwise(out))

    return run


def min_max(df: DataFrame, column: str, name: str, keys: list[str] = ()) -> DataFrame:
    """Scale a column to [0, 1] over all rows (or per group); a constant column becomes 0."""
    stats = [F.min(column).alias("_lo"), F.max(column).alias("_hi")]
    if keys:
        joined = df.join(df.groupBy(*keys).agg(*stats), list(keys))
    else:
        all_rows = df.agg(F.struct(*stats)).scalar()
        joined = df.withColumns({c: all_rows[c] for c in ("_lo", "_hi")})
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(span == 0, F.lit(0.0)).otherwise((F.col(column) - F.col("_lo")) / span)
    return joined.withColumn(name, scaled).drop("_lo", "_hi")


def mark_wrong(df: DataFrame, pred=NORMAL, truth=TRUTH) -> DataFrame:
    return df.withColumn("wrong", as_flag(dot(pred, truth) < 0))
