"""Shared inputs of the catalogue: overlapping grid patches of the embedding points with per-patch normals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pointlake.fixtures import EMB, emb_points
from pointlake.functions.geometry import NORMAL, TRUTH, XYZ
from pointlake.operators.patches import grid_patches

PER_PATCH, OVERLAP = 16, 0.5


def grid_sql(source: str, num: int = PER_PATCH, stride: int = 2) -> str:
    """CTEs ending in ``mem(cloud_id, patch_id, point_id)``: grid windows over the relation ``source``."""
    lo = "CAST(greatest(0, ceil((c{a} - 3) / {s}.0)) AS BIGINT)"
    steps = "".join(
        f"""
g{a} AS (SELECT *, {stride} * unnest(generate_series({lo.format(a=a, s=stride)}, CAST(floor(c{a} / {stride}.0) AS BIGINT))) AS a{a} FROM {prev}),"""
        for a, prev in (("x", "cells"), ("y", "gx_"), ("z", "gy_"))
    ).replace("gx AS", "gx_ AS").replace("gy AS", "gy_ AS").replace("gz AS", "gz_ AS")
    return f"""
box AS (SELECT cloud_id, min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) AS x1, max(y) AS y1, max(z) AS z1, count(*) AS n
  FROM {source} GROUP BY cloud_id),
geo AS (SELECT *, (x1 - x0) * (y1 - y0) * (z1 - z0) AS vol FROM box),
geo2 AS (SELECT *, cbrt({num}.0 / (CASE WHEN vol > 0 THEN n / vol ELSE 1.0 END)) / 4.0 AS cell FROM geo),
cells AS (SELECT p.cloud_id, p.point_id, CAST(trunc((p.x - g.x0) / g.cell) AS BIGINT) AS cx,
    CAST(trunc((p.y - g.y0) / g.cell) AS BIGINT) AS cy, CAST(trunc((p.z - g.z0) / g.cell) AS BIGINT) AS cz
  FROM {source} p JOIN geo2 g USING (cloud_id)),{steps}
mem AS (SELECT cloud_id, CAST(ax AS BIGINT) * 4398046511104 + CAST(ay AS BIGINT) * 2097152 + CAST(az AS BIGINT) AS patch_id, point_id FROM gz_)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_patches(emb_points(spark, sf_dir), PER_PATCH, OVERLAP)


def patch_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with positions, truth, and normals whose sign depends on the patch and, for some points, on both."""
    m = members(spark, sf_dir).join(emb_points(spark, sf_dir), ["cloud_id", "point_id"])
    odd = (F.col("patch_id") % 7) % 2 == 1
    noisy = (F.col("patch_id") % 5 + F.col("point_id")) % 4 == 0
    s = F.when(odd != noisy, F.lit(-1.0)).otherwise(F.lit(1.0))
    return m.select("cloud_id", "patch_id", "point_id", *XYZ, *[(s * F.col(c)).alias(c) for c in NORMAL], *TRUTH)


def patch_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = members(spark, sf_dir).select("cloud_id", "patch_id").distinct()
    return m.withColumn("flip", (F.col("patch_id") % 7) % 2)


PN = f"""{EMB},{grid_sql('emb')},
pn AS (SELECT m.cloud_id, m.patch_id, m.point_id, e.x, e.y, e.z, s * nx AS nx, s * ny AS ny, s * nz AS nz, gx, gy, gz
  FROM (SELECT *, CASE WHEN ((patch_id % 7) % 2 = 1) <> ((patch_id % 5 + point_id) % 4 = 0) THEN -1.0 ELSE 1.0 END AS s FROM mem) m
  JOIN emb e USING (cloud_id, point_id)),
flips AS (SELECT DISTINCT cloud_id, patch_id, (patch_id % 7) % 2 AS flip FROM mem)"""

EDGES = """edges AS (SELECT a.cloud_id, a.patch_id AS i, b.patch_id AS j,
    CAST(sum(CASE WHEN a.nx * b.nx + a.ny * b.ny + a.nz * b.nz > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS a,
    CAST(sum(CASE WHEN a.nx * b.nx + a.ny * b.ny + a.nz * b.nz < 0 THEN 1 ELSE 0 END) AS DOUBLE) AS b
  FROM pn a JOIN pn b ON a.cloud_id = b.cloud_id AND a.point_id = b.point_id AND a.patch_id < b.patch_id
  GROUP BY 1, 2, 3)"""

GT_FLIPS = """gtf AS (SELECT cloud_id, patch_id,
    CAST(sum(CASE WHEN nx * gx + ny * gy + nz * gz < 0 THEN 1 ELSE 0 END) * 2 > count(*) AS BIGINT) AS flip
  FROM pn GROUP BY 1, 2)"""


def sql_dot(a: str = "n", b: str = "g") -> str:
    return f"({a}x * {b}x + {a}y * {b}y + {a}z * {b}z)"


def sql_cos(additive: bool, a: str = "n", b: str = "g") -> str:
    """Clipped cosine between two column triples, with the same order of operations as the engine."""
    def unit(v: str, c: str) -> str:
        length = f"sqrt({v}x * {v}x + {v}y * {v}y + {v}z * {v}z)"
        return f"({v}{c} / " + (f"({length} + 1e-8))" if additive else f"greatest({length}, 1e-12))")

    d = " + ".join(f"{unit(a, c)} * {unit(b, c)}" for c in "xyz")
    return f"greatest(-1.0, least(1.0, {d}))"


def sql_angle(oriented: bool, additive: bool, a: str = "n", b: str = "g") -> str:
    c = sql_cos(additive, a, b)
    return f"degrees(acos({c if oriented else f'abs({c})'}))"
