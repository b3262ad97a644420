"""Space-filling curves, serialisation and voxel pooling over the test tables."""

from pyspark.sql import functions as F

from pointlake.catalog.registry import query, rnd, rounded
from pointlake.fixtures import EMB, EVT, emb_points, event_points
from pointlake.functions import curves
from pointlake.functions.geometry import XYZ
from pointlake.operators import curve

_GRID = f"""WITH {EVT}, m AS (SELECT cloud_id, min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM evt GROUP BY 1),
grid AS (SELECT cloud_id, point_id, x, y, z, CAST(trunc((x - x0) / 0.05) AS BIGINT) AS gx, CAST(trunc((y - y0) / 0.05) AS BIGINT) AS gy,
  CAST(trunc((z - z0) / 0.05) AS BIGINT) AS gz FROM evt JOIN m USING (cloud_id))"""
DEPTH = 10


def _bits(a, b, c, n=16):
    return "(" + " + ".join(
        f"((({v} >> {i}) & 1) << {3 * i + s})" for i in range(n) for v, s in ((a, 2), (b, 1), (c, 0))
    ) + ")"


_Z, _ZT = _bits("gx", "gy", "gz"), _bits("gy", "gx", "gz")
_ORD = "ord AS (SELECT cloud_id, dense_rank() OVER (ORDER BY cloud_id) - 1 AS ordinal FROM (SELECT DISTINCT cloud_id FROM evt))"
_CODED = f"""{_GRID}, {_ORD},
coded AS (SELECT g.*, CAST((ordinal << {3 * DEPTH}) + {_Z} AS BIGINT) AS code_z, CAST((ordinal << {3 * DEPTH}) + {_ZT} AS BIGINT) AS code_z_trans
  FROM grid g JOIN ord USING (cloud_id))"""


def _grid(spark, sf):
    return curve.quantise(event_points(spark, sf), 0.05)


def _coded(spark, sf):
    return curve.encode(_grid(spark, sf), ["z", "z-trans"], DEPTH)


@query("quantise", f"{_GRID} SELECT cloud_id, point_id, gx, gy, gz FROM grid")
def _(spark, sf):
    return _grid(spark, sf).select("cloud_id", "point_id", *curve.GRID)


@query("quantise_batch_origin", f"""WITH {EVT}, m AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM evt)
SELECT cloud_id, point_id, CAST(trunc((x - x0) / 0.05) AS BIGINT) AS gx, CAST(trunc((y - y0) / 0.05) AS BIGINT) AS gy,
  CAST(trunc((z - z0) / 0.05) AS BIGINT) AS gz FROM evt, m""")
def _(spark, sf):
    return curve.quantise(event_points(spark, sf), 0.05, "batch").select("cloud_id", "point_id", *curve.GRID)


@query("sparse_shape", f"{_GRID} SELECT max(gx) + 96 AS shape_gx, max(gy) + 96 AS shape_gy, max(gz) + 96 AS shape_gz FROM grid")
def _(spark, sf):
    return curve.sparse_shape(_grid(spark, sf))


@query("z_encode", f"{_GRID} SELECT cloud_id, point_id, CAST({_Z} AS BIGINT) AS code FROM grid")
def _(spark, sf):
    return _grid(spark, sf).select("cloud_id", "point_id", curves.z_encode(*[F.col(c) for c in curve.GRID]).alias("code"))


@query("z_decode", f"{_GRID} SELECT cloud_id, point_id, gx, gy, gz FROM grid")
def _(spark, sf):
    coded = _grid(spark, sf).withColumn("code", curves.z_encode(*[F.col(c) for c in curve.GRID]))
    back = dict(zip(curve.GRID, curves.z_decode(F.col("code"))))
    return coded.select("cloud_id", "point_id", *[c.alias(n) for n, c in back.items()])


_STEP = "CASE WHEN ({a} >> b) & 1 = 1 THEN {hit} ELSE {miss} END"


def _hilbert_sql(columns, tail):
    """One recursion step per bit; inside a step the three axes act one after the other."""
    low = "((CAST(1 AS BIGINT) << b) - 1)"
    return f"""{_GRID.replace('WITH ', 'WITH RECURSIVE ', 1)},
h AS (SELECT cloud_id, point_id, gx AS a0, gy AS a1, gz AS a2, {DEPTH - 1} AS b FROM grid
  UNION ALL
  SELECT cloud_id, point_id, CASE WHEN (a2 >> b) & 1 = 1 THEN xor(a0, {low}) ELSE xor(a0, xor(a0, a2) & {low}) END,
    a1, CASE WHEN (a2 >> b) & 1 = 1 THEN a2 ELSE xor(a2, xor(a0, a2) & {low}) END, b - 1
  FROM (SELECT cloud_id, point_id, b, CASE WHEN (a1 >> b) & 1 = 1 THEN xor(a0, {low}) ELSE xor(a0, xor(a0, a1) & {low}) END AS a0,
      CASE WHEN (a1 >> b) & 1 = 1 THEN a1 ELSE xor(a1, xor(a0, a1) & {low}) END AS a1, a2
    FROM (SELECT cloud_id, point_id, b, CASE WHEN (a0 >> b) & 1 = 1 THEN xor(a0, {low}) ELSE a0 END AS a0, a1, a2 FROM h WHERE b > 0))),
t AS (SELECT cloud_id, point_id, {_bits('a0', 'a1', 'a2', DEPTH)} AS g0 FROM h WHERE b = 0),
p1 AS (SELECT *, xor(g0, g0 >> 1) AS g1 FROM t), p2 AS (SELECT *, xor(g1, g1 >> 2) AS g2 FROM p1), p3 AS (SELECT *, xor(g2, g2 >> 4) AS g3 FROM p2),
p4 AS (SELECT *, xor(g3, g3 >> 8) AS g4 FROM p3), p5 AS (SELECT *, xor(g4, g4 >> 16) AS g5 FROM p4), p6 AS (SELECT *, xor(g5, g5 >> 32) AS code FROM p5)
SELECT {columns} FROM p6 {tail}"""


@query("hilbert_encode", _hilbert_sql("cloud_id, point_id, CAST(code AS BIGINT) AS code", ""))
def _(spark, sf):
    g = _grid(spark, sf)
    return g.select("cloud_id", "point_id", curves.hilbert_encode(*[F.col(c) for c in curve.GRID], DEPTH).alias("code"))


@query("hilbert_decode", f"{_GRID} SELECT cloud_id, point_id, gx, gy, gz FROM grid")
def _(spark, sf):
    g = _grid(spark, sf).withColumn("code", curves.hilbert_encode(*[F.col(c) for c in curve.GRID], DEPTH))
    return g.select("cloud_id", "point_id", curves.hilbert_decode(F.col("code"), DEPTH).alias("g")).select(
        "cloud_id", "point_id", "g.*")


@query("curve_codes", f"{_CODED} SELECT cloud_id, point_id, code_z, code_z_trans FROM coded")
def _(spark, sf):
    return _coded(spark, sf).select("cloud_id", "point_id", "code_z", "code_z_trans")


@query("curve_codes_adaptive_depth", f"""{_GRID}, {_ORD},
dep AS (SELECT length(ltrim(bin(max(greatest(gx, gy, gz))), '0')) AS depth FROM grid)
SELECT g.cloud_id, point_id, CAST((ordinal << CAST(3 * depth AS BIGINT)) + {_Z} AS BIGINT) AS code_z
FROM grid g JOIN ord USING (cloud_id), dep""")
def _(spark, sf):
    return curve.encode(_grid(spark, sf), ["z"]).select("cloud_id", "point_id", "code_z")


_RANKED = f"""{_CODED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY code_z, point_id) - 1 AS rank_z,
  row_number() OVER (PARTITION BY cloud_id ORDER BY code_z_trans, point_id) - 1 AS rank_z_trans FROM coded)"""


@query("serialised_order", f"{_RANKED} SELECT cloud_id, point_id, rank_z, rank_z_trans FROM ranked")
def _(spark, sf):
    s = curve.serialise(_coded(spark, sf), ["z", "z-trans"])
    return rounded(s.select("cloud_id", "point_id", "rank_z", "rank_z_trans"))


@query("curve_chunks", f"""{_RANKED}, n AS (SELECT *, count(*) OVER (PARTITION BY cloud_id) AS n FROM ranked),
p AS (SELECT *, CASE WHEN n > 16 THEN CAST(ceil(n / 16.0) AS BIGINT) * 16 ELSE n END AS padded FROM n),
s AS (SELECT cloud_id, point_id, rank_z AS slot, n FROM p UNION ALL
  SELECT cloud_id, point_id, rank_z + 16, n FROM p WHERE rank_z + 16 >= n AND rank_z + 16 < padded)
SELECT cloud_id, slot, CAST(floor(slot / 16.0) AS BIGINT) AS chunk, point_id, CAST(slot >= n AS BIGINT) AS borrowed FROM s""")
def _(spark, sf):
    return rounded(curve.curve_chunks(curve.serialise(_coded(spark, sf), ["z"]), 16))


_POOL = f"""{_CODED}, pooled AS (SELECT cloud_id, code_z >> 12 AS code, max(y) AS fy, sum(x) AS unused, avg(x) AS x, avg(y) AS y, avg(z) AS z,
  min(point_id) AS head, count(*) AS n FROM coded GROUP BY 1, 2)"""


@query("voxel_pooling", f"""{_POOL} SELECT p.cloud_id, p.code, round(fy, 6) + 0.0 AS fy, round(p.x, 6) + 0.0 AS x, round(p.y, 6) + 0.0 AS y,
  round(p.z, 6) + 0.0 AS z, n, c.gx >> 4 AS gx, c.gy >> 4 AS gy, c.gz >> 4 AS gz
FROM pooled p JOIN coded c ON c.cloud_id = p.cloud_id AND c.point_id = p.head""")
def _(spark, sf):
    c = _coded(spark, sf).withColumn("fy", F.col("y"))
    return rounded(curve.pool(c, ["fy"], 16, DEPTH, "max"))


@query("voxel_unpooling", f"""{_POOL} SELECT c.cloud_id, c.point_id, round(c.y + p.fy, 6) + 0.0 AS fy
FROM coded c JOIN pooled p ON c.cloud_id = p.cloud_id AND c.code_z >> 12 = p.code""")
def _(spark, sf):
    c = _coded(spark, sf).withColumn("fy", F.col("y"))
    up = curve.unpool(c, curve.pool(c, ["fy"], 16, DEPTH, "max"), ["fy"], 16, DEPTH)
    return rounded(up.select("cloud_id", "point_id", "fy"))
