"""Point transforms, sampling and colouring over the test tables."""

from pyspark.sql import functions as F

from pointlake.catalog.registry import query, rnd, rounded
from pointlake.catalog.toy import sql_cos, sql_dot
from pointlake.fixtures import EMB, EVT, emb_points, event_points, scored_labels, SCORED, table
from pointlake.functions.geometry import NORMAL, TRUTH, XYZ, unit_or_up
from pointlake.operators import sampling, transforms as T
from pointlake.operators.knn import nearest_to_query, radius_join

_BOX = """box AS (SELECT cloud_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1, count(*) AS n
  FROM {src} GROUP BY 1)"""


def _points(df, *extra):
    return rounded(df.select("cloud_id", "point_id", *XYZ, *extra))


def _norm_sql(method):
    rng = "greatest(x1 - x0, y1 - y0, z1 - z0)"
    if method == "unit_sphere":
        s = "greatest((x1 - x0) / 2, (y1 - y0) / 2, (z1 - z0) / 2)"
        e = "({c} - ({c}0 + {c}1) / 2) / s"
    elif method == "zero_one":
        s, e = rng, "({c} - ({c}0 + {c}1) / 2 + ({c}1 - {c}0) / 2) / s"
    else:
        s, e = rng, "({c} - ({c}0 + {c}1) / 2) / s"
    cols = ", ".join(f"round({e.format(c=c)}, 6) + 0.0 AS {c}" for c in "xyz")
    return f"""WITH {EVT}, {_BOX.format(src='evt')}, b AS (SELECT *, CASE WHEN {s} > 0 THEN {s} ELSE 1.0 END AS s FROM box)
SELECT cloud_id, point_id, {cols} FROM evt JOIN b USING (cloud_id)"""


for _method in ("unit_sphere", "zero_one", "unit_cube"):

    @query(f"normalise_{_method}", _norm_sql(_method))
    def _(spark, sf, method=_method):
        return _points(event_points(spark, sf).transform(T.normalise(method)))


@query("denormalise", f"WITH {EVT} SELECT cloud_id, point_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM evt")
def _(spark, sf):
    p = event_points(spark, sf)
    params = T.norm_params(p)
    return _points(T.undo_norm(T.apply_norm(p, params), params))


@query("unit_vectors", f"""WITH {EMB}, l AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS len FROM emb)
SELECT cloud_id, point_id, round(nx / greatest(len, 1e-12), 6) + 0.0 AS nx, round(ny / greatest(len, 1e-12), 6) + 0.0 AS ny,
  round(nz / greatest(len, 1e-12), 6) + 0.0 AS nz, round(nx / (len + 1e-8), 6) + 0.0 AS ax FROM l""")
def _(spark, sf):
    from pointlake.functions.geometry import unit

    p = emb_points(spark, sf).withColumn("ax", unit(NORMAL, 1e-8, True)[0])
    return rounded(p.withColumns(dict(zip(NORMAL, unit_or_up(NORMAL)))).select("cloud_id", "point_id", *NORMAL, "ax"))


def _hash_sql(seed, col):
    return f"CAST(('0x' || substr(md5('{seed}:' || CAST({col} AS VARCHAR)), 1, 13)) AS BIGINT)"


_RAD = "radians((({h}) / 4503599627370496.0 * 2 - 1) * 15.0)"


@query("random_rotation", f"""WITH {EMB}, a AS (SELECT *, {_RAD.format(h=_hash_sql(420, 'cloud_id'))} AS ax,
  {_RAD.format(h=_hash_sql(421, 'cloud_id'))} AS ay, {_RAD.format(h=_hash_sql(422, 'cloud_id'))} AS az FROM emb),
m AS (SELECT *, cos(az)*cos(ay) AS m00, cos(az)*sin(ay)*sin(ax)-sin(az)*cos(ax) AS m01, cos(az)*sin(ay)*cos(ax)+sin(az)*sin(ax) AS m02,
  sin(az)*cos(ay) AS m10, sin(az)*sin(ay)*sin(ax)+cos(az)*cos(ax) AS m11, sin(az)*sin(ay)*cos(ax)-cos(az)*sin(ax) AS m12,
  -sin(ay) AS m20, cos(ay)*sin(ax) AS m21, cos(ay)*cos(ax) AS m22 FROM a),
r AS (SELECT cloud_id, point_id, m00*x+m01*y+m02*z AS x, m10*x+m11*y+m12*z AS y, m20*x+m21*y+m22*z AS z,
  m00*nx+m01*ny+m02*nz AS nx, m10*nx+m11*ny+m12*nz AS ny, m20*nx+m21*ny+m22*nz AS nz FROM m)
SELECT cloud_id, point_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z,
  round(nx / sqrt(nx*nx+ny*ny+nz*nz), 6) + 0.0 AS nx FROM r""")
def _(spark, sf):
    return _points(emb_points(spark, sf).transform(T.rotate(15.0, "xyz", 42)), "nx")


@query("gaussian_jitter", f"""WITH {EMB}, u AS (SELECT *, {_hash_sql(42, 'cloud_id')} / 4503599627370496.0 * 0.005 AS std,
  ({_hash_sql(142, 'point_id')} + 1) / 4503599627370497.0 AS a0, {_hash_sql(242, 'point_id')} / 4503599627370496.0 AS b0,
  ({_hash_sql(143, 'point_id')} + 1) / 4503599627370497.0 AS a1, {_hash_sql(243, 'point_id')} / 4503599627370496.0 AS b1,
  ({_hash_sql(144, 'point_id')} + 1) / 4503599627370497.0 AS a2, {_hash_sql(244, 'point_id')} / 4503599627370496.0 AS b2 FROM emb)
SELECT cloud_id, point_id, round(x + sqrt(-2 * ln(a0)) * cos(2 * pi() * b0) * std, 6) + 0.0 AS x,
  round(y + sqrt(-2 * ln(a1)) * cos(2 * pi() * b1) * std, 6) + 0.0 AS y,
  round(z + sqrt(-2 * ln(a2)) * cos(2 * pi() * b2) * std, 6) + 0.0 AS z FROM u""")
def _(spark, sf):
    return _points(emb_points(spark, sf).transform(T.jitter()))


_FLIP = "CASE WHEN point_id % 3 = 0 THEN -n{c} ELSE n{c} END"


@query("flip_normals", f"WITH {EMB} SELECT cloud_id, point_id, " + ", ".join(
    f"round({_FLIP.format(c=c)}, 6) + 0.0 AS n{c}" for c in "xyz") + " FROM emb")
def _(spark, sf):
    p = emb_points(spark, sf).withColumn("flag", (F.col("point_id") % 3 == 0).cast("long"))
    return rounded(p.transform(T.flip_normals("flag")).select("cloud_id", "point_id", *NORMAL))


@query("point_features", f"""WITH {EMB} SELECT cloud_id, point_id,
  [round(x,6)+0.0, round(y,6)+0.0, round(z,6)+0.0, round(nx,6)+0.0, round(ny,6)+0.0, round(nz,6)+0.0, 0.5] AS feature,
  [round(x,6)+0.0, round(y,6)+0.0, round(z,6)+0.0, round(-nx,6)+0.0, round(-ny,6)+0.0, round(-nz,6)+0.0, 0.5] AS inv_feature FROM emb""")
def _(spark, sf):
    from pointlake.operators.normals import point_features

    p = point_features(emb_points(spark, sf).withColumn("confidence", F.lit(0.5)))
    arrays = [F.transform(c, lambda v: rnd(v)).alias(c) for c in ("feature", "inv_feature")]
    return p.select("cloud_id", "point_id", *arrays)


@query("colour_correctness", f"""WITH {EMB}, d AS (SELECT *, {sql_dot()} > 0 AS ok FROM emb)
SELECT cloud_id, point_id, CAST(CASE WHEN ok THEN 0 ELSE 255 END AS BIGINT) AS r, CAST(CASE WHEN ok THEN 255 ELSE 0 END AS BIGINT) AS g,
  CAST(0 AS BIGINT) AS b FROM d""")
def _(spark, sf):
    return rounded(T.colour_correctness(emb_points(spark, sf)).select("cloud_id", "point_id", "r", "g", "b"))


_PALETTE_SQL = "[" + ", ".join(str(list(c)) for c in T.PALETTE[:8]) + "]"


@query("colour_labels", f"""WITH {EMB}, c AS (SELECT cloud_id, point_id, {_PALETTE_SQL}[least(7, greatest(0, point_id % 11 - 1)) + 1] AS rgb,
  (nx + 1) / 2 AS nr FROM emb)
SELECT cloud_id, point_id, CAST(rgb[1] AS BIGINT) AS r, CAST(rgb[2] AS BIGINT) AS g, CAST(rgb[3] AS BIGINT) AS b, round(nr, 6) AS nr FROM c""")
def _(spark, sf):
    p = emb_points(spark, sf)
    p = T.colour_normals(p).withColumnRenamed("r", "nr").withColumn("label", F.col("point_id") % 11 - 1)
    return rounded(T.colour_labels(p, "label", 8).select("cloud_id", "point_id", "r", "g", "b", "nr"))


@query("consistency_score", f"""WITH {EMB}, c AS (SELECT cloud_id, point_id, {sql_cos(True)} AS c FROM emb)
SELECT cloud_id, point_id, round(c, 6) + 0.0 AS consistency, round(abs(c), 6) AS unoriented, round((c + 1) / 2, 6) AS ramp FROM c""")
def _(spark, sf):
    return rounded(T.consistency_score(emb_points(spark, sf)).select(
        "cloud_id", "point_id", "consistency", "unoriented", "ramp"))


_G = [[0.5, -1.25, 2.0], [1.5, 0.25, -0.75], [-0.5, 1.0, 0.125]]
_PH = [" + ".join(f"{c} * {_G[i][j]}" for i, c in enumerate("xyz")) for j in range(3)]


@query("fourier_features", f"WITH {EMB} SELECT cloud_id, point_id, " + ", ".join(
    [f"round(sin(2 * pi() * ({p})), 6) + 0.0 AS f{j}" for j, p in enumerate(_PH)]
    + [f"round(cos(2 * pi() * ({p})), 6) + 0.0 AS f{j + 3}" for j, p in enumerate(_PH)]) + " FROM emb")
def _(spark, sf):
    p = emb_points(spark, sf).transform(T.fourier_features(_G, [*XYZ, *NORMAL]))
    return rounded(p.select("cloud_id", "point_id", *[F.col("fourier")[i].alias(f"f{i}") for i in range(6)]))


@query("min_max_confidence", f"""WITH {SCORED}, m AS (SELECT min(logit) AS lo, max(logit) AS hi FROM scored)
SELECT point_id, round(CASE WHEN hi = lo THEN 0 ELSE (logit - lo) / (hi - lo) END, 6) AS confidence FROM scored, m""")
def _(spark, sf):
    return rounded(T.min_max(scored_labels(spark, sf), "logit", "confidence").select("point_id", "confidence"))


@query("transform_pipeline", f"""WITH {EMB}, {_BOX.format(src='emb')},
b AS (SELECT *, greatest((x1 - x0) / 2, (y1 - y0) / 2, (z1 - z0) / 2) AS s FROM box),
p AS (SELECT cloud_id, point_id, (x - (x0 + x1) / 2) / s AS x, (y - (y0 + y1) / 2) / s AS y, (z - (z0 + z1) / 2) / s AS z,
  nx / greatest(sqrt(nx*nx+ny*ny+nz*nz), 1e-12) AS nx FROM emb JOIN b USING (cloud_id))
SELECT cloud_id, point_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, round(nx, 6) + 0.0 AS nx FROM p""")
def _(spark, sf):
    return _points(emb_points(spark, sf).transform(T.compose(T.normalise(), T.unit_normals())), "nx")


def _sample_sql(size, src="evt", cte=EVT, seed=42):
    return f"""WITH {cte}, h AS (SELECT *, {_hash_sql(seed, 'point_id')} AS h, count(*) OVER (PARTITION BY cloud_id) AS n FROM {src}),
r AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY h, point_id) AS rn FROM h)
SELECT cloud_id, point_id FROM r WHERE rn <= {size}"""


@query("random_downsample_ratio", _sample_sql("greatest(1, floor(n * 0.3))"))
def _(spark, sf):
    return sampling.random_downsample(event_points(spark, sf), ratio=0.3).select("cloud_id", "point_id")


@query("random_downsample_target", _sample_sql("60"))
def _(spark, sf):
    return sampling.random_downsample(event_points(spark, sf), target_points=60).select("cloud_id", "point_id")


_U = f"(0.2 + 0.8 * ({_hash_sql(42, 'cloud_id')} / 4503599627370496.0))"


@query("augment_downsample", _sample_sql(f"CASE WHEN n < 50 THEN n ELSE greatest(2, floor(n * {_U})) END"))
def _(spark, sf):
    return sampling.augment_downsample(event_points(spark, sf), 0.2, 50).select("cloud_id", "point_id")


@query("max_points", _sample_sql("20"))
def _(spark, sf):
    return sampling.random_downsample(event_points(spark, sf), target_points=20).select("cloud_id", "point_id")


@query("query_points_random", _sample_sql("8", "emb", EMB))
def _(spark, sf):
    return sampling.sample_queries(emb_points(spark, sf), 8, "random").select("cloud_id", "point_id")


@query("thin_large_clouds", _sample_sql("CASE WHEN n > 60 THEN greatest(1, floor(n * 0.1)) ELSE n END"))
def _(spark, sf):
    n = F.col("_n")
    size = F.when(n > 60, F.greatest(F.lit(1), F.floor(n * 0.1))).otherwise(n)
    return sampling.exact_sample(event_points(spark, sf), size, 42).select("cloud_id", "point_id")


_VOX = f"""WITH {EVT}, {_BOX.format(src='evt')},
v AS (SELECT cloud_id, CAST(floor((x - x0) / {{v}}) AS BIGINT) AS vx, CAST(floor((y - y0) / {{v}}) AS BIGINT) AS vy,
  CAST(floor((z - z0) / {{v}}) AS BIGINT) AS vz, x, y, z FROM evt JOIN box USING (cloud_id))
SELECT cloud_id, vx, vy, vz, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(z), 6) + 0.0 AS z, count(*) AS n
FROM v GROUP BY 1, 2, 3, 4"""


@query("voxel_downsample", _VOX.format(v="0.75"))
def _(spark, sf):
    return rounded(sampling.voxel_downsample(event_points(spark, sf), 0.75))


@query("voxel_downsample_normalised", f"""WITH {EMB}, {_BOX.format(src='emb')},
b AS (SELECT *, greatest((x1 - x0) / 2, (y1 - y0) / 2, (z1 - z0) / 2) AS s FROM box),
p AS (SELECT cloud_id, (x - (x0 + x1) / 2) / s AS x, (y - (y0 + y1) / 2) / s AS y, (z - (z0 + z1) / 2) / s AS z, nx FROM emb JOIN b USING (cloud_id)),
l AS (SELECT cloud_id, min(x) AS mx, min(y) AS my, min(z) AS mz FROM p GROUP BY 1),
v AS (SELECT cloud_id, CAST(floor((x - mx) / 0.4) AS BIGINT) AS vx, CAST(floor((y - my) / 0.4) AS BIGINT) AS vy,
  CAST(floor((z - mz) / 0.4) AS BIGINT) AS vz, x, y, z, nx FROM p JOIN l USING (cloud_id)),
g AS (SELECT cloud_id, vx, vy, vz, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(nx) AS nx, count(*) AS n FROM v GROUP BY 1, 2, 3, 4)
SELECT cloud_id, vx, vy, vz, round(x * s + (x0 + x1) / 2, 6) + 0.0 AS x, round(y * s + (y0 + y1) / 2, 6) + 0.0 AS y,
  round(z * s + (z0 + z1) / 2, 6) + 0.0 AS z, round(nx, 6) + 0.0 AS nx, g.n AS n FROM g JOIN b USING (cloud_id)""")
def _(spark, sf):
    return rounded(sampling.normalized_voxel_downsample(emb_points(spark, sf), 0.4, ["nx"]))


@query("rate_voxel_downsample")
def _(spark, sf):
    return rounded(sampling.rate_voxel_downsample(event_points(spark, sf), 0.5))


@query("rate_voxel_band", f"""WITH {EVT}, s AS (SELECT cloud_id, count(*) AS n_points FROM evt GROUP BY 1)
SELECT cloud_id, n_points, CAST(1 AS BIGINT) AS in_band FROM s""")
def _(spark, sf):
    """Whether the number of voxels lies within the band around half of the points, cloud by cloud."""
    p = event_points(spark, sf)
    got = sampling.rate_voxel_downsample(p, 0.5).groupBy("cloud_id").agg(F.count(F.lit(1)).alias("k"))
    n = p.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n_points"))
    goal = F.col("n_points") * F.lit(0.5)
    band = (F.col("k") <= goal * F.lit(1.1)) & (F.col("k") >= goal * F.lit(0.9))
    return n.join(got, "cloud_id").select("cloud_id", "n_points", band.cast("long").alias("in_band"))


@query("downsample_stats", f"""WITH {EMB}, s AS (SELECT cloud_id, count(*) AS n_in FROM emb GROUP BY 1)
SELECT cloud_id, n_in, CAST(1 AS BIGINT) AS has_normals, CAST(0 AS BIGINT) AS has_colors,
  CAST(greatest(1, floor(n_in * 0.25)) AS BIGINT) AS n_out, round(greatest(1, floor(n_in * 0.25)) / n_in, 6) AS actual_ratio FROM s""")
def _(spark, sf):
    p = emb_points(spark, sf)
    return rounded(sampling.downsample_stats(p, sampling.random_downsample(p, ratio=0.25)))


_Q = "SELECT cloud_id, avg(x) AS qx, avg(y) AS qy, avg(z) AS qz FROM emb GROUP BY 1"


@query("nearest_to_query", f"""WITH {EMB}, q AS ({_Q}),
d AS (SELECT e.cloud_id, point_id, row_number() OVER (PARTITION BY e.cloud_id
  ORDER BY (x-qx)*(x-qx)+(y-qy)*(y-qy)+(z-qz)*(z-qz), point_id) AS rn FROM emb e JOIN q USING (cloud_id))
SELECT cloud_id, point_id, CAST(rn <= 4 AS BIGINT) AS highlight FROM d""")
def _(spark, sf):
    p = emb_points(spark, sf)
    q = p.groupBy("cloud_id").agg(*[F.avg(c).alias(f"q{c}") for c in XYZ])
    return rounded(nearest_to_query(p, q, 4).select("cloud_id", "point_id", "highlight"))


@query("radius_join", f"""WITH {EMB} SELECT a.cloud_id, a.point_id AS src, b.point_id AS dst,
  round((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z), 6) AS d2
FROM emb a JOIN emb b ON a.cloud_id = b.cloud_id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 0.15 * 0.15""")
def _(spark, sf):
    p = emb_points(spark, sf)
    return rounded(radius_join(p, p, 0.15))


@query("highlight_near_query", f"""WITH {EMB}, q AS (SELECT cloud_id, x AS qx, y AS qy, z AS qz FROM emb WHERE point_id % 25 = 0),
h AS (SELECT DISTINCT e.cloud_id, e.point_id FROM emb e JOIN q USING (cloud_id)
  WHERE (x-qx)*(x-qx)+(y-qy)*(y-qy)+(z-qz)*(z-qz) <= 0.1 * 0.1)
SELECT e.cloud_id, e.point_id, CAST(CASE WHEN h.point_id IS NULL THEN 128 ELSE 255 END AS BIGINT) AS r,
  CAST(CASE WHEN h.point_id IS NULL THEN 128 ELSE 215 END AS BIGINT) AS g, CAST(CASE WHEN h.point_id IS NULL THEN 128 ELSE 0 END AS BIGINT) AS b
FROM emb e LEFT JOIN h ON h.cloud_id = e.cloud_id AND h.point_id = e.point_id""")
def _(spark, sf):
    p = emb_points(spark, sf)
    gray = p.withColumns({c: F.lit(v) for c, v in zip(T.RGB, T.GRAY)})
    out = T.highlight_near(gray, p.where("point_id % 25 = 0"), 0.1)
    return rounded(out.select("cloud_id", "point_id", *T.RGB))
