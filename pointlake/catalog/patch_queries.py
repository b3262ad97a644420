"""Nearest neighbours and patch extraction over the test tables."""

from pyspark.sql import functions as F

from pointlake.catalog.registry import query, rounded
from pointlake.catalog.toy import PN, grid_sql, members
from pointlake.fixtures import EMB, EVT, emb_points, event_points
from pointlake.functions.geometry import XYZ
from pointlake.operators import knn, orient, patches, sampling

D2 = "((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"


def knn_sql(name, src, k):
    return f"""{name} AS (SELECT * FROM (SELECT a.cloud_id, a.point_id AS src, b.point_id AS dst, {D2} AS d2,
    row_number() OVER (PARTITION BY a.cloud_id, a.point_id ORDER BY {D2}, b.point_id) AS nn_rank
  FROM {src} a JOIN {src} b ON a.cloud_id = b.cloud_id AND a.point_id <> b.point_id) WHERE nn_rank <= {k})"""


def fps_sql(count, src="emb"):
    """CTEs ``f`` and ``cen(cloud_id, center, point_id, x, y, z)``; needs WITH RECURSIVE."""
    return f"""f AS (SELECT cloud_id, 1 AS i, [min(point_id)] AS sel FROM {src} GROUP BY cloud_id
  UNION ALL
  SELECT cloud_id, i + 1, list_append(sel, arg_max(point_id, gap)) FROM (
    SELECT f.cloud_id, f.i, f.sel, a.point_id, min({D2}) AS gap FROM f JOIN {src} a ON a.cloud_id = f.cloud_id
      JOIN {src} b ON b.cloud_id = f.cloud_id AND list_contains(f.sel, b.point_id)
    WHERE f.i < {count} AND NOT list_contains(f.sel, a.point_id) GROUP BY 1, 2, 3, 4) GROUP BY cloud_id, i, sel),
pick AS (SELECT cloud_id, unnest(sel) AS point_id, generate_subscripts(sel, 1) - 1 AS center FROM f WHERE i = {count}),
cen AS (SELECT p.cloud_id, CAST(p.center AS BIGINT) AS center, p.point_id, e.x, e.y, e.z FROM pick p JOIN {src} e USING (cloud_id, point_id))"""


def near_sql(m, src="emb"):
    return f"""near AS (SELECT * FROM (SELECT a.cloud_id, a.point_id, b.center, {D2} AS d2,
    row_number() OVER (PARTITION BY a.cloud_id, a.point_id ORDER BY {D2}, b.center) AS rank
  FROM {src} a JOIN cen b ON a.cloud_id = b.cloud_id) WHERE rank <= {m})"""


@query("knn_graph", f"WITH {EVT}, {knn_sql('k', 'evt', 10)} SELECT cloud_id, src, dst, nn_rank, round(d2, 6) AS d2 FROM k")
def _(spark, sf):
    return rounded(knn.knn_graph(event_points(spark, sf), 10))


@query("knn_graph_embeddings", f"WITH {EMB}, {knn_sql('k', 'emb', 10)} SELECT cloud_id, src, dst, nn_rank, round(d2, 6) AS d2 FROM k")
def _(spark, sf):
    return rounded(knn.knn_graph(emb_points(spark, sf), 10))


@query("knn_within_radius", f"WITH {EMB}, {knn_sql('k', 'emb', 10)} SELECT cloud_id, src, dst, nn_rank, round(d2, 6) AS d2 FROM k WHERE d2 <= 0.15 * 0.15")
def _(spark, sf):
    return rounded(knn.hybrid_neighbours(emb_points(spark, sf), 10, 0.15))


@query("seed_neighbours", f"""WITH RECURSIVE {EMB}, {fps_sql(5)},
k AS (SELECT b.cloud_id, b.center AS src, a.point_id AS dst, {D2} AS d2,
  row_number() OVER (PARTITION BY b.cloud_id, b.center ORDER BY {D2}, a.point_id) AS nn_rank FROM cen b JOIN emb a ON a.cloud_id = b.cloud_id)
SELECT cloud_id, src AS patch_id, dst AS point_id, nn_rank AS rank FROM k WHERE nn_rank <= 12""")
def _(spark, sf):
    return rounded(patches.knn_patches(emb_points(spark, sf), 5, 12))


@query("farthest_points", f"WITH RECURSIVE {EMB}, {fps_sql(8)} SELECT cloud_id, center, point_id FROM cen")
def _(spark, sf):
    return sampling.farthest_points(emb_points(spark, sf), 8).select("cloud_id", "center", "point_id")


@query("query_points_farthest", f"WITH RECURSIVE {EMB}, {fps_sql(8)} SELECT cloud_id, point_id FROM cen")
def _(spark, sf):
    return sampling.sample_queries(emb_points(spark, sf), 8, "fps").select("cloud_id", "point_id")


@query("nearest_centre", f"WITH RECURSIVE {EMB}, {fps_sql(6)}, {near_sql(1)} SELECT cloud_id, point_id, center, rank, round(d2, 6) AS d2 FROM near")
def _(spark, sf):
    p = emb_points(spark, sf)
    return rounded(sampling.nearest_centres(p, sampling.farthest_points(p, 6)))


@query("nearest_centres_overlap", f"WITH RECURSIVE {EMB}, {fps_sql(6)}, {near_sql(3)} SELECT cloud_id, point_id, center, rank, round(d2, 6) AS d2 FROM near")
def _(spark, sf):
    p = emb_points(spark, sf)
    return rounded(sampling.nearest_centres(p, sampling.farthest_points(p, 6), 3))


@query("patches_fps", f"WITH RECURSIVE {EMB}, {fps_sql(6)}, {near_sql(2)} SELECT cloud_id, center AS patch_id, point_id FROM near")
def _(spark, sf):
    return patches.fps_patches(emb_points(spark, sf), 6, 0.5)


@query("patches_grid", f"WITH {EVT}, {grid_sql('evt', 16, 3)} SELECT cloud_id, patch_id, point_id FROM mem")
def _(spark, sf):
    return patches.grid_patches(event_points(spark, sf), 16, 0.25)


@query("patches_grid_overlap", f"WITH {EMB}, {grid_sql('emb')} SELECT cloud_id, patch_id, point_id FROM mem")
def _(spark, sf):
    return members(spark, sf)


def kd_sql(src, limit):
    part = "PARTITION BY cloud_id, node"
    return f"""kd AS (SELECT cloud_id, point_id, x, y, z, CAST(1 AS BIGINT) AS node, 0 AS lvl FROM {src}
  UNION ALL
  SELECT cloud_id, point_id, x, y, z, node * 2 + CAST(v > cut AS BIGINT), lvl + 1 FROM (
    SELECT *, max(CAST(v > cut AS INT)) OVER ({part}) AS has_right FROM (
      SELECT *, max(CASE WHEN rn = n // 2 + 1 THEN v END) OVER ({part}) AS cut FROM (
        SELECT *, row_number() OVER ({part} ORDER BY v, point_id) AS rn FROM (
          SELECT *, CASE WHEN vx >= vy AND vx >= vz THEN x WHEN vy >= vz THEN y ELSE z END AS v FROM (
            SELECT *, count(*) OVER ({part}) AS n, var_samp(x) OVER ({part}) AS vx, var_samp(y) OVER ({part}) AS vy,
              var_samp(z) OVER ({part}) AS vz FROM kd) WHERE n > {limit})))) WHERE has_right = 1),
leaf AS (SELECT cloud_id, point_id, arg_max(node, lvl) AS patch_id FROM kd GROUP BY 1, 2)"""


@query("patches_kd", f"WITH RECURSIVE {EVT}, {kd_sql('evt', 12)} SELECT cloud_id, patch_id, point_id FROM leaf")
def _(spark, sf):
    return patches.kd_patches(event_points(spark, sf), 12)


def bfs_sql(k, m, seeds):
    return f"""{knn_sql('k', 'emb', k)}, {fps_sql(seeds)},
bfs AS (SELECT cloud_id, center AS patch_id, [point_id] AS lst, 0 AS start FROM cen
  UNION ALL
  SELECT cloud_id, patch_id, list_concat(lst, list(dst ORDER BY pos, nn)), len(lst) FROM (
    SELECT cloud_id, patch_id, lst, dst, min(pos * 1000 + nn_rank) // 1000 AS pos, min(pos * 1000 + nn_rank) % 1000 AS nn FROM (
      SELECT q.cloud_id, q.patch_id, q.lst, k.dst, k.nn_rank, q.pos FROM
        (SELECT * FROM (SELECT cloud_id, patch_id, lst, start, unnest(lst) AS pt, generate_subscripts(lst, 1) AS pos FROM bfs
          WHERE len(lst) < {m}) WHERE pos > start) q
        JOIN k ON k.cloud_id = q.cloud_id AND k.src = q.pt WHERE NOT list_contains(q.lst, k.dst)) GROUP BY 1, 2, 3, 4)
  GROUP BY cloud_id, patch_id, lst),
full_ AS (SELECT cloud_id, patch_id, arg_max(lst, len(lst)) AS lst FROM bfs GROUP BY 1, 2),
found AS (SELECT * FROM (SELECT cloud_id, patch_id, unnest(lst) AS point_id, generate_subscripts(lst, 1) AS rank FROM full_) WHERE rank <= {m})"""


@query("patches_bfs", f"WITH RECURSIVE {EMB}, {bfs_sql(4, 20, 4)} SELECT cloud_id, patch_id, point_id, CAST(rank AS BIGINT) AS rank FROM found")
def _(spark, sf):
    return patches.extract_patches(emb_points(spark, sf), "bfs", patch_count=4, num_per_patch=20, k=4)


@query("patches_bfs_padded", f"""WITH RECURSIVE {EMB}, {bfs_sql(2, 20, 4)},
l AS (SELECT cloud_id, patch_id, arg_max(point_id, rank) AS point_id, max(rank) AS n FROM found GROUP BY 1, 2)
SELECT cloud_id, patch_id, point_id, CAST(rank AS BIGINT) AS rank FROM found UNION ALL
SELECT cloud_id, patch_id, point_id, CAST(unnest(generate_series(n + 1, 20)) AS BIGINT) AS rank FROM l WHERE n < 20""")
def _(spark, sf):
    return patches.extract_patches(emb_points(spark, sf), "bfs_cpu", patch_count=4, num_per_patch=20, k=2)


def split_sql(src, k, min_size):
    """Parts ``parts(cloud_id, parent_id, label, point_id)`` of the members ``src(cloud_id, patch_id, point_id)``."""
    return f"""mp AS (SELECT m.cloud_id, m.patch_id, m.point_id, e.x, e.y, e.z FROM {src} m JOIN emb e USING (cloud_id, point_id)),
pk AS (SELECT * FROM (SELECT a.cloud_id, a.patch_id, a.point_id AS src, b.point_id AS dst,
    row_number() OVER (PARTITION BY a.cloud_id, a.patch_id, a.point_id ORDER BY {D2}, b.point_id) AS nn
  FROM mp a JOIN mp b ON a.cloud_id = b.cloud_id AND a.patch_id = b.patch_id AND a.point_id <> b.point_id) WHERE nn <= {k}),
reach AS (SELECT cloud_id, patch_id, point_id AS u, point_id AS v FROM mp UNION
  SELECT r.cloud_id, r.patch_id, r.u, pk.dst FROM reach r JOIN pk ON pk.cloud_id = r.cloud_id AND pk.patch_id = r.patch_id AND pk.src = r.v),
lab AS (SELECT cloud_id, patch_id AS parent_id, v AS point_id, min(u) AS label FROM reach GROUP BY 1, 2, 3),
parts AS (SELECT cloud_id, parent_id, label, point_id FROM (SELECT *, count(*) OVER (PARTITION BY cloud_id, parent_id, label) AS n FROM lab)
  WHERE n >= {min_size})"""


@query("patches_split_connected", f"WITH RECURSIVE {EMB}, {grid_sql('emb')}, {split_sql('mem', 2, 4)} SELECT * FROM parts")
def _(spark, sf):
    return patches.split_connected(members(spark, sf), emb_points(spark, sf), 2, 4)


@query("patches_fps_connected", f"""WITH RECURSIVE {EMB}, {fps_sql(6)}, {near_sql(2)},
base AS (SELECT cloud_id, center AS patch_id, point_id FROM near), {split_sql('base', 3, 2)}
SELECT cloud_id, dense_rank() OVER (PARTITION BY cloud_id ORDER BY parent_id, label) - 1 AS patch_id, point_id FROM parts""")
def _(spark, sf):
    return patches.fps_connected_patches(emb_points(spark, sf), 6, 2, 3, 2)


@query("patches_fps_split_pruned")
def _(spark, sf):
    """Greedy removal of redundant parts; tests compare it with the one-by-one procedure."""
    return patches.fps_bfs_patches(emb_points(spark, sf), 6, 40, 0.5, 3, 2)


@query("patches_by_method", f"""WITH RECURSIVE {EMB}, {fps_sql(4)}, {near_sql(1)}, {kd_sql('emb', 12)}, {grid_sql('emb', 12, 4)},
u AS (SELECT 'fps' AS method, cloud_id, center AS patch_id, point_id FROM near
  UNION ALL SELECT 'kdtree', cloud_id, patch_id, point_id FROM leaf UNION ALL SELECT 'grid', cloud_id, patch_id, point_id FROM mem)
SELECT method, cloud_id, patch_id, count(*) AS n FROM u GROUP BY 1, 2, 3""")
def _(spark, sf):
    p = emb_points(spark, sf)
    calls = {"fps": dict(patch_count=4, num_per_patch=12), "kdtree": dict(num_per_patch=12, patch_count=4),
             "grid": dict(num_per_patch=12, patch_count=4)}
    out = None
    for method, kw in calls.items():
        m = patches.extract_patches(p, method, **kw).select(F.lit(method).alias("method"), "cloud_id", "patch_id", "point_id")
        out = m if out is None else out.unionByName(m)
    return out.groupBy("method", "cloud_id", "patch_id").agg(F.count(F.lit(1)).alias("n"))


_SCALES = [dict(method="grid", num_per_patch=16, overlap_rate=0.5), dict(method="kdtree", num_per_patch=48, patch_count=2)]
_MULTI = f"""WITH RECURSIVE {EMB}, {grid_sql('emb')}, {kd_sql('emb', 48)}, cnt AS (SELECT cloud_id, count(*) AS cn FROM emb GROUP BY 1),
allm AS (SELECT cloud_id, 0 AS scale_idx, CASE WHEN cn < 16 THEN 0 ELSE patch_id END AS patch_id, point_id FROM mem JOIN cnt USING (cloud_id)
  UNION SELECT cloud_id, 1, patch_id, point_id FROM leaf),
ms AS (SELECT cloud_id, CAST(scale_idx AS BIGINT) AS scale_idx, patch_id, point_id FROM
  (SELECT *, count(*) OVER (PARTITION BY cloud_id, scale_idx, patch_id) AS c FROM allm) WHERE c > 1)"""


def _multi(spark, sf):
    return patches.multi_scale_patches(emb_points(spark, sf), _SCALES)


@query("patches_multi_scale", f"{_MULTI} SELECT * FROM ms")
def _(spark, sf):
    return _multi(spark, sf)


_CNT = "cnt AS (SELECT cloud_id, count(*) AS cn FROM emb GROUP BY 1)"


def some_centres(count):
    """As many of the first four centres of a cloud as an expression over its size ``cn`` says."""
    return f"""{_CNT}, {fps_sql(4).replace('cen AS (', 'cen0 AS (')},
cen AS (SELECT cen0.* FROM cen0 JOIN cnt USING (cloud_id) WHERE center < {count})"""


@query("patches_count_from_size", f"""WITH RECURSIVE {EMB}, {some_centres('greatest(1, floor(cn / 24.0 * 1.5))')}, {near_sql(2)}
SELECT cloud_id, center AS patch_id, point_id FROM near""")
def _(spark, sf):
    """The number of patches of each cloud follows from its own size."""
    return patches.extract_patches(emb_points(spark, sf), "fps", num_per_patch=24, overlap_rate=0.5)


@query("patches_size_from_count", f"""WITH RECURSIVE {EMB}, {_CNT}, {fps_sql(4)},
k AS (SELECT b.cloud_id, b.center, a.point_id, row_number() OVER (PARTITION BY b.cloud_id, b.center ORDER BY {D2}, a.point_id) AS rank
  FROM cen b JOIN emb a ON a.cloud_id = b.cloud_id)
SELECT cloud_id, center AS patch_id, point_id, rank FROM k JOIN cnt USING (cloud_id) WHERE rank <= greatest(1, floor(cn / 4.0 * 1.25))""")
def _(spark, sf):
    """The size of the patches of each cloud follows from its own size."""
    return rounded(patches.extract_patches(emb_points(spark, sf), "knn", patch_count=4, overlap_rate=0.25))


@query("patches_multi_scale_counts", f"""WITH RECURSIVE {EMB}, {some_centres('floor(cn / 16.0)')}, {near_sql(2)}
SELECT cloud_id, CAST(0 AS BIGINT) AS scale_idx, center AS patch_id, point_id FROM near""")
def _(spark, sf):
    """Counts by scale leave the overlap out."""
    return patches.multi_scale_patches(emb_points(spark, sf), [dict(method="fps", num_per_patch=16, overlap_rate=0.5)])


@query("patches_single", f"WITH {EVT} SELECT cloud_id, CAST(0 AS BIGINT) AS patch_id, point_id FROM evt")
def _(spark, sf):
    return patches.single_patch(event_points(spark, sf))


_STATS = """SELECT cloud_id, count(*) AS patch_count, min(n) AS min_points, max(n) AS max_points, round(avg(n), 6) AS mean_points,
  round(var_pop(n), 6) AS var_points, any_value(u) AS total_points, round(1 - any_value(u) / sum(n), 6) AS overlap_rate
FROM (SELECT cloud_id, patch_id, count(*) AS n FROM mem GROUP BY 1, 2) JOIN (SELECT cloud_id, count(DISTINCT point_id) AS u FROM mem GROUP BY 1)
USING (cloud_id) GROUP BY cloud_id"""


@query("patch_statistics", f"WITH {EMB}, {grid_sql('emb')} {_STATS}")
def _(spark, sf):
    return rounded(patches.patch_statistics(members(spark, sf)))


@query("patch_lookup", f"{_MULTI} SELECT patch_id, count(*) AS n FROM ms WHERE cloud_id = 3 AND scale_idx = 0 GROUP BY 1")
def _(spark, sf):
    one = patches.lookup_patches(_multi(spark, sf), 3, 0)
    return one.groupBy("patch_id").agg(F.count(F.lit(1)).alias("n"))


@query("patch_inventory", f"""{_MULTI} SELECT cloud_id, count(DISTINCT scale_idx) AS num_scales, count(*) AS num_patches,
  CAST(sum(n) AS BIGINT) AS num_rows, round(sum(n) * 16 / 1048576.0, 6) AS size_mb, CAST(count(DISTINCT scale_idx) = 2 AS BIGINT) AS complete
FROM (SELECT cloud_id, scale_idx, patch_id, count(*) AS n FROM ms GROUP BY 1, 2, 3) GROUP BY 1""")
def _(spark, sf):
    return rounded(patches.patch_inventory(_multi(spark, sf), 2))


@query("patch_members_distinct", f"""WITH RECURSIVE {EMB}, {fps_sql(6)}, {near_sql(2)}, {grid_sql('emb')},
u AS (SELECT cloud_id, center AS patch_id, point_id FROM near UNION SELECT cloud_id, patch_id % 6, point_id FROM mem)
SELECT cloud_id, patch_id, count(*) AS n FROM u GROUP BY 1, 2""")
def _(spark, sf):
    """Distinct union of two levels of membership: a patch is a set of points."""
    g = members(spark, sf).withColumn("patch_id", F.col("patch_id") % 6)
    both = patches.fps_patches(emb_points(spark, sf), 6, 0.5).unionByName(g).distinct()
    return both.groupBy("cloud_id", "patch_id").agg(F.count(F.lit(1)).alias("n"))


@query("small_patches_dropped", f"""WITH {EMB}, {grid_sql('emb')}, n AS (SELECT *, count(*) OVER (PARTITION BY cloud_id, patch_id) AS n FROM mem)
SELECT cloud_id, patch_id, point_id FROM n WHERE n >= 10 AND n <= 25""")
def _(spark, sf):
    return patches.drop_small(members(spark, sf), ["cloud_id", "patch_id"], 10, 25)


@query("gather_members", f"""WITH {EMB}, {grid_sql('emb')} SELECT m.cloud_id, m.patch_id, m.point_id, round(x, 6) + 0.0 AS x,
  round(gz, 6) + 0.0 AS gz FROM mem m JOIN emb e USING (cloud_id, point_id)""")
def _(spark, sf):
    return rounded(knn.gather(members(spark, sf), emb_points(spark, sf)).select("cloud_id", "patch_id", "point_id", "x", "gz"))


_CENT = "cent AS (SELECT cloud_id, patch_id AS point_id, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n FROM pn GROUP BY 1, 2)"


def _centres(spark, sf):
    return patches.patch_centres(members(spark, sf), emb_points(spark, sf))


@query("centre_graph", f"WITH {PN}, {_CENT}, {knn_sql('k', 'cent', 5)} SELECT cloud_id, src, dst, nn_rank, round(d2, 6) AS d2 FROM k")
def _(spark, sf):
    return rounded(orient.centre_graph(_centres(spark, sf), 5))


@query("centre_adjacency", f"""WITH {PN}, {_CENT}, {knn_sql('k', 'cent', 13)}
SELECT cloud_id, src AS i, dst AS j FROM k UNION SELECT cloud_id, dst, src FROM k""")
def _(spark, sf):
    return orient.centre_adjacency(_centres(spark, sf))


@query("colour_training_sets", f"""WITH {EMB}, q AS (SELECT cloud_id, avg(x) AS qx, avg(y) AS qy, avg(z) AS qz FROM emb GROUP BY 1),
d AS (SELECT e.*, row_number() OVER (PARTITION BY e.cloud_id ORDER BY (x-qx)*(x-qx)+(y-qy)*(y-qy)+(z-qz)*(z-qz), point_id) <= 4 AS hit,
  nx * gx + ny * gy + nz * gz < 0 AS t, nx < 0 AS p FROM emb e JOIN q USING (cloud_id))
SELECT cloud_id, point_id, CAST(CASE WHEN hit THEN 255 WHEN p = t THEN 0 ELSE 255 END AS BIGINT) AS cr,
  CAST(CASE WHEN hit THEN 0 WHEN p = t THEN 255 ELSE 0 END AS BIGINT) AS cg, CAST(CASE WHEN hit THEN 255 ELSE 0 END AS BIGINT) AS cb,
  CAST(CASE WHEN t THEN 128 ELSE 0 END AS BIGINT) AS fr, CAST(CASE WHEN t THEN 128 ELSE 255 END AS BIGINT) AS fb FROM d""")
def _(spark, sf):
    from pointlake.operators.normals import flip_bits
    from pointlake.operators.transforms import colour_training_sets

    p = emb_points(spark, sf)
    q = p.groupBy("cloud_id").agg(*[F.avg(c).alias(f"q{c}") for c in XYZ])
    rows = flip_bits(knn.nearest_to_query(p, q, 4)).withColumnRenamed("gt_flip", "ground_truth")
    rows = rows.withColumn("prediction", (F.col("nx") < 0).cast("long"))
    return rounded(colour_training_sets(rows).select("cloud_id", "point_id", "cr", "cg", "cb", "fr", "fb"))
