"""Graphs, normals and orientation over the test tables."""

from pyspark.sql import functions as F

from pointlake.catalog.patch_queries import _CENT, _centres, knn_sql
from pointlake.catalog.registry import query, rnd, rounded
from pointlake.catalog.toy import EDGES, PN, patch_flips, patch_normals, sql_dot
from pointlake.fixtures import EMB, EVT, emb_points, event_points, table
from pointlake.functions.geometry import NORMAL, TRUTH, XYZ
from pointlake.operators import graph, knn, normals, orient
from pointlake.plans import edge_model
from pointlake.plans.orientation import orient_clouds, report

_REACH = """reach AS (SELECT cloud_id, point_id AS u, point_id AS v FROM {src} UNION
  SELECT r.cloud_id, r.u, k.dst FROM reach r JOIN k ON k.cloud_id = r.cloud_id AND k.src = r.v),
lab AS (SELECT cloud_id, v, min(u) AS label FROM reach GROUP BY 1, 2)"""


def _knn_graph(spark, sf, k):
    p = emb_points(spark, sf)
    return p.select("cloud_id", F.col("point_id").alias("v")), knn.knn_graph(p, k)


@query("components_directed", f"WITH RECURSIVE {EMB}, {knn_sql('k', 'emb', 2)}, {_REACH.format(src='emb')} SELECT cloud_id, v, label FROM lab")
def _(spark, sf):
    return graph.components(*_knn_graph(spark, sf, 2))


@query("components_weak", f"""WITH RECURSIVE {EMB}, {knn_sql('k0', 'emb', 2)},
k AS (SELECT cloud_id, src, dst FROM k0 UNION SELECT cloud_id, dst, src FROM k0), {_REACH.format(src='emb')} SELECT cloud_id, v, label FROM lab""")
def _(spark, sf):
    return graph.components(*_knn_graph(spark, sf, 2), mode="weak")


_LARGEST = f"""WITH RECURSIVE {EMB}, {knn_sql('k', 'emb', 2)}, {_REACH.format(src='emb')},
sz AS (SELECT cloud_id, label, count(*) AS n, row_number() OVER (PARTITION BY cloud_id ORDER BY count(*) DESC, label) AS rk FROM lab GROUP BY 1, 2)"""


@query("largest_component", f"""{_LARGEST} SELECT l.cloud_id, l.v AS point_id FROM lab l JOIN sz USING (cloud_id, label) WHERE rk = 1""")
def _(spark, sf):
    labels = graph.components(*_knn_graph(spark, sf, 2))
    return graph.largest_component(emb_points(spark, sf), labels)[0].select("cloud_id", "point_id")


_LSTATS = f"""SELECT cloud_id, CAST(sum(n) AS BIGINT) AS n_in, max(n) AS n_out, count(*) AS num_components,
  coalesce(max(n) FILTER (WHERE rk = 2), 0) AS second_largest, round(max(n) / sum(n), 6) AS retention FROM sz GROUP BY 1"""


@query("largest_component_stats", f"{_LARGEST} {_LSTATS}")
def _(spark, sf):
    labels = graph.components(*_knn_graph(spark, sf, 2))
    return rounded(graph.largest_component(emb_points(spark, sf), labels)[1])


@query("cleaning_report", f"""{_LARGEST}, st AS ({_LSTATS}) SELECT count(*) AS num_files, round(avg(retention), 6) AS mean_retention,
  round(avg(num_components), 6) AS mean_components, CAST(sum(n_in) AS BIGINT) AS points_in, CAST(sum(n_out) AS BIGINT) AS points_out FROM st""")
def _(spark, sf):
    from pointlake.operators.metrics import cleaning_report

    labels = graph.components(*_knn_graph(spark, sf, 2))
    return rounded(cleaning_report(rounded(graph.largest_component(emb_points(spark, sf), labels)[1])))


def _edges(spark, sf):
    return orient.overlap_relation(patch_normals(spark, sf))


@query("patch_graph_components", f"""WITH RECURSIVE {PN}, {EDGES},
strong AS (SELECT * FROM edges WHERE a + b >= 6),
e2 AS (SELECT cloud_id, i, j FROM strong UNION SELECT cloud_id, j, i FROM strong WHERE (i + j) % 3 > 0),
sym AS (SELECT p.cloud_id, p.i AS src, p.j AS dst FROM e2 p JOIN e2 q ON p.cloud_id = q.cloud_id AND p.i = q.j AND p.j = q.i),
reach AS (SELECT cloud_id, patch_id AS u, patch_id AS v FROM flips UNION
  SELECT r.cloud_id, r.u, s.dst FROM reach r JOIN sym s ON s.cloud_id = r.cloud_id AND s.src = r.v)
SELECT cloud_id, v, min(u) AS label FROM reach GROUP BY 1, 2""")
def _(spark, sf):
    both = orient.both_directions(_edges(spark, sf).where(F.col("a") + F.col("b") >= 6))
    listed = both.where((F.col("i") < F.col("j")) | ((F.col("i") + F.col("j")) % 3 > 0))
    v = patch_flips(spark, sf).select("cloud_id", F.col("patch_id").alias("v"))
    return graph.patch_components(v, listed)


@query("patch_relation", f"WITH {PN}, {EDGES} SELECT * FROM edges")
def _(spark, sf):
    return _edges(spark, sf)


@query("patch_relation_adjacent", f"""WITH {PN}, {EDGES}, {_CENT}, {knn_sql('k', 'cent', 13)},
adj AS (SELECT cloud_id, src AS i, dst AS j FROM k UNION SELECT cloud_id, dst, src FROM k)
SELECT edges.* FROM edges JOIN adj USING (cloud_id, i, j)""")
def _(spark, sf):
    return orient.overlap_relation(patch_normals(spark, sf), orient.centre_adjacency(_centres(spark, sf)))


@query("patch_relation_two", f"""WITH {PN},
t AS (SELECT cloud_id, point_id, min(patch_id) AS i, max(patch_id) AS j, arg_min(nx, patch_id) AS ax, arg_min(ny, patch_id) AS ay,
  arg_min(nz, patch_id) AS az, arg_max(nx, patch_id) AS bx, arg_max(ny, patch_id) AS by_, arg_max(nz, patch_id) AS bz FROM pn GROUP BY 1, 2),
d AS (SELECT *, ax * bx + ay * by_ + az * bz AS d FROM t WHERE i < j)
SELECT cloud_id, i, j, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS a, CAST(sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) AS DOUBLE) AS b
FROM d GROUP BY 1, 2, 3""")
def _(spark, sf):
    return orient.two_patch_relation(patch_normals(spark, sf))


@query("edge_list", f"WITH {PN}, {EDGES} SELECT *, b AS cost_same, a AS cost_different FROM edges WHERE a > 0 OR b > 0")
def _(spark, sf):
    return graph.edge_list(orient.both_directions(_edges(spark, sf))).select("cloud_id", "i", "j", "a", "b", "cost_same", "cost_different")


@query("edges_normalised", f"""WITH {PN}, {EDGES} SELECT cloud_id, i, j, round(CASE WHEN a + b <> 0 THEN a / (a + b) ELSE a END, 6) AS a,
  round(CASE WHEN a + b <> 0 THEN b / (a + b) ELSE b END, 6) AS b FROM edges""")
def _(spark, sf):
    return rounded(graph.normalized_edges(_edges(spark, sf)))


_SCORES = f"""WITH {PN}, {EDGES}, {_CENT}, {knn_sql('k', 'cent', 5)}, sc AS (SELECT cloud_id, src, dst, ((src * 31 + dst * 17) % 100) / 25.0 - 2 AS logit FROM k),
scored AS (SELECT cloud_id, least(src, dst) AS i, greatest(src, dst) AS j, arg_max(1.0 / (1.0 + exp(logit)), src) AS a FROM sc GROUP BY 1, 2, 3)"""


def _scored(spark, sf):
    g = orient.centre_graph(_centres(spark, sf), 5)
    logit = ((F.col("src") * 31 + F.col("dst") * 17) % 100) / F.lit(25.0) - 2
    return graph.scored_edges(g.select("cloud_id", "src", "dst", logit.alias("logit")))


@query("edges_scored", f"{_SCORES} SELECT cloud_id, i, j, round(a, 6) AS a, round(1 - a, 6) AS b FROM scored")
def _(spark, sf):
    return rounded(_scored(spark, sf))


@query("edges_hybrid", f"""{_SCORES} SELECT coalesce(s.cloud_id, e.cloud_id) AS cloud_id, coalesce(s.i, e.i) AS i, coalesce(s.j, e.j) AS j,
  round(0.7 * coalesce(s.a, 0) + 0.3 * coalesce(e.a, 0), 6) AS a, round(0.7 * coalesce(1 - s.a, 0) + 0.3 * coalesce(e.b, 0), 6) AS b
FROM scored s FULL JOIN edges e ON s.cloud_id = e.cloud_id AND s.i = e.i AND s.j = e.j""")
def _(spark, sf):
    return rounded(graph.consistency_relation("hybrid", _scored(spark, sf), _edges(spark, sf)))


@query("edges_filtered", f"WITH {PN}, {EDGES} SELECT * FROM edges WHERE a + b >= 10 AND greatest(a, b) / (a + b) >= 0.6")
def _(spark, sf):
    return graph.overlap_filter(_edges(spark, sf))


@query("edges_enough_patches", f"""WITH {PN}, {EDGES}, c AS (SELECT cloud_id FROM flips GROUP BY 1 HAVING count(*) >= 28)
SELECT edges.* FROM edges JOIN c USING (cloud_id)""")
def _(spark, sf):
    return graph.edges_with_enough_nodes(_edges(spark, sf), patch_flips(spark, sf), 28)


@query("spanning_forest", f"""WITH RECURSIVE {PN}, {EDGES},
sym AS (SELECT cloud_id, i AS src, j AS dst FROM edges WHERE a + b >= 6 UNION SELECT cloud_id, j, i FROM edges WHERE a + b >= 6),
vert AS (SELECT DISTINCT cloud_id, src AS v FROM sym),
reach AS (SELECT cloud_id, v AS u, v FROM vert UNION SELECT r.cloud_id, r.u, s.dst FROM reach r JOIN sym s ON s.cloud_id = r.cloud_id AND s.src = r.v),
lab AS (SELECT cloud_id, v, min(u) AS label FROM reach GROUP BY 1, 2)
SELECT cloud_id, count(*) AS n_vertices, count(DISTINCT label) AS n_trees, count(*) - count(DISTINCT label) AS n_edges FROM lab GROUP BY 1""")
def _(spark, sf):
    """Random spanning forest: vertices, trees and edges per cloud (edges = vertices - trees)."""
    e = _edges(spark, sf).where(F.col("a") + F.col("b") >= 6)
    v = graph.graph_vertices(e, ["cloud_id"])
    f, state = graph.spanning_forest(v, e, ["cloud_id"], graph.random_weight(7))
    n_edges = f.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n_edges"))
    n = state.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n_vertices"), F.count_distinct("root").alias("n_trees"))
    return n.join(n_edges, "cloud_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


_HEAP = """rk AS (SELECT cloud_id, point_id, row_number() OVER (PARTITION BY cloud_id ORDER BY point_id) AS r FROM emb),
heap AS (SELECT a.cloud_id, b.point_id AS i, a.point_id AS j, a.r FROM rk a JOIN rk b ON a.cloud_id = b.cloud_id AND b.r = a.r // 2)"""


def _heap(spark, sf):
    from pointlake.operators.tiles import ranked

    r = ranked(emb_points(spark, sf).select("cloud_id", "point_id"), ["cloud_id"], ["point_id"], ["point_id"], "r")
    up = r.select("cloud_id", F.col("point_id").alias("i"), F.col("r").alias("_p"))
    down = r.select("cloud_id", F.col("point_id").alias("j"), "r", F.floor(F.col("r") / 2).alias("_p"))
    return r, down.join(up, ["cloud_id", "_p"]).select("cloud_id", "i", "j", "r")


@query("rooted_tree", f"""WITH {EMB}, {_HEAP} SELECT rk.cloud_id, point_id AS v, heap.i AS parent, CAST(floor(log2(rk.r)) AS BIGINT) AS level
FROM rk LEFT JOIN heap ON heap.cloud_id = rk.cloud_id AND heap.j = rk.point_id""")
def _(spark, sf):
    r, heap = _heap(spark, sf)
    roots = r.where("r = 1").select("cloud_id", F.col("point_id").alias("v"))
    return graph.rooted_tree(heap, roots)


_HEAP_AB = f"{_HEAP}, ab AS (SELECT cloud_id, i, j, (i * 13 + j * 7) % 10 + 0.0 AS a, (i * 5 + j * 3) % 10 + 0.0 AS b FROM heap)"


@query("forest_flips_on_tree", f"""WITH {EMB}, {_HEAP_AB} SELECT cloud_id, CAST(sum(greatest(a, b)) AS DOUBLE) AS objective FROM ab GROUP BY 1""")
def _(spark, sf):
    """On a tree the forest solver reaches the optimum: the larger relation of every edge."""
    heap = _heap(spark, sf)[1]
    ab = heap.select("cloud_id", "i", "j", ((F.col("i") * 13 + F.col("j") * 7) % 10).cast("double").alias("a"),
                     ((F.col("i") * 5 + F.col("j") * 3) % 10).cast("double").alias("b"))
    labels = orient.forest_flips(ab)
    full = ab.where("a + b > 0")
    return orient.objective(full, labels).select("cloud_id", "objective")


@query("forest_flips")
def _(spark, sf):
    return orient.solve_flips("forest", _edges(spark, sf), patch_flips(spark, sf))


@query("vote_flips")
def _(spark, sf):
    return orient.solve_flips("vote", _edges(spark, sf), patch_flips(spark, sf), runs=3)


@query("vote_flips_improve", f"WITH {PN}, {EDGES} SELECT cloud_id, CAST(1 AS BIGINT) AS not_worse FROM edges GROUP BY 1")
def _(spark, sf):
    """The solved labels serve the objective at least as well as leaving all patches as they are."""
    e, p = _edges(spark, sf), patch_flips(spark, sf)
    solved = orient.objective(e, orient.solve_flips("vote", e, p, runs=3)).select("cloud_id", F.col("objective").alias("o1"))
    start = orient.objective(e, p.withColumn("flip", F.lit(0).cast("long"))).select("cloud_id", F.col("objective").alias("o0"))
    return solved.join(start, "cloud_id").select("cloud_id", (F.col("o1") >= F.col("o0")).cast("long").alias("not_worse"))


@query("vote_labels", f"""WITH {PN}, runs AS (SELECT cloud_id, patch_id, seed, ((patch_id % 1009) * (seed + 2) + patch_id % 13) % 3 % 2 AS flip
  FROM flips, (SELECT unnest(generate_series(0, 4)) AS seed)),
t AS (SELECT r.cloud_id, r.seed, sum(CASE WHEN r.flip = b.flip THEN 1 ELSE -1 END) < 0 AS turn FROM runs r
  JOIN runs b ON b.seed = 0 AND b.cloud_id = r.cloud_id AND b.patch_id = r.patch_id GROUP BY 1, 2)
SELECT r.cloud_id, r.patch_id, CAST(sum(xor(r.flip, CAST(t.turn AS BIGINT))) * 2 > count(*) AS BIGINT) AS flip
FROM runs r JOIN t USING (cloud_id, seed) GROUP BY 1, 2""")
def _(spark, sf):
    p = patch_flips(spark, sf).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(4))))
    flip = (((F.col("patch_id") % 1009) * (F.col("seed") + 2) + F.col("patch_id") % 13) % 3) % 2
    return orient.vote_labels(p.withColumn("flip", flip))


@query("random_flips", f"""WITH {PN} SELECT cloud_id, patch_id,
  CAST(('0x' || substr(md5('42:' || CAST(cloud_id AS VARCHAR) || ':' || CAST(patch_id AS VARCHAR)), 1, 1)) AS BIGINT) % 2 AS flip FROM flips""")
def _(spark, sf):
    p = patch_flips(spark, sf)
    return orient.solve_flips("random", None, p)


@query("objective", f"""WITH {PN}, {EDGES} SELECT e.cloud_id, sum(CASE WHEN fi.flip = fj.flip THEN a ELSE b END) AS objective,
  2 * sum(CASE WHEN fi.flip = fj.flip THEN b ELSE a END) AS total_cost
FROM edges e JOIN flips fi ON fi.cloud_id = e.cloud_id AND fi.patch_id = e.i JOIN flips fj ON fj.cloud_id = e.cloud_id AND fj.patch_id = e.j GROUP BY 1""")
def _(spark, sf):
    return orient.objective(_edges(spark, sf), patch_flips(spark, sf))


_MOM = """mom AS (SELECT k.cloud_id, k.src AS point_id, count(*) AS k, covar_pop(p.x, p.x) AS xx, covar_pop(p.x, p.y) AS xy, covar_pop(p.x, p.z) AS xz,
  covar_pop(p.y, p.y) AS yy, covar_pop(p.y, p.z) AS yz, covar_pop(p.z, p.z) AS zz
  FROM k JOIN {src} p ON p.cloud_id = k.cloud_id AND p.point_id = k.dst GROUP BY 1, 2)"""


@query("neighbourhood_moments", f"""WITH {EMB}, {knn_sql('k', 'emb', 10)}, {_MOM.format(src='emb')}
SELECT cloud_id, point_id, k, round(xx, 6) AS cxx, round(xy, 6) + 0.0 AS cxy, round(xz, 6) + 0.0 AS cxz, round(yy, 6) AS cyy,
  round(yz, 6) + 0.0 AS cyz, round(zz, 6) AS czz FROM mom""")
def _(spark, sf):
    return rounded(normals.neighbourhood_moments(emb_points(spark, sf), 10))


@query("pca_smallest_eigenvalue", f"""WITH {EVT}, {knn_sql('k', 'evt', 10)}, {_MOM.format(src='evt')},
q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM mom),
p AS (SELECT *, sqrt(((xx-q)*(xx-q) + (yy-q)*(yy-q) + (zz-q)*(zz-q) + 2*(xy*xy + xz*xz + yz*yz)) / 6) AS p FROM q),
r AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE greatest(-1, least(1, (((xx-q)*((yy-q)*(zz-q)-yz*yz) - xy*(xy*(zz-q)-yz*xz) + xz*(xy*yz-(yy-q)*xz)) / (p*p*p)) / 2)) END AS r FROM p)
SELECT cloud_id, point_id, round(q + 2 * p * cos(acos(r) / 3 + 2 * pi() / 3), 5) + 0.0 AS e0 FROM r""")
def _(spark, sf):
    n = normals.pca_normals(event_points(spark, sf), 10)
    return n.select("cloud_id", "point_id", rnd("e0", 5).alias("e0"))


@query("pca_normals")
def _(spark, sf):
    return rounded(normals.pca_normals(event_points(spark, sf), 10).select("cloud_id", "point_id", *NORMAL))


@query("pca_normal_metrics")
def _(spark, sf):
    """Angular error of estimated normals against the truth, per cloud."""
    from pointlake.operators.metrics import normal_metrics

    p = emb_points(spark, sf)
    n = normals.pca_normals(p, 10).select("cloud_id", "point_id", *NORMAL)
    return rounded(normal_metrics(n.join(p.select("cloud_id", "point_id", *TRUTH), ["cloud_id", "point_id"]), ["cloud_id"]))


@query("tangent_plane_orientation")
def _(spark, sf):
    return rounded(orient.tangent_plane_orientation(event_points(spark, sf), 10, 1.0))


_ROUND = """sc{r} AS (SELECT k.cloud_id, k.src AS point_id, -sum(sign(a.nx*b.nx + a.ny*b.ny + a.nz*b.nz)) AS logit FROM k
  JOIN {prev} a ON a.cloud_id = k.cloud_id AND a.point_id = k.src JOIN {prev} b ON b.cloud_id = k.cloud_id AND b.point_id = k.dst GROUP BY 1, 2),
st{r} AS (SELECT s.cloud_id, s.point_id, CASE WHEN logit > 0 THEN -nx ELSE nx END AS nx, CASE WHEN logit > 0 THEN -ny ELSE ny END AS ny,
  CASE WHEN logit > 0 THEN -nz ELSE nz END AS nz, 2 * abs(1 / (1 + exp(-logit)) - 0.5) AS confidence FROM {prev} s JOIN sc{r} USING (cloud_id, point_id))"""


@query("refine_flips", f"""WITH {EMB}, {knn_sql('k', 'emb', 6)}, {_ROUND.format(r=1, prev='emb')}, {_ROUND.format(r=2, prev='st1')}
SELECT cloud_id, point_id, round(nx, 6) + 0.0 AS nx, round(ny, 6) + 0.0 AS ny, round(nz, 6) + 0.0 AS nz, round(confidence, 6) AS confidence FROM st2""")
def _(spark, sf):
    p = emb_points(spark, sf)
    out = normals.refine_flips(p, normals.neighbour_scorer(p, 6), 2)
    return rounded(out.select("cloud_id", "point_id", *NORMAL, "confidence"))


@query("patch_scorer", f"""WITH {PN}, m AS (SELECT *, nx + ny + nz > 0 AS up FROM pn)
SELECT cloud_id, patch_id, point_id, round(CASE WHEN up THEN -(nx + ny + nz) ELSE nx + ny + nz END * 1.0, 6) + 0.0 AS logit FROM m""")
def _(spark, sf):
    """A plugged-in scorer, called once per patch."""
    score = normals.patch_scorer(lambda pdf: -(pdf["nx"] + pdf["ny"] + pdf["nz"]).abs(), ["cloud_id", "patch_id"])
    return rounded(score(patch_normals(spark, sf)))


@query("majority_flips", f"""WITH {PN} SELECT cloud_id, patch_id, CAST(sum(CASE WHEN {sql_dot()} < 0 THEN 1 ELSE 0 END) * 2 > count(*) AS BIGINT) AS flip
FROM pn GROUP BY 1, 2""")
def _(spark, sf):
    return orient.majority_flips(patch_normals(spark, sf))


def _feature_sql(fn):
    f = ["x", "y", "z", "nx", "ny", "nz"]
    g = ["x", "y", "z", "-nx", "-ny", "-nz"]
    out = [f"round({fn}({c}), 6) + 0.0 AS f{i}" for i, c in enumerate(f)]
    out += [f"round({fn}({c}), 6) + 0.0 AS g{i}" for i, c in enumerate(g)]
    return f"""WITH {PN} SELECT cloud_id, patch_id, round(avg(x), 6) + 0.0 AS cx, count(*) AS n_points, {', '.join(out)} FROM pn GROUP BY 1, 2"""


for _pool, _fn in (("max", "max"), ("mean", "avg")):

    @query(f"patch_features_{_pool}", _feature_sql(_fn))
    def _(spark, sf, pool=_pool):
        f = orient.patch_features(normals.point_features(patch_normals(spark, sf), 6), pool)
        both = [F.col("feature")[i].alias(f"f{i}") for i in range(6)] + [F.col("inv_feature")[i].alias(f"g{i}") for i in range(6)]
        return rounded(f.select("cloud_id", "patch_id", "cx", "n_points", *both))


def _emb_features(spark, sf):
    e = table(spark, sf, "embeddings")
    f = F.transform("embedding", lambda v: v.cast("double"))
    return e.select(
        F.col("label").cast("long").alias("cloud_id"), F.col("vec_id").cast("long").alias("patch_id"),
        f.alias("feature"), F.transform(f, lambda v: -v).alias("inv_feature"),
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(XYZ)],
        (F.col("vec_id") % 2).cast("long").alias("gt_flip"),
    )


_W = [((i * 7) % 5 - 2) / 2 for i in range(64)]


@query("iterate_patch_flips", f"""WITH z AS (SELECT CAST(label AS BIGINT) AS cloud_id, CAST(vec_id AS BIGINT) AS patch_id,
  {' + '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) * ({w})' for i, w in enumerate(_W))} AS z FROM embeddings),
a AS (SELECT *, CAST(z - 0.05 > 0 AS BIGINT) AS f1 FROM z),
b AS (SELECT *, CASE WHEN f1 = 1 THEN -z ELSE z END AS s FROM a)
SELECT cloud_id, patch_id, xor(f1, CAST(s - 0.05 > 0 AS BIGINT)) AS flip FROM b""")
def _(spark, sf):
    return orient.iterate_patch_flips(_emb_features(spark, sf), orient.linear_scorer(_W, -0.05), 2)


@query("edge_samples", f"""WITH {EMB}, {knn_sql('k', 'emb', 3)}, v AS (SELECT * FROM (VALUES (0, 1, 1), (1, 1, -1), (2, -1, 1), (3, -1, -1)) t(variant, sa, sb))
SELECT k.cloud_id, src AS i, dst AS j, CAST(variant AS BIGINT) AS variant, round(sa * a.nx, 6) + 0.0 AS fa, round(sb * b.ny, 6) + 0.0 AS fb,
  round(a.x - b.x, 6) + 0.0 AS dx, CAST(xor(xor(src % 2, dst % 2), CAST(sa * sb < 0 AS BIGINT)) AS BIGINT) AS label
FROM k JOIN emb a ON a.cloud_id = k.cloud_id AND a.point_id = k.src JOIN emb b ON b.cloud_id = k.cloud_id AND b.point_id = k.dst, v""")
def _(spark, sf):
    s = orient.edge_samples(_emb_features(spark, sf), 3)
    return rounded(s.select("cloud_id", "i", "j", "variant", F.col("fa")[3].alias("fa"), F.col("fb")[4].alias("fb"), "dx", "label"))


@query("edge_model_scores")
def _(spark, sf):
    """Train the pair classifier on edge samples and score the pairs, each in all its variants."""
    s = orient.edge_samples(_emb_features(spark, sf), 3)
    model = edge_model.fit(s)
    return rounded(edge_model.score(model, s, ["variant"]).select("cloud_id", "src", "dst", "variant", "logit"), 4)


@query("pair_scorer", f"""WITH {EMB}, {knn_sql('k', 'emb', 3)}, v AS (SELECT * FROM (VALUES (0, 1, 1), (1, 1, -1), (2, -1, 1), (3, -1, -1)) t(variant, sa, sb)),
e AS (SELECT vec_id AS point_id, list_transform(embedding, lambda u: CAST(u AS DOUBLE)) AS f FROM embeddings),
s AS (SELECT k.cloud_id, src, dst, variant, -sa * sb * list_dot_product(ea.f, eb.f) - ((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS logit
  FROM k JOIN emb a ON a.cloud_id = k.cloud_id AND a.point_id = k.src JOIN emb b ON b.cloud_id = k.cloud_id AND b.point_id = k.dst
    JOIN e ea ON ea.point_id = k.src JOIN e eb ON eb.point_id = k.dst, v)
SELECT cloud_id, src, dst, CAST(variant AS BIGINT) AS variant, round(logit, 6) + 0.0 AS logit, round(1 / (1 + exp(-logit)), 6) + 0.0 AS probability FROM s""")
def _(spark, sf):
    """A plugged-in scorer of pairs: disagreement of the features, less the squared distance of the centres."""
    s = orient.edge_samples(_emb_features(spark, sf), 3)
    return rounded(edge_model.score_with(lambda a, b, d: -(a * b).sum(1) - (d * d).sum(1), s, ["variant"]))


@query("merge_smallest", f"""WITH {PN},
n AS (SELECT cloud_id, patch_id, count(*) AS n FROM pn GROUP BY 1, 2),
r AS (SELECT p.*, CASE WHEN f.flip = 1 THEN -1.0 ELSE 1.0 END AS s, row_number() OVER (PARTITION BY p.cloud_id, p.point_id ORDER BY n.n, p.patch_id DESC) AS rk
  FROM pn p JOIN n USING (cloud_id, patch_id) JOIN flips f USING (cloud_id, patch_id))
SELECT e.cloud_id, e.point_id, coalesce(round(s * r.nx, 6) + 0.0, 0.0) AS nx, coalesce(round(s * r.ny, 6) + 0.0, 0.0) AS ny, coalesce(round(s * r.nz, 6) + 0.0, 0.0) AS nz
FROM emb e LEFT JOIN r ON r.cloud_id = e.cloud_id AND r.point_id = e.point_id AND rk = 1""")
def _(spark, sf):
    return rounded(orient.merge_patches(patch_normals(spark, sf), patch_flips(spark, sf), emb_points(spark, sf)))


@query("merge_vote", f"""WITH {PN},
n AS (SELECT cloud_id, patch_id, count(*) AS n FROM pn GROUP BY 1, 2),
r AS (SELECT p.cloud_id, p.point_id, CASE WHEN f.flip = 1 THEN -1.0 ELSE 1.0 END * p.nx AS nx, CASE WHEN f.flip = 1 THEN -1.0 ELSE 1.0 END * p.ny AS ny,
  CASE WHEN f.flip = 1 THEN -1.0 ELSE 1.0 END * p.nz AS nz, row_number() OVER (PARTITION BY p.cloud_id, p.point_id ORDER BY n.n, p.patch_id DESC) AS rk
  FROM pn p JOIN n USING (cloud_id, patch_id) JOIN flips f USING (cloud_id, patch_id)),
b AS (SELECT * FROM r WHERE rk = 1),
v AS (SELECT r.cloud_id, r.point_id, sum(sign(r.nx*b.nx + r.ny*b.ny + r.nz*b.nz)) AS v FROM r JOIN b USING (cloud_id, point_id) GROUP BY 1, 2)
SELECT b.cloud_id, b.point_id, round(CASE WHEN v < 0 THEN -nx ELSE nx END, 6) + 0.0 AS nx, round(CASE WHEN v < 0 THEN -ny ELSE ny END, 6) + 0.0 AS ny,
  round(CASE WHEN v < 0 THEN -nz ELSE nz END, 6) + 0.0 AS nz FROM b JOIN v USING (cloud_id, point_id)""")
def _(spark, sf):
    return rounded(orient.merge_patches(patch_normals(spark, sf), patch_flips(spark, sf), mode="vote"))


@query("patch_order", f"""WITH {PN} SELECT cloud_id, patch_id, count(*) AS n, row_number() OVER (PARTITION BY cloud_id ORDER BY count(*) DESC, patch_id) AS rank
FROM pn GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(orient.patch_order(patch_normals(spark, sf)))


@query("largest_patches", f"""WITH {PN}, r AS (SELECT cloud_id, patch_id, count(*) AS n,
  row_number() OVER (PARTITION BY cloud_id ORDER BY count(*) DESC, patch_id) AS rank FROM pn GROUP BY 1, 2) SELECT * FROM r WHERE rank <= 5""")
def _(spark, sf):
    return rounded(orient.largest_patches(patch_normals(spark, sf)))


@query("orientation_report")
def _(spark, sf):
    """Flagship: orient every cloud end to end and report its accuracy."""
    p = emb_points(spark, sf)
    result = orient_clouds(p.drop(*NORMAL), method="grid", num_per_patch=16, overlap_rate=0.5, solver="forest")
    return rounded(report(result, p))


@query("oriented_normals")
def _(spark, sf):
    p = event_points(spark, sf)
    result = orient_clouds(p, method="grid", num_per_patch=32, overlap_rate=0.5, solver="forest")
    return rounded(result.normals)
