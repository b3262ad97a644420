"""Components, spanning forests and rooted trees on neighbour and patch graphs.

``keys`` name the independent graphs (clouds, patches of a cloud, forest seeds). Graphs whose rows fit one task
are solved there, many per batch; larger ones by joins repeated to a fixed point, all of them advancing in the
same jobs, with a reliable checkpoint per round. Both ways give the same result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from pointlake.functions.geometry import as_flag
from pointlake.operators.grouped import SMALL_GRAPH_ROWS, map_groups, oversized, typed
from pointlake.operators.tiles import group_sizes
from pointlake.session import cut, discard, is_empty, staged


def _reach_small(g: dict) -> dict:
    ids, ends = np.unique(np.concatenate([g["src"], g["dst"]]), return_inverse=True)
    src, dst = ends[: len(g["src"])], ends[len(g["src"]) :]
    label = np.arange(len(ids))
    while True:
        nxt = label.copy()
        np.minimum.at(nxt, dst, label[src])
        nxt = nxt[nxt]
        if np.array_equal(nxt, label):
            return {"v": ids, "label": ids[label]}
        label = nxt


def _split(rows: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of graphs that fit one task, keys of the others or None)."""
    big = oversized(rows, keys, limit)
    return (rows, None) if big is None else (rows.join(big, keys, "left_anti"), big)


def reach_labels(vertices: DataFrame, edges: DataFrame, keys: list[str], limit: int = SMALL_GRAPH_ROWS) -> DataFrame:
    """label(v) = smallest vertex that reaches v along directed edges src -> dst: (keys, v, label).

    This equals searches started in id order that claim what they reach.
    """
    keys = list(keys)
    edges = edges.select(*keys, "src", "dst")
    loops = vertices.select(*keys, F.col("v").alias("src"), F.col("v").alias("dst"))
    rows = cut(edges.unionByName(loops))
    small, big = _split(rows, keys, limit)
    schema = typed(rows, keys) + ", v {0}, label {0}".format(dict(rows.dtypes)["src"])
    labels = map_groups(small, keys, _reach_small, schema)
    if big is None:
        return labels
    huge = rows.join(big, keys, "left_semi")
    v = huge.where(F.col("src") == F.col("dst")).select(*keys, F.col("src").alias("v")).distinct()
    return labels.unionByName(_reach_rounds(v, huge.where(F.col("src") != F.col("dst")), keys))


def _reach_rounds(vertices: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Labels by rounds of joins. Labels also jump to the label of their label, which is sound because reaching
    is transitive, so long chains need few rounds."""
    edges = cut(edges.select(*keys, "src", "dst"))
    held = staged(vertices.select(*keys, "v", F.col("v").alias("label")))
    labels = held
    while True:
        src = labels.select(*keys, F.col("v").alias("src"), F.col("label").alias("_in"))
        incoming = edges.join(src, keys + ["src"]).groupBy(*keys, F.col("dst").alias("v")).agg(
            F.min("_in").alias("_in")
        )
        hop = labels.select(*keys, F.col("v").alias("label"), F.col("label").alias("_hop"))
        nxt = (
            labels.join(hop, keys + ["label"])
            .join(incoming, keys + ["v"], "left")
            .select(
                *keys, "v", F.col("label").alias("_old"),
                F.least("label", "_hop", F.coalesce("_in", "label")).alias("label"),
            )
        )
        nxt = staged(nxt)
        discard(held)
        held, labels = nxt, nxt.select(*keys, "v", "label")
        if is_empty(nxt.where(F.col("label") < F.col("_old"))):
            labels = cut(labels)
            discard(held)
            return labels


def components(vertices: DataFrame, edges: DataFrame, keys: list[str] = ("cloud_id",), mode: str = "directed"):
    """Component label per vertex. ``directed``: index-order searches on directed edges; ``weak``: undirected."""
    keys = list(keys)
    if mode == "weak":
        back = edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
        edges = edges.select(*keys, "src", "dst").unionByName(back)
    elif mode != "directed":
        raise ValueError(f"unknown component mode {mode}")
    return reach_labels(vertices, edges, keys)


def largest_component(points: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points of each cloud's largest component, per-cloud statistics); ties go to the smaller label."""
    sizes = labels.groupBy("cloud_id", "label").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy("cloud_id").agg(
        F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("label"),
        F.count(F.lit(1)).alias("num_components"), F.sum("n").alias("n_in"), F.max("n").alias("n_out"),
    )
    second = (
        sizes.join(top.select("cloud_id", F.col("label").alias("_top")), "cloud_id")
        .where(F.col("label") != F.col("_top"))
        .groupBy("cloud_id")
        .agg(F.max("n").alias("second_largest"))
    )
    stats = top.join(second, "cloud_id", "left").select(
        "cloud_id", "n_in", "n_out", "num_components",
        F.coalesce("second_largest", F.lit(0)).alias("second_largest"),
        (F.col("n_out") / F.col("n_in")).alias("retention"),
    )
    keep = labels.join(top.select("cloud_id", "label"), ["cloud_id", "label"], "left_semi")
    keep = keep.select("cloud_id", F.col("v").alias("point_id"))
    return points.join(keep, ["cloud_id", "point_id"], "left_semi"), stats


def edge_list(matrix: DataFrame) -> DataFrame:
    """Upper triangle of the relation table: an edge exists when anything agrees or disagrees.

    The cost of giving both ends the same bit is b, of giving them different bits a.
    """
    e = matrix.where((F.col("i") < F.col("j")) & ((F.col("a") > 0) | (F.col("b") > 0)))
    return e.withColumn("cost_same", F.col("b")).withColumn("cost_different", F.col("a"))


def normalized_edges(edges: DataFrame) -> DataFrame:
    """a/(a+b) and b/(a+b); pairs without overlap stay as they are."""
    total = F.col("a") + F.col("b")
    share = {c: F.when(total != 0, F.col(c) / total).otherwise(F.col(c)) for c in ("a", "b")}
    return edges.withColumns(share)


def scored_edges(scores: DataFrame, keys: list[str] = ("cloud_id",)) -> DataFrame:
    """Directed pair scores (src, dst, logit) to one relation per pair; the score of the later source wins."""
    keys = list(keys)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("logit")))
    s = scores.select(
        *keys, F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"), F.col("src"), p.alias("_p")
    )
    return s.groupBy(*keys, "i", "j").agg(F.max_by("_p", "src").alias("a")).withColumn("b", F.lit(1.0) - F.col("a"))


def hybrid_edges(scored: DataFrame, geometric: DataFrame, w_scored: float = 0.7, w_geometric: float = 0.3,
                 keys: list[str] = ("cloud_id",)) -> DataFrame:
    """Weighted sum of two relation tables; a side without the pair counts as zero."""
    on = [*keys, "i", "j"]
    s = scored.select(*on, F.col("a").alias("_sa"), F.col("b").alias("_sb"))
    g = geometric.select(*on, F.col("a").alias("_ga"), F.col("b").alias("_gb"))
    zero = F.lit(0.0)
    mix = {
        c: F.lit(w_scored) * F.coalesce(f"_s{c}", zero) + F.lit(w_geometric) * F.coalesce(f"_g{c}", zero)
        for c in ("a", "b")
    }
    return s.join(g, on, "full_outer").withColumns(mix).select(*on, "a", "b")


def consistency_relation(mode: str, scored: DataFrame | None, geometric: DataFrame, **weights) -> DataFrame:
    """Relation table of the chosen mode; without scores every mode falls back to the geometric one."""
    if scored is None or mode == "geometric":
        return geometric
    if mode == "edgenet":
        return scored
    if mode == "hybrid":
        return hybrid_edges(scored, geometric, **weights)
    return geometric


def random_weight(seed: Column | int) -> Column:
    """Reproducible independent edge weights; a maximum spanning forest under them is a random one."""
    s = F.lit(seed) if isinstance(seed, int) else seed
    return F.xxhash64(s, F.col("i"), F.col("j")).cast("double")


def confidence_weight() -> Column:
    return F.abs(F.col("a") - F.col("b")).cast("double")


def forest_small(g: dict) -> dict:
    """Best edges first; every vertex keeps its tree (the smallest vertex in it) and its parity to that root."""
    real = g["i"] != g["j"]
    ids, ends = np.unique(np.concatenate([g["i"], g["j"]]), return_inverse=True)
    order = np.lexsort((g["j"], g["i"], -g["_w"]))
    order = order[real[order]]
    a, b, differ = ends[: len(real)][order], ends[len(real) :][order], g["differ"][order]
    n, m = len(ids), len(order)
    root, parity, taken = np.arange(n), np.zeros(n, dtype="int64"), np.zeros(m, dtype=bool)
    left = np.arange(m)
    # Every tree takes its best edge to another one, all trees at once; which edges are best has one answer, whatever the way.
    while True:
        ra, rb = root[a[left]], root[b[left]]
        apart = ra != rb
        left, ra, rb = left[apart], ra[apart], rb[apart]
        if not len(left):
            break
        best = np.full((2, n), m)
        best[0, ra[::-1]], best[1, rb[::-1]] = left[::-1], left[::-1]  # the last one written is the best
        best = best.min(axis=0)
        trees = np.flatnonzero(best < m)
        e = best[trees]
        taken[e] = True
        up, turn = np.arange(n), np.zeros(n, dtype="int64")
        up[trees] = root[a[e]] + root[b[e]] - trees
        turn[trees] = parity[a[e]] ^ parity[b[e]] ^ differ[e]
        top = trees[(up[up[trees]] == trees) & (trees < up[trees])]  # two trees that took the same edge
        up[top], turn[top] = top, 0
        while (up != up[up]).any():
            turn, up = turn ^ turn[up], up[up]
        parity, root = parity ^ turn[root], up[root]
    first = np.arange(n)
    first[root[::-1]] = np.arange(n)[::-1]
    root = first[root]
    parity = parity ^ parity[root]
    t = order[taken]
    return {
        "is_edge": np.concatenate([np.zeros(n), np.ones(len(t))]).astype("int32"),
        "v": np.concatenate([ids, g["i"][t]]), "w": np.concatenate([ids[root], g["j"][t]]),
        "bit": np.concatenate([parity, g["differ"][t]]),
    }


def spanning_forest(vertices: DataFrame, edges: DataFrame, keys: list[str], weight: Column,
                    limit: int = SMALL_GRAPH_ROWS) -> tuple[DataFrame, DataFrame]:
    """Maximum spanning forest by rounds of best outgoing edges.

    Returns the forest edges (keys, i, j, differ) and per vertex (keys, v, root, parity): the tree it belongs
    to and whether its bit differs from the root's along the tree, where an edge asks its ends to differ when
    b > a. Of edges with equal weight the one with the smaller ids counts as better.
    """
    keys = list(keys)
    id_type = dict(edges.dtypes)["i"]
    e = edges.where(F.col("i") < F.col("j")).select(
        *keys, "i", "j", weight.alias("_w"), as_flag(F.col("b") > F.col("a")).alias("differ")
    )
    loops = vertices.select(*keys, F.col("v").alias("i"), F.col("v").alias("j"), F.lit(0.0).alias("_w"),
                            F.lit(0).cast("long").alias("differ"))
    rows = cut(e.unionByName(loops))
    small, big = _split(rows, keys, limit)
    schema = typed(rows, keys) + f", is_edge int, v {id_type}, w {id_type}, bit long"
    solved = cut(map_groups(small, keys, forest_small, schema))
    forest = solved.where("is_edge = 1").select(*keys, F.col("v").alias("i"), F.col("w").alias("j"), F.col("bit").alias("differ"))
    state = solved.where("is_edge = 0").select(*keys, "v", F.col("w").alias("root"), F.col("bit").alias("parity"))
    if big is None:
        return forest, state
    huge = rows.join(big, keys, "left_semi")
    v = huge.where(F.col("i") == F.col("j")).select(*keys, F.col("i").alias("v")).distinct()
    f2, s2 = _forest_rounds(v, cut(huge.where(F.col("i") < F.col("j"))), keys)
    return forest.unionByName(f2), state.unionByName(s2)


def _forest_rounds(vertices: DataFrame, e: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Forest by rounds of best outgoing edges. Every round at least halves the number of trees, and parities
    are carried along, so deep trees need no walk from the root."""
    state = cut(vertices.select(*keys, "v", F.col("v").alias("root"), F.lit(0).cast("long").alias("parity")))
    forest = e.select(*keys, "i", "j", "differ").limit(0)
    while True:
        si = state.select(*keys, F.col("v").alias("i"), F.col("root").alias("_ri"), F.col("parity").alias("_pi"))
        sj = state.select(*keys, F.col("v").alias("j"), F.col("root").alias("_rj"), F.col("parity").alias("_pj"))
        cross = (
            e.join(si, keys + ["i"]).join(sj, keys + ["j"]).where(F.col("_ri") != F.col("_rj"))
            .withColumn("_x", F.col("_pi").bitwiseXOR(F.col("_pj")).bitwiseXOR(F.col("differ")))
        )
        both = cross.select(
            *keys, F.inline(F.array(
                *[F.struct(F.col(a).alias("root"), F.col(b).alias("up"), F.col("_w").alias("w"), F.col("i"),
                           F.col("j"), F.col("_x").alias("x"), F.col("differ"))
                  for a, b in (("_ri", "_rj"), ("_rj", "_ri"))]
            )),
        )
        # Unique order of edges (weight, then smaller ids first), so that best edges never form longer cycles.
        best = both.groupBy(*keys, "root").agg(
            F.max_by(F.struct("up", "i", "j", "x", "differ"), F.struct("w", -F.col("i"), -F.col("j"))).alias("m")
        )
        best = cut(best.select(*keys, "root", "m.*"))
        if is_empty(best):
            return forest, state
        forest = cut(forest.unionByName(best.select(*keys, "i", "j", "differ").distinct()))
        mate = best.select(*keys, F.col("root").alias("up"), F.col("up").alias("_back"))
        top = (F.col("_back") == F.col("root")) & (F.col("root") < F.col("up"))
        links = best.join(mate, keys + ["up"], "left").select(
            *keys, "root", F.when(top, F.col("root")).otherwise(F.col("up")).alias("up"),
            F.when(top, F.lit(0)).otherwise(F.col("x")).cast("long").alias("x"),
        )
        links = _shortcut(cut(links), keys)
        state = cut(
            state.join(links, keys + ["root"], "left").select(
                *keys, "v", F.coalesce("up", "root").alias("root"),
                F.col("parity").bitwiseXOR(F.coalesce("x", F.lit(0).cast("long"))).alias("parity"),
            )
        )


def _shortcut(links: DataFrame, keys: list[str]) -> DataFrame:
    """Follow parent links to the top by doubling, combining parities on the way."""
    held = None
    while True:
        up = links.select(*keys, F.col("root").alias("up"), F.col("up").alias("_up2"), F.col("x").alias("_x2"))
        nxt = staged(
            links.join(up, keys + ["up"], "left").select(
                *keys, "root", F.coalesce("_up2", "up").alias("_new"), F.col("up").alias("_old"),
                F.when(F.col("up") == F.col("root"), F.col("x"))
                .otherwise(F.col("x").bitwiseXOR(F.coalesce("_x2", F.lit(0).cast("long")))).alias("x"),
            )
        )
        if held is not None:
            discard(held)
        held, links = nxt, nxt.select(*keys, "root", F.col("_new").alias("up"), "x")
        if is_empty(nxt.where(F.col("_new") != F.col("_old"))):
            links = cut(links)
            discard(held)
            return links


def _suffix_sums(arcs: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of ``s`` from each arc (p, v) to the end of its list, whose next arc is (np, nv), by doubling the links.

    Arcs of lists that do not end are left out.
    """
    arcs, before = staged(arcs), None
    while True:
        left = arcs.where(F.col("np").isNotNull()).count()
        if left == 0 or left == before:
            ended = cut(arcs.where(F.col("np").isNull()).select(*keys, "p", "v", "s"))
            discard(arcs)
            return ended
        before, last = left, arcs
        ahead = last.select(*keys, F.col("p").alias("np"), F.col("v").alias("nv"), F.col("np").alias("_p"), F.col("nv").alias("_v"), F.col("s").alias("_s"))
        moved = last.where(F.col("np").isNotNull()).join(ahead, [*keys, "np", "nv"], "left").select(
            *keys, "p", "v", F.col("_p").alias("np"), F.col("_v").alias("nv"), (F.col("s") + F.coalesce("_s", F.lit(0))).alias("s")
        )
        arcs = staged(moved.unionByName(last.where(F.col("np").isNull())))
        discard(last)


def rooted_tree(tree_edges: DataFrame, roots: DataFrame, keys: list[str] = ("cloud_id",)) -> DataFrame:
    """(keys, v, parent, level) of forests given by undirected edges (i, j) and root vertices (v).

    Each tree is walked along every edge in both directions; places on the walk follow by doubling links, in rounds that
    grow with the logarithm of the tree's size, whatever its depth. An edge leads down where it is walked first.
    """
    keys = list(keys)
    fwd = tree_edges.select(*keys, F.col("i").alias("p"), F.col("j").alias("v"))
    both = fwd.unionByName(tree_edges.select(*keys, F.col("j").alias("p"), F.col("i").alias("v")))
    around = Window.partitionBy(*keys, "v").orderBy("p")
    follow = F.lead("p").over(around)
    smallest = F.min("p").over(Window.partitionBy(*keys, "v"))
    start = roots.select(*keys, "v", F.lit(True).alias("_root"))
    walk = both.withColumn("_next", follow).withColumn("_first", smallest).join(start, [*keys, "v"], "left")
    ends = F.col("_next").isNull() & F.col("_root").isNotNull()
    walk = cut(walk.select(
        *keys, "p", "v", F.when(~ends, F.col("v")).alias("np"), F.when(~ends, F.coalesce("_next", "_first")).alias("nv"),
        F.lit(1).cast("long").alias("s"),
    ))
    place = _suffix_sums(walk, keys)
    back = place.select(*keys, F.col("v").alias("p"), F.col("p").alias("v"), F.col("s").alias("_back"))
    way = F.when(F.col("_s") > F.col("_back"), F.lit(1)).otherwise(F.lit(-1)).cast("long")
    place = place.withColumnRenamed("s", "_s").join(back, [*keys, "p", "v"]).select(*keys, "p", "v", way.alias("_way"))
    steps = walk.drop("s").join(place, [*keys, "p", "v"]).withColumnRenamed("_way", "s")
    depth = _suffix_sums(steps, keys).join(place.where(F.col("_way") == 1), [*keys, "p", "v"])
    down = depth.select(*keys, "v", F.col("p").alias("parent"), (1 - F.col("s")).alias("level"))
    none = F.lit(None).cast(dict(down.dtypes)["parent"])
    return roots.select(*keys, "v", none.alias("parent"), F.lit(0).cast("long").alias("level")).unionByName(down)


def graph_vertices(edges: DataFrame, keys: list[str]) -> DataFrame:
    i = edges.select(*keys, F.col("i").alias("v"))
    return i.unionByName(edges.select(*keys, F.col("j").alias("v"))).distinct()


def patch_components(vertices: DataFrame, edges: DataFrame, keys: list[str] = ("cloud_id",)) -> DataFrame:
    """Undirected components of the patch graph; a pair counts only when it is listed in both directions."""
    keys = list(keys)
    e = edges.where((F.col("a") > 0) | (F.col("b") > 0)).select(*keys, F.col("i").alias("src"), F.col("j").alias("dst"))
    back = e.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach_labels(vertices, e.join(back, keys + ["src", "dst"], "left_semi"), keys)


def edges_with_enough_nodes(edges: DataFrame, patches: DataFrame, k: int) -> DataFrame:
    """Edges of clouds that have at least k patches."""
    ok = group_sizes(patches, ["cloud_id"]).where(F.col("n") >= k).select("cloud_id")
    return edges.join(ok, "cloud_id", "left_semi")


def overlap_filter(edges: DataFrame, min_overlap: int = 10, threshold: float = 0.6) -> DataFrame:
    """Edges with enough shared points whose dominant relation is clear enough."""
    total = F.col("a") + F.col("b")
    return edges.where((total >= min_overlap) & (F.greatest("a", "b") / total >= threshold))


