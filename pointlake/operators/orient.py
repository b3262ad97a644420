"""Patch graph relations, flip solvers, and merging patches back to points."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pointlake.functions.geometry import NORMAL, TRUTH, XYZ, as_flag, dot, sigmoid
from pointlake.operators.graph import confidence_weight, forest_small, graph_vertices, random_weight, spanning_forest
from pointlake.operators.grouped import SMALL_GRAPH_ROWS, map_groups, numbered, oversized, typed
from pointlake.operators.knn import knn_graph, nearest_inside, symmetric_adjacency
from pointlake.operators.tiles import group_sizes, ranked
from pointlake.session import cut, discard, is_empty, staged

WEIGHT_BITS = 36  # bits of a weight in the local search, so that sums of many million of them fit 64
HELD_PATCHES = 2_000  # patches whose pooled features a task holds before it hands them on


def overlap_relation(members: DataFrame, adjacency: DataFrame | None = None, normal=NORMAL) -> DataFrame:
    """Per pair of patches i < j the shared points whose normals agree (a) and disagree (b); a right angle counts
    for neither. ``adjacency(cloud_id, i, j)`` limits the pairs.

    The self-join is on the point, whose number of patches is small, so pairs stay proportional to the rows.
    """
    on = ["cloud_id", "point_id"]
    left = members.select(*on, F.col("patch_id").alias("i"), *[F.col(c).alias(f"_l{c}") for c in normal])
    right = members.select(*on, F.col("patch_id").alias("j"), *[F.col(c).alias(f"_r{c}") for c in normal])
    pairs = left.join(right, on).where(F.col("i") < F.col("j"))
    if adjacency is not None:
        pairs = pairs.join(adjacency.select("cloud_id", "i", "j"), ["cloud_id", "i", "j"], "left_semi")
    d = dot([f"_l{c}" for c in normal], [f"_r{c}" for c in normal])
    return pairs.groupBy("cloud_id", "i", "j").agg(
        F.sum(as_flag(d > 0)).cast("double").alias("a"), F.sum(as_flag(d < 0)).cast("double").alias("b")
    )


def two_patch_relation(members: DataFrame, normal=NORMAL) -> DataFrame:
    """The same from the first and the last patch of each point only: one aggregation, no self-join."""
    n = F.struct(*normal)
    per = members.groupBy("cloud_id", "point_id").agg(
        F.min("patch_id").alias("i"), F.max("patch_id").alias("j"),
        F.min_by(n, "patch_id").alias("_p"), F.max_by(n, "patch_id").alias("_q"),
    )
    d = dot([f"_p.{c}" for c in normal], [f"_q.{c}" for c in normal])
    return per.where(F.col("i") < F.col("j")).groupBy("cloud_id", "i", "j").agg(
        F.sum(as_flag(d > 0)).cast("double").alias("a"), F.sum(as_flag(d < 0)).cast("double").alias("b")
    )


def centre_adjacency(centres: DataFrame, k: int = 13) -> DataFrame:
    """Symmetric neighbour pairs of patch centres (cloud_id, patch_id, x, y, z)."""
    return symmetric_adjacency(centre_graph(centres, k))


def centre_graph(centres: DataFrame, k: int) -> DataFrame:
    return knn_graph(centres.select("cloud_id", F.col("patch_id").alias("point_id"), *XYZ), k)


def both_directions(edges: DataFrame) -> DataFrame:
    keys = [c for c in edges.columns if c not in ("i", "j")]
    return edges.select("i", "j", *keys).unionByName(
        edges.select(F.col("j").alias("i"), F.col("i").alias("j"), *keys)
    )


def majority_flips(members: DataFrame, keys: list[str] = ("cloud_id",), normal=NORMAL, truth=TRUTH) -> DataFrame:
    """True flip bit of a patch: more than half of its points against the truth."""
    against = F.sum(as_flag(dot(normal, truth) < 0))
    return members.groupBy(*keys, "patch_id").agg(as_flag(against * 2 > F.count(F.lit(1))).alias("flip"))


_POOLED = "_n bigint, _sx double, _sy double, _sz double, feature array<double>, inv_feature array<double>"


def _pool_batches(keys: list[str], pool):
    """Pooled features of the patches a task meets; a patch leaves the task in one row, or a few if there are many patches."""

    def flush(held: dict) -> pd.DataFrame:
        rows = [(*key, n, *xyz, f, g) for key, (n, xyz, f, g) in held.items()]
        return pd.DataFrame(rows, columns=[*keys, "_n", "_sx", "_sy", "_sz", "feature", "inv_feature"])

    def run(batches):
        held: dict = {}
        for pdf in batches:
            pdf = pdf[pdf["feature"].notna()]
            if not len(pdf):
                continue
            code = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.diff(code[order], prepend=-1))
            sizes = np.diff(np.append(first, len(order)))
            f, g = (pool.reduceat(np.stack(pdf[c].to_numpy())[order], first, axis=0) for c in ("feature", "inv_feature"))
            xyz = np.add.reduceat(pdf[list(XYZ)].to_numpy(np.float64)[order], first, axis=0)
            heads = pdf[keys].iloc[order[first]].itertuples(index=False, name=None)
            for i, key in enumerate(heads):
                n = int(sizes[i])
                if key in held:
                    m, at, u, v = held[key]
                    held[key] = n + m, xyz[i] + at, pool(f[i], u), pool(g[i], v)
                else:
                    held[key] = n, xyz[i], f[i], g[i]
            if len(held) > HELD_PATCHES:
                yield flush(held)
                held = {}
        if held:
            yield flush(held)

    return run


def patch_features(members: DataFrame, pooling: str = "max") -> DataFrame:
    """Pool the point features (arrays) of every patch, with the twin from negated normals, and the mean position.

    Tasks pool whole arrays first, so a patch of any size sends one row per task, and points send none.
    """
    pool = {"max": np.maximum, "mean": np.add}[pooling]
    keys, types = ["cloud_id", "patch_id"], dict(members.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in keys)
    arrays = [F.transform(c, lambda v: v.cast("double")).alias(c) for c in ("feature", "inv_feature")]
    rows = members.select(*keys, *[F.col(c).cast("double").alias(c) for c in XYZ], *arrays)
    pooled = rows.mapInPandas(_pool_batches(keys, pool), f"{head}, {_POOLED}")

    def merge(g: dict) -> dict:
        n = int(g["_n"].sum())
        out = [pool.reduce(np.stack(g[c])) / (n if pooling == "mean" else 1) for c in ("feature", "inv_feature")]
        mean = {f"c{c}": np.array([g[f"_s{c}"].sum() / n]) for c in XYZ}
        cells = {}
        for name, value in zip(("feature", "inv_feature"), out):
            cells[name] = np.empty(1, object)
            cells[name][0] = value
        return {**mean, "n_points": np.array([n]), **cells}

    schema = f"{head}, cx double, cy double, cz double, n_points bigint, feature array<double>, inv_feature array<double>"
    return map_groups(pooled, keys, merge, schema)


def with_labels(edges: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    keys = list(keys)
    li = labels.select(*keys, F.col("patch_id").alias("i"), F.col("flip").alias("_fi"))
    lj = labels.select(*keys, F.col("patch_id").alias("j"), F.col("flip").alias("_fj"))
    return edges.join(li, keys + ["i"]).join(lj, keys + ["j"])


def objective(edges: DataFrame, labels: DataFrame, keys: list[str] = ("cloud_id",)) -> DataFrame:
    """Sum over i < j of a where the bits agree and of b where they differ; total cost over both directions."""
    keys = list(keys)
    same = F.col("_fi") == F.col("_fj")
    e = with_labels(edges.where(F.col("i") < F.col("j")), labels, keys)
    known = e.groupBy(*keys).agg(
        F.sum(F.when(same, F.col("a")).otherwise(F.col("b"))).alias("objective"),
        (F.sum(F.when(same, F.col("b")).otherwise(F.col("a"))) * 2).alias("total_cost"),
    )
    # A cloud without edges has nothing to gain or to pay.
    return labels.select(*keys).distinct().join(known, keys, "left").fillna(0, ["objective", "total_cost"])


def _scale(largest: np.ndarray) -> np.ndarray:
    """Power of two that takes weights up to the largest to whole numbers of WEIGHT_BITS bits; counts stay exact."""
    return np.ldexp(1.0, WEIGHT_BITS - np.frexp(np.maximum(largest, 1e-300))[1])


def _scaled(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The edges with a and b as whole multiples of a unit of their graph's own, so that sums do not depend on their order."""
    most = edges.groupBy(*keys).agg(F.max(F.greatest(F.abs("a"), F.abs("b")).cast("double")).alias("_most"))

    def unit(batches):
        for pdf in batches:
            yield pdf.assign(_scale=_scale(pdf["_most"].to_numpy()))

    units = most.mapInPandas(unit, typed(most, [*keys, "_most"]) + ", _scale double").drop("_most")
    rows = edges.join(units, keys)
    return rows.withColumns({c: F.round(F.col(c).cast("double") * F.col("_scale")).cast("long") for c in ("a", "b")}).drop("_scale")


def _solve_small(search: bool) -> Callable[[dict, np.ndarray], dict]:
    """Forest, parities and local search of many graphs, as one graph without links between them; rows with i = j carry the vertices."""

    def work(g: dict, group: np.ndarray) -> dict:
        ends, of = np.append(g["i"], g["j"]), np.append(group, group)
        first, vertex = numbered(of, ends)
        i, j = np.split(vertex, 2)
        state = forest_small({**g, "i": i, "j": j})
        out = {"_group": of[first], "patch_id": ends[first], "flip": state["bit"][: len(first)]}
        if not search:
            return out
        real, own = i != j, np.arange(len(first))
        largest = np.zeros(group[-1] + 1)
        np.maximum.at(largest, group[real], np.maximum(np.abs(g["a"][real]), np.abs(g["b"][real])))
        scale = _scale(largest)[group[real]]
        weights = {c: np.append(np.rint(g[c][real] * scale).astype(np.int64), np.zeros(len(own), np.int64)) for c in ("a", "b")}
        bits = np.append(np.zeros(real.sum(), np.int64), out["flip"])
        out["flip"] = _improve_small({"i": np.append(i[real], own), "j": np.append(j[real], own), **weights, "flip": bits})["flip"]
        return out

    return work


def _improve_small(g: dict) -> dict:
    """The rounds of the local search on one graph; rows with i = j carry the vertices and their bits."""
    own = g["i"] == g["j"]
    ids, pos = np.unique(g["i"][own], return_index=True)
    flip = g["flip"][own][pos].copy()
    i, j = np.searchsorted(ids, g["i"][~own]), np.searchsorted(ids, g["j"][~own])
    delta = g["b"][~own] - g["a"][~own]
    while True:
        gain = np.zeros(len(ids), np.int64)
        step = np.where(flip[i] == flip[j], delta, -delta)
        np.add.at(gain, i, step)
        np.add.at(gain, j, step)
        up = gain > 0
        if not up.any():
            break
        both = up[i] & up[j]
        p, q = i[both], j[both]
        first = (gain[p] > gain[q]) | ((gain[p] == gain[q]) & (p < q))
        up[np.where(first, q, p)] = False
        flip[up] = 1 - flip[up]
    return {"patch_id": ids, "flip": flip}


def improve_flips(edges: DataFrame, labels: DataFrame, keys: list[str] = ("cloud_id",),
                  limit: int = SMALL_GRAPH_ROWS) -> DataFrame:
    """Parallel local search. A patch flips when that gains and no neighbour gains more; such patches are never
    adjacent, so the objective rises every round until no single flip helps.

    Weights are taken as whole multiples of a power of two that suits the graph's largest, so that sums do not depend on
    their order and the search ends.
    """
    keys = list(keys)
    e = _scaled(edges.where(F.col("i") < F.col("j")).select(*keys, "i", "j", "a", "b"), keys)
    e = e.select(*keys, "i", "j", "a", "b", F.lit(0).cast("long").alias("flip"))
    zero = F.lit(0).cast("long")
    own = labels.select(*keys, F.col("patch_id").alias("i"), F.col("patch_id").alias("j"), zero.alias("a"),
                        zero.alias("b"), F.col("flip").cast("long").alias("flip"))
    rows = cut(e.unionByName(own))
    big = oversized(rows, keys, limit)
    small = rows if big is None else rows.join(big, keys, "left_anti")
    schema = typed(rows, keys) + f", patch_id {dict(rows.dtypes)['i']}, flip long"
    out = map_groups(small, keys, _improve_small, schema)
    if big is None:
        return out
    huge = rows.join(big, keys, "left_semi")
    bits = huge.where(F.col("i") == F.col("j")).select(*keys, F.col("i").alias("patch_id"), "flip")
    return out.unionByName(_improve_rounds(huge.where(F.col("i") < F.col("j")), bits, keys))


def _improve_rounds(edges: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    e = cut(both_directions(edges.where(F.col("i") < F.col("j")).select(*keys, "i", "j", "a", "b")))
    labels = cut(labels.select(*keys, "patch_id", "flip"))
    while True:
        same = F.col("_fi") == F.col("_fj")
        gain = F.sum(F.when(same, F.col("b") - F.col("a")).otherwise(F.col("a") - F.col("b")))
        gains = with_labels(e, labels, keys).groupBy(*keys, F.col("i").alias("patch_id")).agg(gain.alias("_g"))
        gains = staged(gains.where(F.col("_g") > 0))
        if is_empty(gains):
            discard(gains)
            break
        mine = gains.select(*keys, F.col("patch_id").alias("i"), F.struct(F.col("_g"), -F.col("patch_id")).alias("_mi"))
        theirs = gains.select(*keys, F.col("patch_id").alias("j"), F.struct(F.col("_g"), -F.col("patch_id")).alias("_mj"))
        beaten = (
            e.join(mine, keys + ["i"]).join(theirs, keys + ["j"])
            .where(F.col("_mj") > F.col("_mi")).select(*keys, F.col("i").alias("patch_id")).distinct()
        )
        turn = gains.join(beaten, keys + ["patch_id"], "left_anti").select(*keys, "patch_id", F.lit(1).alias("_t"))
        labels = cut(
            labels.join(turn, keys + ["patch_id"], "left")
            .withColumn("flip", F.when(F.col("_t") == 1, 1 - F.col("flip")).otherwise(F.col("flip")))
            .drop("_t")
        )
        discard(gains)
    return labels


def forest_flips(edges: DataFrame, keys: list[str] = ("cloud_id",), weight: Column | None = None,
                 local_search: bool = True, limit: int = SMALL_GRAPH_ROWS) -> DataFrame:
    """Flip bits from a spanning forest (a child follows its parent where a >= b and turns where b > a), then
    improved by local search on all edges.

    Graphs within ``limit`` rows are solved whole in one grouped call, the others by rounds of joins with the same result.
    """
    keys = list(keys)
    weight = confidence_weight() if weight is None else weight
    e = edges.where(((F.col("a") > 0) | (F.col("b") > 0)) & (F.col("i") < F.col("j"))).select(
        *keys, "i", "j", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"), weight.alias("_w"),
        as_flag(F.col("b") > F.col("a")).alias("differ"),
    )
    zero = F.lit(0.0)
    own = graph_vertices(edges, keys).select(
        *keys, F.col("v").alias("i"), F.col("v").alias("j"), zero.alias("a"), zero.alias("b"), zero.alias("_w"), F.lit(0).cast("long").alias("differ")
    )
    rows = e.unionByName(own)
    big = oversized(rows, keys, limit)
    small = rows if big is None else rows.join(big, keys, "left_anti")
    labels = map_groups(small, keys, _solve_small(local_search), typed(rows, keys) + f", patch_id {dict(rows.dtypes)['i']}, flip bigint", many=True)
    if big is None:
        return labels
    huge = edges.join(big, keys, "left_semi")
    _, state = spanning_forest(graph_vertices(huge, keys), huge.where((F.col("a") > 0) | (F.col("b") > 0)), keys, weight, limit)
    found = state.select(*keys, F.col("v").alias("patch_id"), F.col("parity").alias("flip"))
    return labels.unionByName(improve_flips(huge, found, keys, limit) if local_search else found)


def vote_labels(runs: DataFrame, keys: list[str] = ("cloud_id",)) -> DataFrame:
    """Combine runs (keys, seed, patch_id, flip): every run is turned to agree with run 0 on most patches, then a
    strict majority of the runs decides; a tie means no flip."""
    keys = list(keys)
    base = runs.where(F.col("seed") == 0).select(*keys, "patch_id", F.col("flip").alias("_base"))
    agree = F.sum(F.when(F.col("flip") == F.col("_base"), 1).otherwise(-1))
    turn = runs.join(base, keys + ["patch_id"]).groupBy(*keys, "seed").agg((agree < 0).cast("long").alias("_turn"))
    aligned = runs.join(turn, keys + ["seed"]).withColumn("flip", F.col("flip").bitwiseXOR(F.col("_turn")))
    return aligned.groupBy(*keys, "patch_id").agg(
        as_flag(F.sum("flip") * 2 > F.count(F.lit(1))).alias("flip")
    )


def vote_flips(edges: DataFrame, runs: int = 5, keys: list[str] = ("cloud_id",), local_search: bool = True) -> DataFrame:
    """Majority of ``runs`` random forests; all runs are solved in the same jobs, the seed being one more key."""
    keys = list(keys)
    seeded = edges.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    labels = forest_flips(seeded, keys + ["seed"], random_weight(F.col("seed")), local_search)
    return vote_labels(labels, keys)


def random_flips(patches: DataFrame, seed: int = 42, keys: list[str] = ("cloud_id",)) -> DataFrame:
    """Baseline: reproducible coin per patch, the lowest bit of an md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("patch_id").cast("string"))
    bit = F.conv(F.substring(F.md5(text), 1, 1), 16, 10).cast("long") % 2
    return patches.select(*keys, "patch_id").distinct().withColumn("flip", bit)


SOLVERS: dict[str, Callable[..., DataFrame]] = {"forest": forest_flips, "vote": vote_flips}


def solve_flips(method: str, edges: DataFrame, patches: DataFrame, keys: list[str] = ("cloud_id",), **options) -> DataFrame:
    """Flip solver by name; patches without any edge keep bit 0."""
    keys = list(keys)
    if method == "random":
        return random_flips(patches, keys=keys, **options)
    if method not in SOLVERS:
        raise ValueError(f"unknown flip solver {method}")
    solved = SOLVERS[method](edges, keys=keys, **options)
    every = patches.select(*keys, "patch_id").distinct()
    return every.join(solved, keys + ["patch_id"], "left").withColumn(
        "flip", F.coalesce("flip", F.lit(0).cast("long"))
    )


def iterate_patch_flips(patches: DataFrame, scorer: Callable[[DataFrame], DataFrame], rounds: int,
                        keys: list[str] = ("cloud_id",)) -> DataFrame:
    """T rounds of scoring the feature variant of the current state; the predicted flips are XORed in.

    ``scorer`` takes (keys, patch_id, x, y, z, feature) and returns (keys, patch_id, logit).
    """
    on = list(keys) + ["patch_id"]
    state = patches.withColumn("flip", F.lit(0).cast("long"))
    for _ in range(rounds):
        now = F.when(F.col("flip") == 1, F.col("inv_feature")).otherwise(F.col("feature"))
        scores = scorer(state.select(*on, *XYZ, now.alias("feature"))).select(*on, F.col("logit").alias("_z"))
        state = cut(
            state.join(scores, on)
            .withColumn("flip", F.col("flip").bitwiseXOR(as_flag(sigmoid(F.col("_z")) > 0.5)))
            .drop("_z")
        )
    return state.select(*on, "flip")


def linear_scorer(weights: list[float], bias: float = 0.0) -> Callable[[DataFrame], DataFrame]:
    """Patch scorer from a weight per feature position, as one array expression."""

    def score(df: DataFrame) -> DataFrame:
        w = F.array(*[F.lit(float(v)) for v in weights])
        z = F.aggregate(F.zip_with("feature", w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        return df.withColumn("logit", z + F.lit(bias))

    return score


def edge_samples(patches: DataFrame, k: int, with_inverse: bool = True) -> DataFrame:
    """Training pairs of neighbouring patches (cloud_id, patch_id, x, y, z, feature, inv_feature, gt_flip).

    Four sign variants per directed edge, labelled by whether the ends differ; one variant without inverse
    features. Clouds with fewer than k patches give no samples.
    """
    ok = group_sizes(patches, ["cloud_id"]).where(F.col("n") >= k).select("cloud_id")
    p = patches.join(ok, "cloud_id", "left_semi")
    # Learning and scoring read the samples several times; neighbours are searched once.
    graph = staged(centre_graph(p, k).select("cloud_id", F.col("src").alias("i"), F.col("dst").alias("j")))
    cols = ["feature", *(["inv_feature"] if with_inverse else []), *XYZ, "gt_flip"]
    pi = p.select("cloud_id", F.col("patch_id").alias("i"), *[F.col(c).alias(f"_a_{c}") for c in cols])
    pj = p.select("cloud_id", F.col("patch_id").alias("j"), *[F.col(c).alias(f"_b_{c}") for c in cols])
    e = graph.join(pi, ["cloud_id", "i"]).join(pj, ["cloud_id", "j"])
    variants = [(0, 0), (0, 1), (1, 0), (1, 1)] if with_inverse else [(0, 0)]

    def side(end: str, negated: int) -> Column:
        return F.col(f"_{end}_inv_feature" if negated else f"_{end}_feature")

    rows = F.array(*[
        F.struct(
            F.lit(v).cast("long").alias("variant"), side("a", na).alias("fa"), side("b", nb).alias("fb"),
            F.col("_a_gt_flip").bitwiseXOR(F.col("_b_gt_flip")).bitwiseXOR(F.lit(na ^ nb).cast("long")).alias("label"),
        )
        for v, (na, nb) in enumerate(variants)
    ])
    return e.select(
        "cloud_id", "i", "j", *[(F.col(f"_a_{c}") - F.col(f"_b_{c}")).alias(f"d{c}") for c in XYZ], F.inline(rows)
    )


def merge_patches(members: DataFrame, flips: DataFrame, points: DataFrame | None = None, mode: str = "smallest",
                  confidence: str | None = None) -> DataFrame:
    """One normal per point from its covering patches, after the patch flips.

    ``smallest``: the smallest covering patch decides, of equal ones the later id. ``vote``: sign of the
    (confidence-weighted) majority against the smallest patch's normal. Points of ``points`` in no patch
    get (0, 0, 0).
    """
    patch = ["cloud_id", "patch_id"]
    sizes = group_sizes(members, patch, "_n")
    sign = F.when(F.col("flip") == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    extra = [confidence] if confidence else []
    m = members.select(*patch, "point_id", *NORMAL, *extra).join(sizes.join(flips, patch), patch)
    m = m.withColumns({c: sign * F.col(c) for c in NORMAL})
    best = F.max_by(F.struct(*NORMAL), F.struct(-F.col("_n"), F.col("patch_id")))
    if mode == "smallest":
        out = m.groupBy("cloud_id", "point_id").agg(best.alias("_b")).select("cloud_id", "point_id", "_b.*")
    elif mode == "vote":
        ref = m.groupBy("cloud_id", "point_id").agg(best.alias("_b"))
        weight = F.col(confidence) if confidence else F.lit(1.0)
        d = dot(NORMAL, [f"_b.{c}" for c in NORMAL])
        v = m.join(ref, ["cloud_id", "point_id"]).groupBy("cloud_id", "point_id").agg(
            F.first("_b").alias("_b"), F.sum(F.signum(d) * weight).alias("_v")
        )
        out = v.select("cloud_id", "point_id",
                       *[F.when(F.col("_v") < 0, -F.col(f"_b.{c}")).otherwise(F.col(f"_b.{c}")).alias(c) for c in NORMAL])
    else:
        raise ValueError(f"unknown merge mode {mode}")
    if points is None:
        return out
    every = points.select("cloud_id", "point_id").join(out, ["cloud_id", "point_id"], "left")
    return every.select("cloud_id", "point_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in NORMAL])


def patch_order(members: DataFrame) -> DataFrame:
    """Patches by size, largest first, of equal size by id: (cloud_id, patch_id, n, rank)."""
    sizes = group_sizes(members, ["cloud_id", "patch_id"]).withColumn("_neg", -F.col("n"))
    return ranked(sizes, ["cloud_id"], ["_neg", "patch_id"], ["_neg", "patch_id"], "rank").drop("_neg")


def largest_patches(members: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` largest patches of each cloud (a report)."""
    sizes = group_sizes(members, ["cloud_id", "patch_id"])
    w = Window.partitionBy("cloud_id").orderBy(F.desc("n"), "patch_id")
    return sizes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def propagate_signs(normals: DataFrame, links: DataFrame, keys: list[str] = ("cloud_id",)) -> DataFrame:
    """Make signs agree along a minimum spanning forest of neighbour links, a link weighing 1 - |dot|.

    ``normals``: keys, point_id, nx, ny, nz; ``links``: keys, src, dst. Returns the normals and ``root``, the
    tree of each point.
    """
    keys = list(keys)
    n = normals.select(*keys, "point_id", *NORMAL)
    pairs = links.select(*keys, F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).distinct()
    ni = n.select(*keys, F.col("point_id").alias("i"), *[F.col(c).alias(f"_l{c}") for c in NORMAL])
    nj = n.select(*keys, F.col("point_id").alias("j"), *[F.col(c).alias(f"_r{c}") for c in NORMAL])
    d = dot([f"_l{c}" for c in NORMAL], [f"_r{c}" for c in NORMAL])
    e = pairs.join(ni, keys + ["i"]).join(nj, keys + ["j"]).select(
        *keys, "i", "j", F.greatest(d, F.lit(0.0)).alias("a"), F.greatest(-d, F.lit(0.0)).alias("b"), F.abs(d).alias("w")
    )
    _, state = spanning_forest(n.select(*keys, F.col("point_id").alias("v")), e, keys, F.col("w"))
    s = state.select(*keys, F.col("v").alias("point_id"), "parity", "root")
    sign = F.when(F.col("parity") == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    return n.join(s, keys + ["point_id"]).select(*keys, "point_id", *[(sign * F.col(c)).alias(c) for c in NORMAL], "root")


def _signs_small(k: int) -> Callable[[dict, np.ndarray], dict]:
    """Neighbours, forest and signs of many groups of points: one forest over all, whose trees stay inside their groups."""

    def work(g: dict, group: np.ndarray) -> dict:
        xyz, n, ids = np.stack([g[c] for c in XYZ], axis=1), np.stack([g[c] for c in NORMAL], axis=1), g["point_id"]
        first, vertex = numbered(group, ids)
        rows, cols, _, _ = nearest_inside(xyz, ids, group, k)
        ends = vertex[rows], vertex[cols]
        lo, hi = np.divmod(np.unique(np.minimum(*ends) * len(first) + np.maximum(*ends)), len(first))
        left, right = n[first[lo]], n[first[hi]]
        d = left[:, 0] * right[:, 0] + left[:, 1] * right[:, 1] + left[:, 2] * right[:, 2]
        own = np.arange(len(first))
        state = forest_small({
            "i": np.append(lo, own), "j": np.append(hi, own), "_w": np.append(np.abs(d), np.zeros(len(own))),
            "differ": np.append((d < 0).astype(np.int64), np.zeros(len(own), np.int64)),
        })
        bit, root = state["bit"][: len(own)], state["w"][: len(own)]
        sign = np.where(bit[vertex] == 1, -1.0, 1.0)
        return {"_group": group, "point_id": ids, **{c: g[c] for c in XYZ}, **{c: sign * g[c] for c in NORMAL}, "root": ids[first[root[vertex]]]}

    return work


def agree_inside(points: DataFrame, k: int, keys: list[str] = ("cloud_id",), limit: int = SMALL_GRAPH_ROWS // 10, positions: bool = False) -> DataFrame:
    """``propagate_signs`` over the k-nearest-neighbour graph of each group's points (keys, point_id, position, normal).

    Groups within ``limit`` points are solved whole, many in one grouped call: neighbours, forest and signs; larger ones by
    joins. ``positions`` adds x, y, z, which saves a join back to the points.
    """
    keys = list(keys)
    rows = points.select(*keys, "point_id", *[F.col(c).cast("double").alias(c) for c in (*XYZ, *NORMAL)])
    big = oversized(rows, keys, limit)
    small = rows if big is None else rows.join(big, keys, "left_anti")
    kind = dict(rows.dtypes)["point_id"]
    fields = ", ".join(f"{c} double" for c in (*XYZ, *NORMAL))
    schema = typed(rows, keys) + f", point_id {kind}, {fields}, root {kind}"
    out = [*keys, "point_id", *(XYZ if positions else ()), *NORMAL, "root"]
    found = map_groups(small, keys, _signs_small(k), schema, many=True).select(*out)
    if big is None:
        return found
    huge = rows.join(big, keys, "left_semi")
    signed = propagate_signs(huge, knn_graph(huge, k, keys), keys)
    if positions:
        signed = signed.join(huge.select(*keys, "point_id", *XYZ), [*keys, "point_id"])
    return found.unionByName(signed.select(*out))


def tangent_plane_orientation(points: DataFrame, k: int = 10, radius: float = 0.1) -> DataFrame:
    """Estimate normals and orient them along the forest of the neighbours within ``radius``."""
    from pointlake.operators.knn import hybrid_neighbours
    from pointlake.operators.normals import pca_normals

    n = cut(pca_normals(points, k).select("cloud_id", "point_id", *NORMAL))
    return propagate_signs(n, hybrid_neighbours(points, k, radius))
