"""End-to-end orientation of a batch of clouds: patches, normals, patch graph, flips, merge, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from pointlake.functions.geometry import NORMAL, TRUTH, XYZ
from pointlake.operators import metrics, normals, orient, patches
from pointlake.operators.graph import consistency_relation, normalized_edges
from pointlake.session import cut


@dataclass
class Orientation:
    """Tables of one run; all of them cover every cloud of the batch."""

    members: DataFrame  # cloud_id, patch_id, point_id, position, normal before the patch flip
    edges: DataFrame  # cloud_id, i, j, a, b (normalised)
    flips: DataFrame  # cloud_id, patch_id, flip
    normals: DataFrame  # cloud_id, point_id, oriented normal


def orient_clouds(points: DataFrame, method: str = "grid", k: int = 10, inside: str = "forest", inside_k: int = 6,
                  scorer: normals.Scorer | None = None, refine_rounds: int = 1,
                  solver: str = "vote", relation: str = "geometric", scored: DataFrame | None = None,
                  merge: str = "smallest", solver_options: dict | None = None, **patch_options) -> Orientation:
    """Orient all clouds of ``points(cloud_id, point_id, x, y, z)`` in one set of jobs, keyed by cloud.

    Normals are estimated once per point. Inside each patch signs are made to agree along a forest of neighbour
    links (``inside='forest'``), or by ``refine_rounds`` of a scorer (``'score'``: the built-in one or a plugged-in
    ``scorer``), or left as they are (``'none'``). Then one bit per patch is chosen to make patches agree.
    """
    p = points.select("cloud_id", F.col("point_id").cast("long").alias("point_id"), *XYZ)
    types = dict(p.dtypes)
    base = normals.pca_normals(p, k, positions=True).where(F.col("cloud_id").isNotNull() & F.col("point_id").isNotNull())
    base = cut(base.select("cloud_id", "point_id", *[F.col(c).cast(types[c]).alias(c) for c in XYZ], *NORMAL))
    membership = patches.extract_patches(base, method, **patch_options).select("cloud_id", "patch_id", "point_id")
    membership = patches.drop_small(membership.distinct(), ["cloud_id", "patch_id"], 2)
    members = cut(membership.join(base, ["cloud_id", "point_id"]))
    patch = ["cloud_id", "patch_id"]
    if inside == "forest":
        members = cut(orient.agree_inside(members, inside_k, patch, positions=True).drop("root"))
    elif inside == "score":
        scorer = scorer or normals.neighbour_scorer(members, inside_k, patch)
        members = normals.refine_flips(members, scorer, refine_rounds, patch)
    elif inside != "none":
        raise ValueError(f"unknown way to agree inside patches: {inside}")
    edges = consistency_relation(relation, scored, orient.overlap_relation(members))
    edges = cut(normalized_edges(edges))
    flips = cut(orient.solve_flips(solver, edges, members, **(solver_options or {})))
    merged = orient.merge_patches(members, flips, p, merge)
    return Orientation(members, edges, flips, merged)


def report(run: Orientation, truth: DataFrame) -> DataFrame:
    """Per cloud: point, final, upper-bound, flip and edge accuracy, the objective, and the angular errors."""
    keys = ["cloud_id"]
    t = truth.select("cloud_id", "point_id", *TRUTH)
    members = cut(run.members.select("cloud_id", "patch_id", "point_id", *NORMAL).join(t, ["cloud_id", "point_id"]))
    true_flips = cut(orient.majority_flips(members))
    final = cut(run.normals.join(t, ["cloud_id", "point_id"]))
    best = orient.merge_patches(members, true_flips, final).join(t, ["cloud_id", "point_id"])
    sizes = members.groupBy(*keys).agg(F.count_distinct("patch_id").alias("num_patches"))
    parts = [
        final.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_points")),
        sizes,
        metrics.patch_point_accuracy(members)[1],
        metrics.final_accuracy(final),
        metrics.final_accuracy(best).withColumnRenamed("final_accuracy", "overall_gt_flip"),
        metrics.flip_accuracy(run.flips, true_flips),
        metrics.edge_accuracy(run.edges, true_flips),
        orient.objective(run.edges, run.flips).select("cloud_id", F.col("objective").alias("objective_after")),
        orient.objective(run.edges, true_flips).select("cloud_id", F.col("objective").alias("objective_gt")),
        metrics.normal_metrics(final, keys),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, keys, "left")
    return out
