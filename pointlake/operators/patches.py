"""Patch extraction: from points to a long membership table (cloud_id, patch_id, point_id).

A cloud of any size is a set of rows; no operator here needs a whole cloud, or a whole patch, in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from pointlake.functions.geometry import XYZ
from pointlake.operators.graph import components
from pointlake.operators.grouped import SMALL_GRAPH_ROWS, map_groups
from pointlake.operators.knn import knn_graph, knn_join, nearest_many
from pointlake.operators.sampling import cloud_bounds, farthest_points, nearest_centres
from pointlake.operators.tiles import group_sizes, nth_values, ranked
from pointlake.session import cut, is_empty

WINDOW_CELLS = 4
TASK_NEIGHBOURS = 4096  # neighbours of one seed that a task searches


def overlap_count(rate: float) -> int:
    """How many nearest centres a point joins so that patches overlap by ``rate``."""
    return 1 if rate <= 0 else max(2, round(1.0 / (1.0 - rate)))


def per_cloud(points: DataFrame, value: int | Column) -> DataFrame:
    """(cloud_id, _limit): a number, or an expression over the cloud's own size ``_n``, for each cloud."""
    value = value if isinstance(value, Column) else F.lit(value)
    return group_sizes(points, ["cloud_id"], "_n").select("cloud_id", value.cast("long").alias("_limit"))


def patches_around_centres(points: DataFrame, centres: DataFrame, m: int) -> DataFrame:
    near = nearest_centres(points, centres, m)
    return near.select("cloud_id", F.col("center").alias("patch_id"), "point_id")


def fps_patches(points: DataFrame, patch_count: int | Column, overlap_rate: float = 0.0) -> DataFrame:
    """Every point joins the patches of its nearest farthest-point centres."""
    return patches_around_centres(points, farthest_points(points, patch_count), overlap_count(overlap_rate))


def knn_patches(points: DataFrame, patch_count: int | Column, num_per_patch: int | Column, task_neighbours: int = TASK_NEIGHBOURS) -> DataFrame:
    """The ``num_per_patch`` points nearest to each farthest-point seed, the seed included.

    Every cloud keeps its own number of neighbours. Numbers beyond ``task_neighbours`` are not searched tile by tile but
    selected by counts of distances, so that no task holds them.
    """
    seeds = farthest_points(points, patch_count)
    q = seeds.select("cloud_id", F.col("center").alias("point_id"), *XYZ)
    p = points.select("cloud_id", F.col("point_id").cast("long").alias("point_id"), *XYZ)
    limits = cut(per_cloud(points, num_per_patch))
    narrow, wide = limits.where(F.col("_limit") <= task_neighbours), limits.where(F.col("_limit") > task_neighbours)
    out = None
    most = narrow.agg(F.max("_limit")).first()[0]
    if most is not None:
        mine = narrow.select("cloud_id")
        near = knn_join(q.join(mine, "cloud_id", "left_semi"), p.join(mine, "cloud_id", "left_semi"), max(most, 1))
        out = near.join(narrow, "cloud_id").where(F.col("nn_rank") <= F.col("_limit")).drop("_limit")
    if out is None or not is_empty(wide):
        far = nearest_many(q, p, wide)
        out = far if out is None else out.unionByName(far)
    return out.select(
        "cloud_id", F.col("src").alias("patch_id"), F.col("dst").alias("point_id"), F.col("nn_rank").alias("rank")
    )


def grid_geometry(points: DataFrame, num_per_patch: int | Column) -> DataFrame:
    """Per cloud: origin and cell width, a window of 4 cells holding ``num_per_patch`` points at mean density."""
    b = cloud_bounds(points).withColumn("_n", F.col("n_points"))
    wanted = num_per_patch if isinstance(num_per_patch, Column) else F.lit(num_per_patch)
    volume = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")) * (F.col("max_z") - F.col("min_z"))
    density = F.when(volume > 0, F.col("n_points") / volume).otherwise(F.lit(1.0))
    cell = F.cbrt(wanted.cast("double") / density) / F.lit(float(WINDOW_CELLS))
    return b.select("cloud_id", *[f"min_{c}" for c in XYZ], cell.alias("cell"))


def grid_patches(points: DataFrame, num_per_patch: int | Column, overlap_rate: float = 0.25) -> DataFrame:
    """Overlapping windows of a grid. A point lists the windows that cover it, so nothing is joined but the
    per-cloud geometry; ``patch_id`` packs the three anchors, 21 bits each, in scan order."""
    stride = max(1, int(WINDOW_CELLS * (1 - overlap_rate)))
    p = points.select("cloud_id", "point_id", *XYZ).join(grid_geometry(points, num_per_patch), "cloud_id")

    def anchors(c: str) -> Column:
        g = ((F.col(c) - F.col(f"min_{c}")) / F.col("cell")).cast("long")
        first = F.greatest(F.lit(0).cast("long"), F.ceil((g - (WINDOW_CELLS - 1)) / F.lit(float(stride))))
        last = F.floor(g / F.lit(float(stride)))
        return F.sequence(first * stride, last * stride, F.lit(stride).cast("long"))

    for i, c in enumerate(XYZ):
        p = p.withColumn(f"_a{i}", F.explode(anchors(c)))
    for i in range(3):
        wide = F.raise_error(F.lit("grid_patches: more than 2^21 windows along an axis, choose a larger patch size"))
        p = p.withColumn(f"_a{i}", F.when(F.col(f"_a{i}") < 1 << 21, F.col(f"_a{i}")).otherwise(wide.cast("long")))
    packed = F.shiftleft("_a0", 42).bitwiseOR(F.shiftleft("_a1", 21)).bitwiseOR(F.col("_a2"))
    return p.select("cloud_id", packed.alias("patch_id"), "point_id")


def _kd_leaves(g: dict) -> dict:
    """All halvings of one node inside a task."""
    xyz = np.stack([g[c] for c in XYZ], axis=1)
    limit, leaf = int(g["_limit"][0]), np.empty(len(xyz), np.int64)
    todo = [(np.arange(len(xyz)), int(g["_node"][0]))]
    while todo:
        rows, node = todo.pop()
        if len(rows) > limit:
            own = xyz[rows]
            value = own[:, np.argmax(own.var(axis=0, ddof=1))] if len(rows) > 1 else own[:, 0]
            right = value > np.partition(value, len(rows) // 2)[len(rows) // 2]
            if right.any():
                todo += [(rows[~right], 2 * node), (rows[right], 2 * node + 1)]
                continue
        leaf[rows] = node
    return {"patch_id": leaf, "point_id": g["point_id"]}


def kd_patches(points: DataFrame, max_points: int | Column, task_rows: int = SMALL_GRAPH_ROWS) -> DataFrame:
    """Halve every node above ``max_points`` at the upper median of its most varying axis.

    A node whose split would leave one side empty stays a leaf. ``patch_id`` is the heap number of the leaf. Nodes of more
    than ``task_rows`` points are split by counts of coordinate values, without sorting or gathering their rows; everything
    below is finished inside tasks, many nodes in each.
    """
    node = ["cloud_id", "_node"]
    sizes = group_sizes(points, ["cloud_id"], "_n")
    limit = max_points if isinstance(max_points, Column) else F.lit(max_points)
    limits = cut(sizes.select("cloud_id", "_n", limit.cast("long").alias("_limit")))
    rows = points.select("cloud_id", "point_id", *[F.col(c).cast("double").alias(c) for c in XYZ], F.lit(1).cast("long").alias("_node"))
    types = dict(points.dtypes)
    schema = f"cloud_id {types['cloud_id']}, patch_id bigint, point_id {types['point_id']}"

    def finished(part: DataFrame) -> DataFrame:
        return map_groups(part.join(limits.drop("_n"), "cloud_id"), node, _kd_leaves, f"_node bigint, {schema}").drop("_node")

    wide = limits.where((F.col("_n") > task_rows) & (F.col("_n") > F.col("_limit"))).select("cloud_id")
    if is_empty(wide):
        return finished(rows)
    leaves = finished(rows.join(wide, "cloud_id", "left_anti"))
    open_rows = cut(rows.join(wide, "cloud_id", "left_semi"))
    while True:
        stats = open_rows.groupBy(*node).agg(F.count(F.lit(1)).alias("_n"), *[F.var_samp(c).alias(f"_v{c}") for c in XYZ])
        top = F.greatest(*[f"_v{c}" for c in XYZ])
        axis = F.when(F.col("_vx") == top, 0).when(F.col("_vy") == top, 1).otherwise(2)
        large = stats.join(limits.drop("_n"), "cloud_id").where((F.col("_n") > task_rows) & (F.col("_n") > F.col("_limit")))
        large = cut(large.select(*node, "_n", axis.alias("_axis")))
        leaves = leaves.unionByName(finished(open_rows.join(large, node, "left_anti")))
        if is_empty(large):
            return leaves
        value = F.when(F.col("_axis") == 0, F.col("x")).when(F.col("_axis") == 1, F.col("y")).otherwise(F.col("z"))
        busy = open_rows.join(large.drop("_n"), node).withColumn("_val", value)
        middle = nth_values(busy, node, "_val", large.select(*node, (F.floor(F.col("_n") / 2) + 1).alias("_rank")), task_rows)
        middle = cut(middle.select(*node, F.col("_val").alias("_cut")))
        sides = busy.join(middle, node).withColumn("_right", F.col("_val") > F.col("_cut"))
        whole = cut(sides.groupBy(*node).agg(F.max("_right").alias("_splits")).where(~F.col("_splits")).select(*node))
        stuck = open_rows.join(whole, node, "left_semi").select("cloud_id", F.col("_node").alias("patch_id"), "point_id")
        leaves = leaves.unionByName(stuck)
        open_rows = cut(
            sides.join(whole, node, "left_anti")
            .select("cloud_id", "point_id", *XYZ, (F.col("_node") * 2 + F.col("_right").cast("int")).cast("long").alias("_node"))
        )


def bfs_patches(points: DataFrame, seeds: DataFrame, k: int, num_per_patch: int | Column, pad: bool = False,
                graph: DataFrame | None = None) -> DataFrame:
    """Breadth-first patches: the first ``num_per_patch`` points that a queue discovers from each seed along
    the directed neighbour graph, neighbours by distance. ``seeds``: (cloud_id, patch_id, point_id).

    Levels advance together for all seeds; ordering a level by (rank of the parent, rank of the neighbour)
    reproduces the queue. Returns (cloud_id, patch_id, point_id, rank), rank from 1. ``pad`` repeats the last
    point of a short patch up to the full length.
    """
    patch = ["cloud_id", "patch_id"]
    edges = cut((graph if graph is not None else knn_graph(points, k)).select(
        "cloud_id", F.col("src").alias("point_id"), "dst", "nn_rank"
    ))
    limits = per_cloud(points, num_per_patch)
    front = cut(seeds.select(*patch, "point_id", F.lit(1).cast("long").alias("rank")))
    found = front
    while True:
        nxt = (
            front.join(edges, ["cloud_id", "point_id"])
            .groupBy(*patch, F.col("dst").alias("point_id"))
            .agg(F.min(F.struct("rank", "nn_rank")).alias("_key"))
            .join(found, patch + ["point_id"], "left_anti")
        )
        have = found.groupBy(*patch).agg(F.max("rank").alias("_have"))
        w = Window.partitionBy(*patch).orderBy("_key.rank", "_key.nn_rank")
        front = cut(
            nxt.withColumn("_r", F.row_number().over(w))
            .join(have, patch)
            .join(limits, "cloud_id")
            .where(F.col("_have") + F.col("_r") <= F.col("_limit"))
            .select(*patch, "point_id", (F.col("_have") + F.col("_r")).alias("rank"))
        )
        if is_empty(front):
            break
        found = cut(found.unionByName(front))
    if not pad:
        return found
    last = found.groupBy(*patch).agg(F.max_by("point_id", "rank").alias("point_id"), F.max("rank").alias("_n"))
    fill = last.join(limits, "cloud_id").where(F.col("_n") < F.col("_limit")).select(
        *patch, "point_id", F.explode(F.sequence(F.col("_n") + 1, F.col("_limit"))).alias("rank")
    )
    return found.unionByName(fill)


def split_connected(members: DataFrame, points: DataFrame, k: int, min_size: int = 1) -> DataFrame:
    """Split patches of any size into the parts connected by neighbour links inside the patch.

    Neighbours are searched among the patch's own points; parts below ``min_size`` are dropped. Returns
    (cloud_id, parent_id, label, point_id).
    """
    keys = ["cloud_id", "patch_id"]
    m = cut(members.select(*keys, "point_id").join(points.select("cloud_id", "point_id", *XYZ), ["cloud_id", "point_id"]))
    labels = components(m.select(*keys, F.col("point_id").alias("v")), knn_graph(m, k, keys), keys)
    parts = labels.select("cloud_id", F.col("patch_id").alias("parent_id"), "label", F.col("v").alias("point_id"))
    if min_size > 1:
        big = group_sizes(parts, ["cloud_id", "parent_id", "label"]).where(F.col("n") >= min_size)
        parts = parts.join(big.drop("n"), ["cloud_id", "parent_id", "label"], "left_semi")
    return parts


def number_parts(parts: DataFrame) -> DataFrame:
    """Consecutive patch ids for parts, in order of parent and label."""
    names = parts.select("cloud_id", "parent_id", "label").distinct()
    ids = ranked(names, ["cloud_id"], ["parent_id", "label"], ["parent_id", "label"], "_rn")
    ids = ids.select("cloud_id", "parent_id", "label", (F.col("_rn") - 1).alias("patch_id"))
    return parts.join(ids, ["cloud_id", "parent_id", "label"]).select("cloud_id", "patch_id", "point_id")


def drop_redundant(members: DataFrame, small_below: float | DataFrame, keep_at_least: int | DataFrame) -> DataFrame:
    """Drop small patches, smallest first, as long as every point stays covered.

    The one-by-one greedy order is reproduced in rounds: a patch is decided as soon as its fate no longer
    depends on undecided patches before it. Dropping stops when ``keep_at_least`` patches are left
    (a number, or (cloud_id, _keep) per cloud); ``small_below`` is a number or (cloud_id, _below) per cloud.
    """
    patch = ["cloud_id", "patch_id"]
    m = cut(members.select(*patch, "point_id").join(group_sizes(members, patch, "_n"), patch))
    sized = m.join(small_below, "cloud_id") if isinstance(small_below, DataFrame) else m.withColumn("_below", F.lit(small_below))
    undecided = cut(sized.where(F.col("_n") < F.col("_below")).select(*patch, "_n").distinct())
    dropped = undecided.limit(0)
    while not is_empty(undecided):
        alive = m.join(dropped, patch, "left_anti")
        cover = group_sizes(alive, ["cloud_id", "point_id"], "_cover")
        w = (
            Window.partitionBy("cloud_id", "point_id").orderBy("_n", "patch_id")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        open_rows = m.join(undecided.select(*patch), patch, "left_semi").withColumn("_ahead", F.count(F.lit(1)).over(w))
        fate = open_rows.join(cover, ["cloud_id", "point_id"]).groupBy(*patch, "_n").agg(
            F.min(F.col("_cover") - F.col("_ahead")).alias("_worst"), F.min("_cover").alias("_best")
        )
        fate = cut(fate)
        dropped = cut(dropped.unionByName(fate.where(F.col("_worst") > 1).select(*patch, "_n")))
        undecided = cut(fate.where((F.col("_worst") <= 1) & (F.col("_best") > 1)).select(*patch, "_n"))
    total = m.select(*patch).distinct().groupBy("cloud_id").agg(F.count(F.lit(1)).alias("_p"))
    if isinstance(keep_at_least, DataFrame):
        total = total.join(keep_at_least, "cloud_id")
    else:
        total = total.withColumn("_keep", F.lit(keep_at_least))
    gone = ranked(dropped, ["cloud_id"], ["_n", "patch_id"], ["_n", "patch_id"], "_rn").join(total, "cloud_id")
    gone = gone.where(F.col("_rn") <= F.col("_p") - F.col("_keep")).select(*patch)
    return m.join(gone, patch, "left_anti").select(*patch, "point_id")


def fps_bfs_patches(points: DataFrame, patch_count: int | Column, num_per_patch: int | Column, overlap_rate: float,
                    k: int = 30, min_size: int = 10) -> DataFrame:
    """Farthest-point patches, split into connected parts, without redundant small parts."""
    parts = split_connected(fps_patches(points, patch_count, overlap_rate), points, k, min_size)
    below = per_cloud(points, num_per_patch).select("cloud_id", (F.col("_limit") / 4).alias("_below"))
    keep = per_cloud(points, patch_count).select("cloud_id", F.col("_limit").alias("_keep"))
    return drop_redundant(number_parts(parts), below, keep)


def fps_connected_patches(points: DataFrame, patch_count: int | Column, m: int = 2, k: int = 10,
                          min_size: int = 1) -> DataFrame:
    """Farthest-point patches over the m nearest centres, split into connected parts; 1 <= m <= 10."""
    if not 1 <= m <= 10:
        raise ValueError("overlap count must be between 1 and 10")
    base = patches_around_centres(points, farthest_points(points, patch_count), m)
    sizes = group_sizes(points, ["cloud_id"], "_n")
    tiny = sizes.where((F.col("_n") == 1) | (F.col("_n") <= patch_count)).select("cloud_id")
    single = points.join(tiny, "cloud_id", "left_semi")
    single = ranked(single, ["cloud_id"], ["point_id"], ["point_id"], "_rn").select(
        "cloud_id", (F.col("_rn") - 1).alias("patch_id"), F.col("point_id").cast("long").alias("point_id")
    )
    rest = base.join(tiny, "cloud_id", "left_anti")
    return number_parts(split_connected(rest, points, k, min_size)).unionByName(single)


def single_patch(points: DataFrame) -> DataFrame:
    """Whole cloud as patch 0."""
    return points.select("cloud_id", F.lit(0).cast("long").alias("patch_id"), "point_id")


EXTRACTORS: dict[str, Callable[..., DataFrame]] = {}


def extractor(name: str):
    """Register a patch extractor ``fn(points, patch_count=..., num_per_patch=..., overlap_rate=..., **options)``."""

    def register(fn):
        EXTRACTORS[name] = fn
        return fn

    return register


@extractor("fps")
def _fps(points, patch_count, num_per_patch, overlap_rate, **_):
    return fps_patches(points, patch_count, overlap_rate)


@extractor("fps_bfs")
def _fps_bfs(points, patch_count, num_per_patch, overlap_rate, k=30, min_component_size=10, **_):
    return fps_bfs_patches(points, patch_count, num_per_patch, overlap_rate, k, min_component_size)


@extractor("fps_cpu")
def _fps_cpu(points, patch_count, num_per_patch, overlap_rate, overlap_count=2, k_connectivity=10,
             min_component_size=5, **_):
    return fps_connected_patches(points, patch_count, overlap_count, k_connectivity, min_component_size)


@extractor("knn")
def _knn(points, patch_count, num_per_patch, overlap_rate, **_):
    return knn_patches(points, patch_count, num_per_patch)


@extractor("kdtree")
def _kdtree(points, patch_count, num_per_patch, overlap_rate, **_):
    return kd_patches(points, num_per_patch)


@extractor("grid")
def _grid(points, patch_count, num_per_patch, overlap_rate, **_):
    return grid_patches(points, num_per_patch, overlap_rate)


def _seeds(points, patch_count, query_points):
    if query_points is not None:
        ids = ranked(query_points.select("cloud_id", "point_id"), ["cloud_id"], ["point_id"], ["point_id"], "_rn")
        return ids.select("cloud_id", (F.col("_rn") - 1).alias("patch_id"), "point_id")
    return farthest_points(points, patch_count).select("cloud_id", F.col("center").alias("patch_id"), "point_id")


@extractor("bfs")
def _bfs(points, patch_count, num_per_patch, overlap_rate, query_points=None, k=10, **_):
    return bfs_patches(points, _seeds(points, patch_count, query_points), k, num_per_patch)


@extractor("bfs_cpu")
def _bfs_cpu(points, patch_count, num_per_patch, overlap_rate, query_points=None, k=10, **_):
    return bfs_patches(points, _seeds(points, patch_count, query_points), k, num_per_patch, pad=True)


@extractor("no_chunk")
def _no_chunk(points, **_):
    return single_patch(points)


NEEDS = {
    "fps": ("patch_count",), "fps_bfs": ("patch_count", "num_per_patch"), "fps_cpu": ("patch_count",),
    "knn": ("patch_count", "num_per_patch"), "kdtree": ("num_per_patch",), "grid": ("num_per_patch",),
    "bfs": ("num_per_patch",), "bfs_cpu": ("num_per_patch",), "no_chunk": (),
}


def extract_patches(points: DataFrame, method: str, patch_count: int | Column | None = None,
                    num_per_patch: int | Column | None = None, overlap_rate: float = 0.0,
                    query_points: DataFrame | None = None, **options) -> DataFrame:
    """Membership table by method name.

    A missing patch count follows from the patch size, and the reverse, by each cloud's own number of points
    (at least 1), so a cloud's patches do not depend on its batch. Both may be expressions over that number, ``_n``.
    """
    if method not in EXTRACTORS:
        raise ValueError(f"unknown patch method {method}")
    if not 0.0 <= overlap_rate < 1.0:
        raise ValueError("overlap_rate must be in [0, 1)")
    given = {"patch_count": patch_count, "num_per_patch": num_per_patch}
    for name, value in given.items():
        if isinstance(value, int) and value <= 0:
            raise ValueError(f"{name} must be positive")
    seeded = method in ("bfs", "bfs_cpu") and query_points is not None

    def derived(other: int | Column) -> Column:
        other = other if isinstance(other, Column) else F.lit(other)
        return F.greatest(F.lit(1), F.floor(F.col("_n") / other * F.lit(1 + overlap_rate))).cast("long")

    if method != "no_chunk" and not seeded:
        if patch_count is None and num_per_patch is None:
            raise ValueError("give patch_count or num_per_patch")
        if patch_count is None:
            patch_count = derived(num_per_patch)
        elif num_per_patch is None:
            num_per_patch = derived(patch_count)
    for name in NEEDS.get(method, ()):
        if {"patch_count": patch_count, "num_per_patch": num_per_patch}[name] is None:
            raise ValueError(f"{method} needs {name}")
    call = dict(patch_count=patch_count, num_per_patch=num_per_patch, overlap_rate=overlap_rate, **options)
    if query_points is not None:
        call["query_points"] = query_points
    return EXTRACTORS[method](points, **call)


def multi_scale_patches(points: DataFrame, scales: list[dict]) -> DataFrame:
    """All clouds at all scales: (cloud_id, scale_idx, patch_id, point_id).

    Without a patch count, a cloud of N points gets N / num_per_patch patches, rounded down and whatever the overlap;
    where that is none, the whole cloud is one patch. Patches of a single point are removed.
    """
    sizes = group_sizes(points, ["cloud_id"], "_n")
    out = None
    for idx, scale in enumerate(scales):
        rest, whole = points, None
        if scale.get("patch_count") is None:
            size = scale["num_per_patch"]
            small = sizes.where(F.col("_n") < size).select("cloud_id")
            whole = single_patch(points.join(small, "cloud_id", "left_semi"))
            rest = points.join(small, "cloud_id", "left_anti")
            scale = {**scale, "patch_count": F.floor(F.col("_n") / F.lit(size)).cast("long")}
        both = extract_patches(rest, **scale).select("cloud_id", "patch_id", "point_id")
        both = both if whole is None else both.unionByName(whole)
        both = both.select("cloud_id", F.lit(idx).cast("long").alias("scale_idx"), "patch_id", "point_id")
        out = both if out is None else out.unionByName(both)
    return drop_small(out, ["cloud_id", "scale_idx", "patch_id"], 2)


def drop_small(members: DataFrame, keys: list[str], min_size: int, max_size: int | None = None) -> DataFrame:
    """Only groups within the size limits; the sizes are joined back, never windowed over a hot group."""
    n = group_sizes(members, keys, "_n").where(F.col("_n") >= min_size)
    if max_size is not None:
        n = n.where(F.col("_n") <= max_size)
    return members.join(n.drop("_n"), keys, "left_semi")


def patch_statistics(members: DataFrame, keys: list[str] = ("cloud_id",)) -> DataFrame:
    """Count and size statistics of patches and the realised overlap, per cloud."""
    keys = list(keys)
    sizes = group_sizes(members, keys + ["patch_id"])
    size_stats = sizes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("patch_count"), F.min("n").alias("min_points"), F.max("n").alias("max_points"),
        F.avg("n").alias("mean_points"), F.var_pop("n").alias("var_points"), F.sum("n").alias("_total"),
    )
    covered = members.select(*keys, "point_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("total_points"))
    return size_stats.join(covered, keys).withColumn(
        "overlap_rate", F.lit(1.0) - F.col("total_points") / F.col("_total")
    ).drop("_total")


def patch_centres(members: DataFrame, points: DataFrame) -> DataFrame:
    """(cloud_id, patch_id, x, y, z, n_points): mean position of the members."""
    m = members.join(points.select("cloud_id", "point_id", *XYZ), ["cloud_id", "point_id"])
    return m.groupBy("cloud_id", "patch_id").agg(*[F.avg(c).alias(c) for c in XYZ], F.count(F.lit(1)).alias("n_points"))


def lookup_patches(members: DataFrame, cloud_id=None, scale_idx: int | None = None) -> DataFrame:
    out = members
    if cloud_id is not None:
        out = out.where(F.col("cloud_id") == cloud_id)
    return out if scale_idx is None else out.where(F.col("scale_idx") == scale_idx)


def patch_inventory(members: DataFrame, expected_scales: int) -> DataFrame:
    """Per cloud: scales present, patches, rows, megabytes of the ids, and whether every scale is there.

    A row holds the ids of its patch and its point as eight bytes each.
    """
    per = members.groupBy("cloud_id", "scale_idx", "patch_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("cloud_id").agg(
        F.count_distinct("scale_idx").alias("num_scales"), F.count(F.lit(1)).alias("num_patches"),
        F.sum("n").alias("num_rows"), (F.sum("n") * 16 / (1 << 20)).alias("size_mb"),
    ).withColumn("complete", (F.col("num_scales") == expected_scales).cast("long"))
