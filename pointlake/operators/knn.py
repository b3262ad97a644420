"""Exact nearest-neighbour and radius joins.

The search space is cut into bounded tiles (``tiles.build_splits``). Every query first meets the points of
its own tile, which gives a bound on its k-th distance; only queries whose ball leaves the tile travel on
to the neighbouring tiles. All distances are computed in Arrow batches on one tile against one bounded
chunk of queries; Spark does the partitioning, the routing and the merge.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from pointlake.functions.geometry import XYZ, dist2
from pointlake.operators.grouped import map_groups
from pointlake.operators.tiles import RANK_ROWS, Splits, assign_ball, assign_tiles, build_splits, nth_values, ranked
from pointlake.session import cut

TILE_POINTS = 512
QUERY_CHUNK = 8192
_BLOCK = 1024
_STACK_ROWS = 128  # rows of a group whose distances are found together with those of others
_STACK_CELLS = 1 << 19  # distances in one array of several groups


def nearest_rows(q_xyz, q_id, t_xyz, t_id, k, exclude_self, reach=None):
    """Rows (query index, target index, d2, rank) of the k nearest targets; ties go to the smaller id."""
    order = np.argsort(t_id, kind="stable")
    t_xyz, t_id = t_xyz[order], t_id[order]
    parts = []
    for start in range(0, len(q_id), _BLOCK):
        q = q_xyz[start : start + _BLOCK]
        d2 = np.zeros((len(q), len(t_id)))
        for axis in range(3):
            diff = q[:, axis][:, None] - t_xyz[:, axis][None, :]
            d2 += diff * diff
        if exclude_self:
            d2[q_id[start : start + _BLOCK][:, None] == t_id[None, :]] = np.inf
        kk = min(k, d2.shape[1])
        bound = np.partition(d2, kk - 1, axis=1)[:, kk - 1]
        if reach is not None:
            bound = np.minimum(bound, reach[start : start + _BLOCK])
        rows, cols = np.nonzero((d2 <= bound[:, None]) & np.isfinite(d2))
        dist = d2[rows, cols]
        srt = np.lexsort((cols, dist, rows))
        rows, cols, dist = rows[srt], cols[srt], dist[srt]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") + 1
        keep = rank <= k
        parts.append((rows[keep] + start, order[cols[keep]], dist[keep], rank[keep]))
    return [np.concatenate(p) for p in zip(*parts)]


def nearest_inside(xyz: np.ndarray, ids: np.ndarray, group: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Rows (index, index, d2, rank) of the k nearest others inside each row's group, of many groups, as ``nearest_rows`` finds them.

    ``group`` is ascending. Groups of equal size are stacked; wide ones, and those with coordinates that are not finite, go
    one by one.
    """
    order = np.lexsort((ids, group))
    xyz, ids = xyz[order], ids[order]
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(np.append(starts, len(group)))
    sound = np.logical_and.reduceat(np.isfinite(xyz).all(axis=1), starts) if len(starts) else np.zeros(0, bool)
    stacked = sound & (sizes <= _STACK_ROWS)
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
    for s, n in zip(starts[~stacked], sizes[~stacked]):
        rows, cols, dist, rank = nearest_rows(xyz[s : s + n], ids[s : s + n], xyz[s : s + n], ids[s : s + n], k, True)
        parts.append((order[rows + s], order[cols + s], dist, rank))
    for n in np.unique(sizes[stacked]):
        first = starts[stacked & (sizes == n)]
        step = max(1, _STACK_CELLS // int(n * n))
        for at in range(0, len(first), step):
            place = first[at : at + step, None] + np.arange(n)
            p, i = xyz[place], ids[place]
            d2 = np.zeros((len(place), n, n))
            for axis in range(3):
                diff = p[:, :, None, axis] - p[:, None, :, axis]
                d2 += diff * diff
            d2[i[:, :, None] == i[:, None, :]] = np.inf
            near = np.argsort(d2, axis=2, kind="stable")[:, :, :k]
            dist = np.take_along_axis(d2, near, axis=2)
            g, r, rank = np.nonzero(np.isfinite(dist))
            parts.append((order[place[g, r]], order[place[g, near[g, r, rank]]], dist[g, r, rank], rank + 1))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _schema(df: DataFrame, keys: list[str], id_col: str) -> str:
    types = dict(df.dtypes)
    fields = [f"{key} {types[key]}" for key in keys]
    fields += [f"src {types[id_col]}", f"dst {types[id_col]}", "nn_rank int", "d2 double"]
    return ", ".join(fields + ["x double", "y double", "z double", "_home string"])


def _emit(keys, left, right, k, exclude_self, home_rows):
    q_xyz, t_xyz = left[["x", "y", "z"]].to_numpy(), right[["x", "y", "z"]].to_numpy()
    q_id, t_id = left["_id"].to_numpy(), right["_id"].to_numpy()
    reach = None if home_rows else left["_reach"].to_numpy()
    rows, cols, dist, rank = nearest_rows(q_xyz, q_id, t_xyz, t_id, k, exclude_self, reach)
    head = {key: left[key].iloc[0] for key in keys}
    found = pd.DataFrame(
        {**head, "src": q_id[rows], "dst": t_id[cols], "nn_rank": rank.astype("int32"), "d2": dist}
    )
    found[["x", "y", "z"]] = t_xyz[cols]
    found["_home"] = None
    if not home_rows:
        return found
    # One row of rank 0 per query carries its position and the bound on its k-th distance.
    kth = np.full(len(q_id), np.inf)
    kth[rows[rank == k]] = dist[rank == k]
    own = pd.DataFrame({**head, "src": q_id, "dst": q_id, "nn_rank": np.int32(0), "d2": kth})
    own[["x", "y", "z"]] = q_xyz
    own["_home"] = left["_node"].iloc[0]
    return pd.concat([found, own], ignore_index=True) if len(found) else own


def _match(queries: DataFrame, targets: DataFrame, keys: list[str], k: int, exclude_self: bool, schema: str,
           home_rows: bool) -> DataFrame:
    """Meet queries and targets of the same tile; crowded tiles are worked off in chunks of queries."""
    tile = keys + ["_node"]
    crowd = queries.groupBy(*tile).agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_CHUNK)).cast("int").alias("_chunks"))
    q = queries.join(crowd, tile).withColumn("_chunk", F.pmod(F.xxhash64("_id"), F.col("_chunks")).cast("int"))
    t = targets.join(crowd, tile).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    group = tile + ["_chunk"]

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        return _emit(keys, left, right, k, exclude_self, home_rows)

    q, t = q.drop("_chunks"), t.drop("_chunks")
    return q.groupBy(*group).cogroup(t.groupBy(*group)).applyInPandas(work, schema)


def _match_self(points: DataFrame, keys: list[str], k: int, exclude_self: bool, schema: str) -> DataFrame:
    """Every tile against itself; tiles are bounded, so many of them are worked off per batch."""

    def work(g: dict) -> dict:
        xyz, ids = np.stack([g["x"], g["y"], g["z"]], axis=1), g["_id"]
        rows, cols, dist, rank = nearest_rows(xyz, ids, xyz, ids, k, exclude_self)
        kth = np.full(len(ids), np.inf)
        kth[rows[rank == k]] = dist[rank == k]
        both = np.concatenate([xyz[cols], xyz])
        return {
            "src": np.concatenate([ids[rows], ids]), "dst": np.concatenate([ids[cols], ids]),
            "nn_rank": np.concatenate([rank, np.zeros(len(ids))]).astype("int32"),
            "d2": np.concatenate([dist, kth]), "x": both[:, 0], "y": both[:, 1], "z": both[:, 2],
            "_home": np.repeat(g["_node"][:1], len(both)),
        }

    return map_groups(points, [*keys, "_node"], work, schema)


def _search(queries, targets, k, keys, splits: Splits, exclude_self, schema, same) -> DataFrame:
    t = assign_tiles(targets, splits)
    if same:
        home = _match_self(t, keys, k, exclude_self, schema)
    else:
        home = _match(assign_tiles(queries, splits), t, keys, k, exclude_self, schema, True)
    out_cols = [*keys, "src", "dst", "nn_rank", "d2", *XYZ]
    if not splits.levels:
        return home.where("nn_rank > 0").select(*out_cols)
    home = cut(home)
    # The factor covers the rounding of the square root; a ball that is slightly too large is harmless.
    radius = F.sqrt("_reach") * F.lit(1.0 + 1e-9)
    travellers = home.where("nn_rank = 0").select(
        *keys, F.col("src").alias("_id"), *XYZ, F.col("d2").alias("_reach"), "_home"
    )
    routed = assign_ball(travellers, splits, radius).where("_node <> _home").drop("_home")
    away = _match(routed, t, keys, k, exclude_self, schema, False)
    both = home.where("nn_rank > 0").unionByName(away).drop("nn_rank", "_home")
    w = Window.partitionBy(*keys, "src").orderBy("d2", "dst")
    return both.withColumn("nn_rank", F.row_number().over(w)).where(F.col("nn_rank") <= k).select(*out_cols)


def knn_join(
    queries: DataFrame,
    targets: DataFrame | None,
    k: int,
    keys: list[str] = ("cloud_id",),
    exclude_self: bool = False,
    id_col: str = "point_id",
    tile_points: int = TILE_POINTS,
    positions: bool = False,
) -> DataFrame:
    """k nearest targets of every query inside the same group: (keys, src, dst, nn_rank, d2).

    ``positions`` adds the coordinates x, y, z of the neighbour, which saves a join back to the points.

    Clouds with fewer than k candidates return all of them. Ties in distance go to the smaller id.
    ``targets=None`` joins the queries with themselves. Extra copies of one position beyond the k+1 smallest
    ids can be nobody's neighbour, so an oversized position is reduced to those first; that reduction is exact.
    """
    keys = list(keys)
    same = targets is None

    def pick(df: DataFrame) -> DataFrame:
        # Aliases give both sides their own columns even when they come from the same DataFrame.
        mine = [F.col(key).alias(key) for key in keys]
        return df.select(*mine, F.col(id_col).alias("_id"), *[F.col(c).cast("double").alias(c) for c in XYZ])

    schema = _schema(queries, keys, id_col)
    q = pick(queries)
    t = q if same else pick(targets)
    splits = build_splits(t, keys, list(XYZ), max(tile_points, 2 * (k + 1)))
    out_cols = [*keys, "src", "dst", "nn_rank", "d2", *(XYZ if positions else ())]
    if not splits.stuck:
        return _search(q, t, k, keys, splits, exclude_self, schema, same).select(*out_cols)

    place = keys + list(XYZ)
    first = Window.partitionBy(*place).orderBy("_id")
    t = cut(t.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1).drop("_r"))
    splits = build_splits(t, keys, list(XYZ), max(tile_points, 2 * (k + 1)))
    places = q.groupBy(*place).agg(F.min("_id").alias("_id"))
    found = _search(places, t, k + 1, keys, splits, False, schema, False)
    found = found.select(*keys, "src", "dst", "d2", *[F.col(c).alias(f"t{c}") for c in XYZ])
    found = found.join(places.withColumnRenamed("_id", "src"), keys + ["src"]).drop("src")
    out = found.join(q.withColumnRenamed("_id", "src"), place).drop(*XYZ)
    out = out.withColumnsRenamed({f"t{c}": c for c in XYZ})
    if exclude_self:
        out = out.where(F.col("src") != F.col("dst"))
    w = Window.partitionBy(*keys, "src").orderBy("d2", "dst")
    out = out.withColumn("nn_rank", F.row_number().over(w)).where(F.col("nn_rank") <= k)
    return out.select(*out_cols)


def nearest_many(queries: DataFrame, targets: DataFrame, limits: DataFrame, keys: list[str] = ("cloud_id",), task_rows: int = RANK_ROWS) -> DataFrame:
    """(keys, src, dst, nn_rank, d2): the nearest targets of few queries, as many as ``limits(keys, _limit)`` says.

    For numbers of neighbours that no task should hold: the distance of the last one is found by counts, then everything up
    to it is kept and ranked in pieces. Ties go to the smaller id, as in ``knn_join``.
    """
    keys = list(keys)
    q = queries.select(*keys, F.col("point_id").alias("src"), *[F.col(c).cast("double").alias(f"q{c}") for c in XYZ])
    t = targets.select(*keys, F.col("point_id").alias("dst"), *[F.col(c).cast("double").alias(c) for c in XYZ])
    apart = t.join(q, keys).select(*keys, "src", "dst", dist2(XYZ, [f"q{c}" for c in XYZ]).alias("d2"))
    sizes = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    wanted = cut(q.select(*keys, "src").join(limits, keys).join(sizes, keys).select(*keys, "src", F.least("_limit", "_n").alias("_rank")))
    last = nth_values(apart, [*keys, "src"], "d2", wanted, task_rows).withColumnRenamed("d2", "_last")
    near = apart.join(last, [*keys, "src"]).where(F.col("d2") <= F.col("_last"))
    ranks = ranked(near, [*keys, "src"], ["d2", "dst"], ["d2", "dst"], "nn_rank", task_rows)
    return ranks.where(F.col("nn_rank") <= F.col("_rank")).select(*keys, "src", "dst", F.col("nn_rank").cast("int").alias("nn_rank"), "d2")


def knn_graph(points: DataFrame, k: int, keys: list[str] = ("cloud_id",), **kw) -> DataFrame:
    """Directed k-nearest-neighbour graph; a point is never its own neighbour, copies of it may be."""
    return knn_join(points, None, k, keys, exclude_self=True, **kw)


MOMENTS = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]


def own_moments(k: int) -> Callable[[dict, np.ndarray], dict]:
    """Covariances of the k nearest other points of a tile around their own mean, and the bound on the k-th distance; many tiles."""

    def work(g: dict, group: np.ndarray) -> dict:
        xyz, ids = np.stack([g[c] for c in XYZ], axis=1), g["_id"]
        if not np.isfinite(xyz).all():
            raise ValueError("coordinates are not finite")
        rows, cols, dist, rank = nearest_inside(xyz, ids, group, k)
        n = np.bincount(rows, minlength=len(ids))
        share = 1.0 / np.maximum(n, 1)
        near = xyz[cols]
        mean = np.stack([np.bincount(rows, near[:, a], len(ids)) for a in range(3)], 1) * share[:, None]
        off = near - mean[rows]
        out = {"_group": group, "point_id": ids, "k": n}
        for a, b in MOMENTS:
            out[f"c{a}{b}"] = np.bincount(rows, off[:, XYZ.index(a)] * off[:, XYZ.index(b)], len(ids)) * share
        kth = np.full(len(ids), np.inf)
        kth[rows[rank == k]] = dist[rank == k]
        return {**out, **{c: g[c] for c in XYZ}, "_reach": kth, "_home": g["_node"]}

    return work


def knn_moments(points: DataFrame, k: int, keys: list[str] = ("cloud_id",), tile_points: int = TILE_POINTS, positions: bool = False) -> DataFrame:
    """(keys, point_id, k, cxx, cxy, ..., czz) per point: number and covariances of its k nearest other points.

    Tasks return the moments of a tile's points, one row each, and no neighbours. Only points whose ball leaves their tile
    meet the tiles it touches, with candidates in rows. Ties go to the smaller id, as in ``knn_join``. ``positions`` adds the
    point's own x, y, z.
    """
    keys = list(keys)
    types = dict(points.dtypes)
    t = points.select(*keys, F.col("point_id").alias("_id"), *[F.col(c).cast("double").alias(c) for c in XYZ])
    splits = build_splits(t, keys, list(XYZ), max(tile_points, 2 * (k + 1)))
    names = [f"c{a}{b}" for a, b in MOMENTS]
    covariances = [F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in MOMENTS]
    count = F.count(F.lit(1)).alias("k")
    own_xyz = XYZ if positions else ()
    out = [*keys, "point_id", "k", *names, *own_xyz]
    if splits.stuck:
        near = knn_graph(points, k, keys, tile_points=tile_points, positions=True)
        found = near.groupBy(*keys, F.col("src").alias("point_id")).agg(count, *covariances)
        every = t.select(*keys, F.col("_id").alias("point_id"), *own_xyz).join(found, [*keys, "point_id"], "left")
        return every.na.fill(0, ["k", *names]).select(*out)
    tiles = assign_tiles(t, splits)
    fields = [f"{c} {types[c]}" for c in [*keys, "point_id"]] + ["k bigint", *(f"{c} double" for c in [*names, *XYZ, "_reach"]), "_home string"]
    own = map_groups(tiles, [*keys, "_node"], own_moments(k), ", ".join([*fields, "_node string"]), many=True).drop("_node")
    if not splits.levels:
        return own.select(*out)
    own = cut(own)
    radius = F.sqrt("_reach") * F.lit(1.0 + 1e-9)
    ask = own.select(*keys, F.col("point_id").alias("_id"), *XYZ, "_reach", "_home")
    routed = cut(assign_ball(ask, splits, radius))
    leaving = routed.where("_node <> _home").select(*keys, "_id").distinct()
    routed = routed.join(leaving, [*keys, "_id"], "left_semi").drop("_home")
    near = _match(routed, tiles, keys, k, True, _schema(points, keys, "point_id"), False)
    w = Window.partitionBy(*keys, "src").orderBy("d2", "dst")
    near = near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    met = near.groupBy(*keys, F.col("src").alias("point_id")).agg(count, *covariances)
    stay = own.join(leaving.withColumnRenamed("_id", "point_id"), [*keys, "point_id"], "left_anti")
    if positions:
        met = met.join(own.select(*keys, "point_id", *XYZ), [*keys, "point_id"])
    # A point that meets nobody has no row in the end and none among those that stay.
    alone = own.where("k = 0").join(met, [*keys, "point_id"], "left_anti").join(leaving.withColumnRenamed("_id", "point_id"), [*keys, "point_id"], "left_semi")
    return stay.select(*out).unionByName(met.select(*out)).unionByName(alone.select(*out))


def hybrid_neighbours(points: DataFrame, k: int, radius: float, keys: list[str] = ("cloud_id",)) -> DataFrame:
    """At most k neighbours and none beyond ``radius``."""
    return knn_graph(points, k, keys).where(F.col("d2") <= F.lit(radius * radius))


def symmetric_adjacency(graph: DataFrame, keys: list[str] = ("cloud_id",)) -> DataFrame:
    """Pairs (i, j) linked in at least one direction, listed in both."""
    keys = list(keys)
    fwd = graph.select(*keys, F.col("src").alias("i"), F.col("dst").alias("j"))
    back = graph.select(*keys, F.col("dst").alias("i"), F.col("src").alias("j"))
    return fwd.unionByName(back).distinct()


def radius_join(queries: DataFrame, targets: DataFrame, radius: float, keys: list[str] = ("cloud_id",)) -> DataFrame:
    """All targets within ``radius`` of each query: an equi-join on cells as wide as the radius.

    Queries look into the 27 cells around them; a hot cell is split by adaptive skew-join handling.
    """
    keys = list(keys)
    cell = [F.floor(F.col(c) / F.lit(radius)).cast("long") for c in XYZ]
    near = F.expr(
        "flatten(transform(sequence(-1, 1), a -> flatten(transform(sequence(-1, 1), b ->"
        " transform(sequence(-1, 1), c -> struct(a AS a, b AS b, c AS c))))))"
    )
    q = queries.select(
        *keys, F.col("point_id").alias("src"), *[F.col(c).alias(f"q{c}") for c in XYZ],
        *[c.alias(f"c{i}") for i, c in enumerate(cell)], F.explode(near).alias("o"),
    ).select(
        *keys, "src", "qx", "qy", "qz",
        *[(F.col(f"c{i}") + F.col(f"o.{o}")).alias(f"c{i}") for i, o in enumerate("abc")],
    )
    t = targets.select(
        *keys, F.col("point_id").alias("dst"), *XYZ, *[c.alias(f"c{i}") for i, c in enumerate(cell)]
    )
    d2 = dist2(XYZ, ("qx", "qy", "qz"))
    return (
        q.join(t, keys + ["c0", "c1", "c2"])
        .withColumn("d2", d2)
        .where(F.col("d2") <= F.lit(radius * radius))
        .select(*keys, "src", "dst", "d2")
    )


def nearest_to_query(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Flag the k points closest to each cloud's query point. ``queries``: (cloud_id, qx, qy, qz), one per cloud.

    The rank filter lets Spark keep only k candidates per cloud and task before anything is shuffled.
    """
    q = points.join(queries, "cloud_id").withColumn("d2", dist2(XYZ, ("qx", "qy", "qz")))
    w = Window.partitionBy("cloud_id").orderBy("d2", "point_id")
    hits = (
        q.withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= k)
        .select("cloud_id", "point_id", F.lit(1).cast("long").alias("highlight"))
    )
    return points.join(hits, ["cloud_id", "point_id"], "left").withColumn(
        "highlight", F.coalesce("highlight", F.lit(0).cast("long"))
    )


def gather(members: DataFrame, points: DataFrame) -> DataFrame:
    """Point attributes of patch members."""
    return members.join(points, ["cloud_id", "point_id"])
