"""Farthest-point, exact-size random and voxel sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pointlake.functions.geometry import XYZ, dist2
from pointlake.operators.knn import knn_join
from pointlake.operators.tiles import group_sizes
from pointlake.session import cut, discard, is_empty, staged

WHOLE_POINTS = 20_000  # points of a cloud that is sampled at once
POOL_POINTS = 200_000  # points one task looks at when it picks farthest points
_BLOCK_POINTS = 128  # points whose gaps are left alone together when a pick is too far away

_CENTRES = "cloud_id {cloud}, center bigint, point_id {point}, x double, y double, z double"


def _pick_farthest(xyz, ids, gap, need, floor):
    """Rows of greedy picks inside one pool while the widest gap is certain to be the widest of the whole cloud."""
    order = np.argsort(ids, kind="stable")
    xyz, gap = xyz[order], gap[order].copy()
    if len(ids) > 8 * _BLOCK_POINTS and np.isfinite(xyz).all():
        return order[_pick_in_blocks(xyz, gap, need, floor)]
    picks = []
    while len(picks) < need:
        i = int(np.argmax(gap))  # the first maximum has the smallest id
        if gap[i] < 0 or not gap[i] > floor:
            break
        picks.append(i)
        diff = xyz - xyz[i]
        d2 = diff[:, 0] * diff[:, 0] + diff[:, 1] * diff[:, 1] + diff[:, 2] * diff[:, 2]
        gap = np.minimum(gap, d2)
        gap[i] = -1.0
    return order[np.array(picks, dtype=np.int64)]


def _blocks(xyz):
    """Rows in blocks of neighbouring points, ascending inside a block: (blocks, width), short blocks end in -1."""
    parts = [np.arange(len(xyz))]
    while len(parts[0]) > _BLOCK_POINTS:
        halves = []
        for rows in parts:
            own = xyz[rows]
            value = own[:, np.argmax(own.max(axis=0) - own.min(axis=0))]
            side = np.argpartition(value, len(rows) // 2)
            halves += [rows[side[len(rows) // 2 :]], rows[side[: len(rows) // 2]]]  # the first is never the shorter one
        parts = halves
    out = np.full((len(parts), len(parts[0])), -1)
    for i, rows in enumerate(parts):
        out[i, : len(rows)] = np.sort(rows)
    return out


def _pick_in_blocks(xyz, gap, need, floor):
    """The same picks, row by row, but a pick only meets the blocks that hold a gap wider than their distance from it.

    Boxes bound distances exactly: rounding is monotonic, and the sums have the order of those between points.
    """
    rows = _blocks(xyz)
    real = rows >= 0
    at = np.where(real, rows, rows[:, :1])
    axes = [np.ascontiguousarray(xyz[:, a][at]) for a in range(3)]
    low, high = [v.min(axis=1) for v in axes], [v.max(axis=1) for v in axes]
    gaps = np.where(real, gap[at], -1.0)
    place = gaps.argmax(axis=1)  # the first maximum of a block has its smallest id
    every = np.arange(len(rows))
    best, first = gaps[every, place], at[every, place]
    picks = []
    while len(picks) < need:
        widest = best.max()
        if widest < 0 or not widest > floor:
            break
        ties = np.flatnonzero(best == widest)
        b = ties[np.argmin(first[ties])]
        picks.append(i := first[b])
        p = xyz[i]
        away = [np.maximum(0.0, np.maximum(low[a] - p[a], p[a] - high[a])) for a in range(3)]
        near = away[0] * away[0] + away[1] * away[1] + away[2] * away[2] < best
        near[b] = True
        hit = np.flatnonzero(near)
        diff = [axes[a][hit] - p[a] for a in range(3)]
        gaps[b, place[b]] = -1.0
        new = np.minimum(gaps[hit], diff[0] * diff[0] + diff[1] * diff[1] + diff[2] * diff[2])
        gaps[hit] = new
        place[hit] = at_best = new.argmax(axis=1)
        best[hit], first[hit] = new[every[: len(hit)], at_best], at[hit, at_best]
    return np.array(picks, dtype=np.int64)


def with_counts(points: DataFrame, count: int | Column) -> DataFrame:
    """(cloud_id, _n, _want): number of samples per cloud; ``count`` may be an expression over ``_n``."""
    c = F.lit(count) if isinstance(count, int) else count
    sizes = group_sizes(points, ["cloud_id"], "_n")
    return sizes.withColumn("_want", F.greatest(F.lit(1), F.least(c.cast("long"), F.col("_n"))).cast("long"))


def farthest_points(points: DataFrame, count: int | Column, starts: DataFrame | None = None,
                    pool: int = POOL_POINTS) -> DataFrame:
    """Exact farthest-point sampling per cloud: (cloud_id, center, point_id, x, y, z), ``center`` from 0.

    Starts at the smallest id, or at ``starts(cloud_id, point_id)``; ties go to the smaller id. A small cloud
    that fits the pool is sampled in one task. A larger cloud proceeds in passes: the pool holds its points with
    the widest gaps, and picks go on as long as the pool's widest gap exceeds every gap outside, so each pass
    yields a run of picks that equals the one-by-one procedure. Gaps are kept as a table of known size: sizes that
    are estimated through passes of joins get six times as many digits each time, until the driver cannot hold them.
    """
    types = dict(points.dtypes)
    schema = _CENTRES.format(cloud=types["cloud_id"], point=types["point_id"])
    whole = min(pool, WHOLE_POINTS)
    want = cut(with_counts(points, count))
    p = points.select("cloud_id", "point_id", *[F.col(c).cast("double").alias(c) for c in XYZ])
    first = starts if starts is not None else p.groupBy("cloud_id").agg(F.min("point_id").alias("point_id"))
    first = first.select("cloud_id", F.col("point_id").alias("_start"))

    def small(pdf: pd.DataFrame) -> pd.DataFrame:
        gap = np.full(len(pdf), 1e300)
        gap[(pdf["point_id"] == pdf["_start"]).to_numpy()] = np.inf
        rows = _pick_farthest(pdf[list(XYZ)].to_numpy(), pdf["point_id"].to_numpy(), gap, int(pdf["_want"].iloc[0]), -1.0)
        return pdf.iloc[rows].assign(center=np.arange(len(rows)))[["cloud_id", "center", "point_id", *XYZ]]

    picked = (
        p.join(want.where(F.col("_n") <= whole), "cloud_id")
        .join(first, "cloud_id")
        .groupBy("cloud_id")
        .applyInPandas(small, schema)
    )
    big = want.where(F.col("_n") > whole).select("cloud_id", "_want")
    if is_empty(big):
        return picked

    # Ids may repeat, rows have numbers of their own.
    state = staged(p.join(big.select("cloud_id"), "cloud_id").withColumn("_row", F.monotonically_increasing_id()).withColumn("_gap", F.lit(float("inf"))))
    new = state.join(first, "cloud_id").where(F.col("point_id") == F.col("_start"))
    new = new.groupBy("cloud_id").agg(F.min_by(F.struct("point_id", *XYZ, "_row"), "_row").alias("_s"))
    new = cut(new.select("cloud_id", F.lit(0).cast("long").alias("center"), "_s.*"))
    while True:
        picked = picked.unionByName(new.drop("_row"))
        done = new.groupBy("cloud_id").agg((F.max("center") + 1).alias("_have"))
        left = cut(big.join(done, "cloud_id").where(F.col("_have") < F.col("_want")))
        if is_empty(left):
            discard(state)
            return picked
        rest = state.select("cloud_id", "point_id", *XYZ, "_row", "_gap").join(left, "cloud_id")
        near = knn_join(
            rest.select("cloud_id", F.col("_row").alias("point_id"), *XYZ),
            new.select("cloud_id", F.col("center").alias("point_id"), *XYZ),
            1,
        ).select("cloud_id", F.col("src").alias("_row"), F.col("d2").alias("_d2"))
        taken = new.select("cloud_id", "_row", F.lit(True).alias("_taken"))
        gap = F.when(F.col("_taken") | (F.col("_gap") < 0), F.lit(-1.0)).otherwise(F.least("_gap", "_d2"))
        last, state = state, staged(
            rest.join(near, ["cloud_id", "_row"])
            .join(taken, ["cloud_id", "_row"], "left")
            .withColumn("_gap", gap)
            .drop("_d2", "_taken")
        )
        discard(last)
        new = cut(_next_picks(state, pool, f"{schema}, _row bigint"))


def _next_picks(state: DataFrame, pool: int, schema: str) -> DataFrame:
    w = Window.partitionBy("cloud_id").orderBy(F.desc("_gap"), "point_id", "_row")
    top = state.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= pool + 1)

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        outside = pdf["_gap"][pdf["_r"] == pool + 1]
        floor = float(outside.iloc[0]) if len(outside) else -1.0
        inner = pdf[pdf["_r"] <= pool].sort_values("_r")
        have, need = int(pdf["_have"].iloc[0]), int(pdf["_want"].iloc[0] - pdf["_have"].iloc[0])
        rows = _pick_farthest(inner[list(XYZ)].to_numpy(), inner["point_id"].to_numpy(), inner["_gap"].to_numpy(), need, floor)
        if len(rows) == 0 and inner["_gap"].iloc[0] >= 0:  # the widest gap is tied with the outside: rank 1 has the smallest id of all ties
            rows = [0]
        return inner.iloc[rows].assign(center=have + np.arange(len(rows)))[["cloud_id", "center", "point_id", *XYZ, "_row"]]

    return top.groupBy("cloud_id").applyInPandas(step, schema)


def nearest_centres(points: DataFrame, centres: DataFrame, m: int = 1) -> DataFrame:
    """The m nearest centres of every point, earlier centres first on ties: (cloud_id, point_id, center, rank, d2)."""
    c = centres.select("cloud_id", F.col("center").alias("point_id"), *XYZ)
    q = points.select("cloud_id", F.col("point_id").cast("long").alias("point_id"), *XYZ)
    return knn_join(q, c, m).select(
        "cloud_id", F.col("src").alias("point_id"), F.col("dst").alias("center"), F.col("nn_rank").alias("rank"), "d2"
    )


def hash_order(seed: int, id_col: str = "point_id") -> Column:
    """Reproducible random order of rows: a number from the md5 of seed and id (53 bits are kept)."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


SAMPLE_BUCKETS = 65_536
SAMPLE_BUCKET_ROWS = 1024


def exact_sample(points: DataFrame, size: Column, seed: int, keys: list[str] = ("cloud_id",)) -> DataFrame:
    """Exactly ``size`` rows per group (an expression over the group size ``_n``), all columns kept.

    The rows with the smallest hashes are chosen by counting: hash ranges that lie wholly below the limit are
    kept as they are, and only the one range in which the limit falls is ranked. Nothing is sorted as a whole.
    """
    keys = list(keys)
    span = float(16**13)
    wanted = F.ceil(F.col("_n") / F.lit(float(SAMPLE_BUCKET_ROWS)))
    sizes = group_sizes(points, keys, "_n").select(
        *keys, size.cast("long").alias("_size"), F.least(F.lit(SAMPLE_BUCKETS), wanted).cast("long").alias("_buckets")
    )
    h = points.withColumn("_h", hash_order(seed)).join(sizes, keys)
    h = h.withColumn("_b", F.floor(F.col("_h") / F.lit(span) * F.col("_buckets")))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = h.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_k"), F.first("_size").alias("_limit"))
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0)))
    ranges = ranges.where(F.col("_before") < F.col("_limit"))
    inside = ranges.withColumn("_whole", F.col("_before") + F.col("_k") <= F.col("_limit")).drop("_k", "_limit")
    h = h.join(inside, [*keys, "_b"])
    local = Window.partitionBy(*keys, "_b").orderBy("_h", "point_id")
    edge = h.where(~F.col("_whole")).withColumn("_r", F.row_number().over(local))
    edge = edge.where(F.col("_before") + F.col("_r") <= F.col("_size")).drop("_r")
    return h.where("_whole").unionByName(edge).select(*points.columns)


def random_downsample(points: DataFrame, ratio: float | None = None, target_points: int | None = None,
                      seed: int = 42) -> DataFrame:
    """Random sample of exact size: by ratio (at least one point), or by target (smaller clouds stay whole)."""
    if (ratio is None) == (target_points is None):
        raise ValueError("give exactly one of ratio and target_points")
    if ratio is not None:
        if not 0 < ratio <= 1:
            raise ValueError("ratio must be in (0, 1]")
        size = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(ratio)))
    else:
        if target_points <= 0:
            raise ValueError("target_points must be positive")
        size = F.lit(target_points)
    return exact_sample(points, size, seed)


def augment_downsample(points: DataFrame, min_ratio: float, min_points: int, seed: int = 42) -> DataFrame:
    """Per-cloud random ratio in [min_ratio, 1]; clouds below ``min_points`` stay whole, others keep two or more."""
    u = hash_order(seed, "cloud_id") / F.lit(float(16**13))
    ratio = F.lit(min_ratio) + F.lit(1.0 - min_ratio) * u
    size = F.when(F.col("_n") < min_points, F.col("_n")).otherwise(
        F.greatest(F.lit(2), F.floor(F.col("_n") * ratio))
    )
    return exact_sample(points, size, seed)


def sample_queries(points: DataFrame, count: int, method: str = "fps", seed: int = 42) -> DataFrame:
    """``count`` query points per cloud, by farthest-point or random sampling; small clouds return all."""
    if method == "fps":
        return farthest_points(points, count).select("cloud_id", "point_id", *XYZ)
    if method == "random":
        return exact_sample(points, F.lit(count), seed).select("cloud_id", "point_id", *XYZ)
    raise ValueError(f"unknown sampling method {method}")


def cloud_bounds(points: DataFrame, keys: list[str] = ("cloud_id",)) -> DataFrame:
    aggs = [F.min(c).alias(f"min_{c}") for c in XYZ] + [F.max(c).alias(f"max_{c}") for c in XYZ]
    return points.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("n_points"))


def voxel_downsample(points: DataFrame, voxel: float | Column, extra: list[str] = ()) -> DataFrame:
    """One centroid per voxel (origin at the cloud's minimum), mean of ``extra`` columns."""
    v = F.lit(voxel) if isinstance(voxel, float) else voxel
    b = cloud_bounds(points).select("cloud_id", *[f"min_{c}" for c in XYZ])
    cell = [F.floor((F.col(c) - F.col(f"min_{c}")) / v).cast("long").alias(f"v{c}") for c in XYZ]
    p = points.join(b, "cloud_id").select("*", *cell)
    return p.groupBy("cloud_id", "vx", "vy", "vz").agg(
        *[F.avg(c).alias(c) for c in [*XYZ, *extra]], F.count(F.lit(1)).alias("n")
    )


def normalized_voxel_downsample(points: DataFrame, voxel: float, extra: list[str] = ()) -> DataFrame:
    """Voxel size relative to the cloud scaled into [-1, 1]; centroids come back in the original coordinates."""
    b = cloud_bounds(points)
    half = F.greatest(*[(F.col(f"max_{c}") - F.col(f"min_{c}")) / 2 for c in XYZ])
    b = b.select(
        "cloud_id", *[((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2).alias(f"_mid_{c}") for c in XYZ],
        F.when(half > 0, half).otherwise(F.lit(1.0)).alias("_half"),
    )
    scaled = points.join(b, "cloud_id")
    for c in XYZ:
        scaled = scaled.withColumn(c, (F.col(c) - F.col(f"_mid_{c}")) / F.col("_half"))
    small = voxel_downsample(scaled, voxel, list(extra)).join(b, "cloud_id")
    for c in XYZ:
        small = small.withColumn(c, F.col(c) * F.col("_half") + F.col(f"_mid_{c}"))
    return small.drop("_half", *[f"_mid_{c}" for c in XYZ])


def voxel_sizes_for_rate(points: DataFrame, rate: float, offset: float = 0.1, rungs: int = 16) -> DataFrame:
    """Per cloud a voxel size that leaves rate * N voxels within the tolerance: (cloud_id, voxel, in_band).

    ``in_band`` is false where no size does: the interval has shrunk to neighbouring doubles, or no rung narrows it.

    Every round sketches the number of voxels for ``rungs`` sizes in one aggregation, counts the most promising
    size exactly, and narrows the interval of each open cloud; a size is accepted by its exact count only.
    """
    b = cloud_bounds(points)
    longest = F.greatest(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in XYZ])
    want = b.select(
        "cloud_id", *[f"min_{c}" for c in XYZ], (F.col("n_points") * F.lit(rate)).alias("_goal"),
        F.lit(0.0).alias("_low"),
        (longest / F.pow(F.col("n_points") * F.lit(rate), F.lit(1.0 / 3.0)) + F.lit(0.001)).alias("_high"),
    )
    want, done = cut(want), None

    def cell(v: Column) -> Column:
        return F.struct(*[F.floor((F.col(c) - F.col(f"min_{c}")) / v).cast("long") for c in XYZ])

    while True:
        p = points.select("cloud_id", *XYZ).join(want, "cloud_id")
        tries = p.withColumn("_rung", F.explode(F.sequence(F.lit(1), F.lit(rungs)))).withColumn(
            "_v", F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_rung") / F.lit(float(rungs))
        )
        rung = tries.groupBy("cloud_id", "_v").agg(
            F.approx_count_distinct(F.xxhash64(cell(F.col("_v"))), 0.02).alias("_k"), F.first("_goal").alias("_goal")
        )
        over = F.col("_k") > F.col("_goal") * F.lit((1 + offset) * 1.06)
        under = F.col("_k") < F.col("_goal") * F.lit((1 - offset) * 0.94)
        best = cut(
            rung.groupBy("cloud_id").agg(
                F.min_by("_v", F.struct(F.abs(F.col("_k") - F.col("_goal")), "_v")).alias("_try"),
                F.max(F.when(over, F.col("_v"))).alias("_new_low"),
                F.min(F.when(under, F.col("_v"))).alias("_new_high"),
            )
        )
        exact = (
            p.join(best.select("cloud_id", "_try"), "cloud_id")
            .select("cloud_id", "_try", "_goal", cell(F.col("_try")).alias("_c")).distinct()
            .groupBy("cloud_id", "_try", "_goal").agg(F.count(F.lit(1)).alias("_k"))
        )
        fits = (F.col("_k") <= F.col("_goal") * F.lit(1 + offset)) & (F.col("_k") >= F.col("_goal") * F.lit(1 - offset))
        exact = cut(exact.withColumn("_fits", fits))
        many = F.col("_k") > F.col("_goal")
        left = cut(
            want.join(exact.where(~F.col("_fits")).select("cloud_id", "_k"), "cloud_id")
            .join(best, "cloud_id")
            .withColumn("_l", F.greatest("_low", "_new_low", F.when(many, F.col("_try"))))
            .withColumn("_h", F.least("_high", "_new_high", F.when(~many, F.col("_try"))))
            .withColumn("_open", (F.col("_h") - F.col("_l") > F.col("_h") * 1e-12) & ((F.col("_h") < F.col("_high")) | (F.col("_l") > F.col("_low"))))
        )
        hit = exact.where("_fits").select("cloud_id", F.col("_try").alias("voxel"), F.lit(True).alias("in_band"))
        hit = hit.unionByName(left.where(~F.col("_open")).select("cloud_id", F.col("_try").alias("voxel"), F.lit(False).alias("in_band")))
        done = hit if done is None else done.unionByName(hit)
        want = cut(left.where("_open").select(*[c for c in want.columns if c not in ("_low", "_high")], F.col("_l").alias("_low"), F.col("_h").alias("_high")))
        if is_empty(want):
            break
    return done


def rate_voxel_downsample(points: DataFrame, rate: float, offset: float = 0.1, extra: list[str] = ()) -> DataFrame:
    """Voxel means at the size that keeps about ``rate`` of each cloud; ``in_band`` tells whether the size meets it."""
    sizes = cut(voxel_sizes_for_rate(points, rate, offset))
    p = points.join(sizes.drop("in_band"), "cloud_id")
    return voxel_downsample(p, F.col("voxel"), extra).join(sizes.select("cloud_id", "in_band"), "cloud_id")


def downsample_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Points in and out per cloud, the actual ratio, and whether normals and colours are present."""
    def present(cs):
        known = [c for c in cs if c in before.columns]
        return F.max(F.col(known[0]).isNotNull().cast("long")) if len(known) == len(cs) else F.lit(0).cast("long")

    n_in = before.groupBy("cloud_id").agg(
        F.count(F.lit(1)).alias("n_in"), present(["nx", "ny", "nz"]).alias("has_normals"),
        present(["r", "g", "b"]).alias("has_colors"),
    )
    n_out = group_sizes(after, ["cloud_id"], "n_out")
    return n_in.join(n_out, "cloud_id", "left").withColumn("n_out", F.coalesce("n_out", F.lit(0))).withColumn(
        "actual_ratio", F.col("n_out") / F.col("n_in")
    )
