"""Serialisation of clouds along space-filling curves, chunks along the curve, and hierarchical voxel pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pointlake.functions.curves import curve_code
from pointlake.functions.geometry import XYZ
from pointlake.operators.tiles import dense_ordinals, group_sizes, ranked

GRID = ("gx", "gy", "gz")
SPARSE_PAD = 96


def quantise(points: DataFrame, grid_size: float, origin: str = "cloud") -> DataFrame:
    """Add grid coordinates gx, gy, gz = truncated offset from the origin in cells.

    ``origin='cloud'``: the minimum of each cloud; ``'batch'``: the minimum of everything.
    """
    lows = [F.min(c).alias(f"_m{c}") for c in XYZ]
    if origin == "cloud":
        p = points.join(points.groupBy("cloud_id").agg(*lows), "cloud_id")
    else:
        low = points.agg(F.struct(*lows)).scalar()
        p = points.withColumns({f"_m{c}": low[f"_m{c}"] for c in XYZ})
    cells = {g: ((F.col(c) - F.col(f"_m{c}")) / F.lit(grid_size)).cast("long") for g, c in zip(GRID, XYZ)}
    return p.withColumns(cells).drop(*[f"_m{c}" for c in XYZ])


def sparse_shape(grid: DataFrame, pad: int = SPARSE_PAD) -> DataFrame:
    return grid.agg(*[(F.max(g) + F.lit(pad)).alias(f"shape_{g}") for g in GRID])


def curve_depth(grid: DataFrame) -> int:
    """Bits needed for the largest grid coordinate: one scalar."""
    top = grid.agg(F.max(F.greatest(*GRID))).first()[0]
    return int(top or 0).bit_length()


def cloud_ordinals(points: DataFrame) -> DataFrame:
    """Dense number of every cloud, from 0, in id order."""
    return dense_ordinals(points, "cloud_id")


def encode(grid: DataFrame, orders: list[str], depth: int | None = None) -> DataFrame:
    """Add one code column ``code_<order>`` per order, prefixed by the cloud's ordinal above the curve bits."""
    depth = curve_depth(grid) if depth is None else depth
    g = grid.join(cloud_ordinals(grid), "cloud_id")
    for order in orders:
        code = curve_code(order, *[F.col(c) for c in GRID], depth)
        over = F.shiftrightunsigned("ordinal", 63 - 3 * depth) > 0
        full = F.shiftleft("ordinal", 3 * depth).bitwiseOR(code)
        g = g.withColumn(
            code_name(order), F.when(over, F.raise_error(F.lit("curve codes exceed 63 bits"))).otherwise(full)
        )
    return g.drop("ordinal")


def code_name(order: str) -> str:
    return "code_" + order.replace("-", "_")


def serialise(coded: DataFrame, orders: list[str]) -> DataFrame:
    """Add ``rank_<order>`` from 0: the place of each point along the curve inside its cloud.

    Listing a cloud by that rank is the serialised order, and the rank is the inverse permutation.
    """
    out = coded
    for order in orders:
        c = code_name(order)
        name = "rank_" + order.replace("-", "_")
        out = ranked(out, ["cloud_id"], [c, "point_id"], [c, "point_id"], name)
        out = out.withColumn(name, F.col(name) - 1)
    return out


def curve_chunks(serialised: DataFrame, size: int, rank: str = "rank_z") -> DataFrame:
    """Chunks of ``size`` along the curve: (cloud_id, slot, chunk, point_id, borrowed).

    The incomplete last chunk of a cloud longer than one chunk is filled with the items of the preceding chunk
    in the same places; shorter clouds are not padded.
    """
    n = F.col("_n")
    r = serialised.join(group_sizes(serialised, ["cloud_id"], "_n"), "cloud_id").select(
        "cloud_id", "point_id", F.col(rank).alias("slot"), "_n"
    )
    padded = F.ceil(n / F.lit(float(size))) * size
    lent = (n > size) & (F.col("slot") >= n - size) & (F.col("slot") < padded - size)
    slots = F.when(lent, F.array(F.col("slot"), F.col("slot") + size)).otherwise(F.array(F.col("slot")))
    out = r.select("cloud_id", "point_id", "_n", F.explode(slots).alias("slot"))
    return out.select(
        "cloud_id", "slot", F.floor(F.col("slot") / F.lit(float(size))).alias("chunk"), "point_id",
        (F.col("slot") >= n).cast("long").alias("borrowed"),
    )


def pooling_depth(stride: int, depth: int) -> int:
    d = (stride - 1).bit_length()
    return 0 if d > depth else d


def pool(coded: DataFrame, features: list[str], stride: int, depth: int, reduce: str = "max",
         code: str = "code_z") -> DataFrame:
    """Merge points whose code agrees above the pooled bits: reduced features, mean position, grid of the head."""
    d = pooling_depth(stride, depth)
    how = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}
    if reduce not in how:
        raise ValueError(f"unknown reduction {reduce}")
    head = F.min_by(F.struct(*GRID), "point_id")
    agg = coded.groupBy("cloud_id", F.shiftright(code, 3 * d).alias("code")).agg(
        *[how[reduce](f).alias(f) for f in features],
        *[F.avg(c).alias(c) for c in XYZ],
        head.alias("_head"), F.count(F.lit(1)).alias("n"),
    )
    return agg.withColumns({g: F.shiftright(F.col(f"_head.{g}"), d) for g in GRID}).drop("_head")


def unpool(coded: DataFrame, pooled: DataFrame, features: list[str], stride: int, depth: int,
           code: str = "code_z") -> DataFrame:
    """Add the parent's features to those of every member."""
    d = pooling_depth(stride, depth)
    up = pooled.select("cloud_id", F.col("code").alias("_parent"), *[F.col(f).alias(f"_up_{f}") for f in features])
    m = coded.withColumn("_parent", F.shiftright(code, 3 * d)).join(up, ["cloud_id", "_parent"])
    added: dict[str, Column] = {f: F.col(f) + F.col(f"_up_{f}") for f in features}
    return m.withColumns(added).drop("_parent", *[f"_up_{f}" for f in features])
