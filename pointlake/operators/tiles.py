"""Bounded tiles and distributed ranks.

Neighbour search and per-cloud ranks both need pieces that fit one task although a single cloud may hold
a third of all rows. ``build_splits`` cuts oversized groups along approximate quantiles until every piece
is bounded; groups that are small already cost one counting job and no extra shuffle. The approximate
quantiles only place the borders: results built on the tiles stay exact.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from pointlake.session import cut, is_empty

FANOUT = 16  # one hexadecimal digit of the node path per level
RANK_ROWS = 1_000_000  # rows one task sorts when ranking
BUCKETS = 1024  # parts of a value range whose rows are counted in one round of a selection


@dataclass
class Splits:
    keys: list[str]
    axes: list[str]
    levels: list[DataFrame] = field(default_factory=list)
    stuck: bool = False  # an oversized tile holds one single position only


def _axis_value(axes: list[str]) -> Column:
    out = F.col(axes[-1]).cast("double")
    for i in range(len(axes) - 2, -1, -1):
        out = F.when(F.col("_axis") == i, F.col(axes[i]).cast("double")).otherwise(out)
    return out


def _below(value: Column) -> Column:
    """Number of borders strictly below ``value`` = index of the child tile that holds it."""
    return F.size(F.filter("_cuts", lambda c: c < value))


def _child(index: Column) -> Column:
    return F.concat(F.col("_node"), F.lower(F.hex(index.cast("long"))))


def _borders(tiles: DataFrame, keys: list[str], axes: list[str], limit: int, widest: bool) -> DataFrame:
    fractions = [i / FANOUT for i in range(1, FANOUT)]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, a in enumerate(axes):
        value = F.col(a).cast("double")
        aggs += [
            F.min(value).alias(f"_lo{i}"),
            F.max(value).alias(f"_hi{i}"),
            F.percentile_approx(value, fractions, 1000).alias(f"_q{i}"),
        ]
    spans = [F.col(f"_hi{i}") - F.col(f"_lo{i}") for i in range(len(axes))]
    if widest:
        top = F.greatest(*spans) if len(spans) > 1 else spans[0]
        choices = [(i, s == top) for i, s in enumerate(spans)]
    else:
        choices = [(i, s > 0) for i, s in enumerate(spans)]
    axis = F.coalesce(*[F.when(ok, F.lit(i)) for i, ok in choices], F.lit(0))
    heavy = tiles.groupBy(*keys, "_node").agg(*aggs).where(F.col("_n") > limit).withColumn("_axis", axis)

    def pick(prefix: str) -> Column:
        return F.coalesce(*[F.when(F.col("_axis") == i, F.col(f"{prefix}{i}")) for i in range(len(axes))])

    inner = F.filter(F.array_distinct(pick("_q")), lambda c: c < pick("_hi"))
    cuts = F.when(F.size(inner) > 0, inner).otherwise(F.array(pick("_lo")))
    return heavy.select(
        *keys, "_node", "_axis", cuts.alias("_cuts"), (pick("_hi") > pick("_lo")).alias("_splittable")
    )


def build_splits(
    df: DataFrame, keys: list[str], axes: list[str], limit: int, widest: bool = True
) -> Splits:
    """Find the borders that bring every tile to at most ``limit`` rows.

    ``widest`` splits along the longest axis (space); otherwise along the first axis that still varies (ranks).
    """
    out = Splits(list(keys), list(axes))
    big = df.groupBy(*keys).count().where(F.col("count") > limit).drop("count")
    if is_empty(big):
        return out
    big = cut(big)
    tiles = df.select(*keys, *axes).join(big, keys).withColumn("_node", F.lit(""))
    while True:
        level = cut(_borders(tiles, keys, axes, limit, widest))
        if not is_empty(level.where(~F.col("_splittable"))):
            out.stuck = True
        level = level.where("_splittable").drop("_splittable")
        if is_empty(level):
            return out
        out.levels.append(level)
        tiles = (
            tiles.join(level, keys + ["_node"])
            .withColumn("_node", _child(_below(_axis_value(axes))))
            .drop("_axis", "_cuts")
        )


def assign_tiles(df: DataFrame, splits: Splits) -> DataFrame:
    """Add ``_node``, the path of the one tile that holds each row."""
    out = df.withColumn("_node", F.lit(""))
    for level in splits.levels:
        out = out.join(level, splits.keys + ["_node"], "left")
        child = _child(_below(_axis_value(splits.axes)))
        out = out.withColumn("_node", F.when(F.col("_cuts").isNull(), F.col("_node")).otherwise(child))
        out = out.drop("_axis", "_cuts")
    return out


def assign_ball(df: DataFrame, splits: Splits, radius: Column) -> DataFrame:
    """One row per tile that the ball of ``radius`` around each row may touch."""
    out = df.withColumn("_radius", radius).withColumn("_node", F.lit(""))
    for level in splits.levels:
        value = _axis_value(splits.axes)
        lo, hi = _below(value - F.col("_radius")), _below(value + F.col("_radius"))
        out = out.join(level, splits.keys + ["_node"], "left")
        nodes = F.when(F.col("_cuts").isNull(), F.array("_node")).otherwise(
            F.transform(F.sequence(lo, hi), lambda i: _child(i))
        )
        out = out.withColumn("_node", F.explode(nodes)).drop("_axis", "_cuts")
    return out.drop("_radius")


def ranked(
    df: DataFrame,
    keys: list[str],
    order_by: list[Column | str],
    split_on: list[str],
    name: str = "rn",
    limit: int = RANK_ROWS,
) -> DataFrame:
    """``row_number`` per group, 1-based, without sorting a whole oversized group in one task.

    ``split_on`` are numeric columns that ``order_by`` starts with.
    """
    splits = build_splits(df, keys, split_on, limit, widest=False)
    if not splits.levels:
        w = Window.partitionBy(*keys).orderBy(*order_by)
        return df.withColumn(name, F.row_number().over(w).cast("long"))
    tagged = assign_tiles(df, splits)
    before = Window.partitionBy(*keys).orderBy("_node").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        tagged.groupBy(*keys, "_node")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    local = Window.partitionBy(*keys, "_node").orderBy(*order_by)
    return (
        tagged.withColumn("_local", F.row_number().over(local))
        .join(sizes, keys + ["_node"])
        .withColumn(name, (F.col("_before") + F.col("_local")).cast("long"))
        .drop("_before", "_local", "_node")
    )


def group_sizes(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def ordered_blocks(df: DataFrame, key: str) -> DataFrame:
    """The rows with ``_block``, numbered so that blocks follow the order of ``key``, whatever its type.

    Rows are dealt by range and kept, so every later step sees the same blocks; a block is one task's share.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, key).withColumn("_block", F.spark_partition_id()))


def dense_ordinals(ids: DataFrame, key: str) -> DataFrame:
    """(key, ordinal): 0, 1, ... in order of ``key`` over its distinct values."""
    rows = ordered_blocks(ids.select(key).distinct(), key)
    # One row per block.
    before = group_sizes(rows, ["_block"], "_n").withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    place = F.row_number().over(Window.partitionBy("_block").orderBy(key))
    return rows.withColumn("_place", place).join(before, "_block").select(
        key, (F.col("_before") + F.col("_place") - 1).cast("long").alias("ordinal")
    )


def _bucket(value: Column, low: str, high: str) -> Column:
    """Place of a value among BUCKETS equal parts of the finite range; infinities and NaN lie beyond, in Spark's order."""
    inf = F.lit(float("inf"))
    # Halves, because the difference of two large numbers may be infinite.
    share = (value / 2 - F.col(low) / 2) / (F.col(high) / 2 - F.col(low) / 2)
    inside = F.when(F.col(high) > F.col(low), F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))).otherwise(F.lit(0))
    return F.when(F.isnan(value), BUCKETS + 1).when(value == inf, BUCKETS).when(value == -inf, -1).otherwise(inside).cast("int")


def _at_rank(rows: DataFrame, keys: list[str], value: str, targets: DataFrame) -> DataFrame:
    """(keys, _rank, value) from counts of distinct values; ``_before`` rows of the group are smaller than all given."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    place = F.col("_rank") - F.col("_before")
    hit = counts.withColumn("_upto", upto).join(targets.select(*keys, "_rank", "_before"), keys)
    return hit.where((F.col("_upto") >= place) & (F.col("_upto") - F.col("_n") < place)).select(*keys, "_rank", value)


def nth_values(rows: DataFrame, keys: list[str], value: str, targets: DataFrame, limit: int = RANK_ROWS) -> DataFrame:
    """(keys, _rank, value): the values at the ranks, from 1, that ``targets(keys, _rank)`` asks for; nothing is sorted whole.

    Groups beyond ``limit`` rows are narrowed in rounds: tasks count the rows of each part of the value range, and only the
    part that holds the rank stays. A value however frequent is one number in these counts. What is left within the limit
    is decided by counts of its distinct values.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias(value))
    v = F.col(value)
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    span = [F.count(F.lit(1)).alias("_n"), F.min(v).alias("_low"), F.max(v).alias("_high"), F.min(finite).alias("_from"), F.max(finite).alias("_to")]
    state = targets.select(*keys, "_rank").distinct().join(rows.groupBy(*keys).agg(*span), keys).withColumn("_before", F.lit(0).cast("long"))
    state = cut(state)
    narrow = (F.col("_n") <= limit) | F.col("_low").eqNullSafe(F.col("_high"))
    done = state.where(narrow)
    while not is_empty(state.where(~narrow)):
        wide = state.where(~narrow).select(*keys, "_rank", "_low", "_high", "_from", "_to", "_before")
        inside = rows.join(wide, keys).where(v.between(F.col("_low"), F.col("_high")))
        parts = inside.withColumn("_part", _bucket(v, "_from", "_to")).select(*keys, "_rank", "_before", "_part", value)
        parts = parts.groupBy(*keys, "_rank", "_before", "_part").agg(*span)
        before = F.sum("_n").over(Window.partitionBy(*keys, "_rank").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        parts = parts.withColumn("_before", F.col("_before") + F.coalesce(before, F.lit(0)))
        state = cut(parts.where((F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_n"))).select(state.columns))
        done = done.unionByName(state.where(narrow))
    single = done.where(F.col("_low").eqNullSafe(F.col("_high"))).select(*keys, "_rank", F.col("_low").alias(value))
    several = done.where(~F.col("_low").eqNullSafe(F.col("_high")))
    target = [F.col("_rank").alias("_asked"), "_low", "_high", "_before"]
    held = rows.join(several.select(*keys, *target), keys).where(v.between(F.col("_low"), F.col("_high"))).select(*keys, "_asked", value)
    found = _at_rank(held, [*keys, "_asked"], value, several.select(*keys, F.col("_rank").alias("_asked"), "_rank", "_before"))
    return single.unionByName(found.drop("_asked"))


def exact_medians(
    df: DataFrame, keys: list[str], value: str, lower: bool, name: str, limit: int = RANK_ROWS
) -> DataFrame:
    """Exact median per group: the lower middle value, or the mean of both middle values.

    Groups within ``limit`` rows take one aggregation, larger ones the selection by counts.
    """
    if not keys:
        whole = exact_medians(df.withColumn("_whole", F.lit(0)), ["_whole"], value, lower, name, limit)
        return whole.drop("_whole")
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    sizes = group_sizes(rows, keys, "_n")
    big = cut(sizes.where(F.col("_n") > limit))
    middle = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}`)" if lower else f"percentile(`{value}`, 0.5)")
    if is_empty(big):
        return rows.groupBy(*keys).agg(middle.alias(name))
    small = rows.join(big, keys, "left_anti").groupBy(*keys).agg(middle.alias(name))
    ranks = [F.floor((F.col("_n") + 1) / 2)] + ([] if lower else [F.floor(F.col("_n") / 2) + 1])
    targets = big.select(*keys, F.explode(F.array(*ranks)).alias("_rank"))
    found = nth_values(rows.join(big.drop("_n"), keys, "left_semi"), keys, value, targets, limit)
    return small.unionByName(found.groupBy(*keys).agg(F.avg(value).alias(name)))
