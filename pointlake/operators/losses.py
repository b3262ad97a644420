"""Loss evaluation as column expressions and aggregates, by name. Clouds weigh by their number of points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pointlake.functions.geometry import NORMAL, TRUTH, cols, cross, dot, norm, sigmoid, unit


def bce(logit: Column, target: Column) -> Column:
    """Binary cross entropy from logits, in the form that cannot overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def focal(logit: Column, target: Column, alpha: float, gamma: float) -> Column:
    e = bce(logit, target)
    return F.lit(alpha) * F.pow(F.lit(1.0) - F.exp(-e), F.lit(gamma)) * e


def _mean_of(point_loss: Callable[[Column, Column], Column]):
    return lambda z, t: F.avg(point_loss(z, t))


def _dice(z: Column, t: Column) -> Column:
    p = sigmoid(z)
    return F.lit(1.0) - (F.lit(2.0) * F.sum(p * t) + 1.0) / (F.sum(p) + F.sum(t) + 1.0)


def label_loss(name: str, alpha: float = 0.25, gamma: float = 2.0) -> Callable[[Column, Column], Column]:
    """Aggregate expression of a label loss; the flip-aware ones take the better of target and complement."""
    base = {
        "bce": _mean_of(bce),
        "focal": _mean_of(lambda z, t: focal(z, t, alpha, gamma)),
        "dice": _dice,
    }
    if name in base:
        return base[name]
    flip = {"flip_bce": "bce", "flip_focal": "focal", "flip_dice": "dice", "bifocal": "focal"}
    if name not in flip:
        raise ValueError(f"unknown label loss {name}")
    inner = base[flip[name]]
    return lambda z, t: F.least(inner(z, t), inner(z, F.lit(1.0) - t))


LABEL_LOSSES = ["bce", "focal", "dice", "flip_bce", "flip_focal", "flip_dice", "bifocal"]


def evaluate_label_losses(df: DataFrame, names: list[str] = LABEL_LOSSES, cloud: str = "cloud_id") -> DataFrame:
    z, t = F.col("logit"), F.col("target").cast("double")
    per = df.groupBy(cloud).agg(F.count(F.lit(1)).alias("_n"), *[label_loss(n)(z, t).alias(n) for n in names])
    return per.agg(*[(F.sum(F.col(n) * F.col("_n")) / F.sum("_n")).alias(n) for n in names])


def normal_loss_terms(pred=NORMAL, truth=TRUTH) -> dict[str, Column]:
    """Aggregate expressions of the elementary normal losses against unit truth vectors."""
    g = unit(truth)
    d = dot(pred, g)
    sign = F.signum(d)
    p = cols(pred)
    inline = sum((F.abs(a - b * sign) for a, b in zip(p, g)), F.lit(0.0))
    square = sum(((a - b) * (a - b) for a, b in zip(p, g)), F.lit(0.0))
    off = norm(pred) - F.lit(1.0)
    return {
        "oriented": F.avg(F.lit(1.0) - d),
        "absolute": F.avg(F.lit(1.0) - F.abs(d)),
        "inline": F.avg(inline) / 3.0,
        "eikonal": F.avg(off * off),
        "sine": F.avg(norm(cross(pred, g))),
        "mse": F.avg(square) / 3.0,
    }


def evaluate_normal_losses(df: DataFrame, keys: list[str] = (), oriented_weight: float = 0.5,
                           unoriented_weight: float = 0.5, mse_weight: float = 1.0, sin_weight: float = 1.0,
                           pred=NORMAL, truth=TRUTH) -> DataFrame:
    terms = normal_loss_terms(pred, truth)
    agg = df.groupBy(*keys).agg(*[c.alias(n) for n, c in terms.items()])
    agg = agg.withColumn("unoriented", F.col("absolute") + F.col("inline") + F.col("eikonal"))
    return agg.withColumn(
        "combined", F.lit(oriented_weight) * F.col("oriented") + F.lit(unoriented_weight) * F.col("unoriented")
    ).withColumn("mse_sine", F.lit(mse_weight) * F.col("mse") + F.lit(sin_weight) * F.col("sine"))


def loss_by_name(name: str) -> Callable[[DataFrame], DataFrame]:
    """Pluggable loss: a function from rows to one row with the column ``loss``."""
    if name in LABEL_LOSSES:
        return lambda df: evaluate_label_losses(df, [name]).withColumnRenamed(name, "loss")
    known = {"oriented_normal": "oriented", "unoriented_normal": "unoriented", "combined_normal": "combined",
             "mse_sine_normal": "mse_sine"}
    if name not in known:
        raise ValueError(f"unknown loss {name}")
    return lambda df: evaluate_normal_losses(df).select(F.col(known[name]).alias("loss"))
