"""Vector arithmetic as Column expressions; everything stays inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

XYZ = ("x", "y", "z")
NORMAL = ("nx", "ny", "nz")
TRUTH = ("gx", "gy", "gz")


def cols(names) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def dot(a, b) -> Column:
    (a1, a2, a3), (b1, b2, b3) = cols(a), cols(b)
    return a1 * b1 + a2 * b2 + a3 * b3


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cross(a, b) -> list[Column]:
    (a1, a2, a3), (b1, b2, b3) = cols(a), cols(b)
    return [a2 * b3 - a3 * b2, a3 * b1 - a1 * b3, a1 * b2 - a2 * b1]


def dist2(a, b) -> Column:
    (a1, a2, a3), (b1, b2, b3) = cols(a), cols(b)
    d1, d2, d3 = a1 - b1, a2 - b2, a3 - b3
    return d1 * d1 + d2 * d2 + d3 * d3


def clamp(c: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def unit(a, eps: float = 1e-12, additive: bool = False) -> list[Column]:
    """Unit vector. ``additive``: divide by (length + eps), otherwise by max(length, eps)."""
    length = norm(a)
    scale = (length + F.lit(eps)) if additive else F.greatest(length, F.lit(eps))
    return [c / scale for c in cols(a)]


def unit_or_up(a, eps: float = 1e-12) -> list[Column]:
    """Unit vector; a vector with a NaN component becomes (0, 0, 1)."""
    bad = F.isnan(cols(a)[0]) | F.isnan(cols(a)[1]) | F.isnan(cols(a)[2])
    up = (0.0, 0.0, 1.0)
    return [F.when(bad, F.lit(u)).otherwise(c) for u, c in zip(up, unit(a, eps))]


def angle_deg(a, b, oriented: bool, eps: float = 1e-12, additive: bool = False) -> Column:
    """Angle between two vectors in degrees: 0..180 when oriented, else 0..90."""
    c = clamp(dot(unit(a, eps, additive), unit(b, eps, additive)))
    return F.degrees(F.acos(c if oriented else F.abs(c)))


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def as_flag(c: Column) -> Column:
    return F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("long")


def safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))
