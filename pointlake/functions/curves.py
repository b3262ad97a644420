"""Space-filling curve codes of grid coordinates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf

AXIS_BITS = 21  # three axes fill 63 bits


def _any_bit(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out.bitwiseOR(t)
    return out


def z_encode(x: Column, y: Column, z: Column, bits: int = AXIS_BITS) -> Column:
    """Interleave the bits: bit i of x, y, z goes to 3i+2, 3i+1, 3i. One flat term per bit keeps generated code short."""
    terms = [
        F.shiftleft(v.cast("long").bitwiseAND(F.lit(1 << i)), 2 * i + place)
        for v, place in ((x, 2), (y, 1), (z, 0))
        for i in range(bits)
    ]
    return _any_bit(terms)


def z_decode(code: Column, bits: int = AXIS_BITS) -> list[Column]:
    return [
        _any_bit([F.shiftright(code, 2 * i + place).bitwiseAND(F.lit(1 << i)) for i in range(bits)])
        for place in (2, 1, 0)
    ]


def _turn(axes: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """Skilling's rotations between axis coordinates and the transposed Hilbert index, over whole columns."""
    a = axes.copy()
    n = a.shape[0]
    levels = range(bits - 1, 0, -1) if forward else range(1, bits)
    for bit in levels:
        low = np.int64((1 << bit) - 1)
        for d in range(n) if forward else range(n - 1, -1, -1):
            on = (a[d] >> bit) & 1 == 1
            swap = np.where(on, 0, (a[0] ^ a[d]) & low)
            a[0] ^= swap | np.where(on, low, 0)
            a[d] ^= swap
    return a


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer coordinates, one row per axis; axes * bits must not exceed 63."""
    n = axes.shape[0]
    t = _turn(axes.astype(np.int64), bits, True)
    code = np.zeros(axes.shape[1], dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for d in range(n):
            code = (code << 1) | ((t[d] >> bit) & 1)
    for shift in (1, 2, 4, 8, 16, 32):
        code ^= code >> shift
    return code


def hilbert_coords(code: np.ndarray, dims: int, bits: int) -> np.ndarray:
    gray = code ^ (code >> 1)
    t = np.zeros((dims, len(code)), dtype=np.int64)
    for bit in range(bits):
        for d in range(dims):
            t[d] |= ((gray >> (bit * dims + dims - 1 - d)) & 1) << bit
    return _turn(t, bits, False)


def _check(dims: int, bits: int) -> None:
    if dims * bits > 63:
        raise ValueError("a Hilbert code has at most 63 bits")


def hilbert_encode(x: Column, y: Column, z: Column, bits: int) -> Column:
    _check(3, bits)

    @pandas_udf("long")
    def encode(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([a, b, c]).astype(np.int64), bits))

    return encode(x.cast("long"), y.cast("long"), z.cast("long"))


def hilbert_decode(code: Column, bits: int) -> Column:
    """Struct of the grid coordinates gx, gy, gz."""
    _check(3, bits)

    @pandas_udf("struct<gx long, gy long, gz long>")
    def decode(c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(hilbert_coords(c.to_numpy(dtype=np.int64), 3, bits).T, columns=["gx", "gy", "gz"])

    return decode(code.cast("long"))


ORDERS = ("z", "z-trans", "hilbert", "hilbert-trans")


def curve_code(order: str, x: Column, y: Column, z: Column, depth: int) -> Column:
    """Code along one of the four orders; the transposed ones swap x and y."""
    if order not in ORDERS:
        raise ValueError(f"unknown curve order {order}")
    if depth > 16:
        raise ValueError("curve depth is at most 16")
    if order.endswith("-trans"):
        x, y = y, x
    return z_encode(x, y, z, max(depth, 1)) if order.startswith("z") else hilbert_encode(x, y, z, depth)
