"""Grouped map over many bounded groups.

``applyInPandas`` calls Python once per group; with millions of small clouds, tiles or patches that overhead
dominates. Here Spark partitions and sorts by the group keys and each task walks the groups of an Arrow batch,
holding at most one batch and one group. Callers make sure that groups are bounded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pointlake.session import cut, is_empty

SMALL_GRAPH_ROWS = 200_000  # rows of one graph that a task solves in memory


def _walk(pdf: pd.DataFrame, starts: np.ndarray, ends: np.ndarray, keys, fn, names, failed: list | None) -> pd.DataFrame | None:
    arrays = {c: pdf[c].to_numpy() for c in pdf.columns}
    parts, heads, counts = [], [], []
    for s, e in zip(starts, ends):
        try:
            out = fn({c: a[s:e] for c, a in arrays.items()})
        except Exception as problem:
            if failed is None:
                raise
            failed.append({**{k: arrays[k][s] for k in keys}, "error": f"{type(problem).__name__}: {problem}"})
            continue
        n = len(next(iter(out.values())))
        if n:
            parts.append(out)
            heads.append(s)
            counts.append(n)
    if not parts:
        return None
    head = np.repeat(heads, counts)
    data = {k: arrays[k][head] for k in keys}
    data.update({c: np.concatenate([p[c] for p in parts]) for c in names if c not in keys})
    return pd.DataFrame(data)[names]


def _walk_many(pdf: pd.DataFrame, starts: np.ndarray, ends: np.ndarray, keys, fn, names) -> pd.DataFrame | None:
    rows = pdf.iloc[: ends[-1]]
    group = np.repeat(np.arange(len(starts)), ends - starts)
    out = fn({c: rows[c].to_numpy() for c in rows.columns}, group)
    of = out.pop("_group")
    if not len(of):
        return None
    return pd.DataFrame({**{k: rows[k].to_numpy()[starts[of]] for k in keys}, **out})[names]


def numbered(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct (group, id), in their order, and the number of that pair for every row."""
    order = np.lexsort((ids, group))
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (np.diff(group[order]) != 0) | (ids[order][1:] != ids[order][:-1])
    number = np.empty(len(ids), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[dict], dict], schema: str, errors: bool = False, many: bool = False) -> DataFrame:
    """Apply ``fn`` (column arrays of one group -> column arrays of its result, without keys) to every group.

    With ``errors``, a group for which ``fn`` raises does not end the job: it gives one row with its keys and the column
    ``error``, which is null in all other rows; ``split_errors`` tells them apart.

    With ``many``, ``fn`` works off all whole groups of a batch in one call: it gets their columns and the number of each row's
    group, ascending, and returns the group of each row of its result as ``_group``. For groups so small that a call costs more
    than the work.
    """
    keys = list(keys)
    if errors and many:
        raise ValueError("errors of single groups need a call per group")
    names = [c.strip().split()[0] for c in schema.split(", ")]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def walked(pdf, starts, ends):
        if many:
            out = _walk_many(pdf, starts, ends, keys, fn, names)
            if out is not None:
                yield out
            return
        failed = [] if errors else None
        out = _walk(pdf, starts, ends, keys, fn, names, failed)
        if out is not None:
            yield out.assign(error=None) if errors else out
        if failed:
            bad = pd.DataFrame(failed)
            yield bad.assign(**{c: None for c in names if c not in keys})[[*names, "error"]]

    def run(batches):
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if len(pdf) == 0:
                continue
            change = np.zeros(len(pdf), dtype=bool)
            change[0] = True
            for k in keys:
                v = pdf[k].to_numpy()
                change[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(change)
            if len(starts) > 1:
                yield from walked(pdf, starts[:-1], starts[1:])
            held = pdf.iloc[starts[-1] :].reset_index(drop=True)
        if held is not None and len(held):
            yield from walked(held, np.array([0]), np.array([len(held)]))

    whole = schema + ", error string" if errors else schema
    return df.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInPandas(run, whole)


def split_errors(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(results, one (keys, error) per failed key) of a map with ``errors``; a key with any error has no results."""
    rows = cut(df)
    failed = rows.where(F.col("error").isNotNull()).groupBy(*keys).agg(F.min("error").alias("error"))
    return rows.where(F.col("error").isNull()).drop("error").join(failed.select(*keys), list(keys), "left_anti"), failed


def oversized(df: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """Keys of the groups with more than ``limit`` rows, or None when there are none (one counting job)."""
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*keys)
    return None if is_empty(big) else cut(big)


def typed(df: DataFrame, columns: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"{c} {types[c]}" for c in columns)
