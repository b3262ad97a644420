"""Registry of named queries, each with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pointlake.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Counts as bigint, flags as bigint, doubles rounded; other columns as they are."""
    out = []
    for name, dtype in df.dtypes:
        if dtype in ("double", "float"):
            out.append(rnd(name, digits).alias(name))
        elif dtype in ("int", "smallint", "tinyint", "bigint", "boolean"):
            out.append(F.col(name).cast("long").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)
