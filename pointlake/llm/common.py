"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pointlake.session import discard, staged, tune  # noqa: F401

#: Rows of an Arrow batch, so that a batch of long texts stays in memory.
BATCH_ROWS = 1000


def session(df_or_spark) -> SparkSession:
    """The session with the settings all operators rely on."""
    spark = df_or_spark if isinstance(df_or_spark, SparkSession) else df_or_spark.sparkSession
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ids_and_texts(df: DataFrame, id_col: str, text_col: str, keep: list[str] = ()) -> DataFrame:
    """(doc_id, text, keep_0, ...) only: other columns, whatever their names, are never read. A null text is the empty text.

    Kept columns travel under numbers, so that their names cannot clash; ``restored`` gives them back.
    """
    kept = [F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)]
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *kept)


def kept_schema(rows: DataFrame) -> str:
    """The numbered columns of ``rows`` as the end of a schema string."""
    return "".join(f", {n} {t}" for n, t in rows.dtypes if n.startswith("keep_"))


def kept_names(rows: DataFrame) -> list[str]:
    return [n for n in rows.columns if n.startswith("keep_")]


def restored(rows: DataFrame, keep: list[str], new: dict[str, Column] | None = None) -> DataFrame:
    """The kept columns under their own names, some of them replaced by ``new``."""
    new = new or {}
    return rows.select(*(new.get(c, F.col(f"keep_{i}")).alias(c) for i, c in enumerate(keep)))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds at most ``most`` bytes in each (or one row)."""
    for batch in batches:
        texts = batch.column(column)
        if not len(texts):
            continue
        lengths = pc.binary_length(texts).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and total + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n or 0
        yield batch.slice(start)


def packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers below 2^48 as differences, by byte planes; all but the lowest plane compress."""
    if not len(numbers):
        return b""
    steps = np.diff(numbers.astype(np.uint64), prepend=np.uint64(0)).astype("<u8")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :6].T)
    return zlib.compress(planes[1:].tobytes(), 1) + planes[0].tobytes()


def unpacked(data: bytes, count: int) -> np.ndarray:
    """The ``count`` numbers of ``packed``."""
    if not count:
        return np.zeros(0, np.uint64)
    planes = np.zeros((count, 8), np.uint8)
    planes[:, 0] = np.frombuffer(data, np.uint8, count, len(data) - count)
    planes[:, 1:6] = np.frombuffer(zlib.decompress(data[:-count]), np.uint8).reshape(5, count).T
    return np.cumsum(planes.reshape(-1).view("<u8").astype(np.uint64), dtype=np.uint64)


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on the machine that asks; executors resolve it themselves."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
