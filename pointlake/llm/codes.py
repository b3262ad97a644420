"""Compression of vectors to codes: a small codebook per part of the vector, entries found by equal-average search."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pointlake.llm.common import session, staged

#: Largest whole component; differences, their squares and their sums then stay within 64 bits.
MOST = 1 << 26
#: Most vectors that are searched together.
TOGETHER = 20_000


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each part, ties to the lower index.

    Equal-average search: by Cauchy's inequality the squared difference of two sums over the dimension is no more than the
    squared distance. Entries in the order of their sums are visited outwards from the part's own sum, and a side ends
    where this bound strictly exceeds the best distance so far (equal ones may still be ties with a lower index).
    """
    n, dim = parts.shape
    sums, means = parts.sum(1), entries.sum(1)
    order = np.argsort(means, kind="stable")
    means, ranked = means[order], entries[order]
    best, index = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    start = np.searchsorted(means, sums)
    for side in (1, -1):
        # The upper side begins at the first sum that is no smaller, the lower side right below it.
        who, at = np.arange(n), start if side > 0 else start - 1
        while True:
            inside = (at >= 0) & (at < len(means))
            who, at = who[inside], at[inside]
            gap = means[at] - sums[who]
            # gap^2 / dim > best without division; the first entry of all has nothing to beat.
            near = gap * gap <= np.where(best[who] < 1 << 56, best[who] * dim, np.iinfo(np.int64).max)
            who, at = who[near], at[near]
            if not len(who):
                break
            apart = parts[who] - ranked[at]
            distance, entry = np.einsum("ij,ij->i", apart, apart), order[at]
            better = (distance < best[who]) | ((distance == best[who]) & (entry < index[who]))
            best[who[better]], index[who[better]] = distance[better], entry[better]
            at = at + side
    return index, best


def _assigned(v: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, squared distances), vectors x parts."""
    size = v.shape[1] // len(books)
    found = [nearest(np.ascontiguousarray(v[:, p * size : (p + 1) * size]), book) for p, book in enumerate(books)]
    return np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)


def _matrices(batches, dim: int):
    """(batch, vectors) in pieces of bounded size."""
    for whole in batches:
        for at in range(0, len(whole), TOGETHER):
            batch = whole.slice(at, TOGETHER)
            yield batch, batch.column("v").flatten().to_numpy().reshape(len(batch), dim)


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str, scale: float) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of each component, without vectors that are null, empty or hold a null or non-finite value."""
    x = F.col(f"`{vec_col}`")
    whole = (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(whole).select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"),
        F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long")).alias("v"),
    )


def _improved(vectors: DataFrame, books: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """Every entry replaced by the floored mean of the parts that are nearest to it; unused ones stay.

    A task sends at most one row per part and entry, whatever its number of vectors.
    """
    width = dim // len(books)
    longest = max(map(len, books))

    def sums(batches):
        slots = len(books) * longest
        total, count = np.zeros((slots, width), np.int64), np.zeros(slots, np.int64)
        for _, v in _matrices(batches, dim):
            index, _ = _assigned(v, books)
            slot = (index + np.arange(len(books)) * longest).ravel()
            np.add.at(total, slot, v.reshape(-1, width))
            count += np.bincount(slot, minlength=slots)
        used = np.flatnonzero(count)
        at, component = np.repeat(used, width), np.tile(np.arange(width), len(used))
        arrays = [pa.array(x, pa.int64()) for x in (at, component, total[used].ravel(), np.repeat(count[used], width))]
        yield pa.RecordBatch.from_arrays(arrays, ["slot", "component", "total", "n"])

    found = vectors.select("v").mapInArrow(sums, "slot long, component long, total long, n long")
    found = found.groupBy("slot", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    books = [b.copy() for b in books]
    # One row per component of an entry: as many as the codebooks have, at any size of input.
    for slot, component, total, n in found.collect():
        books[slot // longest][slot % longest, component] = int(total) // n
    return books


def compress_vectors(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64,
    rounds: int = 2, scale: float = 256.0,
) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error, label_error) per vector, the codebooks, one array (entry, component) per part).

    Components become floor(scale * x). A codebook starts as its part of the ``entries`` vectors with the smallest ids (of
    repeated ids the smallest vectors, null ids last; fewer vectors give fewer entries) and is improved in ``rounds`` over
    all vectors. ``code`` has two hex digits per part, ``error`` is the sum of squared distances, ``label_error`` that of all
    vectors with the label (nulls together). Vectors that are null or empty, hold a null or non-finite component, or have another
    dimension than the vector with the smallest id are dropped; repeated rows each give a row; an empty table gives none.
    Whole components beyond 2^26 are refused with an error, because distances would not be exact; so is a dimension that
    ``parts`` does not divide. Other columns are never read.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits allow 256 entries")
    spark = session(df)
    vectors = staged(whole_vectors(df, id_col, vec_col, label_col, scale))
    start = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).select(F.size("v").alias("dim")).first()
    dim = start.dim if start else 0
    if dim % parts:
        raise ValueError(f"{parts} equal parts of {dim} components")
    width = dim // parts
    vectors = vectors.where(F.size("v") == dim)
    most = vectors.agg(F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()[0] if dim else 0
    if (most or 0) > MOST:
        raise ValueError(f"whole components must be within {MOST}, found {most}")
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect() if dim else []
    books = [np.array([r.v[p * width : (p + 1) * width] for r in first], np.int64).reshape(len(first), width) for p in range(parts)]
    for _ in range(rounds if first else 0):
        books = _improved(vectors, books, dim)

    def encode(batches):
        for batch, v in _matrices(batches, dim):
            index, distance = _assigned(v, books)
            raw = index.astype(np.uint8).tobytes().hex()
            codes = [raw[i : i + 2 * parts] for i in range(0, len(raw), 2 * parts)]
            out = [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(distance.sum(1))]
            yield pa.RecordBatch.from_arrays(out, ["vec_id", "label", "code", "error"])

    kind = dict(vectors.dtypes)["label"]
    if first:
        coded = staged(vectors.mapInArrow(encode, f"vec_id long, label {kind}, code string, error long"))
    else:
        coded = spark.createDataFrame([], f"vec_id long, label {kind}, code string, error long")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimal numbers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def oracle(table: str, parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The same rows in DuckDB's SQL, every entry compared with every part."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, w) AS id, vec_id, label, w FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM {table}
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
c AS MATERIALIZED (
  SELECT id, i // (len(w) // {parts}) AS part, i % (len(w) // {parts}) AS pos, w[i + 1] AS x
  FROM (SELECT id, w, unnest(range(len(w))) AS i FROM v)),
b0 AS MATERIALIZED (SELECT part, id - 1 AS entry, pos, x FROM c WHERE id <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT id, part, min(d * 1000 + entry) % 1000 AS entry, min(d) AS d
  FROM (SELECT c.id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d FROM c JOIN b{k} b USING (part, pos) GROUP BY ALL)
  GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""
b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
    SELECT a.part, a.entry, c.pos, CAST((sum(c.x) - ((sum(c.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
    FROM a{k} a JOIN c USING (id, part) GROUP BY ALL) m USING (part, entry, pos))""")
    return f"""
WITH {','.join(steps)},
s AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{rounds}),
e AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY id)
SELECT v.vec_id, e.code, e.error, CAST(sum(e.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, s.codebooks_sha256
FROM v JOIN e USING (id), s
"""
