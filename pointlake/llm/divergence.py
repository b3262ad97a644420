"""Divergence of sources by their words: one-hot level products give the joint count tables of all pairs of sources.

For a block of terms, every (source, count) that occurs is a column of ones and zeros. The product of these columns with
their transpose says how many terms have count c in one source and d in another; with a price per (source, count) that
joint table yields the distance of the two sources. Products are exact (counts of a block's terms) and blocked both by
terms of similar frequency, which share few counts, and by sources.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from pointlake.llm.common import by_bytes, discard, session, staged

BATCH_BYTES, PIECE_BYTES = 8 << 20, 4 << 20
#: Entries of a task's counters before they are handed on.
HELD_TERMS = 400_000
#: Terms and sources of a block (on average), and most columns of one side of a product.
BLOCK_TERMS, BLOCK_SOURCES, COLUMNS = 512, 32, 2048
#: Letters in lower case, every other ASCII byte as a space; bytes of longer characters stay.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def pieces(text: bytes):
    """Lists of a text's terms, each of at most PIECE_BYTES of text (or one longer term)."""
    plain, at = text.translate(TERM_BYTES), 0
    while at < len(plain):
        cut = len(plain)
        if cut - at > PIECE_BYTES:
            cut = plain.rfind(b" ", at, at + PIECE_BYTES)
            if cut < 0:
                cut = plain.find(b" ", at + PIECE_BYTES)
                cut = len(plain) if cut < 0 else cut
        yield plain[at:cut].split()
        at = cut + 1


def term_counts(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, and a row without a term per source.

    Counted in tasks first, so that a source with a third of all documents sends no more rows than its tasks have terms.
    """
    session(df)
    rows = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))

    def flush(held):
        lang, source, term, n, docs = [], [], [], [], []
        for (l, s), (times, texts) in held.items():
            k = len(times) + 1
            lang += [l] * k
            source += [s] * k
            term += [None, *times]
            n += [0, *times.values()]
            docs += [0, *map(texts.__getitem__, times)]
        arrays = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])

    def run(batches):
        held, size = {}, 0
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            columns = (batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist())
            for lang, source, text in zip(*columns):
                times, texts = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(times)
                seen: set[bytes] = set()
                for words in pieces(text):
                    times.update(words)
                    new = set(words) - seen if seen else set(words)
                    texts.update(new)
                    seen |= new
                size += len(times)
                if size > HELD_TERMS:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)

    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, kinds: str):
    """1 + floor(10^9 (n + 5) / (total + 5 kinds)), in whole numbers throughout."""
    return F.expr(f"1L + (CAST({n} + 5 AS DECIMAL(20, 0)) * CAST(1000000000 AS DECIMAL(10, 0))) div CAST({total} + 5 * {kinds} AS DECIMAL(20, 0))")


def level_columns(counts: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indicators, price of each column, first column of each source) of counts (terms x sources)."""
    order = np.argsort(counts, axis=0, kind="stable")
    ranked = np.take_along_axis(counts, order, 0)
    level = np.concatenate([np.zeros((1, counts.shape[1]), np.int64), np.cumsum(ranked[1:] != ranked[:-1], axis=0)])
    sizes = level[-1] + 1
    starts = np.cumsum(sizes) - sizes
    column = np.empty_like(level)
    np.put_along_axis(column, order, level + starts, 0)
    ones = np.zeros((len(counts), int(sizes.sum())), np.float32)
    ones[np.arange(len(counts))[:, None], column] = 1
    price = np.zeros(ones.shape[1], np.int64)
    price[column] = shares
    return ones, price, starts


def distances(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sum over the terms of |share in a source of a - share in a source of b|, from the joint tables of their counts.

    A side is (counts, shares), both terms x sources. Blocks whose indicators have too many columns are halved by terms.
    """
    if not len(a[0]):
        return np.zeros((a[0].shape[1], b[0].shape[1]), np.int64)
    (left, price_a, at_a), (right, price_b, at_b) = (level_columns(*side) for side in (a, b))
    if max(left.shape[1], right.shape[1]) > COLUMNS and len(left) > 1:
        half = len(left) // 2
        return distances(*((c[:half], s[:half]) for c, s in (a, b))) + distances(*((c[half:], s[half:]) for c, s in (a, b)))
    joint = (left.T @ right).astype(np.int64)  # at most the number of terms, exact in 32-bit floats
    priced = joint * np.abs(price_a[:, None] - price_b[None, :])
    return np.add.reduceat(np.add.reduceat(priced, at_a, axis=0), at_b, axis=1)


def _dense(tile, width: int) -> tuple[list, np.ndarray, np.ndarray]:
    """(sources, counts, shares) of a tile: terms x sources, zeros included."""
    sources, cells = tile["sources"].values, tile["cells"].values
    counts = np.zeros((width, len(sources)), np.int64)
    shares = np.tile(sources.field("zero").to_numpy(zero_copy_only=False), (width, 1)).astype(np.int64)
    if cells is not None and len(cells):
        slot, place = (cells.field(c).to_numpy(zero_copy_only=False) for c in ("slot", "place"))
        counts[slot, place] = cells.field("n").to_numpy(zero_copy_only=False)
        shares[slot, place] = cells.field("share").to_numpy(zero_copy_only=False)
    return sources.field("source").to_pylist(), counts, shares


def _priced(batches):
    for batch in batches:
        for lang, width, tiles in zip(batch.column("lang").to_pylist(), batch.column("width").to_pylist(), batch.column("tiles")):
            sides = [_dense(t, width) for t in tiles.values]
            a, b = sides[0], sides[-1]
            value = distances(a[1:], b[1:])
            i, j = np.nonzero(np.triu(np.ones(value.shape, bool), 1)) if len(sides) == 1 else np.nonzero(np.ones(value.shape, bool))
            out = [[lang] * len(i), [a[0][k] for k in i], [b[0][k] for k in j]]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in out), pa.array(value[i, j], pa.int64())], ["lang", "source", "item", "value"])


def audit_sources(
    df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 30, top: int = 50
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the words of each source are from those of its language's others.

    Terms are runs of letters A-Z, lower-cased, and of characters beyond ASCII; a language keeps those in at least
    ``least_docs`` of its rows. With V kept terms, the share of a term with count n of N is 1 + floor(10^9 (n + 5) / (N + 5 V)).
    Part ``pair`` has the summed difference of shares to every other source of the language, part ``term`` the ``top`` terms
    that a source uses by more than its language does, both by value descending and item ascending. Null texts, languages
    and sources are empty strings and groups like any other; repeated rows are documents of their own; a language without
    kept terms has pairs of value 0; an empty table gives no rows; other columns are never read.
    """
    cells = staged(term_counts(df, lang_col, source_col, text_col))
    vocabulary = cells.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    # Terms of a block have totals of the same binary length: rare ones share their few counts.
    vocabulary = vocabulary.select("lang", "term", "total", F.length(F.bin("total")).alias("class"))
    parts = vocabulary.groupBy("lang", "class").agg(F.ceil(F.count(F.lit(1)) / BLOCK_TERMS).alias("parts"))
    block = W.partitionBy("lang", "class", "part").orderBy("term")
    vocabulary = staged(
        vocabulary.join(parts, ["lang", "class"]).withColumn("part", F.pmod(F.xxhash64("term"), "parts"))
        .repartition("lang", "class", "part")  # else the join's dealing, by class alone, would serve the window
        .withColumn("slot", (F.row_number().over(block) - 1).cast("int")).drop("parts")
    )
    langs = cells.select("lang").distinct().join(vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("total").alias("lang_n")), "lang", "left").na.fill(0)
    kept = staged(cells.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "total", "class", "part", "slot"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    groups = cells.where("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left").na.fill(0, ["source_n"]).join(langs, "lang")
    buckets = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SOURCES).alias("buckets"))
    groups = groups.join(buckets, "lang").withColumn("bucket", F.pmod(F.xxhash64("source"), "buckets"))
    groups = groups.withColumn("place", (F.row_number().over(W.partitionBy("lang", "bucket").orderBy("source")) - 1).cast("int"))
    groups = staged(groups.withColumn("zero", F.when(F.col("kinds") > 0, _share("0L", "source_n", "kinds")).otherwise(F.lit(0))))
    discard(cells)
    shares = kept.join(groups, ["lang", "source"]).withColumn("share", _share("n", "source_n", "kinds")).withColumn("common", _share("total", "lang_n", "kinds"))

    above = shares.where((F.col("n") > 0) & (F.col("share") > F.col("common"))).select("lang", "source", F.col("term").alias("item"), (F.col("share") - F.col("common")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    terms = above.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term"))

    cell = F.struct("slot", "place", "n", "share")
    filled = shares.groupBy("lang", "class", "part", "bucket").agg(F.collect_list(cell).alias("cells"))
    blocks = vocabulary.groupBy("lang", "class", "part").agg(F.count(F.lit(1)).cast("int").alias("width"))
    # A language without kept terms has one block of none.
    blocks = groups.select("lang").distinct().join(blocks, "lang", "left").na.fill(0)
    sources = groups.groupBy("lang", "bucket", "buckets").agg(F.array_sort(F.collect_list(F.struct("place", "source", "zero"))).alias("sources"))
    tiles = blocks.join(sources, "lang").join(filled, ["lang", "class", "part", "bucket"], "left")
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)))
    meets = tiles.groupBy("lang", "class", "part", F.least("bucket", "other").alias("low"), F.greatest("bucket", "other").alias("high")).agg(
        F.first("width").alias("width"), F.array_sort(F.collect_list(F.struct("bucket", "sources", "cells"))).alias("tiles")
    )
    # A bucket without sources has no tile to meet.
    meets = meets.where((F.col("low") == F.col("high")) | (F.size("tiles") == 2))
    apart = meets.select("lang", "width", "tiles").mapInArrow(_priced, "lang string, source string, item string, value long")
    apart = apart.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = apart.select("lang", both.alias("pair"), "value").select("lang", "pair.source", "pair.item", "value")
    pairs = pairs.withColumn("rank", rank).withColumn("part", F.lit("pair"))
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*names).unionByName(terms.select(*names))


def oracle(documents: str, least_docs: int = 30, top: int = 50) -> str:
    """The same rows in DuckDB's SQL, by counting and joining."""
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM {documents}),
c AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM c GROUP BY ALL HAVING count(DISTINCT id) >= {least_docs}),
l AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT lang, source, term, count(*) AS cnt FROM c SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(cnt)::HUGEINT AS n FROM x GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(x.cnt, 0) AS cnt,
    (1 + (1000000000::HUGEINT * (coalesce(x.cnt, 0) + 5)) // (coalesce(s.n, 0) + 5 * l.v))::BIGINT AS share,
    (1 + (1000000000::HUGEINT * (k.total + 5)) // (l.n + 5 * l.v))::BIGINT AS common
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term
    LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
a AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.share - b.share)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(a.value, 0)::BIGINT AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN a ON a.lang = g.lang AND a.source = g.source AND a.item = h.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, share - common AS value FROM p WHERE cnt > 0 AND share > common),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= {top}
"""
