"""Named queries of the corpus operators over the whole test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline

from pointlake.llm import codes, divergence, html, jaccard, licenses, packing, quality, simhash, spm, suffix, tokens, topk, url_filter
from pointlake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: host, path, verdict
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


QUERIES["pipeline"] = corpus_pipeline.run


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_url_filters(spark, sf_dir):
    """Every page URL judged by the fixed rules."""
    pages = table(spark, sf_dir, "pages")
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, URL_RULES))} AS rules(host, path, verdict)")
    return url_filter.filter_urls(pages, rules)


ORACLES["op1_url_filters"] = f"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rhost, rpath, verdict) AS (VALUES {', '.join(str(r) for r in URL_RULES)}),
m AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM p JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""


@query
def op3_best_fit_packing(spark, sf_dir):
    """Documents packed into sequences of 2048 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), limit=2048, end_id=0)


@query
def op9_token_counts(spark, sf_dir):
    """Bytes and byte-level BPE tokens of every document."""
    return tokens.token_counts(table(spark, sf_dir, "documents"), limit=1024)


@query
def op10_sentencepiece(spark, sf_dir):
    """Digests of the ids of every document and of the text they decode to."""
    return spm.piece_digests(table(spark, sf_dir, "documents"))


@query
def op8_license_scans(spark, sf_dir):
    """Licence phrases and notices of every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


ORACLES["op8_license_scans"] = licenses.oracle("documents")


@query
def op7_quality_rules(spark, sf_dir):
    """Counts, base rules and verdict of every document."""
    out = quality.score_quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@query
def op4_exact_top_k(spark, sf_dir):
    """The five best of all vectors for every fiftieth."""
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.exact_top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


ORACLES["op4_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


@query
def op5_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_suffix_dedup(spark, sf_dir):
    """What is left of every document without the 50-byte strings of documents with a smaller id."""
    out = suffix.remove_repeats(table(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_html_extraction(spark, sf_dir):
    """Main text of every page."""
    return html.extract_text(table(spark, sf_dir, "pages"))


@query
def op11_vector_codes(spark, sf_dir):
    """Code and error of every vector with codebooks fitted to all of them."""
    coded, books = codes.compress_vectors(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    digest = F.lit(codes.codebooks_digest(books)).alias("codebooks_sha256")
    return coded.select("vec_id", "code", "error", "label_error", digest)


ORACLES["op11_vector_codes"] = codes.oracle("embeddings")


@query
def op12_ngram_jaccard(spark, sf_dir):
    """Size of the shingle set and component of every document."""
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), width=3, percent=90)


@query
def op13_source_divergence(spark, sf_dir):
    """How far the words of each source are from those of the other sources of its language."""
    return divergence.audit_sources(table(spark, sf_dir, "documents"), least_docs=30, top=50)


ORACLES["op13_source_divergence"] = divergence.oracle("documents")
