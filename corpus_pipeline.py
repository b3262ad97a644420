"""From raw documents to packed sequences: quality rules, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pointlake.llm import packing, quality, simhash, suffix
from pointlake.llm.common import restored, staged, table

#: No SQL: fingerprints, suffix arrays and packing are beyond it. The tests hold run() against plain Python.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are more likely bad than good go."""
    return restored(quality.score_quality(docs, keep=docs.columns).where("kept"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id.

    Near are texts whose sets of five-word shingles have a similarity of 0.8 or more. Fingerprints of such texts mostly
    differ in 12 bits or less; an exact search over the shingles finds the others.
    """
    out = simhash.near_duplicates(docs, width=5, radius=12, keep=docs.columns, least_similarity=0.8)
    return restored(out.where("stays"), docs.columns)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has as well go from the text; all documents stay."""
    out = suffix.remove_repeats(docs, length=50, keep=docs.columns, as_text=True)
    return restored(out, docs.columns, {"text": F.col("kept"), "n_chars": F.length("kept").cast(dict(docs.dtypes).get("n_chars", "long"))})


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, limit=2048, end_id=0)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each read from what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
