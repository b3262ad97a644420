"""The pipeline stage by stage, each against its own input."""

import importlib
from collections import Counter

import corpus_pipeline
from pointlake.llm import queries
from tests.llm.test_dedup import plain_removal, plain_similar
from tests.llm.test_quality_and_licenses import plain_counts
from tests.llm.test_tokens_and_packing import check_sequences


def test_stages_follow_each_other(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.selectExpr("*", "'k' AS kept", "lang AS fp", "1 AS row", "'q' AS keep_0", "source AS quality")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "suffix-array dedup", "best-fit packing"]
    tables = [extra.collect()]
    at = extra
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        if k < 3:
            assert out.columns == extra.columns and out.dtypes == extra.dtypes
        at = spark.read.parquet(f"{tmp_path}/{k}")
        tables.append(at.collect())
    raw, good, single, clean, packed = tables
    assert {r.doc_id for r in good} <= {r.doc_id for r in raw} and all(plain_counts(r.text)[0] >= 50 for r in good)
    rows = {r.doc_id: r for r in raw}
    assert all(r == rows[r.doc_id] for r in good + single)
    assert len({r.text for r in single}) == len(single)
    assert {r.doc_id for r in single} == set(plain_similar([(r.doc_id, r.text) for r in good], 5, 0.8).values())
    want = Counter((d, bytes(x).decode("utf-8", "ignore")) for (d, _, _, _, x), n in plain_removal([(r.doc_id, r.text) for r in single], 50).items() for _ in range(n))
    assert Counter((r.doc_id, r.text) for r in clean) == want and all(r.n_chars == len(r.text) for r in clean)
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean}
    check_sequences(packed, 2048)
    whole = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole) == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)


def test_stages_bear_hard_rows(spark, sf, hard, tmp_path):
    at = hard
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, sf).write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
    empty = hard.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).collect() == []


def test_all_queries_are_registered():
    names = set(queries.QUERIES)
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and len(names) == 14
    assert set(queries.ORACLES) <= names and importlib.import_module("__spark_entry__").queries().keys() >= names
