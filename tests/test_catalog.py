"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle_tool import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    n, problem = compare(spark, con, name, QUERIES, ORACLES, sf)
    assert n > 0 and not problem


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_edge_model_scores_all_variants(spark, sf):
    from pointlake.catalog import orient_queries
    from pointlake.catalog.registry import QUERIES
    from pointlake.operators.orient import edge_samples

    samples = edge_samples(orient_queries._emb_features(spark, sf), 3).selectExpr("cloud_id", "i", "j", "variant")
    scored = QUERIES["edge_model_scores"](spark, sf).select("cloud_id", "src", "dst", "variant")
    want, got = (sorted(map(tuple, t.collect())) for t in (samples, scored))
    assert want == got and {r[3] for r in got} == {0, 1, 2, 3}
