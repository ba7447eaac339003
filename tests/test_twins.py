"""Every registered query with a twin gives the rows its SQL gives."""

import pytest
from check_twins import compare, duck

import __spark_entry__ as entry
from reportlens.plans.queries import REGISTRY
from reportlens.plans.twins import TWINS

HEAVY = {"stream_extract", "stream_audit", "stream_chunks"}  # covered by test_streaming
#: Approximate search; held to exact search in test_search.py.
NO_SQL = {"vector_topk_ivf"}
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n not in HEAVY])
def test_twin(name, spark, sf, con):
    assert compare(QUERIES[name](spark, sf), con, entry.oracle_sql()[name]) == ""


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(QUERIES)
    assert set(REGISTRY) - set(TWINS) == NO_SQL


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns[:3] == ["document_id", "company", "year"] and rows.count() > 0
