"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from civilspark.plans.oracle import ORACLE as SQL
from civilspark.plans.registry import QUERIES

# Fits take a while and have no SQL; the operators behind them are tested in
# test_models.
FITS = {
    "tfidf_logreg_eval",
    "class_probabilities",
    "w2v_mlp_eval",
    "select_best_val",
    "binary_heads_fit",
}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_every_query_has_sql_or_is_a_fit():
    assert set(QUERIES) - set(SQL) == FITS
    assert set(SQL) <= set(QUERIES)


def test_the_entry_has_all_queries():
    assert queries().keys() >= QUERIES.keys() and oracle_sql().keys() >= SQL.keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, small, con, name):
    assert differences(QUERIES[name](spark, small), con, SQL[name]) is None


def test_entry(spark):
    report = entry(spark)
    assert report.columns[:3] == ["doc_id", "Comment", "Status"]
    assert report.count() == 200
