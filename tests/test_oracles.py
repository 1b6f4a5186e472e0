"""A sample of the named queries against their SQL; ``tests/oracle.py`` runs all of them."""

import os

import pytest

from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
NAMES = (
    "a2_union_by_name", "b1_sanitize_columns", "b9_clean_labels", "c3_top_levels", "d3_mileage_bin",
    "e5_out_of_fold_encoding", "f1_kfold", "h8_best_trial", "j8_baseline_delta", "k1e_best_worst",
)
# MAE per fold of the flagship query at sf0.01.
GOLDEN = {0: 27490.2308, 1: 27312.8090, 2: 27213.1428, 3: 27274.9069, 4: 27355.0421}

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables absent")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    assert compare(queries()[name](spark, SMALL), connect(SMALL), oracle_sql()[name]) is None


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_flagship(spark):
    assert entry(spark).count() == 5
    got = {r["outer_fold"]: r["MAE"] for r in queries()["i_fold_metrics"](spark, MEDIUM).collect()}
    assert got == pytest.approx(GOLDEN, abs=1e-3)
