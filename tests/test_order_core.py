"""Queries that rest on order statistics, with few rows to a task and with many, against their SQL."""

import os

import pytest

from __spark_entry__ import oracle_sql, queries
from oracle import compare, connect
from plumbline.functions import ordering

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables absent")
NAMES = (
    "c2_numeric_summary", "f1_exact_kfold", "f5_evenly_spaced", "i4_medae", "h4_median_pruning", "h10_aggregate_parameters", "j3_paired_tests",
    "j4_signed_rank", "k1c_spearman",
)


@pytest.mark.parametrize("target", [50, 10**6])
@pytest.mark.parametrize("name", NAMES)
def test_same_results_whatever_a_task_holds(spark, monkeypatch, name, target):
    monkeypatch.setattr(ordering, "TARGET_ROWS", target)
    assert compare(queries()[name](spark, SMALL), connect(SMALL), oracle_sql()[name]) is None
