"""Rows that fits read many times are written and removed again; none are cached in executor memory."""

import os

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from plumbline.operators import models
from plumbline.operators.assembly import Policy
from plumbline.plans import experiment as ex
from plumbline.plans import fixtures as fx
from plumbline.session import Stored

SMALL = "/root/testdata/sf0.001"
small = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables absent")


class Spy:
    """Predicts a constant and notes how the rows it is fitted on are kept."""

    def __init__(self):
        self.cached, self.files = [], []

    def fit(self, df, label, weight=None, valid=None):
        self.cached.append(df.storageLevel.useMemory)
        self.files += [f.removeprefix("file://") for f in df.inputFiles()]
        assert all(os.path.exists(f) for f in self.files[-1:])
        return models.LinearFitted([0.0] * len(df.first()["features"]), 1.0)

    def check(self):
        assert self.cached and not any(self.cached)
        assert self.files and not any(os.path.exists(f) for f in self.files)


def test_stored_rows_are_the_same_until_they_go(spark):
    df = VectorAssembler(inputCols=["id", "b"], outputCol="features").transform(spark.range(50).withColumn("b", F.col("id") * 2.0))
    kept = Stored(df)
    assert kept.rows.schema["features"].metadata == df.schema["features"].metadata != {}
    assert sorted(map(str, kept.rows.collect())) == sorted(map(str, df.collect()))
    kept.drop()
    assert not os.path.exists(kept.path.removeprefix("file://"))


def test_residuals_read_written_rows(spark):
    df = VectorAssembler(inputCols=["id"], outputCol="features").transform(spark.range(50).withColumn("y", F.col("id") * 2.0))
    spy = Spy()
    models.Stacked(models.build_model("LinearRegression"), [spy]).fit(df, "y")
    spy.check()


def test_quantile_regression_reads_written_rows(spark, monkeypatch):
    from plumbline.operators import select

    df = VectorAssembler(inputCols=["id"], outputCol="features").transform(spark.range(200).withColumn("y", F.col("id") * 2.0))
    seen = []
    plain = select.quantile_regression
    monkeypatch.setattr(select, "quantile_regression", lambda rows, *a, **k: seen.append(rows.storageLevel.useMemory) or plain(rows, *a, **k))
    fitted = models.QuantileRegression().fit(df, "y")
    assert seen == [False] and fitted.weights[0] == pytest.approx(2.0, abs=0.1)


@small
def test_tuned_folds_read_written_rows(spark, monkeypatch):
    spy = Spy()
    monkeypatch.setitem(models.BASE_MODELS, "Spy", lambda p, seed: spy)
    cfg = ex.ExperimentConfig(outer_folds=2, inner_folds=2, n_trials=1)
    df = fx.listings(spark, SMALL).select("row_key", "price", "mileage", "mpg")
    out = ex.NestedCV(df, fx.Roles("price", ("mileage", "mpg"), ()), cfg, ["Spy"], policies={"Spy": Policy("target", None, "scale")}).run()
    assert out.results.count() == 2
    spy.check()
    assert not out.entries[0].rows.storageLevel.useMemory


@small
def test_named_queries_read_written_rows(spark, monkeypatch):
    from plumbline.plans.queries import explanation
    from plumbline.plans.queries.models import _trained

    spy = Spy()
    assert _trained(spark, SMALL, spy, "Spy").count() == 1
    spy.check()
    other = Spy()
    monkeypatch.setitem(models.BASE_MODELS, "Spy", lambda p, seed: other)
    assert len(explanation._fold_entries(spark, SMALL, "Spy", {}, "tree")) == fx.FOLDS
    other.check()
