import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import assembly
from plumbline.plans import experiment as ex
from plumbline.plans.serving import best_model_name, make_predictor
from plumbline.sources.csv_folder import CsvFolder

POLICY = assembly.Policy("target", None, "scale", "interactions")


@pytest.fixture(scope="module")
def folder():
    rng = np.random.default_rng(1)
    root = tempfile.mkdtemp(prefix="plumbline-cars-")
    for make in ("ford", "audi"):
        with open(os.path.join(root, f"{make}.csv"), "w") as f:
            f.write("brand,model,year,mileage,price\n")
            for _ in range(150):
                year, km = int(rng.integers(1990, 2024)), int(rng.integers(1, 90000))
                price = 3000 + 400 * (year - 1990) + (5000 if make == "audi" else 0) - km / 40 + rng.normal(0, 100)
                f.write(f"{make},m{rng.integers(3)},{year},{km},{max(price, 1):.2f}\n")
    return root


@pytest.fixture(scope="module")
def done(spark, folder):
    cfg = ex.ExperimentConfig(
        outer_folds=2, inner_folds=2, n_trials=2,
        residuals={"DecisionTree": [{"kind": "None"}, {"kind": "ElasticNet", "params": {"alpha": 0.01}}]},
    )
    space = ex.SearchSpace({"models": {"DecisionTree": {"search": {"max_depth": {"type": "int", "low": 3, "high": 5}}}}})
    e = ex.Experiment.from_folder(spark, CsvFolder(folder), "price", cfg, ["DecisionTree"], space, policies={"DecisionTree": POLICY}, exclude=["_source_file"])
    e.run()
    return e


def test_results_trials_and_statistics(done):
    results = done.outcome.results
    assert results.count() == 4 and set(results.columns) == {"outer_fold", "model", "R2", "MAE", "MedAE", "MSE", "RMSE"}
    assert results.agg(F.min("R2")).first()[0] > 0.5
    assert done.trials().count() == 8 and "param__max_depth" in done.trials().columns
    assert done.outcome.predictions.groupBy("model").count().select("count").distinct().first()[0] == 300
    assert done.summary().count() == 2
    assert done.significance("MAE", "DecisionTree").count() == 1
    assert done.significance_matrix("RMSE").count() == 1
    assert done.metric_comparison("DecisionTree").count() == 10
    assert done.sensitivity().columns
    info = done.data_info()
    assert info["numeric"].count() == 3 and info["categorical"].count() > 0


def test_refit_serve_and_stream(spark, folder, done):
    path = tempfile.mkdtemp(prefix="plumbline-art-") + "/a"
    saved = done.refit_and_save(path, top_k=2)
    assert "DecisionTree" in saved and any("ensemble_top2" in k for k in saved)
    assert best_model_name(spark, path) in saved
    for name in [None, *saved]:
        scored = make_predictor(spark, path, name)(done.df)
        row = scored.agg(F.avg(F.abs(F.col("price") - F.col("prediction"))), F.stddev("price")).first()
        assert row[0] < row[1]
    done.save_tables(path + "/tables")

    from plumbline.streaming.scoring import score_stream, stream_csv_folder

    schema = "brand string, model string, year int, mileage int, price double"
    out = path + "/scored"
    stream = stream_csv_folder(spark, folder, schema)
    score_stream(stream, make_predictor(spark, path, "DecisionTree"), out, path + "/cp").awaitTermination()
    assert spark.read.parquet(out).count() == 300


def test_explanations(done):
    tables = done.explainability(models=["DecisionTree+ElasticNet"], max_features=2, max_samples=30, grid_size=4)
    assert tables["partial_dependence"].count() > 0 and tables["counterfactuals"].columns
    shap = done.shapley("DecisionTree", background=5, eval_rows=5)
    assert shap.select("feature").distinct().count() >= 5


def test_no_models_and_conflicting_direction(spark, done):
    with pytest.raises(ValueError):
        ex.NestedCV(done.df, done.roles, done.cfg, [])
    with pytest.raises(ValueError):
        ex.ExperimentConfig(metric="r2", direction="minimize")
    assert ex.ExperimentConfig(metric="r2").direction == "maximize"


def test_pruner_and_stable_parameters():
    cfg = ex.ExperimentConfig(pruner_startup=2)
    p = ex._Pruner(cfg)
    p.history = [[1.0, 1.0], [2.0, 2.0]]
    assert p.stop_at([9.0, 9.0]) == 2 and p.stop_at([1.0, 9.0]) is None
    best = [{"model": "M", "params": {"a": 1, "b": 2}}, {"model": "M", "params": {"a": 3}}]
    assert [r["params"] for r in ex._stable(best)] == [{"a": 1}, {"a": 3}]
