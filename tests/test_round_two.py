"""Leaks, keys and cuts that must not come back."""

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from plumbline.operators import explain, folds, models, numeric, trials
from plumbline.plans.experiment import with_row_key


def _ready(df, cols):
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(df)


def test_given_validation_rows_stay_out_of_the_blend(spark):
    rows = spark.range(400).withColumn("x", F.rand(3)).withColumn("valid", F.col("id") % 4 == 0)
    rows = rows.withColumn("y", F.when(F.col("valid"), 1000.0).otherwise(0.0) + 0.01 * F.rand(5))
    blend = models.EvolvedBlend(max_iter=3, rf_n_estimators=3, key="id")
    ready = _ready(rows, ["x"])
    low = blend.fit(ready, "y", valid="valid").predict(ready).filter("not valid").agg(F.max("prediction")).first()[0]
    assert low < 5
    inside = blend.fit(ready, "y").predict(ready).filter("not valid").agg(F.avg("prediction")).first()[0]
    assert inside > 50  # without a given split all rows are refitted


def test_row_keys_do_not_depend_on_partitions(spark):
    rows = [(i % 7, None if i % 5 == 0 else f"s{i % 3}", "x" if i % 2 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b string, `c.d` string")
    keyed = [with_row_key(df.repartition(n), block=4) for n in (2, 7)]
    sets = [{(r["row_key"], r["a"], r["b"], r["c.d"]) for r in k.collect()} for k in keyed]
    assert sets[0] == sets[1] and len({r[0] for r in sets[0]}) == 300
    assert keyed[0].columns == ["a", "b", "c.d", "row_key"]
    swapped = spark.createDataFrame([(None, "q"), ("q", None)], "a string, b string")
    assert with_row_key(swapped).select("row_key").distinct().count() == 2


@pytest.mark.parametrize(
    "name, params, residual",
    [
        ("Bagging", {"base": "LinearRegression", "n_estimators": 2}, None),
        ("LinearRegression", {}, {"kind": "EvolutionaryStacking", "params": {"max_iter": 2, "rf_n_estimators": 2}}),
        ("LinearRegression", {}, {"kind": "PseudoHuber", "params": {"n_estimators": 2}}),
    ],
)
def test_models_take_the_configured_key(spark, name, params, residual):
    df = _ready(spark.range(120).withColumn("x", F.rand(1)).withColumn("y", F.col("x") * 3), ["x"])
    fitted = models.build_model(name, params, residuals=[residual] if residual else None, key="id").fit(df, "y")
    assert fitted.predict(df).filter("prediction is null").count() == 0


def test_depth_beyond_the_limit_is_an_error():
    with pytest.raises(ValueError, match="30"):
        models.build_model("DecisionTree", {"max_depth": 40}).make()


def test_power_fit_reaches_far_exponents_and_skips_nan(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    z = rng.normal(0.5, 0.08, 3000)
    far = np.expm1(np.log(15 * z + 1) / 15)  # the inverse transform at lambda 15
    rows = [(float(x), float("nan") if i == 7 else float(i % 90), 3.0) for i, x in enumerate(far)]
    fit = numeric.fit_power(spark.createDataFrame(rows, "far double, gap double, flat double"), ["far", "gap", "flat"])
    assert fit.lambdas["far"] > 8 and "gap" in fit.lambdas
    assert fit.dropped == {"flat": "ZeroVariance"}
    means = numeric.standard_scale_fit(spark.createDataFrame(rows, "far double, gap double, flat double"), ["gap"])
    assert means["gap"][0] == pytest.approx(np.nanmean([r[1] for r in rows]))


def test_coverage_lists_parameters_without_a_hit(spark):
    log = spark.createDataFrame([("s1", "a", None), ("s1", "b", None), ("s2", None, "q")], "study_name string, param__p string, param__q string")
    need = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "z")], "parameter string, level string")
    got = {(r["study_name"], r["parameter"]): (r["required"], r["seen"], r["covered"]) for r in trials.coverage_table(log, need).collect()}
    assert got == {("s1", "p"): (2, 2, True), ("s2", "p"): (2, 0, False), ("s1", "q"): (1, 0, False), ("s2", "q"): (1, 0, False)}


def test_explanations_use_all_folds_rows_and_the_same_features(spark):
    cols = [f"x{i}" for i in range(10)]
    # In fold 1 the order of variances is reversed.
    df = spark.range(600).withColumn("fold", (F.col("id") % 3).cast("int"))
    df = df.withColumns({c: F.rand(i) * F.when(F.col("fold") == 1, 10.0 - i).otherwise(1.0 + i) for i, c in enumerate(cols)})
    df = _ready(df.withColumn("row_key", F.col("id").cast("string")), cols)
    fitted = models.LinearFitted([1.0] * 10, 0.0)
    store = [explain.Entry("L", "L", f, fitted, df.filter(F.col("fold") == f), cols) for f in range(3)]
    out = explain.partial_dependence(store, "L").select("outer_fold", "feature", "n_samples").distinct().collect()
    by_fold = {f: {r["feature"] for r in out if r["outer_fold"] == f} for f in range(3)}
    assert len(by_fold[0]) == 8 and by_fold[0] == by_fold[1] == by_fold[2]
    assert {r["n_samples"] for r in out} == {200}
    drawn = explain.entries_for(store, "L", 2, seed=1)
    assert len(drawn) == 2 and {tuple(e.outer_fold for e in explain.entries_for(store, "L", 1, seed=s)) for s in range(20)} == {(0,), (1,), (2,)}


def test_poisson_counts_of_large_rates(spark):
    drawn = spark.range(4000).select(models.poisson_count(F.rand(4), 30.0).alias("n"))
    mean, top = drawn.agg(F.avg("n"), F.max("n")).first()
    assert abs(mean - 30) < 0.5 and top > 40


def test_evenly_spaced_positions(spark):
    df = spark.range(101).select(F.format_string("%03d", F.col("id")).alias("k"))
    got = folds.evenly_spaced(df, ["k"], 5).orderBy("instance_index").collect()
    assert [(r["k"], r["instance_index"]) for r in got] == [("000", 0), ("025", 25), ("050", 50), ("075", 75), ("100", 100)]


def test_pruned_trials_cost_no_further_fit_and_do_not_count():
    from types import SimpleNamespace

    from plumbline.plans import experiment as ex

    p = ex._Pruner(SimpleNamespace(pruner_startup=2, pruner_warmup=1, pruner_interval=1))
    assert not p.active()
    p.history = [[1.0, 1.0, 1.0], [2.0, 2.0, 2.0]]
    assert p.active() and p.stop_at([9.0]) is None and p.stop_at([9.0, 9.0]) == 2


def test_median_pruning_counts_completed_trials_only(spark):
    import random
    from statistics import median

    rng = random.Random(3)
    rows = [("s", t, s, rng.randint(1, 9) * 1.0, t % 3 != 0) for t in range(40) for s in range(1, 4)]
    df = spark.createDataFrame(rows, "study_name string, trial_number long, step int, loss double, done boolean")
    loss = {(t, s): x for _, t, s, x, _ in rows}
    for r in trials.median_pruning(df, startup=4, complete="done").collect():
        t, s = r["trial_number"], r["step"]
        seen = [loss[e, s] for e in range(t) if e % 3 != 0]
        best = min(loss[t, k] for k in range(1, s + 1))
        assert r["earlier_trials"] == len(seen)
        assert r["prune"] == (len(seen) >= 4 and s > 1 and best > median(seen)), r
