import json
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import space, trials
from plumbline.plans.experiment import parameters_from, parameters_long


def _records(*params):
    return [{"model": "M", "outer_fold": i, "params": p, "residual_cfg": None} for i, p in enumerate(params)]


def _aggregate(spark, *params):
    return parameters_from(trials.aggregate_parameters(parameters_long(spark, _records(*params))))["M"]


def test_parameters_median_and_mode(spark):
    got = _aggregate(
        spark,
        {"max_depth": 3, "learning_rate": 0.1, "features": ["a", "b"]},
        {"max_depth": 5, "learning_rate": 0.2, "features": ["a", "b"]},
        {"max_depth": 7, "learning_rate": 0.3, "features": ["c"]},
    )
    assert got == {"max_depth": 5, "learning_rate": pytest.approx(0.2), "features": ["a", "b"]}


def test_parameters_keep_booleans_and_round_half_to_even(spark):
    got = _aggregate(
        spark,
        {"bootstrap": False, "n": 100, "half": 2, "mixed": 1, "tie": "x"},
        {"bootstrap": False, "n": 200, "half": 3, "mixed": "a", "tie": "y"},
        {"bootstrap": True, "n": 300, "mixed": "a"},
    )
    assert got["bootstrap"] is False and got["n"] == 200 and got["half"] == 2 and got["mixed"] == "a" and got["tie"] == "x"


def test_residual_configuration_mode(spark):
    df = spark.createDataFrame([("M", 0, None), ("M", 1, '{"k":1}'), ("M", 2, None), ("N", 0, '{"k":1}')], "model string, outer_fold int, residual_cfg string")
    assert {r["model"]: r["residual_cfg"] for r in trials.aggregate_residual_configs(df).collect()} == {"M": None, "N": '{"k":1}'}
    a = spark.sql("select map('b', '1', 'a', '2') as m").select(trials.canonical_json(F.col("m"))).first()[0]
    assert a == '{"a":"2","b":"1"}'


def _log(spark, values, depth, booster, direction="minimize", state=True):
    rows = [("X", "X", "base", "MAE", direction, "COMPLETE", float(v), d, b) for v, d, b in zip(values, depth, booster)]
    df = spark.createDataFrame(rows, "model string, base_model string, residual_kind string, metric string, direction string, state string, value double, param__max_depth int, param__booster string")
    return df if state else df.drop("state")


def test_sensitivity_of_numeric_and_categorical(spark):
    df = _log(spark, [4, 3, 2, 1], [2, 3, 4, 5], ["a", "a", "b", "b"])
    got = {r["parameter"]: r for r in trials.sensitivity_summary(df).collect()}
    assert got["max_depth"]["sensitivity"] == pytest.approx(1.0) and got["max_depth"]["spearman_corr"] == pytest.approx(-1.0)
    assert got["booster"]["sensitivity"] == pytest.approx(0.8) and got["booster"]["spearman_corr"] is None
    assert got["booster"]["best_value"] == "b" and got["booster"]["worst_value"] == "a"
    assert got["max_depth"]["score_std"] == pytest.approx(np.std([4, 3, 2, 1], ddof=1))
    up = {r["parameter"]: r for r in trials.sensitivity_summary(_log(spark, [4, 3, 2, 1], [2, 3, 4, 5], ["a", "a", "b", "b"], "maximize", state=False)).collect()}
    assert up["booster"]["best_value"] == "a" and up["max_depth"]["best_value"] == "2.0"


def test_sensitivity_skips_constant_short_and_flat(spark):
    df = _log(spark, [1, 1, 1, 1], [2, 3, 3, 5], ["a", "a", "a", "a"])
    got = trials.sensitivity_summary(df).collect()
    assert [r["parameter"] for r in got] == ["max_depth"] and got[0]["sensitivity"] == 0.0
    empty = trials.sensitivity_summary(_log(spark, [1, 2], [1, 2], ["a", "b"]))
    assert empty.count() == 0 and "sensitivity" in empty.columns
    assert trials.top_sensitivity(trials.sensitivity_summary(df), model="other").count() == 0


def test_best_trial_and_missing_completion(spark):
    rows = [("s", "minimize", "COMPLETE", 0, 2.0), ("s", "minimize", "COMPLETE", 1, 1.0), ("s", "minimize", "PRUNED", 2, 0.1)]
    schema = "study_name string, direction string, state string, trial_number int, value double"
    assert trials.best_trials(spark.createDataFrame(rows, schema)).first()["trial_number"] == 1
    with pytest.raises(Exception, match="no completed trials"):
        trials.best_trials(spark.createDataFrame(rows[2:], schema)).collect()


@pytest.mark.parametrize(("ties", "target"), [(False, 10**6), (True, 10**6), (True, 50)])
def test_median_pruning_against_brute_force(spark, monkeypatch, ties, target):
    """Ties included; once with every ordering forced through value slices."""
    plain = trials.ordered_counts
    monkeypatch.setattr(trials, "ordered_counts", lambda *a, **k: plain(*a, **k, target=target))
    rng = np.random.default_rng(4)
    rows = []
    for study in ("a", "b"):
        for t in range(23):
            for step in range(1, 4):
                if rng.random() < 0.9:
                    loss = float(rng.integers(0, 6)) if ties else float(rng.random())
                    rows.append((study, t * 3, step, loss))
    df = spark.createDataFrame(rows, "study_name string, trial_number int, step int, loss double")
    for r in trials.median_pruning(df, startup=4, warmup=1).collect():
        seen = [v for s, t, k, v in rows if s == r["study_name"] and k == r["step"] and t < r["trial_number"]]
        best = min(v for s, t, k, v in rows if s == r["study_name"] and t == r["trial_number"] and k <= r["step"])
        want = len(seen) >= 4 and r["step"] > 1 and best > median(seen)
        assert r["earlier_trials"] == len(seen) and r["prune"] == want, r


def _simulate(rows, levels, patience):
    best, stale, seen = None, 0, set()
    for number, state, value, level in rows:
        seen.add(level)
        if state == "PRUNED":
            stale += 1
        elif best is None or value < best:
            best, stale = value, 0
        else:
            stale += 1
        if stale >= patience and levels <= seen:
            return number
    return None


@pytest.mark.parametrize("block", [4, 4096])
def test_stopping_point_against_a_simulation(spark, monkeypatch, block):
    """Also with blocks shorter than the study, so that totals are carried over."""
    monkeypatch.setattr(trials, "BLOCK", block)
    rng = np.random.default_rng(8)
    studies = {
        s: [(i, "PRUNED" if rng.random() < 0.2 else "COMPLETE", float(rng.random()), str(rng.choice(["p", "q", "r"], p=[0.8, 0.15, 0.05]))) for i in range(60)]
        for s in ("s1", "s2", "s3")
    }
    studies["never"] = [(0, "COMPLETE", 1.0, "p")]
    rows = [(s, "minimize", st, n, v, lv) for s, ts in studies.items() for n, st, v, lv in ts]
    df = spark.createDataFrame(rows, "study_name string, direction string, state string, trial_number int, value double, param__kind string")
    required = spark.createDataFrame([("kind", x) for x in "pqr"], "parameter string, level string")
    got = {r["study_name"]: r["stop_trial"] for r in trials.stopping_points(df, required, patience=5).collect()}
    assert got == {s: _simulate(ts, {"p", "q", "r"}, 5) for s, ts in studies.items()}


def test_coverage_counts_only_all_text_choices():
    got = space.named_levels(
        {
            "opt": {"type": "categorical", "choices": ["a", "b"]}, "mix": {"type": "categorical", "choices": ["a", 0.3]},
            "flag": {"type": "categorical", "choices": [True, False]}, "n": {"type": "int", "low": 1, "high": 2},
        }
    )
    assert got == {"opt": ["a", "b"]}


def test_draws_respect_the_space(spark):
    sp = {
        "n_d": {"type": "int", "low": 8, "high": 64, "step": 8}, "lr": {"type": "float", "low": 0.001, "high": 0.1, "log": True},
        "f": {"type": "categorical", "choices": ["sqrt", 0.3, True]},
    }
    got = space.trial_settings(spark, 200, sp, 1)
    assert {g["n_d"] for g in got} == set(range(8, 65, 8)) and all(0.001 <= g["lr"] <= 0.1 for g in got)
    assert np.median([g["lr"] for g in got]) == pytest.approx(0.01, rel=0.4)
    assert {json.dumps(g["f"]) for g in got} == {'"sqrt"', "0.3", "true"}
    with pytest.raises(ValueError):
        space.trial_settings(spark, 1, {"x": {"type": "odd"}}, 1)


def test_own_budget_wins():
    s = space.SearchSpace({"global": {"n_trials": 40}, "models": {"A": {"n_trials": 80}}})
    assert s.budget("A", 4) == 80 and s.budget("B", 4) == 40 and space.SearchSpace().budget("A", 4) == 4
