"""Boxes of additive models: predictions, Shapley values and partial dependence against scoring and walks."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from plumbline.operators import explain, models
from plumbline.operators.trees import BoxShapley, additive


@pytest.fixture(scope="module")
def rows(spark):
    x = np.random.default_rng(3).normal(size=(300, 4))
    y = x[:, 0] * x[:, 1] + np.abs(x[:, 2])
    data = [(f"{i:03d}", *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "row_key string, a double, b double, c double, d double, y double")
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df).cache()


MODELS = {
    "DecisionTree": ("DecisionTree", {"max_depth": 5}, None),
    "RandomForest": ("RandomForest", {"n_estimators": 4, "max_depth": 4}, None),
    "BoostedTrees": ("BoostedTrees", {"n_estimators": 4, "max_depth": 3}, None),
    "Linear": ("LinearRegression", {}, None),
    "Bagging": ("Bagging", {"n_estimators": 2, "base": "DecisionTree", "base__max_depth": 3}, None),
    "Stack": ("DecisionTree", {"max_depth": 2}, [{"kind": "ElasticNet"}, {"kind": "PseudoHuber", "params": {"n_estimators": 3, "max_depth": 2, "colsample_bytree": 0.6}}]),
}


@pytest.fixture(scope="module")
def entries(rows):
    out = {}
    for name, (kind, params, residuals) in MODELS.items():
        fitted = models.build_model(kind, params, 42, residuals).fit(rows, "y")
        out[name] = explain.Entry(name, name, 0, fitted, rows, ["a", "b", "c", "d"])
    return out


@pytest.mark.parametrize("name", MODELS)
def test_boxes_predict_what_the_model_predicts(rows, entries, name):
    scored = entries[name].fitted.predict(rows, "p").select("features", "p").collect()
    form = additive(entries[name].fitted, 4)
    assert np.allclose(form.predict(np.array([r["features"].toArray() for r in scored])), [r["p"] for r in scored])


@pytest.mark.parametrize("name", ["RandomForest", "BoostedTrees", "Stack"])
def test_shapley_values_add_up_and_equal_a_direct_sum(rows, entries, name):
    """Against the definition: all subsets of the four features, averaged over the background."""
    from itertools import combinations
    from math import factorial

    form = additive(entries[name].fitted, 4)
    x = np.array([r["features"].toArray() for r in rows.limit(12).collect()])
    bg = np.array([r["features"].toArray() for r in rows.orderBy("row_key").limit(7).collect()])
    phi = BoxShapley(form, bg)(x)
    assert np.allclose(phi.sum(axis=1), form.predict(x) - form.predict(bg).mean())

    def value(row, kept):
        mixed = bg.copy()
        mixed[:, list(kept)] = row[list(kept)]
        return form.predict(mixed).mean()

    for row, got in zip(x, phi):
        for j in range(4):
            rest = [k for k in range(4) if k != j]
            want = sum(
                factorial(n) * factorial(3 - n) / 24 * (value(row, (*s, j)) - value(row, s)) for n in range(4) for s in combinations(rest, n)
            )
            assert got[j] == pytest.approx(want, abs=1e-9)


def test_tree_shapley_as_a_job_and_base_only(rows, entries):
    got = explain.tree_shapley(entries["Stack"], background=10).toPandas()
    assert len(got) == 1200
    base = explain.tree_shapley(entries["Stack"], background=10, base_only=True).toPandas()
    only = explain.Entry("b", "b", 0, entries["Stack"].fitted.base, rows, ["a", "b", "c", "d"])
    same = explain.tree_shapley(only, background=10).toPandas()
    key = ["row_key", "feature"]
    both = base.merge(same, on=key)
    assert len(both) == 1200 and np.allclose(both.phi_x, both.phi_y)
    fuzzy = models.build_model("LinearRegression", {}, 42, [{"kind": "FuzzyLogic", "params": {"n_rules": 2}}]).fit(rows, "y")
    with pytest.raises(ValueError, match="permutation"):
        explain.tree_shapley(explain.Entry("f", "f", 0, fuzzy, rows, ["a", "b", "c", "d"]))


def test_a_deep_tree_is_explained(spark):
    """A tree of depth 20: tables over subsets would need a million entries for a leaf."""
    n = 400
    data = [(f"{i}", *[float((i * 7919 >> k) % 2 + (i % 13) / 100) for k in range(22)], float(i % 97)) for i in range(n)]
    names = [f"x{k}" for k in range(22)]
    df = spark.createDataFrame(data, "row_key string, " + ", ".join(f"{c} double" for c in names) + ", y double")
    df = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    fitted = models.build_model("DecisionTree", {"max_depth": 20}).fit(df, "y")
    assert fitted.model.depth > 8
    e = explain.Entry("t", "t", 0, fitted, df, names)
    got = explain.tree_shapley(e, background=20).toPandas().groupby("row_key").phi.sum()
    pred = {r["row_key"]: r["p"] for r in fitted.predict(df, "p").collect()}
    gaps = [v - pred[k] for k, v in got.items()]
    assert len(gaps) == n and np.ptp(gaps) < 1e-9


@pytest.mark.parametrize("name", MODELS)
def test_curves_equal_those_of_scoring_every_row(entries, name):
    e = entries[name]
    got = explain.partial_dependence([e], name, grid_size=6).toPandas()
    sample = explain.sampled(e, None, 42)
    (grids,) = explain.feature_grids([sample], range(4), 6)
    want = explain._scored_curves(e, sample, grids).toPandas()
    both = got.merge(want, left_on=["feature_index", "grid_value"], right_on=["fidx", "grid_value"])
    assert len(got) == len(want) == len(both) == 24
    assert np.allclose(both.prediction_mean_x, both.prediction_mean_y)
    assert np.allclose(both.prediction_std_x, both.prediction_std_y, atol=1e-7) and (both.n_samples_x == 300).all()
