import math
import tempfile

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from plumbline.operators import assembly, encode, features, folds, metrics, numeric, select
from plumbline.operators.schema import Roles


@pytest.fixture(scope="module")
def regression(spark):
    """y depends on x0 and x2; x1 and x3 are noise; g shifts the level."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4))
    g = rng.choice(["a", "b", "c"], 400)
    y = 2 * x[:, 0] - x[:, 2] + (g == "a") + rng.normal(scale=0.05, size=400) + 5
    rows = [(f"k{i}", *map(float, x[i]), str(g[i]), float(y[i])) for i in range(400)]
    return spark.createDataFrame(rows, "row_key string, x0 double, x1 double, x2 double, x3 double, g string, y double").cache()


def test_interactions_on_nulls_and_bin_edges(spark):
    rows = [(2020, 10000.0, "a", "b"), (2030, 10000.5, None, "b"), (None, None, "a", None), (2024, 100001.0, "a", "b")]
    df = spark.createDataFrame(rows, "year int, mileage double, brand string, model string")
    out, num, cat = features.add_interactions(df)
    got = out.collect()
    assert [r["vehicle_age"] for r in got] == [5.0, 0.0, None, 1.0]
    assert [r["mileage_bin"] for r in got] == ["very_low", "low", None, "very_high"]
    assert [r["mileage_per_year"] for r in got] == [2000.0, 10000.5, 0.0, 100001.0]
    assert [r["brand_model"] for r in got] == ["a__b", "nan__b", "a__nan", "a__b"]
    assert num == ["vehicle_age", "age_x_mileage", "mileage_per_year"] and cat == ["mileage_bin", "brand_model"]
    assert features.add_interactions(df, "none")[1] == []


def test_target_encoding_null_unseen_and_smoothing(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 7.0)], "c string, y double")
    t = {r["level"]: r["encoding"] for r in encode.target_encoding(train, ["c"], "y", 10.0).collect()}
    assert t == {"a": pytest.approx((2 * 2 + 10 * 4) / 12), "b": pytest.approx((5 + 40) / 11)}
    held = spark.createDataFrame([("b",), ("zzz",), (None,)], "c string")
    out = encode.apply_target_encoding(held, encode.target_encoding(train, ["c"], "y"), 4.0, ["c"]).collect()
    assert [r["c__te"] for r in out] == [pytest.approx(45 / 11), 4.0, 4.0]
    floor = {r["level"]: r["encoding"] for r in encode.target_encoding(train, ["c"], "y", 10.0, min_leaf=5).collect()}
    assert floor["b"] == pytest.approx((5 * 5 + 40) / 15)


def test_noise_is_seeded_by_key(spark):
    df = spark.createDataFrame([(i, "a") for i in range(500)], "id int, c string")
    t = spark.createDataFrame([("c", "a", 1.0)], "column string, level string, encoding double")
    one = encode.apply_target_encoding(df, t, 0.0, ["c"], noise_std=0.5, key="id").orderBy("id").collect()
    two = encode.apply_target_encoding(df.repartition(3), t, 0.0, ["c"], noise_std=0.5, key="id").orderBy("id").collect()
    values = [r["c__te"] for r in one]
    assert values == [r["c__te"] for r in two]
    assert np.mean(values) == pytest.approx(1.0, abs=0.1) and np.std(values) == pytest.approx(0.5, abs=0.06)


def test_out_of_fold_equals_refit_without_the_fold(spark, regression):
    df = folds.with_folds(regression, "row_key", 4)
    df = df.withColumn("g", F.when(F.col("x1") < 1.5, F.col("g")))
    out = encode.out_of_fold_encoding(df, ["g"], "y", "outer_fold").toPandas()
    for f in range(4):
        rest = out[out.outer_fold != f]
        overall = rest.y.mean()
        stats = rest.groupby("g").y.agg(["count", "mean"])
        enc = (stats["count"] * stats["mean"] + 10 * overall) / (stats["count"] + 10)
        mine = out[out.outer_fold == f]
        want = mine.g.map(enc).fillna(overall)
        assert np.allclose(mine.g__te, want)


def test_level_only_inside_a_fold_gets_the_outside_mean(spark):
    df = spark.createDataFrame([("rare", 0, 9.0), ("a", 0, 1.0), ("a", 1, 3.0)], "c string, f int, y double")
    got = {(r["c"], r["f"]): r["c__te"] for r in encode.out_of_fold_encoding(df, ["c"], "y", "f").collect()}
    assert got[("rare", 0)] == 3.0


def test_balanced_weights(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], "l string")
    assert sorted({round(r["weight"], 6) for r in encode.balanced_weights(df, "l").collect()}) == [0.666667, 2.0]


def test_yeo_johnson_lambda_is_the_likelihood_maximum(spark):
    rng = np.random.default_rng(2)
    x = rng.lognormal(size=600)
    fit = numeric.fit_power(spark.createDataFrame([(float(v),) for v in x], "x double"), ["x"])

    def ll(lam):
        t = np.log1p(x) if lam == 0 else ((x + 1) ** lam - 1) / lam
        return -len(x) / 2 * np.log(t.var()) + (lam - 1) * np.log1p(x).sum()

    lam = fit.lambdas["x"]
    assert ll(lam) >= max(ll(v) for v in np.linspace(lam - 0.5, lam + 0.5, 2001)) - 1e-6
    out = fit.apply(spark.createDataFrame([(float(v),) for v in x], "x double")).agg(F.avg("x"), F.stddev_pop("x")).first()
    assert out[0] == pytest.approx(0, abs=1e-9) and out[1] == pytest.approx(1, abs=1e-9)


def test_power_drops_flat_and_flat_likelihood_columns(spark):
    df = spark.createDataFrame([(1.0, float(i % 7)) for i in range(50)], "flat double, ok double")
    assert numeric.fit_power(df, ["flat", "ok"]).dropped == {"flat": "ZeroVariance"}
    with pytest.raises(ValueError, match="all numeric"):
        numeric.fit_power(df, ["flat"])


def test_quantile_scores_are_monotone_and_centre_ties(spark):
    xs = [float(v) for v in [0] * 50 + list(range(1, 51))]
    df = spark.createDataFrame([(v,) for v in xs] + [(None,), (99.0,)], "x double")
    fit = numeric.fit_quantiles(df.filter("x <= 50"), ["x"], n=101)
    got = [(r["x"], r["z"]) for r in numeric.quantile_normal(df, "x", fit, "z").collect()]
    assert got[-2] == (None, None) and got[-1][1] == pytest.approx(5.199, abs=1e-2)
    scored = sorted(p for p in got if p[0] is not None)
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(scored, scored[1:]))
    assert scored[0][1] == pytest.approx(-0.674, abs=0.03)


def test_folds_are_exhaustive_and_exact_ones_are_even(spark, regression):
    sizes = [r["count"] for r in folds.with_exact_folds(regression, "row_key", 7).groupBy("outer_fold").count().collect()]
    assert sum(sizes) == 400 and max(sizes) - min(sizes) <= 1
    a = folds.with_folds(regression, "row_key", 3).select("row_key", "outer_fold").toPandas()
    b = folds.with_folds(regression.repartition(9), "row_key", 3).select("row_key", "outer_fold").toPandas()
    assert a.sort_values("row_key").outer_fold.tolist() == b.sort_values("row_key").outer_fold.tolist()


def test_inner_folds_do_not_repeat_the_outer_split(spark, regression):
    for o in range(3):
        df = folds.with_inner_folds(folds.with_folds(regression, "row_key", 3), "row_key", o, 3)
        inner = {r[0] for r in df.filter(F.col("outer_fold") != o).select("inner_fold").distinct().collect()}
        assert inner == {0, 1, 2}
        assert df.filter((F.col("outer_fold") == o) & F.col("inner_fold").isNotNull()).count() == 0


def test_evenly_spaced(spark):
    df = spark.createDataFrame([(f"{i:03d}",) for i in range(50)], "k string")
    got = sorted(r["instance_index"] for r in folds.evenly_spaced(df, ["k"], 5).collect())
    assert got == np.linspace(0, 49, 5, dtype=int).tolist()
    few = folds.evenly_spaced(df.limit(2), ["k"], 5)
    assert few.count() == 2


def test_metrics_edge_cases(spark):
    rows = [("flat", 2.0, 2.0), ("flat", 2.0, 2.0), ("off", 2.0, 3.0), ("off", 2.0, 2.0), ("bad", 1.0, float("nan")), ("bad", float("inf"), 1.0)]
    df = spark.createDataFrame(rows, "g string, y_true double, y_pred double")
    got = {r["g"]: r for r in metrics.score(df, ["g"], ["R2", "MAE", "MedAE", "NegMSE"]).collect()}
    assert got["flat"]["R2"] == 1.0 and got["off"]["R2"] == 0.0 and got["off"]["MedAE"] == 0.5
    assert math.isnan(got["bad"]["MAE"]) and math.isnan(got["bad"]["MedAE"]) and got["bad"]["n"] == 0
    guard = {r["g"]: r["score"] for r in metrics.guarded_score(df, ["g"], "r2").collect()}
    assert guard["bad"] == float("-inf") and guard["flat"] == 1.0
    assert metrics.check_direction("r^2", None) == "maximize"
    with pytest.raises(ValueError):
        metrics.check_direction("mae", "maximize")


def test_user_metric(spark):
    metrics.register_metric("Bias", lambda y, p: F.avg(p - y))
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 4.0)], "g int, y_true double, y_pred double")
    assert metrics.score(df, ["g"], ["bias"]).first()["Bias"] == 2.0


XS = ["x0", "x1", "x2", "x3"]


def test_moments_match_numpy(spark, regression):
    pdf = regression.toPandas()
    m = select.moments_by(regression.repartition(6), XS, "y")[0]
    w, b = select.ridge(m, 0.0)
    a = np.column_stack([pdf[XS], np.ones(len(pdf))])
    want = np.linalg.lstsq(a, pdf.y, rcond=None)[0]
    assert np.allclose([*w, b], want)
    assert m.mse(w, b) == pytest.approx(np.mean((pdf.y - a @ want) ** 2))


def test_selection_finds_the_relevant_columns(spark, regression):
    lasso = select.select_lasso(folds.with_folds(regression, "row_key", 10, column="cv"), XS, "y", "cv")
    assert set(lasso.kept) == {"x0", "x2"}
    genetic = select.select_genetic(folds.with_holdout(regression, "row_key"), XS, "y", "is_valid", size_penalty=0.05)
    assert {"x0", "x2"} <= set(genetic.kept)
    assert select.select_genetic(folds.with_holdout(regression, "row_key"), ["x0"], "y", "is_valid").kept == ["x0"]
    tiny = folds.with_holdout(regression.limit(5), "row_key", 0.4)
    assert select.select_genetic(tiny, XS, "y", "is_valid").kept == XS


def test_quantile_regression_minimises_pinball_loss(spark, regression):
    pdf = regression.toPandas()
    w, b = select.quantile_regression(regression, XS, "y", 0.75, alpha=0.0, rounds=60)

    def loss(w, b):
        r = pdf.y - pdf[XS].to_numpy() @ w - b
        return np.mean(np.where(r >= 0, 0.75 * r, -0.25 * r))

    base, rng = loss(w, b), np.random.default_rng(0)
    assert all(loss(w + rng.normal(0, 0.02, 4), b + rng.normal(0, 0.02)) > base - 1e-3 for _ in range(50))
    assert np.mean(pdf.y <= pdf[XS].to_numpy() @ w + b) == pytest.approx(0.75, abs=0.03)


@pytest.mark.parametrize(
    "policy",
    [
        assembly.Policy("onehot", "lasso", "power"), assembly.Policy("target", None, "quantile"),
        assembly.Policy("raw"), assembly.Policy("onehot", "genetic", "scale", nulls="mean"),
    ],
)
def test_policies_fit_save_and_load(spark, regression, policy):
    roles = Roles("y", tuple(XS), ("g",))
    train, held = regression.filter("x3 < 0.8"), regression.filter("x3 >= 0.8").withColumn("g", F.lit("unseen"))
    if policy.nulls == "mean":
        held = held.withColumn("x0", F.lit(None).cast("double"))
    feats = assembly.fit_features(train, roles, policy, "y", "row_key")
    path = tempfile.mkdtemp(prefix="plumbline-pipe-") + "/p"
    feats.pipeline.write().save(path)
    a = feats.transform(held).orderBy("row_key").select("features").collect()
    b = PipelineModel.load(path).transform(held).orderBy("row_key").select("features").collect()
    assert a == b and len(a) > 0 and len(a[0][0]) == len(feats.feature_names)


def test_unknown_policy_values():
    with pytest.raises(ValueError):
        assembly.policy_for("RandomForest", cat_encoding="weird")
    with pytest.raises(ValueError):
        assembly.policy_for("RandomForest", selection="weird")


def test_null_numbers_fail_unless_filled(spark, regression):
    roles = Roles("y", ("x0",), ())
    feats = assembly.fit_features(regression, roles, assembly.Policy("onehot", None, "scale"), "y", "row_key")
    with pytest.raises(Exception):
        feats.transform(regression.withColumn("x0", F.lit(None).cast("double"))).select("features").collect()


def test_text_rows_and_vectors(spark):
    df = spark.createDataFrame([("de", None, "ein auto"), ("en", "s", "a car a car")], "lang string, source string, text string")
    out = df.select(features.joined_text("lang", "source", "text").alias("t"))
    assert out.first()["t"] == "de nan ein auto"
    model = features.fit_text_vectors(out, "t", dim=3, min_count=1)
    assert [c for c in features.text_vector_columns(model, out, 3).columns if c.startswith("text_emb_")] == ["text_emb_0", "text_emb_1", "text_emb_2"]
