"""Regressors, residual stacks, nested cross-validation and serving."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import assembly, models
from plumbline.operators.metrics import score
from plumbline.operators.schema import log_target
from plumbline.plans import experiment as ex
from plumbline.plans import fixtures as fx
from plumbline.plans.catalog import query
from plumbline.plans.fixtures import rd, rounded
from plumbline.plans.serving import Predictor, make_predictor
from plumbline.session import Stored, cut_lineage, scratch_path

_POLICY = assembly.Policy("target", None, "scale")


def prepared(spark, sf_dir, fold: int = 0, df: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """One fold held out, features fitted on the other folds."""
    df = fx.stored_folded(spark, sf_dir) if df is None else df
    train, held = df.filter(F.col("outer_fold") != fold), df.filter(F.col("outer_fold") == fold)
    feats = assembly.fit_features(train, fx.ROLES, _POLICY, "y_log", "row_key")
    keep = ["row_key", "outer_fold", "features", "y_log", F.col("price").alias("y_true")]
    return feats.transform(train).select(*keep), feats.transform(held).select(*keep), feats.feature_names


def held_scores(fitted: models.Fitted, held: DataFrame, name: str) -> DataFrame:
    scored = fitted.predict(held, "__p").select(
        F.lit(name).alias("model"), "y_true", F.exp("__p").alias("y_pred")
    )
    return score(scored, ["model"], ["R2", "MAE", "RMSE"])


def _trained(spark, sf_dir, model, name: str, valid: bool = False, weight: str | None = None) -> DataFrame:
    train, held, _ = prepared(spark, sf_dir)
    if valid:
        from plumbline.operators.folds import with_holdout

        train = with_holdout(train, "row_key", 0.2)
    train = Stored(train)
    fitted = model.fit(train.rows, "y_log", weight, "is_valid" if valid else None)
    train.drop()
    return held_scores(fitted, held, name)


@query(
    "g1_linear_regression",
    f"""WITH {fx.FOLDED}, c AS (SELECT regr_slope(price, mileage) AS b, regr_intercept(price, mileage) AS a FROM folded WHERE outer_fold <> 0)
SELECT round(b, 6) AS slope, round(a, 2) AS intercept, count(*) AS n, round(avg(abs(price - (a + b * mileage))), 3) AS mae
FROM folded, c WHERE outer_fold = 0 GROUP BY a, b""",
)
def g1(spark, sf_dir):
    df = VectorAssembler(inputCols=["mileage"], outputCol="features").transform(fx.stored_folded(spark, sf_dir))
    fitted = models.build_model("LinearRegression").fit(df.filter("outer_fold <> 0"), "price")
    b, a = float(fitted.model.coefficients[0]), float(fitted.model.intercept)
    scored = fitted.predict(df.filter("outer_fold = 0"), "p")
    return scored.agg(
        rd(F.first(F.lit(b))).alias("slope"), rd(F.first(F.lit(a)), 2).alias("intercept"), F.count(F.lit(1)).alias("n"),
        rd(F.avg(F.abs(F.col("price") - F.col("p"))), 3).alias("mae"),
    )


@query("g2_decision_tree")
def g2(spark, sf_dir):
    return _trained(spark, sf_dir, models.build_model("DecisionTree", {"max_depth": 8, "min_samples_split": 20}), "DecisionTree")


@query("g3_random_forest")
def g3(spark, sf_dir):
    p = {"n_estimators": 10, "max_depth": 7, "max_features": 0.7, "max_samples": 0.8, "min_samples_leaf": 5}
    return _trained(spark, sf_dir, models.build_model("RandomForest", p), "RandomForest")


@query("g4_boosted_trees")
def g4(spark, sf_dir):
    """Gradient boosting that stops on its own validation rows."""
    p = {"n_estimators": 15, "max_depth": 4, "learning_rate": 0.3, "subsample": 0.8}
    return _trained(spark, sf_dir, models.build_model("BoostedTrees", p), "BoostedTrees", valid=True)


@query("g5_bagging")
def g5(spark, sf_dir):
    p = {"n_estimators": 3, "base": "DecisionTree", "max_samples": 0.8, "base__max_depth": 6}
    return _trained(spark, sf_dir, models.build_model("Bagging", p), "Bagging")


def _residual(kind: str, params: dict):
    return models.build_model("DecisionTree", {"max_depth": 4}, 42, [{"kind": kind, "params": params}])


def _residual_query(name: str, kind: str, params: dict) -> None:
    @query(name)
    def run(spark, sf_dir):
        return _trained(spark, sf_dir, _residual(kind, params), f"DecisionTree+{kind}")


for _name, _kind, _params in (
    ("g7_elastic_net_residual", "ElasticNet", {"alpha": 0.001, "l1_ratio": 0.5}),
    ("g8_huber_residual", "Huber", {"epsilon": 1.35}),
    ("g9_quantile_residual", "Quantile", {"quantile": 0.75, "alpha": 0.001}),
    ("g10_fuzzy_residual", "FuzzyLogic", {"n_rules": 5, "fuzziness": 2.0, "alpha": 0.001}),
    ("g11_evolved_blend_residual", "EvolutionaryStacking", {"max_iter": 20, "population_size": 8, "tree_max_depth": 3, "rf_n_estimators": 10}),
    ("g12_pseudo_huber_residual", "PseudoHuber", {"n_estimators": 6, "max_depth": 2, "learning_rate": 0.2, "subsample": 0.8, "colsample_bytree": 0.8, "reg_alpha": 0.1}),
):
    _residual_query(_name, _kind, _params)


@query(
    "g13_residual_stack",
    f"""WITH {fx.FOLDED}, b AS (SELECT row_key, outer_fold, price, mileage, mpg, regr_slope(price, mileage) OVER w AS s1,
  regr_intercept(price, mileage) OVER w AS i1 FROM folded WINDOW w AS (PARTITION BY 1)),
r AS (SELECT *, price - (i1 + s1 * mileage) AS e FROM b),
f AS (SELECT *, regr_slope(e, mpg) OVER (PARTITION BY 1) AS s2, regr_intercept(e, mpg) OVER (PARTITION BY 1) AS i2 FROM r)
SELECT outer_fold, round(avg(i1 + s1 * mileage), 3) AS base_mean, round(avg(i1 + s1 * mileage + i2 + s2 * mpg), 3) AS stack_mean,
round(sqrt(avg(pow(price - (i1 + s1 * mileage + i2 + s2 * mpg), 2))), 3) AS rmse FROM f GROUP BY outer_fold""",
)
def g13(spark, sf_dir):
    """Least squares on one feature, then least squares of its residual on another."""

    class OnColumn:
        """A linear fit restricted to one position of the feature vector."""

        def __init__(self, position: int):
            self.position = position

        def fit(self, df, label, weight=None, valid=None):
            from pyspark.ml.feature import VectorSlicer

            one = VectorSlicer(inputCol="features", outputCol="__one", indices=[self.position]).transform(df)
            got = models.build_model("LinearRegression").fit(one.drop("features").withColumnRenamed("__one", "features"), label)
            weights = [0.0, 0.0]
            weights[self.position] = float(got.model.coefficients[0])
            return models.LinearFitted(weights, float(got.model.intercept))

    # written: both fits and the scores read the rows again
    rows = cut_lineage(fx.folded(spark, sf_dir, even=True).select("outer_fold", "price", "mileage", "mpg"))
    df = VectorAssembler(inputCols=["mileage", "mpg"], outputCol="features").transform(rows)
    stack = models.Stacked(OnColumn(0), [OnColumn(1)]).fit(df, "price")
    scored = stack.predict(stack.base.predict(df, "base"), "stack")
    e = F.col("price") - F.col("stack")
    return scored.groupBy("outer_fold").agg(
        rd(F.avg("base"), 3).alias("base_mean"), rd(F.avg("stack"), 3).alias("stack_mean"), rd(F.sqrt(F.avg(e * e)), 3).alias("rmse")
    )


@query(
    "a8_model_artifact",
    f"""WITH {fx.LISTINGS}, c AS (SELECT regr_slope(price, mileage) AS b, regr_intercept(price, mileage) AS a FROM listings)
SELECT brand, count(*) AS n, round(avg(a + b * mileage), 3) AS prediction FROM listings, c GROUP BY brand""",
)
def a8(spark, sf_dir):
    """A fitted model saved, loaded and applied."""
    df = VectorAssembler(inputCols=["mileage"], outputCol="features").transform(fx.listings(spark, sf_dir))
    fitted = models.build_model("LinearRegression").fit(df, "price")
    path = scratch_path(spark, "model")
    models.save_fitted(spark, fitted, path)
    loaded = models.load_fitted(spark, path)
    return loaded.predict(df).groupBy("brand").agg(F.count(F.lit(1)).alias("n"), rd(F.avg("prediction"), 3).alias("prediction"))


def _config(**kw) -> ex.ExperimentConfig:
    base = dict(outer_folds=2, inner_folds=2, n_trials=2, report_metrics=("r2", "mae", "rmse"))
    return ex.ExperimentConfig(**{**base, **kw})


_SPACE = ex.SearchSpace(
    {
        "models": {
            "DecisionTree": {"search": {"max_depth": {"type": "int", "low": 3, "high": 6}}},
            "LinearRegression": {"fixed": {"fit_intercept": True}},
        }
    }
)
_ROLES = fx.Roles("price", ("mileage", "mpg", "tax"), ("brand", "fuelType"))


def _nested(spark, sf_dir, **kw) -> ex.ExperimentResult:
    cfg = _config(residuals={"DecisionTree": [{"kind": "None"}, {"kind": "ElasticNet", "params": {"alpha": 0.001}}]}, **kw)
    policies = {"LinearRegression": assembly.Policy("onehot", "lasso", "scale"), "DecisionTree": _POLICY}
    return ex.NestedCV(fx.listings(spark, sf_dir), _ROLES, cfg, ["DecisionTree", "LinearRegression"], _SPACE, policies).run()


@query("h2_nested_cv")
def h2(spark, sf_dir):
    """Three variants, two outer and two inner folds: out-of-fold scores."""
    return _nested(spark, sf_dir).results


@query("g16_refit_and_save")
def g16(spark, sf_dir):
    """Tuned on folds, refitted on all rows, saved with a top-k ensemble; lists what was saved."""
    path = scratch_path(spark, "artefacts")
    saved = _experiment(fx.listings(spark, sf_dir), path)
    return spark.createDataFrame([(k, v.removeprefix(path)) for k, v in sorted(saved.items())], "model string, path string")


def _experiment(listings: DataFrame, path: str) -> dict[str, str]:
    df = listings.select("row_key", "price", "mileage", "mpg", "brand")
    e = ex.Experiment(df, "price", _config(n_trials=1), ["DecisionTree"], _SPACE, {"DecisionTree": _POLICY})
    e.run()
    return e.refit_and_save(path, top_k=2)


@query("l2_batch_scoring")
def l2(spark, sf_dir):
    """The recorded best model loaded and applied to every listing."""
    path = scratch_path(spark, "artefacts")
    df = cut_lineage(fx.listings(spark, sf_dir).select("row_key", "price", "mileage", "mpg", "brand"))
    _experiment(df, path)
    scored = make_predictor(spark, path)(df)
    return score(scored.select("brand", F.col("price").alias("y_true"), F.col("prediction").alias("y_pred")), ["brand"], ["MAE", "R2"])


@query("l2_stream_scoring")
def l2_stream(spark, sf_dir):
    """The same predictor on a stream of listing files."""
    from plumbline.streaming.scoring import score_stream, stream_parquet

    source, target = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    fx.folded(spark, sf_dir).write.parquet(source)
    df = spark.read.parquet(source)
    feats = assembly.fit_features(df, _ROLES, _POLICY, "y_log", "row_key")
    fitted = models.build_model("LinearRegression").fit(feats.transform(df), "y_log")
    stream = stream_parquet(spark, source, df.schema)
    score_stream(stream, Predictor(feats.pipeline, fitted), target).awaitTermination()
    return spark.read.parquet(target).groupBy("outer_fold").agg(
        F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean_prediction")
    )
