"""Fits whose results SQL can state: closed forms, optimality conditions, additivity and round trips."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import encode, explain, features, folds, models, numeric, select, trials
from plumbline.plans import fixtures as fx
from plumbline.plans.catalog import query
from plumbline.plans.fixtures import rd, rounded
from plumbline.plans.queries.explanation import _entries_of, _fold_entries, _stacked
from plumbline.plans.queries.explanation import _store as _linear_store
from plumbline.session import cut_lineage, scratch_path


def _flagged(spark, sf_dir) -> DataFrame:
    """Listings with one binary feature, large orders, whose models have closed forms."""
    df = fx.folded(spark, sf_dir, even=True).withColumns(
        {"flag": (F.col("mpg") > 25).cast("double"), "y": F.col("mileage") / 1000}
    )
    return cut_lineage(VectorAssembler(inputCols=["flag"], outputCol="features").transform(df))


_FLAGGED = fx.FOLDED + ", f AS (SELECT *, CAST(mpg > 25 AS DOUBLE) AS flag, mileage / 1000 AS y FROM folded)"


def _by_flag(fitted, df: DataFrame) -> DataFrame:
    points = df.groupBy("flag", "features").agg(F.count(F.lit(1)).alias("n"))
    return fitted.predict(points, "prediction").select("flag", "n", rd("prediction", 4).alias("prediction"))


# ---- trees and their ensembles ---------------------------------------------------------


@query("g2_tree_step", f"WITH {_FLAGGED} SELECT flag, count(*) AS n, round(avg(y), 4) AS prediction FROM f GROUP BY flag")
def g2_step(spark, sf_dir):
    """A tree on a binary feature predicts the mean of either side."""
    df = _flagged(spark, sf_dir)
    return _by_flag(models.build_model("DecisionTree", {"max_depth": 1}).fit(df, "y"), df)


@query("g3_forest_step", f"WITH {_FLAGGED} SELECT flag, count(*) AS n, round(avg(y), 4) AS prediction FROM f GROUP BY flag")
def g3_step(spark, sf_dir):
    """Without bootstrap, the trees of a forest are that tree."""
    df = _flagged(spark, sf_dir)
    return _by_flag(models.build_model("RandomForest", {"max_depth": 1, "n_estimators": 3, "bootstrap": 0}).fit(df, "y"), df)


_RATE, _ALPHA, _LAMBDA, _ROUNDS, _PATIENCE = 0.05, 60.0, 100.0, 30, 4


@query(
    "g4_early_stopping",
    f"""WITH RECURSIVE {_FLAGGED}, g AS (SELECT flag, mpg BETWEEN 16 AND 35 AS held, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM f GROUP BY 1, 2),
p AS (SELECT max(n) FILTER (flag = 0 AND NOT held) AS n0, max(s) FILTER (flag = 0 AND NOT held) AS s0,
  max(n) FILTER (flag = 1 AND NOT held) AS n1, max(s) FILTER (flag = 1 AND NOT held) AS s1,
  max(n) FILTER (flag = 0 AND held) AS m0, max(s) FILTER (flag = 0 AND held) AS t0, max(q) FILTER (flag = 0 AND held) AS q0,
  max(n) FILTER (flag = 1 AND held) AS m1, max(s) FILTER (flag = 1 AND held) AS t1, max(q) FILTER (flag = 1 AND held) AS q1 FROM g),
r AS (SELECT 0 AS k, (s0 + s1) / (n0 + n1) AS a, (s0 + s1) / (n0 + n1) AS b FROM p
  UNION ALL SELECT k + 1,
   a + {_RATE} * sign(s0 - n0 * a) * greatest(abs(s0 - n0 * a) - {_ALPHA}, 0) / (n0 + {_LAMBDA}),
   b + {_RATE} * sign(s1 - n1 * b) * greatest(abs(s1 - n1 * b) - {_ALPHA}, 0) / (n1 + {_LAMBDA}) FROM r, p WHERE k < {_ROUNDS}),
l AS (SELECT k, a, b, (q0 - 2 * a * t0 + m0 * a * a + q1 - 2 * b * t1 + m1 * b * b) / (m0 + m1) AS loss FROM r, p WHERE k > 0),
best AS (SELECT * FROM l ORDER BY loss LIMIT 1)
SELECT k AS rounds, CAST(least(k + {_PATIENCE}, {_ROUNDS}) AS INTEGER) AS tried, round(loss, 4) AS loss, round(a, 4) AS low, round(b, 4) AS high FROM best""",
)
def g4_stop(spark, sf_dir):
    """The validation loss turns, boosting ends after some rounds without gain, and the best round is kept."""
    df = _flagged(spark, sf_dir).withColumn("held", F.col("mpg").between(16, 35))
    p = {
        "n_estimators": _ROUNDS, "max_depth": 1, "learning_rate": _RATE, "reg_alpha": _ALPHA, "reg_lambda": _LAMBDA,
        "early_stopping_rounds": _PATIENCE,
    }
    fitted = models.build_model("BoostedTrees", p).fit(df, "y", valid="held")
    at = {r["flag"]: r["prediction"] for r in _by_flag(fitted, df).collect()}
    row = (len(fitted.trees), len(fitted.history), float(min(fitted.history)), at[0.0], at[1.0])
    out = spark.createDataFrame([row], "rounds int, tried int, loss double, low double, high double")
    return rounded(out, "loss", digits=4)


_RATE_BAG = 0.8


def _poisson_sql(u: str, rate: float) -> str:
    """The draw as SQL: how many partial sums of the distribution the uniform has reached."""
    top = int(np.ceil(rate + 8 * np.sqrt(rate) + 12))
    terms, term, total = [], np.exp(-rate), np.exp(-rate)
    for k in range(1, top + 1):
        terms.append(f"CAST({u} >= {float(total)!r} AS INTEGER)")
        term *= rate / k
        total += term
    return " + ".join(terms)


@query(
    "g5_bagged_means",
    f"""WITH {_FLAGGED}, b AS (SELECT flag, y, bag, {fx.hash_sql("row_key || '#' || bag", 42)} / 4294967296.0 AS u FROM f, (SELECT unnest([0, 1, 2]) AS bag)),
w AS (SELECT flag, y, bag, {_poisson_sql('u', _RATE_BAG)} AS w FROM b),
m AS (SELECT flag, bag, sum(w * y) / sum(w) AS m FROM w GROUP BY flag, bag), n AS (SELECT flag, count(*) AS n FROM f GROUP BY flag)
SELECT flag, n, round(avg(m), 4) AS prediction FROM m JOIN n USING (flag) GROUP BY flag, n""",
)
def g5_means(spark, sf_dir):
    """Three bags of Poisson weights: the mean of their weighted means."""
    df = _flagged(spark, sf_dir)
    p = {"n_estimators": 3, "base": "DecisionTree", "max_samples": _RATE_BAG, "base__max_depth": 1}
    return _by_flag(models.build_model("Bagging", p, 42).fit(df, "y"), df)


# ---- weights ---------------------------------------------------------------------------


@query(
    "g6_weighted_line",
    f"""WITH {fx.FOLDED}, c AS (SELECT brand, count(*) AS c FROM folded WHERE outer_fold <> 0 GROUP BY brand),
w AS (SELECT mileage AS x, price AS y, (SELECT sum(c) FROM c) / (CAST((SELECT count(*) FROM c) AS DOUBLE) * c) AS w FROM folded JOIN c USING (brand) WHERE outer_fold <> 0),
s AS (SELECT sum(w) AS s, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w)
SELECT round(sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)), 6) AS slope, count(*) AS n FROM w, s""",
)
def g6_line(spark, sf_dir):
    """Least squares on rows that are weighted against the frequency of their brand, counted on the training rows."""
    train = fx.folded(spark, sf_dir).filter("outer_fold <> 0")
    df = cut_lineage(VectorAssembler(inputCols=["mileage"], outputCol="features").transform(encode.balanced_weights(train, "brand", "w")))
    fitted = models.build_model("LinearRegression").fit(df, "price", "w")
    return spark.createDataFrame([(round(float(fitted.model.coefficients[0]), 6), df.count())], "slope double, n bigint")


@query(
    "g6_balanced_tree",
    f"""WITH {fx.LISTINGS}, t AS (SELECT CAST(year >= 1998 AS DOUBLE) AS late, CAST(year AS DOUBLE) AS y FROM listings),
c AS (SELECT y, 1.0 / count(*) AS w FROM t GROUP BY y)
SELECT late, count(*) AS n, round(sum(w * t.y) / sum(w), 4) AS prediction FROM t JOIN c USING (y) GROUP BY late""",
)
def g6_tree(spark, sf_dir):
    """A tree with balanced weighting: every year counts alike, however many listings it has."""
    df = fx.listings(spark, sf_dir).select((F.col("year") >= 1998).cast("double").alias("late"), F.col("year").cast("double").alias("y"))
    df = cut_lineage(VectorAssembler(inputCols=["late"], outputCol="features").transform(df))
    fitted = models.build_model("DecisionTree", {"max_depth": 1, "balanced_weighting": True}).fit(df, "y")
    points = df.groupBy("late", "features").agg(F.count(F.lit(1)).alias("n"))
    return fitted.predict(points, "prediction").select("late", "n", rd("prediction", 4).alias("prediction"))


# ---- residual models -------------------------------------------------------------------


@query(
    "g7_residual_line",
    f"""WITH {_FLAGGED}, m AS (SELECT avg(y) AS m FROM f), r AS (SELECT y - m AS e, mileage FROM f, m)
SELECT round(regr_slope(e, mileage), 8) AS slope, round(regr_intercept(e, mileage), 4) AS intercept FROM r""",
)
def g7_line(spark, sf_dir):
    """Without penalty, the elastic net on the residual of a constant is least squares."""
    df = _flagged(spark, sf_dir).drop("features")
    df = VectorAssembler(inputCols=["mileage"], outputCol="features").transform(df)
    stack = models.Stacked(models.base_model("DecisionTree", {"max_depth": 0}, 42), [models.residual_model("ElasticNet", {"alpha": 0.0}, 42)]).fit(df, "y")
    line = stack.residuals[0].model
    out = spark.createDataFrame([(float(line.coefficients[0]), float(line.intercept))], "slope double, intercept double")
    return out.select(rd("slope", 8).alias("slope"), rd("intercept", 4).alias("intercept"))


@query(
    "g8_g12_residuals_help",
    "SELECT unnest(['Huber', 'FuzzyLogic', 'EvolutionaryStacking', 'PseudoHuber']) AS kind, CAST(unnest([1, 1, 1, 1]) AS BOOLEAN) AS closer",
)
def g8_to_g12(spark, sf_dir):
    """Every residual model brings a coarse tree closer to the rows held out, in mean absolute error."""
    df = VectorAssembler(inputCols=["mileage", "mpg", "tax"], outputCol="features").transform(fx.folded(spark, sf_dir, even=True))
    # written once with the columns that the fits need: every fit keeps what it is given
    df = cut_lineage(df.select("row_key", "outer_fold", "features", (F.col("price") / 20_000).alias("y")))
    train, held = df.filter("outer_fold <> 0"), df.filter("outer_fold = 0")
    settings = {
        "Huber": {}, "FuzzyLogic": {"n_rules": 4}, "EvolutionaryStacking": {"max_iter": 5, "rf_n_estimators": 4},
        "PseudoHuber": {"n_estimators": 5, "max_depth": 3, "learning_rate": 0.5},
    }
    rows = []
    for kind, params in settings.items():
        fitted = models.build_model("DecisionTree", {"max_depth": 2}, 42, [{"kind": kind, "params": params}]).fit(train, "y")
        scored = fitted.predict(fitted.base.predict(held, "b"), "p")
        miss = scored.agg(F.avg(F.abs(F.col("y") - F.col("b"))), F.avg(F.abs(F.col("y") - F.col("p")))).first()
        rows.append((kind, bool(miss[1] < miss[0])))
    return spark.createDataFrame(rows, "kind string, closer boolean")


@query("g9_share_below", "SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS quantile, CAST(unnest([1, 1, 1]) AS BOOLEAN) AS right_share")
def g9_share(spark, sf_dir):
    """The wanted share of the rows lies below a quantile line."""
    df = VectorAssembler(inputCols=["mpg"], outputCol="features").transform(fx.listings(spark, sf_dir))
    df = cut_lineage(df.withColumn("y", F.col("price") / 1000))
    rows = []
    for q in (0.25, 0.5, 0.75):
        fitted = models.residual_model("Quantile", {"quantile": q, "alpha": 0.0}, 42).fit(df, "y")
        below = fitted.predict(df, "p").agg(F.avg((F.col("y") < F.col("p")).cast("double"))).first()[0]
        rows.append((q, bool(abs(below - q) < 0.01)))
    return spark.createDataFrame(rows, "quantile double, right_share boolean")


@query("g10_one_rule", f"WITH {_FLAGGED} SELECT flag, count(*) AS n, round((SELECT avg(y) FROM f), 4) AS prediction FROM f GROUP BY flag")
def g10_rule(spark, sf_dir):
    """A single rule holds everywhere: the fit is the mean."""
    df = _flagged(spark, sf_dir)
    return _by_flag(models.residual_model("FuzzyLogic", {"n_rules": 1}, 42).fit(df, "y"), df)


# ---- transforms and selection ----------------------------------------------------------


@query("e6_likelihood_is_highest", "SELECT unnest(['mileage', 'mpg', 'engineSize']) AS \"column\", CAST(unnest([1, 1, 1]) AS BOOLEAN) AS highest")
def e6_highest(spark, sf_dir):
    """No neighbouring exponent has a higher likelihood than the one found."""
    df, cols = fx.stored_folded(spark, sf_dir), ["mileage", "mpg", "engineSize"]
    fit = numeric.fit_power(df, cols)
    rows = []
    for c in cols:
        tried = [fit.lambdas[c] + d for d in (-0.05, 0.0, 0.05)]
        spread = [F.var_pop(numeric.yeo_johnson(c, t)).alias(f"v{k}") for k, t in enumerate(tried)]
        r = df.agg(F.count(c).alias("n"), F.sum(F.signum(F.col(c).cast("double")) * F.log1p(F.abs(F.col(c).cast("double")))).alias("s"), *spread).first()
        score = [-r["n"] / 2 * np.log(r[f"v{k}"]) + (t - 1) * r["s"] for k, t in enumerate(tried)]
        rows.append((c, bool(score[1] >= max(score))))
    return spark.createDataFrame(rows, "column string, highest boolean")


@query(
    "e8_normal_scores",
    f"""WITH {fx.LISTINGS} SELECT count(*) AS n, count(DISTINCT mpg) AS levels, true AS ordered, true AS centred, true AS spread FROM listings""",
)
def e8_scores(spark, sf_dir):
    """Normal scores keep the order of the values and have the moments of a standard normal."""
    df = fx.listings(spark, sf_dir)
    fit = numeric.fit_quantiles(df, ["mpg", "mileage"])
    out = cut_lineage(numeric.quantile_normal(numeric.quantile_normal(df, "mpg", fit, "z"), "mileage", fit, "zm").select("mpg", "z", "zm"))
    from pyspark.sql import Window as W

    # One row for each of the 50 levels of mpg.
    steps = out.groupBy("mpg").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    steps = steps.withColumn("next", F.lead("lo").over(W.orderBy("mpg")))
    told = steps.agg(F.count(F.lit(1)).alias("levels"), F.min((F.col("lo") == F.col("hi")) & F.coalesce(F.col("next") > F.col("hi"), F.lit(True))).alias("ordered"))
    moments = out.agg(F.count("z").alias("n"), (F.abs(F.avg("zm")) < 0.02).alias("centred"), (F.abs(F.stddev_pop("zm") - 1) < 0.03).alias("spread"))
    return moments.crossJoin(told).select("n", "levels", "ordered", "centred", "spread")  # one row each


def _scaled(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    df = fx.stored_folded(spark, sf_dir)
    fit = numeric.standard_scale_fit(df, list(fx.NUMERIC))
    return cut_lineage(df.select("row_key", "outer_fold", "y_log", *[F.expr(numeric.standard_scale_sql(c, fit[c])).alias(c) for c in fx.NUMERIC])), list(fx.NUMERIC)


@query("e10_lasso_optimum", "SELECT unnest(['year', 'mileage', 'tax', 'mpg', 'engineSize']) AS feature, CAST(unnest([1, 1, 1, 1, 1]) AS BOOLEAN) AS optimal")
def e10_optimum(spark, sf_dir):
    """At the optimum, a feature's slope of the squares is alpha against its sign, or less where it is left out."""
    df, cols = _scaled(spark, sf_dir)
    s = select.select_lasso(folds.with_folds(df, "row_key", 10, 7, "cv"), cols, "y_log", "cv")
    rest = F.col("y_log") - sum((F.lit(float(w)) * F.col(c) for c, w in zip(cols, s.coefficients)), F.lit(0.0))
    slopes = df.withColumn("e", rest).agg(*[F.covar_pop(c, "e").alias(c) for c in cols]).first()
    rows = []
    for c, w in zip(cols, s.coefficients):
        gap = abs(slopes[c] - s.alpha * np.sign(w)) if w else max(abs(slopes[c]) - s.alpha, 0.0)
        rows.append((c, bool(gap < 1e-5)))
    return spark.createDataFrame(rows, "feature string, optimal boolean")


@query("e11_no_worse_than_all", "SELECT true AS some, true AS no_worse")
def e11_no_worse(spark, sf_dir):
    """The evolved subset costs no more than all features, validated on the same rows."""
    df, cols = _scaled(spark, sf_dir)
    split = cut_lineage(folds.with_holdout(df, "row_key"))
    s = select.select_genetic(split, cols, "y_log", "is_valid")
    parts = select.moments_by(split.withColumn("g", F.col("is_valid").cast("int")), cols, "y_log", "g")

    def cost(mask: list[bool]) -> float:
        at = np.ix_(*[[0, *(np.flatnonzero(mask) + 1), len(cols) + 1]] * 2)
        w, b = select.ridge(select.Moments(parts[0].matrix[at]), 1.0)
        return select.Moments(parts[1].matrix[at]).mse(w, b) + 0.01 * float(np.mean(mask))

    return spark.createDataFrame([(any(s.mask), bool(cost(s.mask) <= cost([True] * len(cols)) + 1e-9))], "some boolean, no_worse boolean")


# ---- explanations ----------------------------------------------------------------------

_ENSEMBLES = {"RandomForest": {"n_estimators": 4, "max_depth": 2}, "BoostedTrees": {"n_estimators": 4, "max_depth": 2}}


@query(
    "k9_ensemble_shapley",
    f"""WITH {fx.FOLDED} SELECT unnest(['RandomForest', 'BoostedTrees']) AS model, outer_fold, count(*) AS n, true AS additive, true AS same_as_walks
FROM folded GROUP BY outer_fold""",
)
def k9_ensembles(spark, sf_dir):
    """Values of all held-out rows add up to the prediction over the background's mean, and equal those of walks.

    Trees of depth two join two features at most, for which an order and its reverse are exact.
    """
    out = []
    for name, entries in _entries_of(spark, sf_dir, _ENSEMBLES, "tree").items():
        for e in entries:
            exact = explain.tree_shapley(e, background=20)
            walked = explain.permutation_shapley(e, background=20, eval_rows=15)
            out.append(_checked_values(e, exact, walked).select(F.lit(name).alias("model"), F.lit(e.outer_fold).alias("outer_fold"), "n", "additive", "same_as_walks"))
    return _stacked(out)


def _checked_values(e: explain.Entry, exact: DataFrame, walked: DataFrame) -> DataFrame:
    """Whether exact values add up to the predictions, and equal the walked ones; the exact ones are made once."""
    # a few rows, written so that their size is known; least and most, as rows may share a key
    ends = cut_lineage(walked.groupBy("row_key", "feature").agg(F.min("phi").alias("low"), F.max("phi").alias("high")))
    near = (F.abs(F.col("phi") - F.col("low")) < 1e-8) & (F.abs(F.col("phi") - F.col("high")) < 1e-8)
    sums = exact.join(ends, ["row_key", "feature"], "left").groupBy("row_key").agg(F.sum("phi").alias("total"), F.min(near).alias("near"))
    told = e.fitted.predict(e.rows, "p").select(F.col("row_key").cast("string").alias("row_key"), "p")
    gap = sums.join(told, "row_key").withColumn("gap", F.col("p") - F.col("total"))
    return gap.agg(
        F.count(F.lit(1)).alias("n"), (F.max("gap") - F.min("gap") < 1e-8).alias("additive"), F.min("near").alias("same_as_walks")
    )


@query(
    "k2_tree_curves",
    f"WITH {fx.FOLDED} SELECT outer_fold, count(*) AS n_samples, 10 AS features, true AS same_as_scoring FROM folded GROUP BY outer_fold",
)
def k2_trees(spark, sf_dir):
    """Curves of a forest from its leaves equal those of scoring every row at every point."""
    out = []
    for e in _fold_entries(spark, sf_dir, "RandomForest", {"n_estimators": 3, "max_depth": 4}, "tree"):
        fast = explain.partial_dependence([e], e.label, max_features=10, grid_size=3)
        sample = explain.sampled(e)
        (grids,) = explain.feature_grids([sample], range(len(e.feature_names)), 3)
        slow = explain._scored_curves(e, sample, grids).select("fidx", "grid_value", F.col("prediction_mean").alias("mean"), F.col("prediction_std").alias("sd"))
        both = fast.join(slow, (F.col("feature_index") == F.col("fidx")) & (fast["grid_value"] == slow["grid_value"]))
        gap = F.greatest(F.abs(F.col("prediction_mean") - F.col("mean")), F.abs(F.col("prediction_std") - F.col("sd")))
        told = both.groupBy("outer_fold", "n_samples").agg(F.count_distinct("fidx").cast("int").alias("features"), (F.max(gap) < 1e-6).alias("same_as_scoring"))
        out.append(told)
    return _stacked(out)


@query(
    "d7_linear_audit",
    f"""WITH {fx.FOLDED}, f AS (SELECT DISTINCT outer_fold FROM folded)
SELECT outer_fold, unnest(['mileage', 'mpg', 'engineSize', 'tax']) AS feature, CAST(unnest([-1, 0, 1, 0]) AS INTEGER) AS direction,
 CAST(19 AS BIGINT) AS steps, CAST(unnest([19, 0, 19, 0]) AS BIGINT) AS violations FROM f""",
)
def d7_linear(spark, sf_dir):
    """A function that rises with mileage and falls with the engine breaks both expectations at every step."""
    curves = explain.partial_dependence(_linear_store(spark, sf_dir), "Linear", features=["mileage", "mpg", "engineSize", "tax"])
    return features.monotonicity_audit(curves).select("outer_fold", "feature", "direction", "steps", "violations")


# ---- whole runs ------------------------------------------------------------------------


@query(
    "e13_policies_cover_rows",
    f"""WITH {fx.FOLDED} SELECT unnest(['RandomForest', 'LinearRegression']) AS policy, count(*) AS n, true AS complete FROM folded WHERE outer_fold = 0""",
)
def e13_cover(spark, sf_dir):
    """Every assembled feature has a value in every held-out row."""
    from plumbline.plans.queries.features import e13

    out = e13(spark, sf_dir).groupBy("policy").agg(F.max("n").alias("n"), ((F.min("n") == F.max("n")) & (F.count_if(F.isnan("mean") | F.col("mean").isNull()) == 0)).alias("complete"))
    return out.select("policy", "n", "complete")


@query(
    "e14_shares_of_folds",
    "SELECT CAST(7 AS BIGINT) AS features, CAST(5 AS BIGINT) AS n_folds, true AS whole_folds",
)
def e14_shares(spark, sf_dir):
    """Every feature is judged in every fold, and its share is a number of whole folds."""
    from plumbline.plans.queries.features import e14

    fifths = F.col("selected_share") * 5
    whole = (F.abs(fifths - F.round(fifths)) < 1e-9) & F.col("selected_share").between(0, 1)
    return e14(spark, sf_dir).agg(F.count(F.lit(1)).alias("features"), F.min("n_folds").alias("n_folds"), F.min(whole).alias("whole_folds"))


@query(
    "h2_every_fold_scored",
    """SELECT CAST(unnest([0, 1]) AS INTEGER) AS outer_fold, CAST(3 AS BIGINT) AS variants, CAST(unnest([1, 1]) AS BOOLEAN) AS finite,
 CAST(unnest([1, 1]) AS BOOLEAN) AS better_than_mean""",
)
def h2_scored(spark, sf_dir):
    """Nested tuning scores every variant once in every outer fold, and its trees beat the mean."""
    from plumbline.plans.queries.models import h2

    out = h2(spark, sf_dir).groupBy("outer_fold").agg(
        F.count(F.lit(1)).alias("variants"),
        (F.count_if(F.isnan("R2") | F.isnan("MAE") | F.isnan("RMSE")) == 0).alias("finite"),
        (F.max("R2") > 0.5).alias("better_than_mean"),
    )
    return out.withColumn("outer_fold", F.col("outer_fold").cast("int"))


@query(
    "l2_stream_equals_batch",
    f"WITH {fx.FOLDED} SELECT outer_fold, count(*) AS n, true AS same FROM folded GROUP BY outer_fold",
)
def l2_same(spark, sf_dir):
    """What a stream of files is scored with equals the scores of the same rows in a batch."""
    from plumbline.plans.queries.models import _POLICY, _ROLES
    from plumbline.plans.serving import Predictor
    from plumbline.operators import assembly
    from plumbline.streaming.scoring import score_stream, stream_parquet

    source, target = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    fx.folded(spark, sf_dir).write.parquet(source)
    df = spark.read.parquet(source)
    feats = assembly.fit_features(df, _ROLES, _POLICY, "y_log", "row_key")
    fitted = models.build_model("LinearRegression").fit(feats.transform(df), "y_log")
    score_stream(stream_parquet(spark, source, df.schema), Predictor(feats.pipeline, fitted), target).awaitTermination()
    streamed = spark.read.parquet(target).select("row_key", "outer_fold", F.col("prediction").alias("streamed"))
    batch = Predictor(feats.pipeline, fitted)(df).select("row_key", "prediction")
    both = streamed.join(batch, "row_key")
    return both.groupBy("outer_fold").agg(F.count(F.lit(1)).alias("n"), (F.max(F.abs(F.col("streamed") - F.col("prediction"))) < 1e-9).alias("same"))


@query(
    "g16_refitted_model_scores",
    f"WITH {fx.LISTINGS} SELECT brand, count(*) AS n, true AS close FROM listings GROUP BY brand",
)
def g16_scores(spark, sf_dir):
    """Tuned, refitted, saved and loaded again: the model explains the listings of every brand."""
    from plumbline.plans.queries.models import l2

    counted = fx.listings(spark, sf_dir).groupBy("brand").agg(F.count(F.lit(1)).alias("n"))
    return l2(spark, sf_dir).select("brand", (F.col("R2") > 0.8).alias("close")).join(counted, "brand").select("brand", "n", "close")


# ---- the trial log ---------------------------------------------------------------------


@query(
    "h7_trial_append",
    f"""WITH {fx.TRIALS}, a AS (SELECT *, 'first' AS run, CAST(NULL AS VARCHAR) AS param__deep FROM trials WHERE model <> 'view' UNION ALL
  SELECT *, 'second' AS run, CAST(trial_number % 3 AS VARCHAR) AS param__deep FROM trials WHERE model = 'view')
SELECT run, model, count(*) AS n, count(param__k) AS with_k, count(param__deep) AS with_deep, round(sum(value), 4) AS total FROM a GROUP BY run, model""",
)
def h7_append(spark, sf_dir):
    """Two runs with different parameters, one of them written twice: the log holds each once."""
    path = scratch_path(spark, "trials")
    log = fx.trials(spark, sf_dir)
    first = log.filter("model <> 'view'")
    second = log.filter("model = 'view'").withColumn("param__deep", F.col("trial_number") % 3)
    trials.append_trials(first.limit(5), path, "first")
    trials.append_trials(second, path, "second")
    trials.append_trials(first, path, "first")
    out = trials.read_trials(spark, path).groupBy("run", "model")
    return out.agg(
        F.count(F.lit(1)).alias("n"), F.count("param__k").alias("with_k"), F.count("param__deep").alias("with_deep"), rd(F.sum("value"), 4).alias("total")
    )
