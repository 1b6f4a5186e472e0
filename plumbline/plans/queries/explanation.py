"""Explanation tables."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import explain, features, models
from plumbline.plans import fixtures as fx
from plumbline.plans.catalog import query
from plumbline.plans.fixtures import rd, rounded, table
from plumbline.plans.queries.models import prepared
from plumbline.session import Stored, cut_lineage, scratch_path
from plumbline.sources import sinks

_COLS = ("mileage", "mpg", "engineSize", "tax")
_WEIGHTS = (0.9, 25.0, -40.0, 30000.0)
_START = 500.0


def _store(spark, sf_dir, folds=range(fx.FOLDS)) -> list[explain.Entry]:
    """A known linear function of raw columns, explained on the rows of each fold."""
    df = VectorAssembler(inputCols=list(_COLS), outputCol="features").transform(fx.stored_folded(spark, sf_dir))
    names = [f"num__{c}" for c in _COLS]
    fitted = models.LinearFitted(list(_WEIGHTS), _START)
    return [
        explain.Entry("Linear", "Linear", f, fitted, df.filter(F.col("outer_fold") == f), names, policy="linear") for f in folds
    ]


_SAMPLE = fx.FOLDED + """, ranked AS (SELECT outer_fold AS fold, row_key, mileage, mpg, CAST(engineSize AS DOUBLE) AS engineSize, tax FROM folded),
s AS (SELECT *, 500.0 + 0.9 * mileage + 25.0 * mpg - 40.0 * engineSize + 30000.0 * tax AS p0,
  row_number() OVER (PARTITION BY fold ORDER BY row_key) - 1 AS pos, count(*) OVER (PARTITION BY fold) AS size FROM ranked),
cells AS (SELECT fold, row_key, pos, size, p0, unnest(['mileage', 'mpg', 'engineSize', 'tax']) AS feature, unnest([0, 1, 2, 3]) AS fidx,
  unnest([mileage, mpg, engineSize, tax]) AS x, unnest([0.9, 25.0, -40.0, 30000.0]) AS w FROM s),
ends AS (SELECT fold, fidx, quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM cells GROUP BY fold, fidx),
grid AS (SELECT fold, fidx, range AS g, lo + (hi - lo) * range / 19.0 AS v FROM ends, range(20) WHERE lo <> hi)"""


@query(
    "k2_partial_dependence",
    f"""WITH {_SAMPLE} SELECT 'Linear' AS model, c.fold AS outer_fold, feature, c.fidx AS feature_index, round(v, 6) AS grid_value,
round(avg(p0 + w * (v - x)), 3) AS prediction_mean, round(stddev_pop(p0 + w * (v - x)), 3) AS prediction_std, count(*) AS n_samples
FROM cells c JOIN grid ON grid.fold = c.fold AND grid.fidx = c.fidx GROUP BY c.fold, feature, c.fidx, g, v""",
)
def k2(spark, sf_dir):
    out = explain.partial_dependence(_store(spark, sf_dir), "Linear", features=list(_COLS))
    return rounded(rounded(out, "grid_value"), "prediction_mean", "prediction_std", digits=3)


@query("d7_monotonicity_audit")
def d7_audit(spark, sf_dir):
    """Steps of a tree's curves of all features and folds against the expected direction."""
    store = _fold_entries(spark, sf_dir, "DecisionTree", {"max_depth": 5}, "tree")
    every = list(range(len(store[0].feature_names)))
    return features.monotonicity_audit(explain.partial_dependence(store, "DecisionTree", features=every))


@query(
    "k3_default_features",
    f"""WITH {fx.LISTINGS}, v AS (SELECT unnest(['year', 'mileage', 'tax', 'mpg', 'engineSize']) AS feature,
 unnest([var_pop(year), var_pop(mileage), var_pop(tax), var_pop(mpg), var_pop(engineSize)]) AS variance FROM listings)
SELECT feature, round(variance, 3) AS variance FROM v WHERE variance > 0 ORDER BY variance DESC LIMIT 4""",
)
def k3(spark, sf_dir):
    df = fx.listings(spark, sf_dir).withColumn("flat", F.lit(7.0))
    return rounded(explain.variance_ranking(df, [*fx.NUMERIC, "flat"], 4), "variance", digits=3)


@query(
    "k4_counterfactuals",
    f"""WITH {_SAMPLE}, d AS (SELECT fold, 0.25 * stddev_pop(p0) AS delta FROM s GROUP BY fold),
pick AS (SELECT c.*, p0 + delta AS target FROM cells c JOIN d USING (fold)
  WHERE list_contains(list_transform(range(5), lambda i: CAST(floor(i * (size - 1) / 4.0) AS BIGINT)), pos)),
tried AS (SELECT pick.*, g, v, abs(v - x) AS change, p0 + w * (v - x) AS p1 FROM pick JOIN grid ON grid.fold = pick.fold AND grid.fidx = pick.fidx),
best AS (SELECT *, row_number() OVER (PARTITION BY fold, pos ORDER BY change, fidx, g) AS r FROM tried WHERE p1 >= target)
SELECT 'Linear' AS model, fold AS outer_fold, CAST(pos AS INTEGER) AS instance_index, feature, fidx AS feature_index, round(x, 6) AS original_value,
 round(v, 6) AS counterfactual_value, round(change, 6) AS absolute_change, round(p0, 3) AS original_prediction,
 round(p1, 3) AS counterfactual_prediction, round(target, 3) AS target_prediction, 'increase' AS direction FROM best WHERE r = 1""",
)
def k4(spark, sf_dir):
    out = explain.counterfactuals(_store(spark, sf_dir), "Linear", features=list(_COLS))
    out = rounded(out, "original_value", "counterfactual_value", "absolute_change")
    return rounded(out, "original_prediction", "counterfactual_prediction", "target_prediction", digits=3)


@query(
    "k5_group_entries",
    """WITH e AS (SELECT DISTINCT event_type AS model_name, CASE WHEN user_id % 3 = 0 THEN event_type ELSE event_type || '+K' || CAST(user_id % 3 AS VARCHAR) END
  AS model_label, CAST(user_id % 5 AS INTEGER) AS outer_fold FROM events),
n AS (SELECT model_name AS model, model_name, model_label, outer_fold FROM e UNION SELECT model_label, model_name, model_label, outer_fold FROM e)
SELECT * FROM n WHERE model_name IN ('view') OR model_label IN ('click+K1', 'view')""",
)
def k5(spark, sf_dir):
    kind = F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("+K"), (F.col("user_id") % 3).cast("string"))).otherwise("")
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model_name"), F.concat("event_type", kind).alias("model_label"),
        (F.col("user_id") % 5).cast("int").alias("outer_fold"),
    ).distinct()
    return explain.group_entries(e, ["view", "click+K1"]).select("model", "model_name", "model_label", "outer_fold")


@query(
    "k7_linear_shapley",
    f"""WITH {fx.FOLDED}, ev AS (SELECT outer_fold, row_key, mileage, mpg, CAST(engineSize AS DOUBLE) AS engineSize, tax FROM folded),
bg AS (SELECT outer_fold, avg(mileage) AS a, avg(mpg) AS b, avg(engineSize) AS c, avg(tax) AS d FROM ev GROUP BY outer_fold)
SELECT outer_fold, row_key, unnest(['mileage', 'mpg', 'engineSize', 'tax']) AS feature, unnest([mileage, mpg, engineSize, tax]) AS value,
 round(unnest([0.9 * (mileage - a), 25.0 * (mpg - b), -40.0 * (engineSize - c), 30000.0 * (tax - d)]), 4) + 0.0 AS phi FROM ev JOIN bg USING (outer_fold)""",
)
def k7(spark, sf_dir):
    out = None
    for entry in _store(spark, sf_dir):
        one = explain.linear_shapley(entry, _WEIGHTS)
        out = one if out is None else out.unionByName(one)
    return rounded(out, "phi", digits=4).select("outer_fold", "row_key", "feature", "value", "phi")


def _shapley_report(shap):
    return shap.groupBy("model", "outer_fold", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("phi")).alias("mean_abs"), F.avg("phi").alias("mean")
    )


def _fold_entries(spark, sf_dir, name: str, params: dict, policy: str) -> list[explain.Entry]:
    """A model of each fold with its held-out rows."""
    return _entries_of(spark, sf_dir, {name: params}, policy)[name]


def _entries_of(spark, sf_dir, settings: dict[str, dict], policy: str) -> dict[str, list[explain.Entry]]:
    """Models of each fold with its held-out rows; the features of a fold are made once for all models.

    Training rows are written and go when the models are fitted; held-out rows stay, as explanations read
    them many times.
    """
    df = fx.stored_folded(spark, sf_dir)
    out: dict[str, list[explain.Entry]] = {name: [] for name in settings}
    for fold in range(fx.FOLDS):
        train, held, names = prepared(spark, sf_dir, fold, df)
        train = Stored(train.select("row_key", "features", "y_log"))
        held = cut_lineage(held)
        for name, params in settings.items():
            fitted = models.build_model(name, params).fit(train.rows, "y_log")
            out[name].append(explain.Entry(name, name, fold, fitted, held, names, policy=policy))
        train.drop()
    return out


def _stacked(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


@query("k8_permutation_shapley")
def k8(spark, sf_dir):
    """Model-agnostic Shapley values of a boosted model: a sample of 300 rows of each fold, as the reference's kernel policy."""
    entries = _fold_entries(spark, sf_dir, "BoostedTrees", {"n_estimators": 5, "max_depth": 3}, "kernel")
    return _stacked([_shapley_report(explain.permutation_shapley(e, eval_rows=300)) for e in entries])


@query("k9_tree_shapley")
def k9(spark, sf_dir):
    """Exact Shapley values of a tree for all held-out rows of all folds, beside its impurity importances."""
    entries = _fold_entries(spark, sf_dir, "DecisionTree", {"max_depth": 6}, "tree")
    return _stacked(
        [
            _shapley_report(explain.tree_shapley(e)).join(explain.tree_importances(e).select("feature", "importance"), "feature")
            for e in entries
        ]
    )


def _shap_rows(spark, sf_dir):
    """Linear contributions of every listing about its fold's mean; one fold lacks a feature."""
    df = fx.folded(spark, sf_dir)
    means = cut_lineage(df.groupBy("outer_fold").agg(*[F.avg(c).alias(f"m_{c}") for c in _COLS]))
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"), F.lit(i).alias("feature_index"), F.col(c).cast("double").alias("value"),
                (F.lit(w) * (F.col(c) - F.col(f"m_{c}"))).alias("phi"),
            )
            for i, (c, w) in enumerate(zip(_COLS, _WEIGHTS))
        ]
    )
    long = df.join(means, "outer_fold").select(F.lit("Linear").alias("model"), "outer_fold", "row_key", F.inline(cells))
    return long.filter("not (outer_fold = 3 and feature = 'tax')")


_SHAP = fx.FOLDED + """, m AS (SELECT outer_fold, avg(mileage) AS a, avg(mpg) AS b, avg(engineSize) AS c, avg(tax) AS d FROM folded GROUP BY outer_fold),
shap AS (SELECT * FROM (SELECT outer_fold, row_key, unnest(['mileage', 'mpg', 'engineSize', 'tax']) AS feature,
  unnest([mileage, mpg, CAST(engineSize AS DOUBLE), tax]) AS value,
  unnest([0.9 * (mileage - a), 25.0 * (mpg - b), -40.0 * (engineSize - c), 30000.0 * (tax - d)]) AS phi FROM folded JOIN m USING (outer_fold))
  WHERE NOT (outer_fold = 3 AND feature = 'tax')),
common AS (SELECT * FROM shap WHERE feature IN (SELECT feature FROM shap GROUP BY feature HAVING count(DISTINCT outer_fold) = 5))"""


@query(
    "k10_align_folds",
    f"""WITH {_SHAP} SELECT feature, CAST(CASE feature WHEN 'mileage' THEN 0 WHEN 'mpg' THEN 1 ELSE 2 END AS INTEGER) AS feature_order,
outer_fold, count(*) AS n, round(sum(abs(phi)), 2) AS total FROM common GROUP BY feature, outer_fold""",
)
def k10(spark, sf_dir):
    out = explain.align_folds(_shap_rows(spark, sf_dir))
    return out.groupBy("feature", "feature_order", "outer_fold").agg(
        F.count(F.lit(1)).alias("n"), rd(F.sum(F.abs("phi")), 2).alias("total")
    )


@query(
    "k11_global_importance",
    f"""WITH {_SHAP}, i AS (SELECT feature, avg(abs(phi)) AS v FROM shap GROUP BY feature)
SELECT 'Linear' AS model, feature, round(v, 4) AS importance, CAST(row_number() OVER (ORDER BY v DESC, feature) AS INTEGER) AS rank FROM i
QUALIFY rank <= 3""",
)
def k11(spark, sf_dir):
    return rounded(explain.global_importance(_shap_rows(spark, sf_dir), 3), "importance", digits=4)


@query(
    "k12_distribution",
    f"""WITH {_SHAP} SELECT outer_fold, row_key, feature, value, round(phi, 3) + 0.0 AS phi FROM shap""",
)
def k12(spark, sf_dir):
    out = explain.value_distribution(_shap_rows(spark, sf_dir))
    return rounded(out, "phi", digits=3).drop("model")


@query(
    "k12_contributions",
    f"""WITH {_SHAP}, f AS (SELECT outer_fold, row_key FROM shap ORDER BY outer_fold, row_key LIMIT 1)
SELECT 'Linear' AS model, row_key, feature, value, round(phi, 4) + 0.0 AS phi,
 CAST(row_number() OVER (ORDER BY abs(phi) DESC, feature) AS INTEGER) AS rank FROM shap JOIN f USING (outer_fold, row_key)""",
)
def k12_row(spark, sf_dir):
    return rounded(explain.contributions(_shap_rows(spark, sf_dir)), "phi", digits=4)


@query(
    "k13_save_explanations",
    f"""WITH {_SAMPLE}, d AS (SELECT fold, 0.25 * stddev_pop(p0) AS delta FROM s GROUP BY fold),
pick AS (SELECT c.*, p0 + delta AS target FROM cells c JOIN d USING (fold)
  WHERE list_contains(list_transform(range(5), lambda i: CAST(floor(i * (size - 1) / 4.0) AS BIGINT)), pos)),
hit AS (SELECT DISTINCT pick.fold, pos FROM pick JOIN grid ON grid.fold = pick.fold AND grid.fidx = pick.fidx WHERE p0 + w * (v - x) >= target)
SELECT 'Linear' AS model, fold AS outer_fold, count(*) AS n, 'counterfactuals' AS "table" FROM hit GROUP BY fold
UNION ALL SELECT 'Linear', fold, count(*), 'partial_dependence' FROM grid GROUP BY fold""",
)
def k13(spark, sf_dir):
    """Both tables of all models written as CSV and read back."""
    tables = explain.explain_all(_store(spark, sf_dir))
    root = scratch_path(spark, "explain")
    out = None
    for name, df in tables.items():
        path = sinks.write_csv(df, f"{root}/{name}", ["model"])
        part = sinks.read_table_csv(spark, path).groupBy("model", "outer_fold").agg(F.count(F.lit(1)).alias("n"))
        part = part.withColumn("table", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
