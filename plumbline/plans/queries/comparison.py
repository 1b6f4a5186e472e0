"""Metrics over scored rows and comparison of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import compare, metrics
from plumbline.plans import fixtures as fx
from plumbline.plans.catalog import query
from plumbline.plans.fixtures import rd, rounded

# sums of squares have twice the digits, so they are rounded earlier
_DIGITS = {"MSE": 1, "NegMSE": 1, "R2": 9}
_SQL = {
    "MAE": "avg(abs(y_true - y_pred))",
    "RMSE": "sqrt(avg((y_true - y_pred) * (y_true - y_pred)))",
    "MSE": "avg((y_true - y_pred) * (y_true - y_pred))",
    "MedAE": "median(abs(y_true - y_pred))",
    "R2": "1 - sum((y_true - y_pred) * (y_true - y_pred)) / (count(*) * var_pop(y_true))",
    "NegMSE": "-avg((y_true - y_pred) * (y_true - y_pred))",
}


def _digits(name: str) -> int:
    return _DIGITS.get(name, 4)


def _metric_sql(names: list[str]) -> str:
    cols = ", ".join(f"round({_SQL[n]}, {_digits(n)}) AS {n}" for n in names)
    return f"WITH {fx.PREDICTIONS} SELECT outer_fold, count(*) AS n, {cols} FROM predictions GROUP BY outer_fold"


def _metric_query(name: str, metric: str) -> None:
    @query(name, _metric_sql([metric]))
    def run(spark, sf_dir):
        out = metrics.score(fx.predictions(spark, sf_dir), ["outer_fold"], [metric])
        return rounded(out, metric, digits=_digits(metric))


for _name, _metric in (
    ("i1_mae", "MAE"), ("i2_rmse", "RMSE"), ("i3_mse", "MSE"), ("i4_medae", "MedAE"), ("i5_r2", "R2"), ("i6_negmse", "NegMSE"),
):
    _metric_query(_name, _metric)

_ALL = ["R2", "MAE", "MedAE", "MSE", "RMSE"]


@query("i_fold_metrics", _metric_sql(_ALL))
def fold_metrics(spark, sf_dir):
    """Flagship: out-of-fold encoded predictions scored by every metric in every fold."""
    out = metrics.score(fx.predictions(spark, sf_dir), ["outer_fold"], _ALL)
    return out.withColumns({m: rd(m, _digits(m)) for m in _ALL})


@query(
    "i_mean_std_over_folds",
    f"""WITH {fx.PREDICTIONS}, s AS (SELECT outer_fold, {', '.join(f'{_SQL[m]} AS {m}' for m in _ALL)} FROM predictions GROUP BY outer_fold)
SELECT 'brand_mean' AS model, {', '.join(f'round(avg({m}), {_digits(m)}) AS {m}_mean, round(stddev_samp({m}), {_digits(m)}) AS {m}_std' for m in _ALL)} FROM s""",
)
def mean_std(spark, sf_dir):
    scored = metrics.score(fx.predictions(spark, sf_dir), ["outer_fold"], _ALL).drop("n")
    out = compare.summarize_mean_std(scored.withColumn("model", F.lit("brand_mean")))
    return out.withColumns({f"{m}_{s}": rd(f"{m}_{s}", _digits(m)) for m in _ALL for s in ("mean", "std")})


@query(
    "i7_loss_direction",
    f"""WITH {fx.RESULTS}, l AS (SELECT outer_fold, model, 'MAE' AS metric, MAE AS loss FROM results
 UNION ALL SELECT outer_fold, model, 'NegMSE', RMSE * RMSE FROM results)
SELECT metric, outer_fold, arg_min(model, loss) AS best_model, round(min(loss), 4) AS loss FROM l GROUP BY metric, outer_fold""",
)
def i7(spark, sf_dir):
    """Best model per metric and fold when every metric is turned into a loss."""
    df = fx.results(spark, sf_dir).withColumn("NegMSE", -F.col("RMSE") * F.col("RMSE"))
    long = compare.to_long(df, ["MAE", "NegMSE"])
    loss = F.when(compare.lower_is_better(F.col("metric")), F.col("value")).otherwise(-F.col("value"))
    return long.groupBy("metric", "outer_fold").agg(F.min_by("model", loss).alias("best_model"), rd(F.min(loss), 4).alias("loss"))


# ---- comparison ------------------------------------------------------------------------

_STATS = "count(*) AS n, avg(v) AS mean, stddev_samp(v) AS std"
_LONG = fx.RESULTS + """, long AS (SELECT 'MAE' AS metric, outer_fold, model, MAE AS v FROM results
  UNION ALL SELECT 'RMSE', outer_fold, model, RMSE FROM results)"""
# two-sided 95% point of Student's t with 4 degrees of freedom
_T4 = 2.7764451051977987
_P4 = "1 - (abs(t) / sqrt(4 + t * t)) * (1 + 0.5 * 4 / (4 + t * t))"
_SIGNED = """r AS (SELECT *, rank() OVER (PARTITION BY metric, a, b ORDER BY abs(d)) AS k FROM d),
w AS (SELECT metric, a, b, avg(d) / (stddev_samp(d) / sqrt(5)) AS t, sum(CASE WHEN d > 0 THEN k ELSE 0 END) AS w FROM r GROUP BY metric, a, b),
masks AS (SELECT list_sum([i * ((m >> (i - 1)) & 1) FOR i IN [1, 2, 3, 4, 5]]) AS s FROM (SELECT range AS m FROM range(32))),
p AS (SELECT metric, a, b, t, least(1.0, 2 * (SELECT count(*) FROM masks WHERE s <= least(w, 15 - w)) / 32.0) AS wp FROM w)"""


@query(
    "j1_mean_std",
    f"""WITH {fx.RESULTS} SELECT model, round(avg(MAE), 6) AS MAE_mean, round(stddev_samp(MAE), 6) AS MAE_std,
round(avg(RMSE), 6) AS RMSE_mean, round(stddev_samp(RMSE), 6) AS RMSE_std, round(avg(MedAE), 6) AS MedAE_mean,
round(stddev_samp(MedAE), 6) AS MedAE_std FROM results GROUP BY model""",
)
def j1(spark, sf_dir):
    out = compare.summarize_mean_std(fx.stored_results(spark, sf_dir))
    return rounded(out, *[c for c in out.columns if c != "model"])


@query(
    "j2_pivot",
    f"""WITH {fx.RESULTS} SELECT outer_fold, {', '.join(f"round(max(MAE) FILTER (model = '{m}'), 6) AS {m}" for m in ('click', 'error', 'purchase', 'signup', 'view'))}
FROM results GROUP BY outer_fold""",
)
def j2(spark, sf_dir):
    out = compare.pivot_metric(fx.stored_results(spark, sf_dir), "mae")
    return rounded(out, *[c for c in out.columns if c != "outer_fold"])


_BASE_DIFF = """d AS (SELECT x.metric, x.model AS a, y.model AS b, x.v - y.v AS d FROM long x JOIN long y
  ON x.metric = y.metric AND x.outer_fold = y.outer_fold AND y.model = 'click' AND x.model <> 'click')"""


@query(
    "j3_paired_tests",
    f"""WITH {_LONG}, {_BASE_DIFF}, {_SIGNED} SELECT metric, b AS baseline, a AS model, round({_P4}, 9) AS paired_t_p,
CAST(5 AS BIGINT) AS n_outer_folds FROM p""",
)
def j3(spark, sf_dir):
    out = compare.paired_tests(fx.stored_results(spark, sf_dir), ["MAE", "RMSE"], "click")
    return rounded(out, "paired_t_p", digits=9).drop("wilcoxon_p")


@query(
    "j4_signed_rank",
    f"""WITH {_LONG}, {_BASE_DIFF}, {_SIGNED} SELECT metric, a AS model, CAST(round(wp, 9) AS DOUBLE) AS wilcoxon_p FROM p""",
)
def j4(spark, sf_dir):
    out = compare.paired_tests(fx.stored_results(spark, sf_dir), ["MAE", "RMSE"], "click")
    return rounded(out, "wilcoxon_p", digits=9).select("metric", "model", "wilcoxon_p")


@query(
    "j5_significance_matrix",
    f"""WITH {_LONG}, d AS (SELECT x.metric, x.model AS a, y.model AS b, x.v - y.v AS d FROM long x JOIN long y
  ON x.metric = y.metric AND x.outer_fold = y.outer_fold AND x.model < y.model), {_SIGNED}
SELECT metric, a AS model_a, b AS model_b, round({_P4}, 9) AS paired_t_p, CAST(round(wp, 9) AS DOUBLE) AS wilcoxon_p,
CAST(5 AS BIGINT) AS n_outer_folds FROM p""",
)
def j5(spark, sf_dir):
    out = compare.significance_matrix(fx.stored_results(spark, sf_dir), ["MAE", "RMSE"])
    return rounded(out, "paired_t_p", "wilcoxon_p", digits=9)


_SUMMARY = f"""s AS (SELECT metric, model, {_STATS} FROM long GROUP BY metric, model),
ci AS (SELECT *, std / sqrt(n) AS sem, std / sqrt(n) * {_T4} AS h FROM s)"""


@query(
    "j6_metric_summary",
    f"""WITH {_LONG}, {_SUMMARY} SELECT metric, model, n, round(mean, 6) AS mean, round(std, 6) AS std, round(sem, 6) AS sem,
0.95::DOUBLE AS ci, round(mean - h, 6) AS ci_low, round(mean + h, 6) AS ci_high, round(h, 6) AS ci_half_width FROM ci""",
)
def j6(spark, sf_dir):
    out = compare.metric_summary(fx.stored_results(spark, sf_dir), ["MAE", "RMSE"])
    return rounded(out, "mean", "std", "sem", "ci_low", "ci_high", "ci_half_width")


@query(
    "j7_ci_table",
    f"""WITH {_LONG}, {_SUMMARY} SELECT metric, model, round(mean, 6) AS mean, round(mean - h, 6) AS ci_low,
round(mean + h, 6) AS ci_high, model = 'click' AS is_baseline,
round(max(mean) FILTER (model = 'click') OVER (PARTITION BY metric), 6) AS baseline_mean FROM ci""",
)
def j7(spark, sf_dir):
    out = compare.ci_table(fx.stored_results(spark, sf_dir), ["MAE", "RMSE"], "click")
    return rounded(out, "mean", "ci_low", "ci_high", "baseline_mean").select(
        "metric", "model", "mean", "ci_low", "ci_high", "is_baseline", "baseline_mean"
    )


@query(
    "j8_baseline_delta",
    f"""WITH {_LONG}, {_BASE_DIFF} SELECT metric, 'click' AS baseline, a AS model, round(avg(-d), 6) + 0.0 AS delta_mean,
round(stddev_samp(d) / sqrt(5) * {_T4}, 6) AS ci_half_width, count(*) AS n FROM d GROUP BY metric, a""",
)
def j8(spark, sf_dir):
    out = compare.baseline_delta(fx.stored_results(spark, sf_dir), ["MAE", "RMSE"], "click")
    return rounded(out, "delta_mean", "ci_half_width")


@query(
    "j9_point_range",
    f"""WITH {fx.RESULTS} SELECT model, round(avg(MedAE), 6) AS mean, round(stddev_samp(MedAE), 6) AS std,
round(avg(MedAE) - stddev_samp(MedAE), 6) AS low, round(avg(MedAE) + stddev_samp(MedAE), 6) AS high FROM results GROUP BY model""",
)
def j9(spark, sf_dir):
    return rounded(compare.point_range(fx.stored_results(spark, sf_dir), "MedAE"), "mean", "std", "low", "high")


@query(
    "j10_comparison_batch",
    f"""WITH {_LONG}, {_SUMMARY}, {_BASE_DIFF}, g AS (SELECT metric, a, avg(-d) AS dm, stddev_samp(d) / sqrt(5) * {_T4} AS dh FROM d GROUP BY metric, a)
SELECT ci.metric, model, round(mean, 6) AS mean, round(h, 6) AS ci_half_width, round(dm, 6) + 0.0 AS delta_mean, round(dh, 6) AS delta_ci_half_width
FROM ci LEFT JOIN g ON g.metric = ci.metric AND g.a = ci.model""",
)
def j10(spark, sf_dir):
    out = compare.comparison_batch(fx.stored_results(spark, sf_dir), ["MAE", "RMSE"], "click")
    cols = ("mean", "ci_half_width", "delta_mean", "delta_ci_half_width")
    return rounded(out, *cols).select("metric", "model", *cols)


@query(
    "j11_best_model",
    f"""WITH {fx.RESULTS} SELECT model AS best_model, 'MAE' AS metric, round(avg(MAE), 6) AS mean FROM results GROUP BY model
ORDER BY avg(MAE), model LIMIT 1""",
)
def j11(spark, sf_dir):
    return rounded(compare.best_model(fx.stored_results(spark, sf_dir), "MAE"), "mean")


@query(
    "g15_top_folds",
    f"""WITH {fx.RESULTS}, r AS (SELECT model, outer_fold, MAE, row_number() OVER (PARTITION BY model ORDER BY MAE, outer_fold) AS k FROM results)
SELECT model, outer_fold, round(MAE, 6) AS score, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 3""",
)
def g15(spark, sf_dir):
    return rounded(compare.top_fold_models(fx.stored_results(spark, sf_dir), "MAE", 3), "score")
