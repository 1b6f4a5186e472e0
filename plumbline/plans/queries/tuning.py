"""Search spaces, tuning logs and their analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import metrics, space, trials
from plumbline.plans import fixtures as fx
from plumbline.plans.catalog import query
from plumbline.plans.fixtures import rd, rounded, table
from plumbline.session import scratch_path

_SPACE = {
    "rounds": {"type": "int", "low": 50, "high": 950, "step": 25},
    "rate": {"type": "float", "low": 0.02, "high": 0.5, "log": True},
    "share": {"type": "float", "low": 0.3, "high": 0.8},
    "splitter": {"type": "categorical", "choices": ["even", "ranked", "random"]},
}


def _u(name: str) -> str:
    return f"CAST('0x' || substr(md5(CAST(event_id AS VARCHAR) || '#{name}|42'), 1, 8) AS BIGINT) / 4294967296.0"


@query(
    "h1_draw_trials",
    f"""SELECT event_id, CAST(50 + floor({_u('rounds')} * 37) * 25 AS INTEGER) AS param__rounds,
round(exp(ln(0.02) + {_u('rate')} * (ln(0.5) - ln(0.02))), 9) AS param__rate,
round(0.3 + {_u('share')} * 0.5, 9) AS param__share,
['even', 'ranked', 'random'][CAST(floor({_u('splitter')} * 3) AS INTEGER) + 1] AS param__splitter FROM events""",
)
def h1(spark, sf_dir):
    """One drawn setting per event, from the event's key."""
    e = table(spark, sf_dir, "events").select("event_id")
    out = space.draw_parameters(e, "event_id", _SPACE, 42)
    return rounded(out, "param__rate", "param__share", digits=9)


@query(
    "h3_guarded_score",
    f"""WITH {fx.PREDICTIONS}, p AS (SELECT outer_fold, y_true, CASE WHEN outer_fold = 2 AND y_true > 100000 THEN CAST('nan' AS DOUBLE)
 ELSE y_pred END AS y_pred FROM predictions)
SELECT outer_fold, CASE WHEN count(*) FILTER (NOT isfinite(y_pred)) > 0 OR count(*) < 2 THEN CAST('inf' AS DOUBLE)
 ELSE round(avg(abs(y_true - y_pred)) FILTER (isfinite(y_pred)), 4) END AS score FROM p GROUP BY outer_fold""",
)
def h3(spark, sf_dir):
    broken = F.when((F.col("outer_fold") == 2) & (F.col("y_true") > 100000), float("nan")).otherwise(F.col("y_pred"))
    df = fx.predictions(spark, sf_dir).withColumn("y_pred", broken)
    out = metrics.guarded_score(df, ["outer_fold"], "mae")
    finite = F.col("score") < float("inf")
    return out.withColumn("score", F.when(finite, F.round("score", 4)).otherwise(F.col("score")))


def _steps(spark, sf_dir):
    """Intermediate losses: a trial per user and event type, four steps each."""
    return table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("study_name"), F.col("user_id").alias("trial_number"),
        (F.col("event_id") % 4 + 1).cast("int").alias("step"),
    ).agg(F.max("value").alias("loss"))


@query(
    "h4_median_pruning",
    """WITH s AS (SELECT event_type AS study, user_id AS trial, CAST(event_id % 4 + 1 AS INTEGER) AS step, max(value) AS loss FROM events GROUP BY 1, 2, 3),
b AS (SELECT *, min(loss) OVER (PARTITION BY study, trial ORDER BY step) AS best FROM s),
m AS (SELECT b.study, b.trial, b.step, b.loss, b.best, count(e.trial) AS n, median(e.loss) AS med
      FROM b LEFT JOIN s e ON e.study = b.study AND e.step = b.step AND e.trial < b.trial AND e.trial % 7 <> 0 GROUP BY ALL)
SELECT study AS study_name, trial AS trial_number, step, loss, best, n AS earlier_trials,
 coalesce(n >= 10 AND step > 1 AND best > med, FALSE) AS prune FROM m""",
)
def h4(spark, sf_dir):
    steps = _steps(spark, sf_dir).withColumn("complete", F.col("trial_number") % 7 != 0)
    return trials.median_pruning(steps, complete="complete")


def _required(spark, sf_dir):
    return fx.trials(spark, sf_dir).select(F.lit("user").alias("parameter"), F.col("param__user").alias("level")).distinct()


@query(
    "h5_coverage",
    f"""WITH {fx.TRIALS}, t AS (SELECT * FROM trials WHERE value > 60),
need AS (SELECT count(DISTINCT param__user) AS k FROM trials)
SELECT study_name, 'user' AS parameter, k AS required, count(DISTINCT param__user) AS seen,
 count(DISTINCT param__user) >= k AS covered FROM t, need GROUP BY study_name, k""",
)
def h5(spark, sf_dir):
    return trials.coverage_table(fx.trials(spark, sf_dir).filter("value > 60"), _required(spark, sf_dir))


@query(
    "h6_stopping_point",
    f"""WITH {fx.TRIALS}, l AS (SELECT *, CASE WHEN state = 'COMPLETE' THEN value END AS loss FROM trials),
a AS (SELECT *, min(loss) OVER (PARTITION BY study_name ORDER BY trial_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM l),
b AS (SELECT *, loss IS NOT NULL AND (best IS NULL OR loss < best) AS better FROM a),
c AS (SELECT *, sum(CASE WHEN better THEN 1 ELSE 0 END) OVER (PARTITION BY study_name ORDER BY trial_number) AS island FROM b),
d AS (SELECT *, sum(CASE WHEN better THEN 0 ELSE 1 END) OVER (PARTITION BY study_name, island ORDER BY trial_number) AS fails FROM c),
f AS (SELECT study_name, max(first) AS ready FROM (SELECT study_name, param__user, min(trial_number) AS first FROM trials GROUP BY 1, 2) GROUP BY 1
      HAVING count(*) = (SELECT count(DISTINCT param__user) FROM trials))
SELECT d.study_name, min(trial_number) FILTER (fails >= 40 AND trial_number >= ready) AS stop_trial, count(*) AS trials_run
FROM d LEFT JOIN f ON f.study_name = d.study_name GROUP BY d.study_name""",
)
def h6(spark, sf_dir):
    return trials.stopping_points(fx.trials(spark, sf_dir), _required(spark, sf_dir), patience=40)


@query(
    "h7_trial_log",
    f"""WITH {fx.TRIALS} SELECT study_name, state, count(*) AS n, round(sum(value), 4) AS total FROM trials GROUP BY study_name, state""",
)
def h7(spark, sf_dir):
    """The log written study by study in append mode and read back."""
    path = scratch_path(spark, "trial-log")
    log = fx.trials(spark, sf_dir)
    for part in (log.filter("state = 'COMPLETE'"), log.filter("state <> 'COMPLETE'")):
        part.write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("study_name", "state").agg(
        F.count(F.lit(1)).alias("n"), rd(F.sum("value"), 4).alias("total")
    )


@query(
    "h8_best_trial",
    f"""WITH {fx.TRIALS}, r AS (SELECT *, row_number() OVER (PARTITION BY study_name ORDER BY value, trial_number) AS k FROM trials WHERE state = 'COMPLETE')
SELECT study_name, trial_number, value, param__k, param__user FROM r WHERE k = 1""",
)
def h8(spark, sf_dir):
    best = trials.best_trials(fx.trials(spark, sf_dir))
    return best.select("study_name", "trial_number", "value", "param__k", "param__user")


def _params(spark, sf_dir):
    """Long parameter table: four parameters per event, one of them missing at times."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    rows = (
        ("depth", "int", k),
        ("rate", "float", F.col("value").cast("string")),
        ("bootstrap", "bool", F.when(F.col("value") > 10, "true").otherwise("false")),
        ("level", "other", F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string"))),
        ("rare", "int", F.when(k.cast("int") < 90, k)),
    )
    cells = F.array(
        *[F.struct(F.lit(p).alias("param"), F.lit(t).alias("kind"), v.alias("value")) for p, t, v in rows]
    )
    return e.select(F.col("event_type").alias("model"), F.col("event_id").alias("outer_fold"), F.inline(cells)).filter("value is not null")


_PARAMS = """e AS (SELECT event_type AS model, event_id AS fold, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value AS v,
  'u' || CAST(user_id % 4 AS VARCHAR) AS u FROM events)"""


@query(
    "h9_common_parameters",
    f"""WITH {_PARAMS}, p AS (SELECT model, 'rare' AS param, count(*) FILTER (k < 90) AS n, count(*) AS folds FROM e GROUP BY model
 UNION ALL SELECT model, unnest(['depth', 'rate', 'bootstrap', 'level']), count(*), count(*) FROM e GROUP BY model)
SELECT model, param, n FROM p WHERE n = folds""",
)
def h9(spark, sf_dir):
    kept = trials.common_parameters(_params(spark, sf_dir))
    return kept.groupBy("model", "param").agg(F.count(F.lit(1)).alias("n"))


@query(
    "h10_aggregate_parameters",
    f"""WITH {_PARAMS}, m AS (SELECT model, u, v > 10 AS b, fold, k, v FROM e),
mode_u AS (SELECT model, u, row_number() OVER (PARTITION BY model ORDER BY count(*) DESC, min(fold)) AS r FROM m GROUP BY model, u),
mode_b AS (SELECT model, b, row_number() OVER (PARTITION BY model ORDER BY count(*) DESC, min(fold)) AS r FROM m GROUP BY model, b)
SELECT model, 'depth' AS param, 'int' AS kind, round_even(median(k), 0)::DOUBLE AS number, NULL AS text FROM m GROUP BY model
UNION ALL SELECT model, 'rare', 'int', round_even(median(k), 0)::DOUBLE, NULL FROM m WHERE k < 90 GROUP BY model
UNION ALL SELECT model, 'rate', 'float', round(median(v), 6), NULL FROM m GROUP BY model
UNION ALL SELECT model, 'bootstrap', 'bool', NULL, CASE WHEN b THEN 'true' ELSE 'false' END FROM mode_b WHERE r = 1
UNION ALL SELECT model, 'level', 'other', NULL, u FROM mode_u WHERE r = 1""",
)
def h10(spark, sf_dir):
    out = trials.aggregate_parameters(_params(spark, sf_dir))
    numeric = F.col("kind").isin("int", "float")
    return out.select(
        "model", "param", "kind", F.when(numeric, F.round(F.col("value").try_cast("double"), 6)).alias("number"),
        F.when(~numeric, F.col("value")).alias("text"),
    )


@query(
    "h11_aggregate_residuals",
    """WITH c AS (SELECT event_type AS model, event_id AS fold, CASE WHEN user_id % 10 = 0 THEN NULL ELSE
 '{"alpha":"' || CAST(user_id % 3 AS VARCHAR) || '","kind":"K' || CAST(user_id % 2 AS VARCHAR) || '"}' END AS residual_cfg FROM events),
n AS (SELECT model, residual_cfg, row_number() OVER (PARTITION BY model ORDER BY count(*) DESC, min(fold)) AS r FROM c GROUP BY model, residual_cfg)
SELECT model, residual_cfg FROM n WHERE r = 1""",
)
def h11(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cfg = trials.canonical_json(
        F.create_map(
            F.lit("kind"), F.concat(F.lit("K"), (F.col("user_id") % 2).cast("string")),
            F.lit("alpha"), (F.col("user_id") % 3).cast("string"),
        )
    )
    records = e.select(
        F.col("event_type").alias("model"), F.col("event_id").alias("outer_fold"),
        F.when(F.col("user_id") % 10 != 0, cfg).alias("residual_cfg"),
    )
    return trials.aggregate_residual_configs(records)


# ---- sensitivity -----------------------------------------------------------------------

_CELLS = fx.TRIALS + """, ok AS (SELECT * FROM trials WHERE state = 'COMPLETE' AND isfinite(value)),
long AS (SELECT model, 'k' AS parameter, CAST(param__k AS VARCHAR) AS level, CAST(param__k AS DOUBLE) AS x, value FROM ok
  UNION ALL SELECT model, 'user', param__user, NULL, value FROM ok)"""


@query(
    "k1a_parameter_long",
    f"""WITH {_CELLS} SELECT model, parameter, level, count(*) AS n, round(sum(value), 4) AS total FROM long GROUP BY model, parameter, level""",
)
def k1a(spark, sf_dir):
    cells = trials.parameter_cells(fx.trials(spark, sf_dir))
    return cells.groupBy("model", "parameter", "level").agg(
        F.sum("cnt").alias("n"), rd(F.sum(F.col("cnt") * F.col("score")), 4).alias("total")
    )


@query(
    "k1b_parameter_types",
    f"""WITH {_CELLS} SELECT model, parameter, CASE WHEN bool_and(TRY_CAST(level AS DOUBLE) IS NOT NULL) THEN 'numeric' ELSE 'categorical' END
AS parameter_type, count(*) AS n_trials, count(DISTINCT level) AS n_unique FROM long GROUP BY model, parameter""",
)
def k1b(spark, sf_dir):
    cells = trials.parameter_cells(fx.trials(spark, sf_dir))
    return cells.select("model", "parameter", "parameter_type", "n_trials", "n_unique").distinct()


_RHO = """ranks AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY x) + (count(*) OVER (PARTITION BY model, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY model ORDER BY value) + (count(*) OVER (PARTITION BY model, value) - 1) / 2.0 AS ry FROM long WHERE parameter = 'k'),
rho AS (SELECT model, corr(rx, ry) AS rho FROM ranks GROUP BY model)"""
_ETA = """mu AS (SELECT model, avg(value) AS mu, sum(pow(value - a, 2)) AS total FROM (SELECT model, value, avg(value) OVER (PARTITION BY model) AS a
  FROM long WHERE parameter = 'user') GROUP BY model),
lv AS (SELECT model, level, count(*) AS n, avg(value) AS m FROM long WHERE parameter = 'user' GROUP BY model, level),
eta AS (SELECT lv.model, sum(n * pow(m - mu, 2)) / max(total) AS eta FROM lv JOIN mu ON mu.model = lv.model GROUP BY lv.model)"""
_ENDS = """means AS (SELECT model, parameter, CASE WHEN parameter = 'k' THEN CAST(x AS VARCHAR) ELSE level END AS level, min(x) AS x, avg(value) AS m
  FROM long GROUP BY 1, 2, 3),
ends AS (SELECT model, parameter, first(level ORDER BY m, x, level) AS best_value, first(level ORDER BY m DESC, x, level) AS worst_value FROM means GROUP BY 1, 2)"""


@query("k1c_spearman", f"WITH {_CELLS}, {_RHO} SELECT model, 'k' AS parameter, round(rho, 9) + 0.0 AS spearman_corr FROM rho")
def k1c(spark, sf_dir):
    cells = trials.parameter_cells(fx.trials(spark, sf_dir)).filter("parameter_type = 'numeric'")
    out = trials.spearman(cells, [*trials.GROUP, "parameter"], F.col("level").try_cast("double"))
    return rounded(out, "spearman_corr", digits=9).select("model", "parameter", "spearman_corr")


@query("k1d_eta_squared", f"WITH {_CELLS}, {_ETA} SELECT model, 'user' AS parameter, round(eta, 9) AS eta_squared FROM eta")
def k1d(spark, sf_dir):
    cells = trials.parameter_cells(fx.trials(spark, sf_dir)).filter("parameter_type = 'categorical'")
    out = trials.eta_squared(cells, [*trials.GROUP, "parameter"])
    return rounded(out, "eta_squared", digits=9).select("model", "parameter", "eta_squared")


@query("k1e_best_worst", f"WITH {_CELLS}, {_ENDS} SELECT model, parameter, best_value, worst_value FROM ends")
def k1e(spark, sf_dir):
    cells = trials.parameter_cells(fx.trials(spark, sf_dir))
    out = trials.best_worst_levels(cells, [*trials.GROUP, "parameter"])
    return out.select("model", "parameter", "best_value", "worst_value")


_SUMMARY = f"""{_CELLS}, {_RHO}, {_ETA}, {_ENDS}, b AS (SELECT model, parameter, count(*) AS n_trials, count(DISTINCT level) AS n_unique,
  avg(value) AS score_mean, stddev_samp(value) AS score_std FROM long GROUP BY model, parameter),
summary AS (SELECT b.model, b.model AS base_model, 'base' AS residual_kind, 'MAE' AS metric, 'minimize' AS direction, b.parameter,
  CASE WHEN b.parameter = 'k' THEN 'numeric' ELSE 'categorical' END AS parameter_type, n_trials, n_unique,
  round(CASE WHEN b.parameter = 'k' THEN abs(rho) ELSE eta END, 9) AS sensitivity,
  round(CASE WHEN b.parameter = 'k' THEN rho END, 9) + 0.0 AS spearman_corr, best_value, worst_value,
  round(score_mean, 6) AS score_mean, round(score_std, 6) AS score_std
  FROM b JOIN ends ON ends.model = b.model AND ends.parameter = b.parameter LEFT JOIN rho ON rho.model = b.model LEFT JOIN eta ON eta.model = b.model)"""


def _summary(spark, sf_dir):
    out = trials.sensitivity_summary(fx.trials(spark, sf_dir))
    return rounded(rounded(out, "sensitivity", "spearman_corr", digits=9), "score_mean", "score_std")


@query("k1f_sensitivity", f"WITH {_SUMMARY} SELECT * FROM summary")
def k1f(spark, sf_dir):
    return _summary(spark, sf_dir)


@query(
    "k1g_top_sensitivity",
    f"WITH {_SUMMARY} SELECT model, parameter, sensitivity FROM summary ORDER BY sensitivity DESC, model, parameter LIMIT 4",
)
def k1g(spark, sf_dir):
    top = trials.top_sensitivity(_summary(spark, sf_dir), n=4)
    return top.select("model", "parameter", "sensitivity")
