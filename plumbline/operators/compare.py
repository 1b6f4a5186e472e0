"""Comparison of models over blocks (folds): summaries, paired tests, confidence intervals.

Input is a results table with one row per (outer_fold, model) and one column per metric. All
metrics go through one plan in long form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.ordering import average_rank, join_on, ordered_counts
from plumbline.functions.stats import signed_rank_p, t_critical, t_two_sided_p
from plumbline.operators.metrics import METRICS
from plumbline.operators.schema import match_many, match_one

_META = {"model", "outer_fold"}


def metric_columns(results: DataFrame) -> list[str]:
    return [
        f.name for f in results.schema if f.name not in _META and isinstance(f.dataType, T.NumericType)
    ]


def resolve_metric(results: DataFrame, name: str) -> str:
    """Column of a metric, whatever its case."""
    found = [c for c in results.columns if c.lower() == name.lower()]
    if not found:
        raise ValueError(f"metric {name!r} not among {metric_columns(results)}")
    return found[0]


def to_long(results: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """(metric, outer_fold, model, value); two rows for one cell are an error at run time."""
    cols = [resolve_metric(results, m) for m in metrics] if metrics else metric_columns(results)
    long = results.select(
        "outer_fold", "model", *[F.col(c).cast("double").alias(c) for c in cols]
    ).unpivot(["outer_fold", "model"], cols, "metric", "value")
    cell = F.concat_ws(" / ", F.col("metric"), F.col("outer_fold").cast("string"), F.col("model"))
    value = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.concat(F.lit("duplicate cell "), cell))).otherwise(
        F.first("value")
    )
    return long.groupBy("metric", "outer_fold", "model").agg(value.cast("double").alias("value"))


def summarize_mean_std(results: DataFrame, decimals: int = 4, as_text: bool = False) -> DataFrame:
    """Mean and sample std of every metric per model, named ``<metric>_<stat>``."""
    cols = metric_columns(results)
    aggs: list[Column] = []
    for c in cols:
        for stat, f in (("mean", F.avg), ("std", F.stddev_samp)):
            value = f(F.col(c))
            aggs.append((F.format_number(value, decimals) if as_text else value).alias(f"{c}_{stat}"))
    return results.groupBy("model").agg(*aggs)


def pivot_metric(results: DataFrame, metric: str, models: Sequence[str] | None = None) -> DataFrame:
    """One row per fold and one column per model."""
    long = to_long(results, [metric])
    if models is None:
        models = [r[0] for r in long.select("model").distinct().orderBy("model").collect()]
    return long.groupBy("outer_fold").pivot("model", list(models)).agg(F.first("value"))


def paired_p_values(diffs: DataFrame, keys: Sequence[str], d: str = "d") -> DataFrame:
    """paired_t_p and wilcoxon_p per group of paired differences, plus n and their mean.

    Differences without spread give a null t p-value; only zero differences give a null
    signed-rank p-value.
    """
    keys = list(keys)
    diffs = diffs.filter(F.col(d).isNotNull() & ~F.isnan(d))
    basics = diffs.groupBy(*keys).agg(
        F.count(d).alias("n_pairs"),
        F.avg(d).alias("mean_diff"),
        F.stddev_samp(d).alias("__sd"),
        F.count_if(F.col(d) == 0).alias("__zeros"),
    )
    magnitudes = diffs.filter(F.col(d) != 0).withColumn("__a", F.abs(d))
    ranked = ordered_counts(magnitudes, keys, "__a", extra={"__pos": F.count_if(F.col(d) > 0)})
    c = F.col("cnt").cast("double")
    ranks = ranked.groupBy(*keys).agg(
        F.sum("cnt").alias("__n"),
        F.sum(average_rank() * F.col("__pos")).alias("__w"),
        F.sum(c * c * c - c).alias("__ties"),
    )
    t = F.col("mean_diff") / (F.col("__sd") / F.sqrt("n_pairs"))
    return join_on(basics, ranks, keys, "left").select(
        *keys,
        "n_pairs",
        "mean_diff",
        F.when(F.col("__sd") > 0, t_two_sided_p(t, F.col("n_pairs") - 1)).alias("paired_t_p"),
        signed_rank_p(F.col("__n"), F.col("__w"), F.col("__ties"), F.col("__zeros")).alias("wilcoxon_p"),
    )


def _fold_counts(long: DataFrame) -> DataFrame:
    cells = long.groupBy("metric", "outer_fold").agg(F.lit(1).alias("__1"))
    return cells.groupBy("metric").agg(F.count(F.lit(1)).alias("n_outer_folds"))


def paired_tests(
    results: DataFrame,
    metrics: Sequence[str] | None = None,
    baseline: str = "RandomForest",
    models: Sequence[str] | None = None,
) -> DataFrame:
    """Every model against the baseline, paired by fold."""
    base_name = match_one(results, baseline)
    if base_name is None:
        raise ValueError(f"baseline {baseline!r} not found")
    if models is not None:
        results = match_many(results, [*models, base_name])
    long = to_long(results, metrics)
    base = long.filter(F.col("model") == base_name).select(
        "metric", "outer_fold", F.col("value").alias("__base")
    )
    diffs = (
        long.filter(F.col("model") != base_name)
        .join(base, ["metric", "outer_fold"])
        .withColumn("d", F.col("value") - F.col("__base"))
    )
    tested = paired_p_values(diffs, ["metric", "model"])
    return (
        tested.join(_fold_counts(long), "metric")
        .select(
            "metric", F.lit(base_name).alias("baseline"), "model", "paired_t_p", "wilcoxon_p", "n_outer_folds"
        )
        .orderBy("metric", "paired_t_p", "wilcoxon_p", "model")
    )


def significance_matrix(
    results: DataFrame, metrics: Sequence[str] | None = None, models: Sequence[str] | None = None
) -> DataFrame:
    """Both tests for every unordered pair of models.

    The pairs are the result itself: a cell table has one row per (metric, fold, model), so the
    join yields exactly folds x pairs rows, which the tests aggregate to one row per pair.
    """
    if models is not None:
        results = match_many(results, models)
    long = to_long(results, metrics)
    a = long.select("metric", "outer_fold", F.col("model").alias("model_a"), F.col("value").alias("__a"))
    b = long.select("metric", "outer_fold", F.col("model").alias("model_b"), F.col("value").alias("__b"))
    diffs = (
        a.join(b, ["metric", "outer_fold"])
        .filter(F.col("model_a") < F.col("model_b"))
        .select("metric", "model_a", "model_b", (F.col("__a") - F.col("__b")).alias("d"))
    )
    tested = paired_p_values(diffs, ["metric", "model_a", "model_b"])
    return (
        tested.join(_fold_counts(long), "metric")
        .select("metric", "model_a", "model_b", "paired_t_p", "wilcoxon_p", "n_outer_folds")
        .orderBy("metric", "paired_t_p", "wilcoxon_p", "model_a", "model_b")
    )


def _interval(df: DataFrame, keys: Sequence[str], value: str, ci: float) -> DataFrame:
    """n, mean, std, sem and half-width per group; the t quantile is found once per distinct n."""
    stats = df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
    )
    sizes = stats.select("n").distinct().withColumn("__t", t_critical(ci, F.col("n") - 1))
    sem = F.when(F.col("n") > 1, F.col("std") / F.sqrt("n")).otherwise(0.0)
    return (
        stats.join(sizes, "n")
        .withColumn("sem", sem)
        .withColumn("ci_half_width", F.coalesce(F.col("sem") * F.col("__t"), F.lit(0.0)))
        .drop("__t")
    )


def metric_summary(
    results: DataFrame, metrics: Sequence[str] | None = None, ci: float = 0.95, ascending: bool = True
) -> DataFrame:
    """Mean with a t-based confidence interval per (metric, model), sorted by mean."""
    long = to_long(results, metrics).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    out = _interval(long, ["metric", "model"], "value", ci).select(
        "metric",
        "model",
        "n",
        "mean",
        "std",
        "sem",
        F.lit(float(ci)).alias("ci"),
        (F.col("mean") - F.col("ci_half_width")).alias("ci_low"),
        (F.col("mean") + F.col("ci_half_width")).alias("ci_high"),
        "ci_half_width",
    )
    return out.orderBy("metric", F.asc("mean") if ascending else F.desc("mean"))


def ci_table(
    results: DataFrame, metrics: Sequence[str] | None = None, baseline: str | None = None, ci: float = 0.95
) -> DataFrame:
    """The summary with the baseline's mean beside every model; a missing baseline gives nulls."""
    summary = metric_summary(results, metrics, ci)
    marked = F.col("model") == F.lit(baseline) if baseline is not None else F.lit(False)
    per_metric = W.partitionBy("metric")  # one row per model
    return summary.withColumn("is_baseline", F.coalesce(marked, F.lit(False))).withColumn(
        "baseline_mean", F.max(F.when(F.col("is_baseline"), F.col("mean"))).over(per_metric)
    )


def lower_is_better(metric: Column) -> Column:
    higher = [m.name.lower() for m in METRICS.values() if m.direction == "maximize"]
    return ~F.lower(metric).isin(*higher)


def baseline_delta(
    results: DataFrame, metrics: Sequence[str] | None = None, baseline: str = "RandomForest", ci: float = 0.95
) -> DataFrame:
    """Fold-paired improvement over the baseline; positive is better whatever the direction."""
    base_name = match_one(results, baseline)
    if base_name is None:
        raise ValueError(f"baseline {baseline!r} not found")
    long = to_long(results, metrics)
    base = long.filter(F.col("model") == base_name).select(
        "metric", "outer_fold", F.col("value").alias("__base")
    )
    gain = F.col("__base") - F.col("value")
    paired = (
        long.filter(F.col("model") != base_name)
        .join(base, ["metric", "outer_fold"])
        .withColumn("delta", F.when(lower_is_better(F.col("metric")), gain).otherwise(-gain))
        .filter(F.col("delta").isNotNull() & ~F.isnan("delta"))
    )
    return (
        _interval(paired, ["metric", "model"], "delta", ci)
        .select("metric", F.lit(base_name).alias("baseline"), "model", F.col("mean").alias("delta_mean"), "ci_half_width", "n")
        .orderBy("metric", F.desc("delta_mean"))
    )


def point_range(results: DataFrame, metric: str, ascending: bool = True) -> DataFrame:
    """mean, std and the mean -/+ std ends per model, sorted by mean."""
    col = resolve_metric(results, metric)
    out = results.groupBy("model").agg(
        F.avg(col).alias("mean"), F.stddev_samp(col).alias("std")
    )
    out = out.withColumns({"low": F.col("mean") - F.col("std"), "high": F.col("mean") + F.col("std")})
    return out.orderBy(F.asc("mean") if ascending else F.desc("mean"))


def comparison_batch(
    results: DataFrame, metrics: Sequence[str], baseline: str, ci: float = 0.95
) -> DataFrame:
    """Confidence intervals of all metrics, with the delta to the baseline where it is usable."""
    table = ci_table(results, metrics, baseline, ci)
    try:
        delta = baseline_delta(results, metrics, baseline, ci)
    except ValueError:
        return table.withColumns(
            {"delta_mean": F.lit(None).cast("double"), "delta_ci_half_width": F.lit(None).cast("double")}
        )
    delta = delta.select("metric", "model", "delta_mean", F.col("ci_half_width").alias("delta_ci_half_width"))
    return table.join(delta, ["metric", "model"], "left")


def best_model(results: DataFrame, metric: str) -> DataFrame:
    """The model with the best mean, as one row."""
    col = resolve_metric(results, metric)
    known = METRICS.get(metric.lower())
    up = known is not None and known.direction == "maximize"
    means = results.groupBy("model").agg(F.avg(col).alias("mean"))
    order = F.desc_nulls_last("mean") if up else F.asc_nulls_last("mean")
    return means.orderBy(order, "model").limit(1).select(
        F.col("model").alias("best_model"), F.lit(col).alias("metric"), "mean"
    )


def top_fold_models(results: DataFrame, metric: str, k: int = 3) -> DataFrame:
    """The k best folds per model, missing scores last, earlier fold first on ties."""
    col = resolve_metric(results, metric)
    known = METRICS.get(metric.lower())
    up = known is not None and known.direction == "maximize"
    score = F.desc_nulls_last(col) if up else F.asc_nulls_last(col)
    order = W.partitionBy("model").orderBy(score, "outer_fold")
    return (
        results.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("model", "outer_fold", F.col(col).alias("score"), "rank")
    )
