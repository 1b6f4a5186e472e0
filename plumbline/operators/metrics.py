"""Regression metrics as aggregate expressions over scored rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ordering import exact_quantiles, join_on
from plumbline.operators.schema import finite_pairs, is_finite

Expr = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Metric:
    """A named aggregate of (true, predicted) with a direction.

    ``expression`` is None for the exact median, which needs order statistics.
    """

    name: str
    expression: Expr | None
    direction: str = "minimize"

    def is_better(self, a: float, b: float) -> bool:
        return a > b if self.direction == "maximize" else a < b

    def as_loss(self, value: float) -> float:
        return -value if self.direction == "maximize" else value

    @property
    def supports_pruning(self) -> bool:
        return self.name.lower() in PRUNABLE


# Metrics whose fold scores may prune a trial.
PRUNABLE = {"mae", "rmse", "mse"}


def _r2(y: Column, p: Column) -> Column:
    e = y - p
    residual, total = F.sum(e * e), F.count(y) * F.var_pop(y)
    constant = F.when(residual == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(total > 0, 1 - residual / total).otherwise(constant)


METRICS: dict[str, Metric] = {
    m.name.lower(): m
    for m in (
        Metric("MAE", lambda y, p: F.avg(F.abs(y - p))),
        Metric("RMSE", lambda y, p: F.sqrt(F.avg((y - p) * (y - p)))),
        Metric("MSE", lambda y, p: F.avg((y - p) * (y - p))),
        Metric("MedAE", None),
        Metric("R2", _r2, "maximize"),
        Metric("NegMSE", lambda y, p: -F.avg((y - p) * (y - p)), "maximize"),
    )
}
_ALIASES = {"r^2": "r2", "nmse": "negmse"}


def get_metric(name: str) -> Metric:
    key = name.strip().lower()
    key = _ALIASES.get(key, key)
    if key not in METRICS:
        raise ValueError(f"unknown metric {name!r}")
    return METRICS[key]


def register_metric(name: str, expression: Expr, direction: str = "minimize") -> Metric:
    """Add a user metric: a builder of an aggregate over (true, predicted) columns."""
    if direction not in {"minimize", "maximize"}:
        raise ValueError("direction must be 'minimize' or 'maximize'")
    METRICS[name.lower()] = Metric(name, expression, direction)
    return METRICS[name.lower()]


def check_direction(metric: str, direction: str | None) -> str:
    """The metric's direction; a stated one must agree with it."""
    expected = get_metric(metric).direction
    if direction is not None and direction != expected:
        raise ValueError(f"direction {direction!r} conflicts with metric {metric!r} ({expected})")
    return expected


def score(
    df: DataFrame,
    by: Sequence[str],
    metrics: Sequence[str] = ("R2", "MAE", "MedAE", "MSE", "RMSE"),
    y_true: str = "y_true",
    y_pred: str = "y_pred",
    approximate_median: bool = False,
) -> DataFrame:
    """One row per group with a column per metric, over the finite pairs only.

    A group without finite pairs keeps its row, with NaN scores.
    """
    wanted = [get_metric(m) for m in metrics]
    ok = is_finite(F.col(y_true)) & is_finite(F.col(y_pred))
    y = F.when(ok, F.col(y_true).cast("double"))
    p = F.when(ok, F.col(y_pred).cast("double"))
    plain = [m for m in wanted if m.expression is not None]
    aggs = [m.expression(y, p).alias(m.name) for m in plain]
    median = [m for m in wanted if m.expression is None]
    if median and approximate_median:
        aggs.append(F.percentile_approx(F.abs(y - p), 0.5, 100_000).alias(median[0].name))
    out = df.groupBy(*by).agg(F.count_if(ok).alias("n"), *aggs)
    if median and not approximate_median:
        errors = finite_pairs(df, y_true, y_pred).select(
            *by, F.abs(F.col(y_true) - F.col(y_pred)).alias("__e")
        )
        med = exact_quantiles(errors, by, "__e", {median[0].name: 0.5})
        out = join_on(out, med, by, "left")
    nan = F.lit(float("nan"))
    return out.select(
        *by,
        "n",
        *[F.when(F.col("n") > 0, F.col(m.name)).otherwise(nan).alias(m.name) for m in wanted],
    )


def guarded_score(
    df: DataFrame, by: Sequence[str], metric: str, y_true: str = "y_true", y_pred: str = "y_pred"
) -> DataFrame:
    """Score per group, or the worst possible value when any pair is not finite or n < 2."""
    m = get_metric(metric)
    worst = F.lit(float("-inf") if m.direction == "maximize" else float("inf"))
    bad = F.count_if(~(is_finite(F.col(y_true)) & is_finite(F.col(y_pred))))
    health = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), bad.alias("bad"))
    scores = score(df, by, [metric], y_true, y_pred)
    return join_on(health, scores, by).select(
        *by,
        F.when((F.col("bad") > 0) | (F.col("rows") < 2), worst).otherwise(F.col(m.name)).alias("score"),
    )
