"""Power, quantile and scale transforms: fitted by aggregates, applied as SQL expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.stats import normal_quantile

# the search starts on this grid and doubles it while the optimum lies on its edge; past the last
# edge the likelihood only rises, and the column has no usable maximum
LAMBDA_EDGE, LAST_EDGE = 8.0, 1024.0


def sql_number(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)" if not math.isfinite(x) else f"{float(x)!r}D"


def yeo_johnson_sql(x: str, lam: float) -> str:
    """SQL text of the transform of expression ``x``; expm1/log1p keep small values exact."""
    x = f"CAST({x} AS DOUBLE)"
    up = f"expm1({sql_number(lam)} * log1p({x})) / {sql_number(lam)}" if lam != 0 else f"log1p({x})"
    mu = 2.0 - lam
    down = f"-expm1({sql_number(mu)} * log1p(-{x})) / {sql_number(mu)}" if mu != 0 else f"-log1p(-{x})"
    return f"(CASE WHEN {x} >= 0 THEN {up} ELSE {down} END)"


def yeo_johnson(x: str, lam: float) -> Column:
    return F.expr(yeo_johnson_sql(f"`{x}`", lam))


@dataclass(frozen=True)
class PowerFit:
    lambdas: dict[str, float]
    means: dict[str, float]
    stds: dict[str, float]
    dropped: dict[str, str] = field(default_factory=dict)

    def sql(self, col: str) -> str:
        body = yeo_johnson_sql(f"`{col}`", self.lambdas[col])
        return f"(({body} - {sql_number(self.means[col])}) / {sql_number(self.stds[col])})"

    def apply(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({f"{c}{suffix}": F.expr(self.sql(c)) for c in self.lambdas})

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, self.lambdas[c], self.means[c], self.stds[c]) for c in self.lambdas]
        return spark.createDataFrame(rows, "column string, lambda double, mean double, std double")


def _yj(x: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """The transform for a vector of values (rows) and of lambdas (columns)."""
    out = np.empty((len(x), len(lam)))
    for side, sign, k in ((x >= 0, 1.0, lam), (x < 0, -1.0, 2.0 - lam)):
        if not side.any():
            continue
        size = np.log1p(np.abs(x[side]))
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            body = np.expm1(np.outer(size, k)) / k
        body[:, k == 0] = size[:, None]
        out[side] = sign * body
    return out


def _spread(
    df: DataFrame, grid: dict[str, np.ndarray], centre: dict[str, float]
) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean and population variance of every column at every lambda, in one pass.

    Tasks reduce their rows to two sums per (column, lambda), taken about the transform of the
    column's mean so that the difference of squares keeps its digits.
    """
    cols = list(grid)
    pivot = {c: _yj(np.array([centre[c]]), grid[c])[0] for c in cols}

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {c: np.zeros((3, len(grid[c]))) for c in cols}
        for pdf in batches:
            for c in cols:
                x = pdf[c].to_numpy(dtype=float)
                x = x[~np.isnan(x)]
                for part in np.array_split(x, max(1, len(x) // 4096)):
                    d = _yj(part, grid[c]) - pivot[c]
                    with np.errstate(over="ignore", invalid="ignore"):
                        sums[c] += np.stack([np.full(d.shape[1], len(part)), d.sum(0), (d * d).sum(0)])
        for c in cols:
            n, s, q = sums[c]
            yield pd.DataFrame({"c": c, "i": np.arange(len(n)), "n": n, "s": s, "q": q})

    rows = (
        df.select(*[F.col(c).cast("double").alias(c) for c in cols])
        .mapInPandas(partial, "c string, i int, n double, s double, q double")
        .groupBy("c", "i")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
        .collect()
    )
    out = {c: (np.zeros(len(grid[c])), np.zeros(len(grid[c]))) for c in cols}
    for r in rows:
        n = max(r["n"], 1.0)
        m = r["s"] / n
        out[r["c"]][0][r["i"]] = pivot[r["c"]][r["i"]] + m
        out[r["c"]][1][r["i"]] = r["q"] / n - m * m
    return out


def fit_power(df: DataFrame, cols: Sequence[str]) -> PowerFit:
    """Maximum-likelihood lambda per column, then population mean and std of the result.

    A pass evaluates a 65-point grid for all columns at once; columns with the optimum on the edge
    go again with a grid twice as wide. A last pass is 32 times finer; then comes the vertex of the
    parabola through the best three points. NaN counts as missing. Columns without variance, or
    whose likelihood still rises at LAST_EDGE, are dropped with the reason.
    """
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    basics = df.agg(
        *[F.count(value[c]).alias(f"n|{c}") for c in cols],
        *[F.avg(value[c]).alias(f"m|{c}") for c in cols],
        *[F.var_pop(value[c]).alias(f"v|{c}") for c in cols],
        *[F.sum(F.signum(value[c]) * F.log1p(F.abs(value[c]))).alias(f"s|{c}") for c in cols],
    ).first()
    dropped = {c: "ZeroVariance" for c in cols if not basics[f"v|{c}"]}
    centre = {c: basics[f"m|{c}"] for c in cols if c not in dropped}
    best = {c: 0.0 for c in centre}
    step = {c: LAMBDA_EDGE / 32 for c in centre}

    def likelihoods(todo: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        grid = {c: best[c] + step[c] * np.arange(-32, 33) for c in todo}
        spread = _spread(df, grid, centre)
        out = {}
        for c, lams in grid.items():
            n, s, var = basics[f"n|{c}"], basics[f"s|{c}"], spread[c][1]
            ok = np.isfinite(var) & (var > 1e-300)
            out[c] = lams, np.where(ok, -n / 2 * np.log(np.where(ok, var, 1.0)) + (lams - 1) * s, -np.inf)
        return out

    todo = list(centre)
    while todo:
        wider = []
        for c, (lams, ll) in likelihoods(todo).items():
            i = int(np.argmax(ll))
            if not np.isfinite(ll[i]):
                dropped[c] = "ZeroVariance"
            elif i not in (0, len(lams) - 1):
                best[c] = float(lams[i])
            elif step[c] * 32 >= LAST_EDGE:
                dropped[c] = "BracketError"
            else:
                step[c] *= 2
                wider.append(c)
        todo = wider
    for c in step:
        step[c] /= 32
    found = [c for c in centre if c not in dropped]
    for c, (lams, ll) in (likelihoods(found) if found else {}).items():
        i = int(np.argmax(ll))
        best[c] = float(lams[i])
        if 0 < i < len(lams) - 1:
            bend = ll[i - 1] - 2 * ll[i] + ll[i + 1]
            if np.isfinite(bend) and bend < 0:
                best[c] += float(step[c] * 0.5 * (ll[i - 1] - ll[i + 1]) / bend)
    kept = [c for c in cols if c not in dropped]
    if not kept:
        raise ValueError(f"power transform failed for all numeric columns: {sorted(dropped)}")
    final = _spread(df, {c: np.array([best[c]]) for c in kept}, centre)
    return PowerFit(
        {c: best[c] for c in kept},
        {c: float(final[c][0][0]) for c in kept},
        {c: float(np.sqrt(final[c][1][0])) or 1.0 for c in kept},
        dropped,
    )


def standard_scale_fit(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column, without nulls and NaN; a constant column scales by 1."""
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    row = df.agg(
        *[F.avg(value[c]).alias(f"m|{c}") for c in cols], *[F.stddev_pop(value[c]).alias(f"d|{c}") for c in cols]
    ).first()
    return {c: (row[f"m|{c}"], row[f"d|{c}"] or 1.0) for c in cols}


def standard_scale_sql(col: str, fit: tuple[float, float]) -> str:
    return f"((CAST(`{col}` AS DOUBLE) - {sql_number(fit[0])}) / {sql_number(fit[1])})"


@dataclass(frozen=True)
class QuantileFit:
    """Distinct landmarks with the lowest and highest reference level each one stands for."""

    landmarks: dict[str, list[float]]
    low: dict[str, list[float]]
    high: dict[str, list[float]]


def fit_quantiles(df: DataFrame, cols: Sequence[str], n: int = 1000, accuracy: int = 100_000) -> QuantileFit:
    """Landmarks at n evenly spaced levels, for all columns in one aggregate."""
    levels = [i / (n - 1) for i in range(n)]
    row = df.agg(
        *[F.percentile_approx(F.col(c).cast("double"), levels, accuracy).alias(c) for c in cols]
    ).first()
    marks, low, high = {}, {}, {}
    for c in cols:
        first: dict[float, float] = {}
        last: dict[float, float] = {}
        for q, level in zip(row[c], levels):
            first.setdefault(q, level)
            last[q] = level
        marks[c] = list(first)
        low[c] = [first[q] for q in marks[c]]
        high[c] = [last[q] for q in marks[c]]
    return QuantileFit(marks, low, high)


def _constant(values: Sequence[float]) -> Column:
    """A long array as one foldable expression instead of a thousand literals."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def quantile_normal(df: DataFrame, col: str, fit: QuantileFit, out: str) -> DataFrame:
    """Normal score by linear interpolation between landmarks, ties at their middle level.

    The landmark is found by the binary search of Bucketizer, then plain expressions.
    """
    from pyspark.ml.feature import Bucketizer

    marks = fit.landmarks[col]
    x = F.col(col).cast("double")
    if len(marks) < 2:
        return df.withColumn(out, F.when(x.isNotNull(), F.lit(0.0)))
    splits = [-math.inf, *marks, math.inf]
    slot = Bucketizer(splits=splits, inputCol="__x", outputCol="__slot", handleInvalid="keep")
    q, low, high = _constant(marks), _constant(fit.low[col]), _constant(fit.high[col])
    i = F.col("__slot").cast("int")
    left, right = F.element_at(q, i), F.element_at(q, i + 1)
    level = (
        F.when(x < marks[0], 0.0)
        .when(x > marks[-1], 1.0)
        .when(x == marks[-1], (fit.low[col][-1] + 1.0) / 2 if fit.low[col][-1] < 1.0 else 1.0)
        .when(x == left, (F.element_at(low, i) + F.element_at(high, i)) / 2)
        .otherwise(
            F.element_at(high, i)
            + (F.element_at(low, i + 1) - F.element_at(high, i)) * (x - left) / (right - left)
        )
    )
    staged = slot.transform(df.withColumn("__x", x))
    return staged.withColumn(out, F.when(x.isNotNull(), normal_quantile(level))).drop("__x", "__slot")
