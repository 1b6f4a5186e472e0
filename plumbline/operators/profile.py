"""Dataset profile tables. Each one is a single pass plus a small aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.ordering import exact_quantiles, join_on
from plumbline.operators.schema import Roles


def _missing(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def missing_counts(df: DataFrame) -> DataFrame:
    """Columns with missing values, most missing first."""
    return (
        df.agg(*[F.count_if(_missing(df, c)).alias(c) for c in df.columns])
        .unpivot([], df.columns, "column", "missing_count")
        .filter("missing_count > 0")
        .orderBy(F.desc("missing_count"), "column")
    )


def _long_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], list(cols), "column", "value"
    )


def numeric_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, exact quartiles and max per column."""
    long = _long_numeric(df, cols).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    basics = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, ["column"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return join_on(basics, quartiles, ["column"]).select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def top_levels(df: DataFrame, cols: Sequence[str], n: int = 10) -> DataFrame:
    """The n most frequent levels per categorical column; null counts as a level."""
    counts = (
        df.select(*[F.col(c).cast("string").alias(c) for c in cols])
        .unpivot([], list(cols), "column", "level")
        .groupBy("column", "level")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    best = W.partitionBy("column").orderBy(F.desc("count"), F.col("level").asc_nulls_last())
    return (
        counts.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= n)
        .select("column", "level", "count", "rank")
    )


def shape_table(df: DataFrame, roles: Roles) -> DataFrame:
    """One row per column: type, role, non-null count, and the table's shape."""
    role = {c: "numeric" for c in roles.numeric} | {c: "categorical" for c in roles.categorical}
    role[roles.target] = "target"
    cols = [c for c in df.columns if c in role]
    types = dict(df.dtypes)

    def lookup(d: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for c in cols for x in (c, d[c])])[F.col("column")]

    return (
        df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(c) for c in cols])
        .unpivot(["n_rows"], cols, "column", "non_null")
        .select(
            "column",
            lookup(types).alias("dtype"),
            lookup(role).alias("role"),
            "non_null",
            "n_rows",
            F.lit(len(cols)).alias("n_cols"),
            F.lit(len(roles.numeric)).alias("n_numeric"),
            F.lit(len(roles.categorical)).alias("n_categorical"),
        )
    )


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation, nulls dropped pair by pair, in long form and one pass."""
    pairs = list(combinations_with_replacement(cols, 2))
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).agg(
        *[F.corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    )
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(
                F.struct(F.lit(x).alias("col_a"), F.lit(y).alias("col_b"), F.col(f"p{i}").alias("corr"))
            )
    return wide.select(F.inline(F.array(*cells)))
