"""Categorical encodings, fitted on training rows and applied to others."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.keys import seeded_uniform
from plumbline.functions.ordering import join_on
from plumbline.functions.stats import normal_quantile
from plumbline.session import cut_lineage

# what a missing level is called where it counts as a level of its own
MISSING_LEVEL = "__missing__"


def smoothed_mean(n: Column, mean: Column, overall: Column, smoothing: float, min_leaf: int) -> Column:
    weight = F.greatest(n.cast("double"), F.lit(float(min_leaf)))
    return (weight * mean + smoothing * overall) / (weight + smoothing)


def target_encoding(
    train: DataFrame, cols: Sequence[str], y: str, smoothing: float = 10.0, min_leaf: int = 1, with_overall: bool = False
) -> DataFrame:
    """(column, level, n, encoding) for every level of every column, from one group-by.

    The overall mean comes from the same counts (every row contributes once per column);
    ``with_overall`` keeps it as a column.
    """
    long = train.select(y, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [y], list(cols), "column", "level"
    )
    cells = long.groupBy("column", "level").agg(
        F.count(F.lit(1)).alias("rows"), F.count(y).alias("n"), F.sum(F.col(y).cast("double")).alias("total")
    )
    overall = cells.groupBy("column").agg((F.sum("total") / F.sum("n")).alias("overall"))
    # null levels take part in the overall mean but get no entry of their own
    return (
        cells.filter("level is not null and n > 0")
        .join(overall, "column")
        .select(
            "column",
            "level",
            "n",
            smoothed_mean(F.col("n"), F.col("total") / F.col("n"), F.col("overall"), smoothing, min_leaf).alias("encoding"),
            *(["overall"] if with_overall else []),
        )
    )


def apply_target_encoding(
    df: DataFrame,
    encoding: DataFrame,
    overall: float,
    cols: Sequence[str],
    noise_std: float = 0.0,
    key: str | None = None,
    seed: int = 42,
    keep: bool = False,
) -> DataFrame:
    """Replace each column by ``<col>__te``; unseen and null levels get the overall mean.

    No broadcast hint: the encoding table grows with the number of levels, so its measured
    size decides, and a hot level is left to the skew-join rule.
    """
    out = df
    for i, c in enumerate(cols):
        side = encoding.filter(F.col("column") == c).select(
            F.col("level").alias("__level"), F.col("encoding").alias("__enc")
        )
        value = F.coalesce(F.col("__enc"), F.lit(float(overall)))
        if noise_std > 0:
            draw = (
                normal_quantile(seeded_uniform(F.concat_ws("|", F.lit(c), F.col(key)), seed))
                if key
                else F.randn(seed + i)
            )
            value = value + draw * noise_std
        out = (
            out.join(side, out[c].cast("string") == side["__level"], "left")
            .withColumn(f"{c}__te", value)
            .drop("__level", "__enc")
        )
    return out if keep else out.drop(*cols)


def out_of_fold_encoding(
    df: DataFrame,
    cols: Sequence[str],
    y: str,
    fold: str,
    smoothing: float = 10.0,
    min_leaf: int = 1,
) -> DataFrame:
    """``<col>__te`` from all rows outside the row's own fold.

    Per-level totals minus the fold's own share replace a refit per fold: one group-by over
    (level, fold) per column. A level absent outside the fold gets that fold's overall mean.
    Each encoding table is written before the join, so that its measured size decides between
    a broadcast and a shuffle of the rows.
    """
    out = df
    for c in cols:
        cells = df.groupBy(c, fold).agg(
            F.count(y).alias("__n"), F.coalesce(F.sum(F.col(y).cast("double")), F.lit(0.0)).alias("__s")
        )
        level = cells.groupBy(c).agg(F.sum("__n").alias("__ln"), F.sum("__s").alias("__ls"))
        per_fold = cells.groupBy(fold).agg(F.sum("__n").alias("__fn"), F.sum("__s").alias("__fs"))
        everything = W.partitionBy(F.lit(0))  # one row per fold
        rest = per_fold.select(
            fold,
            (
                (F.sum("__fs").over(everything) - F.col("__fs"))
                / (F.sum("__fn").over(everything) - F.col("__fn"))
            ).alias("__overall"),
        )
        table = join_on(join_on(cells, level, [c]), rest, [fold])
        n, s = F.col("__ln") - F.col("__n"), F.col("__ls") - F.col("__s")
        value = F.when(
            (n > 0) & F.col(c).isNotNull(),
            smoothed_mean(n, s / n, F.col("__overall"), smoothing, min_leaf),
        ).otherwise(F.col("__overall"))
        known = cut_lineage(table.select(c, fold, value.alias(f"{c}__te")))
        out = join_on(out, known, [c, fold], "left")
    return out


def balanced_table(df: DataFrame, level: str, column: str = "weight") -> DataFrame:
    """n / (k * count(level)) for each of the k levels; written, so that joins know its size."""
    counts = cut_lineage(df.groupBy(level).agg(F.count(F.lit(1)).alias("__c")))
    n, k = counts.agg(F.sum("__c"), F.count(F.lit(1))).first()
    return counts.select(level, (F.lit(float(n or 0)) / (F.lit(float(k or 1)) * F.col("__c"))).alias(column))


def balanced_weights(df: DataFrame, level: str, column: str = "weight") -> DataFrame:
    """n / (k * count(level)) per row."""
    return join_on(df, balanced_table(df, level, column), [level], "left")


def train_levels(train: DataFrame, col: str, bound: int = 10_000) -> list[str]:
    """Sorted levels of a column to be dummy-encoded; more than ``bound`` is an error."""
    rows = (
        train.select(F.col(col).cast("string").alias("l")).filter("l is not null").distinct()
        .orderBy("l").limit(bound + 1).collect()
    )
    if len(rows) > bound:
        raise ValueError(f"{col} has more than {bound} levels; use target encoding")
    return [r[0] for r in rows]


def dummy_columns(df: DataFrame, col: str, levels: Sequence[str]) -> dict[str, Column]:
    """0/1 columns in the training layout: unknown levels are all zero, absent ones stay 0."""
    text = F.coalesce(F.col(col).cast("string"), F.lit(MISSING_LEVEL))
    return {f"{col}_{lv}": (text == lv).cast("double") for lv in levels}


def align_dummies(train: DataFrame, valid: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both frames with the dummy columns of the training frame."""
    layout = {c: train_levels(train, c) for c in cols}

    def widen(df: DataFrame) -> DataFrame:
        new = {k: v for c in cols for k, v in dummy_columns(df, c, layout[c]).items()}
        return df.withColumns(new).drop(*cols)

    return widen(train), widen(valid)


def one_hot_stages(cols: Sequence[str]) -> tuple[list, list[str]]:
    """Indexer and encoder stages: unknown -> all zeros, every training level has a slot."""
    from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer

    filled = ", ".join(
        f"coalesce(cast(`{c}` as string), '{MISSING_LEVEL}') as `{c}__filled`" for c in cols
    )
    index, hot = [f"{c}__idx" for c in cols], [f"{c}__ohe" for c in cols]
    stages = [
        SQLTransformer(statement=f"select *, {filled} from __THIS__"),
        StringIndexer(
            inputCols=[f"{c}__filled" for c in cols], outputCols=index, handleInvalid="keep",
            stringOrderType="alphabetAsc",
        ),
        OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True),
    ]
    return stages, hot


class TargetEncoder(Estimator, HasInputCols, HasLabelCol):
    """Smoothed target encoding as a pipeline stage."""

    smoothing = Param(Params._dummy(), "smoothing", "pseudo-count of the overall mean", TypeConverters.toFloat)
    minLeaf = Param(Params._dummy(), "minLeaf", "smallest effective count", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, labelCol="label", smoothing=10.0, minLeaf=1):
        super().__init__()
        self._setDefault(smoothing=10.0, minLeaf=1, labelCol="label")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "TargetEncoderModel":
        cols, y = self.getInputCols(), self.getLabelCol()
        table = cut_lineage(
            target_encoding(
                dataset, cols, y, self.getOrDefault(self.smoothing), self.getOrDefault(self.minLeaf), with_overall=True
            )
        )
        known = table.select("overall").first()
        # without a single level there is nothing to read the mean from
        overall = known[0] if known else dataset.agg(F.avg(F.col(y).cast("double"))).first()[0]
        return TargetEncoderModel(table.drop("overall"), float(overall), list(cols))


class TargetEncoderModel(Model, MLReadable, MLWritable):
    """Encoding table plus overall mean; saved as Parquet beside its metadata."""

    def __init__(self, table: DataFrame | None = None, overall: float = 0.0, cols: Sequence[str] = ()):
        super().__init__()
        self.table, self.overall, self.cols = table, overall, list(cols)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return apply_target_encoding(dataset, self.table, self.overall, self.cols, keep=True)

    def write(self) -> MLWriter:
        return _EncoderWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EncoderReader()


class _EncoderWriter(MLWriter):
    def __init__(self, instance: TargetEncoderModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        m = self.instance
        extra = {"overall": m.overall, "cols": json.dumps(m.cols)}
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata=extra)
        m.table.write.parquet(f"{path}/levels")


class _EncoderReader(MLReader):
    def load(self, path: str) -> TargetEncoderModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        table = SparkSession.active().read.parquet(f"{path}/levels")
        m = TargetEncoderModel(table, float(meta["overall"]), json.loads(meta["cols"]))
        m._resetUid(meta["uid"])
        return m
