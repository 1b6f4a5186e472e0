"""Row-wise feature functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column aliases (first match wins), reference year, mileage bins.
YEAR_NAMES = ("year", "model_year", "manufacture_year")
MILEAGE_NAMES = ("mileage", "odometer", "km", "kilometers", "kilometres")
BRAND_NAMES = ("brand", "make")
MODEL_NAMES = ("model", "series")
REFERENCE_YEAR = 2025
MILEAGE_BINS = (("very_low", 10_000), ("low", 30_000), ("mid", 60_000), ("high", 100_000))
MILEAGE_TOP_BIN = "very_high"
# Name patterns with the direction a model should follow.
MONOTONE_PATTERNS = (("mileage|odometer|km", -1), ("year", 1), ("engine|displacement", 1))


def _present(df: DataFrame, names: Sequence[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def vehicle_age(year: Column, reference_year: int = REFERENCE_YEAR) -> Column:
    y = year.try_cast("double")
    return F.when(y.isNotNull(), F.greatest(F.lit(reference_year) - y, F.lit(0.0)))


def mileage_bin(mileage: Column) -> Column:
    """Right-closed bins, so a ``when`` chain and not a left-closed bucketizer."""
    m = mileage.try_cast("double")
    out = F.when(m.isNull() | F.isnan(m), F.lit(None).cast("string"))
    for label, top in MILEAGE_BINS:
        out = out.when(m <= top, label)
    return out.otherwise(MILEAGE_TOP_BIN)


def age_products(age: Column, mileage: Column) -> tuple[Column, Column]:
    a = F.coalesce(age, F.lit(0.0))
    m = F.coalesce(mileage.try_cast("double"), F.lit(0.0))
    return a * m, m / F.greatest(a, F.lit(1.0))


def joined_levels(brand: Column, model: Column) -> Column:
    """Both levels in one; a missing one prints as ``nan``."""
    gap = F.lit("nan")
    return F.concat_ws(
        "__", F.coalesce(brand.cast("string"), gap), F.coalesce(model.cast("string"), gap)
    )


def interaction_expressions(
    df: DataFrame, reference_year: int = REFERENCE_YEAR
) -> tuple[dict[str, Column], dict[str, Column]]:
    """New numeric and new categorical columns this table's names allow."""
    year, mileage = _present(df, YEAR_NAMES), _present(df, MILEAGE_NAMES)
    brand, model = _present(df, BRAND_NAMES), _present(df, MODEL_NAMES)
    numeric: dict[str, Column] = {}
    categorical: dict[str, Column] = {}
    if year:
        numeric["vehicle_age"] = vehicle_age(F.col(year), reference_year)
    if mileage:
        categorical["mileage_bin"] = mileage_bin(F.col(mileage))
    if year and mileage:
        product, ratio = age_products(numeric["vehicle_age"], F.col(mileage))
        numeric["age_x_mileage"], numeric["mileage_per_year"] = product, ratio
    if brand and model:
        categorical["brand_model"] = joined_levels(F.col(brand), F.col(model))
    return numeric, categorical


def add_interactions(
    df: DataFrame, policy: str = "interactions", reference_year: int = REFERENCE_YEAR
) -> tuple[DataFrame, list[str], list[str]]:
    """The frame with its interaction columns, and their names by role."""
    if policy not in {"interaction", "interactions"}:
        return df, [], []
    numeric, categorical = interaction_expressions(df, reference_year)
    return df.withColumns({**numeric, **categorical}), list(numeric), list(categorical)


def monotone_direction(name: Column) -> Column:
    out = None
    for pattern, sign in MONOTONE_PATTERNS:
        hit = F.lower(name).rlike(pattern)
        out = F.when(hit, sign) if out is None else out.when(hit, sign)
    return out.otherwise(0)


def monotonicity_audit(pdp: DataFrame) -> DataFrame:
    """Steps of each partial-dependence curve that go against the expected direction."""
    from pyspark.sql import Window as W

    # a curve has grid_size points, so this window is small by construction
    along = W.partitionBy("model", "outer_fold", "feature").orderBy("grid_value")
    step = F.col("prediction_mean") - F.lag("prediction_mean").over(along)
    return (
        pdp.withColumn("direction", monotone_direction(F.col("feature")))
        .withColumn("step", step)
        .filter("step is not null")
        .groupBy("model", "outer_fold", "feature", "direction")
        .agg(
            F.count(F.lit(1)).alias("steps"),
            F.count_if(F.col("step") * F.col("direction") < 0).alias("violations"),
        )
    )


def joined_text(*cols: str, gap: str = "nan") -> Column:
    """Several text columns in one row text, separated by a blank; a missing one prints as text."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit(gap)) for c in cols])


def fit_text_vectors(
    df: DataFrame, text: str, dim: int = 16, seed: int = 42, min_count: int = 5, partitions: int | None = None, iterations: int | None = None
):
    """Pipeline that turns a text column into ``dim`` dense numbers learnt from the table.

    The texts are trained on in as many partitions as the cluster has cores, with a few iterations
    to bring the partitions together; one partition needs one.
    """
    partitions = partitions or df.sparkSession.sparkContext.defaultParallelism
    iterations = iterations or min(5, partitions)
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import RegexTokenizer, Word2Vec

    stages = [
        RegexTokenizer(inputCol=text, outputCol="__tokens", pattern=r"\s+"),
        Word2Vec(
            inputCol="__tokens", outputCol="__emb", vectorSize=dim, seed=seed, minCount=min_count,
            maxIter=iterations, numPartitions=partitions,
        ),
    ]
    return Pipeline(stages=stages).fit(df)


def text_vector_columns(model, df: DataFrame, dim: int) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df).withColumn("__emb", vector_to_array("__emb"))
    return out.withColumns({f"text_emb_{i}": F.col("__emb")[i] for i in range(dim)}).drop(
        "__emb", "__tokens"
    )
