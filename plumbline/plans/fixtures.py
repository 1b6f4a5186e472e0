"""Experiment tables derived from the star-schema tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.ordering import exact_quantiles, join_on
from plumbline.operators.encode import out_of_fold_encoding
from plumbline.operators.folds import with_folds
from plumbline.operators.schema import Roles, log_target
from plumbline.session import cut_lineage

SEED, FOLDS = 42, 5
NUMERIC = ("year", "mileage", "tax", "mpg", "engineSize")
CATEGORICAL = ("brand", "model", "transmission", "fuelType", "lines")
ROLES = Roles("price", NUMERIC, CATEGORICAL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rd(c: Column | str, digits: int = 6) -> Column:
    """Rounded, with negative zero made positive, so that engines print the same number."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rd(c, digits) for c in cols})


def listings(spark: SparkSession, sf_dir: str, even: bool = False) -> DataFrame:
    """Regression table: one row per line item with its order and part.

    ``even`` spreads the line items by order before heavy work; the join with orders needs them so anyway.
    """
    l, o, p = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    if even:
        l = l.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    key = F.concat_ws(
        "_", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.col("l_quantity").cast("int"), F.round(F.col("l_extendedprice") * 100).cast("bigint"),
    )
    return (
        l.join(o, l["l_orderkey"] == o["o_orderkey"])
        .join(p, l["l_partkey"] == p["p_partkey"])
        .select(
            key.alias("row_key"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("price"),
            F.year("o_orderdate").alias("year"),
            F.col("l_extendedprice").alias("mileage"),
            F.col("l_tax").alias("tax"),
            F.col("l_quantity").alias("mpg"),
            F.col("p_size").alias("engineSize"),
            F.col("p_brand").alias("brand"),
            F.col("p_type").alias("model"),
            F.col("l_returnflag").alias("transmission"),
            F.col("o_orderpriority").alias("fuelType"),
            F.col("l_linenumber").alias("lines"),
        )
    )


LISTINGS = """listings AS (
  SELECT concat_ws('_', l_orderkey, l_partkey, l_suppkey, l_linenumber,
                   CAST(l_quantity AS INTEGER), CAST(round(l_extendedprice * 100) AS BIGINT)) AS row_key,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) AS price,
         CAST(year(o_orderdate) AS INTEGER) AS year, l_extendedprice AS mileage, l_tax AS tax,
         l_quantity AS mpg, p_size AS engineSize, p_brand AS brand, p_type AS model,
         l_returnflag AS transmission, o_orderpriority AS fuelType, l_linenumber AS lines
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def hash_sql(key: str, seed: str | int) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {key}, '{seed}')), 1, 8) AS BIGINT)"


def folded(spark: SparkSession, sf_dir: str, even: bool = False) -> DataFrame:
    """Listings with their fold and log target."""
    return with_folds(listings(spark, sf_dir, even), "row_key", FOLDS, SEED).withColumn(
        "y_log", log_target(F.col("price"))
    )


def stored_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table written once, for fits that pass over it several times."""
    return cut_lineage(folded(spark, sf_dir, even=True))


FOLDED = LISTINGS + f""", folded AS (
  SELECT *, CAST({hash_sql('row_key', SEED)} % {FOLDS} AS INTEGER) AS outer_fold,
         ln(greatest(price, 1.0)) AS y_log FROM listings)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions: the exponent of the encoded brand.

    The listings are joined once and written: the encoding and every metric read them again.
    """
    rows = cut_lineage(folded(spark, sf_dir, even=True).select("outer_fold", "row_key", "brand", "price", "y_log"))
    coded = out_of_fold_encoding(rows, ["brand"], "y_log", "outer_fold")
    return coded.select(
        "outer_fold", "row_key", "brand", F.col("price").alias("y_true"), F.exp("brand__te").alias("y_pred")
    )


PREDICTIONS = FOLDED + """, held AS (SELECT DISTINCT outer_fold AS f FROM folded),
overall AS (SELECT f, avg(y_log) AS g FROM held JOIN folded ON outer_fold <> f GROUP BY f),
fitted AS (SELECT f, brand, count(*) AS n, avg(y_log) AS m
           FROM held JOIN folded ON outer_fold <> f GROUP BY f, brand),
predictions AS (
  SELECT a.outer_fold, a.row_key, a.brand, a.price AS y_true,
         exp(coalesce((n * m + 10.0 * g) / (n + 10.0), g)) AS y_pred
  FROM folded a JOIN overall o ON o.f = a.outer_fold
  LEFT JOIN fitted e ON e.f = a.outer_fold AND e.brand = a.brand)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model x fold metrics from events: five models, five folds."""
    v = F.col("value")
    e = table(spark, sf_dir, "events").withColumn("outer_fold", (F.col("user_id") % 5 + 1).cast("int"))
    keys = ["outer_fold", "event_type"]
    means = e.groupBy(*keys).agg(F.avg(v).alias("MAE"), F.sqrt(F.avg(v * v)).alias("RMSE"))
    med = exact_quantiles(e, keys, "value", {"MedAE": 0.5})
    return join_on(means, med, keys).select(
        "outer_fold", F.col("event_type").alias("model"), "MAE", "RMSE", "MedAE"
    )


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results as a run leaves them: a written table that comparisons read."""
    return cut_lineage(results(spark, sf_dir).coalesce(1))


RESULTS = """results AS (
  SELECT CAST(user_id % 5 + 1 AS INTEGER) AS outer_fold, event_type AS model, avg(value) AS MAE,
         sqrt(avg(value * value)) AS RMSE, median(value) AS MedAE
  FROM events GROUP BY 1, 2)"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial log from events: one study per event type, trials in event order."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("study_name"),
        F.col("event_type").alias("model"),
        F.col("event_type").alias("base_model"),
        F.lit("base").alias("residual_kind"),
        F.lit("MAE").alias("metric"),
        F.lit("minimize").alias("direction"),
        F.when(F.col("event_id") % 17 == 0, "PRUNED").otherwise("COMPLETE").alias("state"),
        F.col("event_id").alias("trial_number"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("param__k"),
        F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("param__user"),
    )


TRIALS = """trials AS (
  SELECT event_type AS study_name, event_type AS model, event_type AS base_model, 'base' AS residual_kind,
         'MAE' AS metric, 'minimize' AS direction,
         CASE WHEN event_id % 17 = 0 THEN 'PRUNED' ELSE 'COMPLETE' END AS state,
         event_id AS trial_number, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS param__k,
         'u' || CAST(user_id % 4 AS VARCHAR) AS param__user
  FROM events)"""
