"""Sources, sinks, schema work and profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import profile, schema
from plumbline.plans import fixtures as fx
from plumbline.plans.catalog import query
from plumbline.plans.fixtures import rd, rounded, table
from plumbline.session import cut_lineage, scratch_path
from plumbline.sources import csv_folder, sinks


def _csv_input(spark: SparkSession, sf_dir: str) -> str:
    """Customer and supplier as CSV files with differing headers, plus one file set to leave out."""
    root = scratch_path(spark, "csv-in")
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    c.select(
        F.col("c_custkey").alias(" key "), F.col("c_name").alias("name"), F.col("c_acctbal").alias("tax(£)"),
        F.col("c_mktsegment").alias("segment"),
    ).write.option("header", "true").csv(f"{root}/customers")
    s.select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("tax"),
        F.col("s_nationkey").alias("nation"),
    ).write.option("header", "true").csv(f"{root}/suppliers")
    table(spark, sf_dir, "region").coalesce(1).write.option("header", "true").csv(f"{root}/regions")
    return root


def _region_file(spark: SparkSession, root: str) -> str:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(f"{root}/regions").select("path")
    return files.first()[0].rsplit("/", 1)[-1]


def _read_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _csv_input(spark, sf_dir)
    cfg = csv_folder.CsvFolder(root, exclude=(_region_file(spark, root),))
    return csv_folder.read_csv_folder(spark, cfg)


_FOLDER_SQL = """folder AS (
  SELECT c_custkey AS key, c_name AS name, c_acctbal AS tax, c_mktsegment AS segment,
         CAST(NULL AS INTEGER) AS nation, 'customers' AS origin FROM customer
  UNION ALL
  SELECT s_suppkey, s_name, s_acctbal, NULL, s_nationkey, 'suppliers' FROM supplier)"""


@query(
    "a1_csv_folder",
    f"""WITH {_FOLDER_SQL}
SELECT CAST(key AS BIGINT) AS key, name, tax, segment, CAST(nation AS BIGINT) AS nation FROM folder""",
)
def a1(spark, sf_dir):
    """Folder of files with two headers, one name excluded, read back as one table."""
    return _read_folder(spark, sf_dir).select(
        F.col("key").cast("bigint").alias("key"), "name", F.col("tax").cast("double").alias("tax"), "segment",
        F.col("nation").cast("bigint").alias("nation"),
    )


@query(
    "a2_union_by_name",
    """SELECT CAST(c_custkey AS BIGINT) AS key, c_name AS name, c_mktsegment AS segment,
       CAST(NULL AS DOUBLE) AS balance FROM customer
UNION ALL SELECT CAST(s_suppkey AS BIGINT), s_name, NULL, s_acctbal FROM supplier""",
)
def a2(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return csv_folder.union_by_name(
        [
            c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
            s.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
        ]
    )


@query(
    "a3_provenance",
    f"WITH {_FOLDER_SQL} SELECT origin, count(*) AS n FROM folder GROUP BY origin",
)
def a3(spark, sf_dir):
    """Rows per source folder, from the provenance column."""
    origin = F.element_at(F.split("_source_file", "/"), -2)
    return _read_folder(spark, sf_dir).groupBy(origin.alias("origin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a4_header_normalise",
    """SELECT l_returnflag AS flag, round(sum(l_tax), 4) AS tax_sum, round(sum(l_quantity), 4) AS qty_sum,
       count(*) AS n FROM lineitem GROUP BY l_returnflag""",
)
def a4(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_tax").alias(" tax(£)"), F.col("l_quantity").alias("Quantity "), F.col("l_returnflag").alias(" FLAG")
    )
    return (
        csv_folder.normalise_columns(raw, lower=True)
        .groupBy("flag")
        .agg(rd(F.sum("tax"), 4).alias("tax_sum"), rd(F.sum("quantity"), 4).alias("qty_sum"), F.count(F.lit(1)).alias("n"))
    )


@query(
    "a5_csv_sink",
    f"""WITH {fx.RESULTS} SELECT outer_fold, model, round(MAE, 6) AS MAE, round(RMSE, 6) AS RMSE,
round(MedAE, 6) AS MedAE FROM results""",
)
def a5(spark, sf_dir):
    """Results written as CSV partitioned by model and read back."""
    path = sinks.write_csv(fx.results(spark, sf_dir), scratch_path(spark, "results"), ["model"])
    back = sinks.read_table_csv(spark, path, "outer_fold int, MAE double, RMSE double, MedAE double, model string")
    return rounded(back, "MAE", "RMSE", "MedAE").select("outer_fold", "model", "MAE", "RMSE", "MedAE")


@query(
    "a6_json_merge",
    """WITH old AS (SELECT n_name AS model, count(*) AS n, round(avg(c_acctbal), 6) AS balance
              FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name),
new AS (SELECT n_name AS model, count(*) AS n, round(avg(s_acctbal), 6) AS balance
        FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000 GROUP BY n_name)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE model NOT IN (SELECT model FROM new)""",
)
def a6(spark, sf_dir):
    """Two runs merged into one keyed artefact; keys of the later run win."""
    nation = table(spark, sf_dir, "nation")

    def run(df: DataFrame, key: str, balance: str) -> DataFrame:
        return (
            df.join(nation, F.col(key) == F.col("n_nationkey"))
            .groupBy(F.col("n_name").alias("model"))
            .agg(F.count(F.lit(1)).alias("n"), rd(F.avg(balance)).alias("balance"))
        )

    path = scratch_path(spark, "params")
    old = run(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal")
    new = run(table(spark, sf_dir, "supplier").filter("s_acctbal > 5000"), "s_nationkey", "s_acctbal")
    sinks.write_merged_json(spark, old, path)
    sinks.write_merged_json(spark, new, path)
    return sinks.read_merged_json(spark, path, new.schema).select("model", "n", "balance")


@query("a7_dropped_log", "SELECT 'flat' AS column_name, 'ZeroVariance' AS error_type, CAST(2 AS BIGINT) AS n")
def a7(spark, sf_dir):
    """Columns a power fit rejects, appended to the log by two runs."""
    from plumbline.operators.numeric import fit_power

    # written: both fits pass over the rows several times
    df = cut_lineage(fx.listings(spark, sf_dir, even=True).select("year", "mpg").withColumn("flat", F.lit(3.0)))
    path = scratch_path(spark, "dropped")
    for fold in (1, 2):
        fit = fit_power(df, ["flat", "year", "mpg"])
        sinks.append_dropped(spark, path, fit.dropped, "run", fold, None, "LinearRegression", 0)
    return sinks.read_dropped(spark, path).groupBy("column_name", "error_type").agg(F.count(F.lit(1)).alias("n"))


# ---- schema ----------------------------------------------------------------------------


@query(
    "b1_sanitize_columns",
    """SELECT v.column_name, v.total FROM (
  SELECT round(sum(l_quantity), 4) AS a, round(sum(l_extendedprice), 2) AS b, round(sum(l_tax), 4) AS c,
         round(sum(l_discount), 4) AS d, CAST(sum(l_linenumber) AS DOUBLE) AS e FROM lineitem) s,
  LATERAL (VALUES ('line_quantity', a), ('f_2nd_price', b), ('tax', c), ('tax_1', d), ('f', e)) v(column_name, total)""",
)
def b1(spark, sf_dir):
    """Awkward names made safe, then the column totals under the new names."""
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("line  quantity!"), F.col("l_extendedprice").alias("2nd__price"),
        F.col("l_tax").alias("tax(%)"), F.col("l_discount").alias("_tax_"),
        F.col("l_linenumber").cast("double").alias("£"),
    )
    clean, _ = schema.sanitize_columns(raw)
    digits = {"f_2nd_price": 2}
    return clean.agg(*[rd(F.sum(c), digits.get(c, 4)).alias(c) for c in clean.columns]).unpivot(
        [], clean.columns, "column_name", "total"
    )


@query(
    "b2_infer_roles",
    f"""WITH {fx.LISTINGS}, u AS (SELECT count(DISTINCT year) AS year, count(DISTINCT engineSize) AS engineSize,
  count(DISTINCT lines) AS lines, count(*) AS n FROM listings)
SELECT v.c AS "column", v.r AS role, u.n AS non_null FROM u, LATERAL (VALUES
 ('year', CASE WHEN year <= 20 THEN 'categorical' ELSE 'numeric' END),
 ('engineSize', CASE WHEN engineSize <= 20 THEN 'categorical' ELSE 'numeric' END),
 ('lines', CASE WHEN lines <= 20 THEN 'categorical' ELSE 'numeric' END),
 ('mileage', 'numeric'), ('tax', 'numeric'), ('mpg', 'numeric'), ('brand', 'categorical'),
 ('model', 'categorical'), ('transmission', 'categorical'), ('fuelType', 'categorical')) v(c, r)""",
)
def b2(spark, sf_dir):
    df = fx.listings(spark, sf_dir).drop("row_key")
    return schema.roles_table(df, schema.infer_roles(df, "price"))


@query(
    "b3_coerce_types",
    """WITH t AS (SELECT CASE WHEN l_linestatus = 'O' THEN CAST(l_linenumber AS VARCHAR) || ' kg'
  ELSE CAST(l_linenumber AS VARCHAR) END AS q, CAST(l_suppkey AS VARCHAR) AS s, l_linestatus AS st FROM lineitem)
SELECT st AS status, count(TRY_CAST(q AS DOUBLE)) AS numeric_ok, sum(TRY_CAST(q AS DOUBLE)) AS total,
       count(DISTINCT s) AS levels FROM t GROUP BY st""",
)
def b3(spark, sf_dir):
    number = F.col("l_linenumber").cast("string")
    raw = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", F.concat(number, F.lit(" kg"))).otherwise(number).alias("q"),
        F.col("l_suppkey").alias("s"), F.col("l_linestatus").alias("status"),
    )
    typed = schema.coerce_types(raw, ["q", "absent"], ["s"])
    return typed.groupBy("status").agg(
        F.count("q").alias("numeric_ok"), F.sum("q").alias("total"), F.count_distinct("s").alias("levels")
    )


@query(
    "b4_drop_missing_target",
    f"""WITH {fx.LISTINGS} SELECT transmission, count(*) AS n FROM listings
WHERE nullif(tax, 0.0) IS NOT NULL GROUP BY transmission""",
)
def b4(spark, sf_dir):
    df = fx.listings(spark, sf_dir).withColumn("target", F.nullif(F.col("tax"), F.lit(0.0)))
    return schema.drop_missing_target(df, "target").groupBy("transmission").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b5_log_target",
    f"""WITH {fx.LISTINGS} SELECT brand, round(avg(ln(greatest(price - 20000, 1.0))), 9) AS mean_log,
round(avg(exp(ln(greatest(price - 20000, 1.0)))), 4) AS mean_back FROM listings GROUP BY brand""",
)
def b5(spark, sf_dir):
    """Log target of a shifted price (so that the floor at 1 matters) and its inverse."""
    y = schema.log_target(F.col("price") - 20000)
    return fx.listings(spark, sf_dir).groupBy("brand").agg(
        rd(F.avg(y), 9).alias("mean_log"), rd(F.avg(F.exp(y)), 4).alias("mean_back")
    )


@query(
    "b6_project_features",
    f"""WITH {fx.LISTINGS} SELECT year, mileage, tax, mpg, engineSize, brand, model, transmission, fuelType, lines
FROM listings""",
)
def b6(spark, sf_dir):
    return schema.project_features(fx.listings(spark, sf_dir), fx.ROLES)


@query(
    "b7_finite_pairs",
    f"""WITH {fx.PREDICTIONS}, p AS (SELECT outer_fold, y_true,
  CASE WHEN y_true > 90000 THEN CAST('inf' AS DOUBLE) WHEN y_true < 2000 THEN CAST('nan' AS DOUBLE) ELSE y_pred END AS y_pred
  FROM predictions)
SELECT outer_fold, count(*) AS n, round(avg(abs(y_true - y_pred)), 4) AS mae FROM p
WHERE isfinite(y_true) AND isfinite(y_pred) GROUP BY outer_fold""",
)
def b7(spark, sf_dir):
    broken = (
        F.when(F.col("y_true") > 90000, float("inf")).when(F.col("y_true") < 2000, float("nan")).otherwise(F.col("y_pred"))
    )
    df = fx.predictions(spark, sf_dir).withColumn("y_pred", broken)
    return schema.finite_pairs(df, "y_true", "y_pred").groupBy("outer_fold").agg(
        F.count(F.lit(1)).alias("n"), rd(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))), 4).alias("mae")
    )


@query(
    "b8_completed_trials",
    f"""WITH {fx.TRIALS} SELECT model, count(*) AS n, round(sum(value), 4) AS total FROM trials
WHERE state = 'COMPLETE' AND isfinite(value) GROUP BY model""",
)
def b8(spark, sf_dir):
    from plumbline.operators.trials import completed

    return completed(fx.trials(spark, sf_dir)).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), rd(F.sum("value"), 4).alias("total")
    )


_RAW_LABELS = """labels_in AS (
  SELECT DISTINCT unnest(['num__' || brand, 'cat_te_' || brand || '__te', 'cat__fuelType_' || fuelType,
         'cat_' || transmission || ' _te_x', '_ te_' || model || '_train']) AS raw FROM listings)"""


@query(
    "b9_clean_labels",
    f"""WITH {fx.LISTINGS}, {_RAW_LABELS},
s1 AS (SELECT raw, replace(replace(replace(replace(raw, '  ', ' '), '_ ', '_'), ' _', '_'), ' ', '_') AS t FROM labels_in),
s2 AS (SELECT raw, regexp_replace(regexp_replace(t, '__+', '_', 'g'), '^(cat_te_|cat__|cat_|num_)', '') AS t FROM s1),
s3 AS (SELECT raw, regexp_replace(regexp_replace(t, '(^|_)te_', '\\1', 'g'), '(_te|_tr|_test|_train)$', '') AS t FROM s2)
SELECT raw, trim(t, '_') AS label FROM s3""",
)
def b9(spark, sf_dir):
    raw = F.explode(
        F.array(
            F.concat(F.lit("num__"), "brand"), F.concat(F.lit("cat_te_"), "brand", F.lit("__te")),
            F.concat(F.lit("cat__fuelType_"), "fuelType"), F.concat(F.lit("cat_"), "transmission", F.lit(" _te_x")),
            F.concat(F.lit("_ te_"), "model", F.lit("_train")),
        )
    )
    names = fx.listings(spark, sf_dir).select(raw.alias("raw")).distinct()
    return names.select("raw", schema.clean_label(F.col("raw")).alias("label"))


@query(
    "b10_model_label",
    """SELECT event_type || CASE WHEN user_id % 4 = 0 THEN '' ELSE '+K' || CAST(user_id % 4 AS VARCHAR) END AS label,
count(*) AS n FROM events GROUP BY 1""",
)
def b10(spark, sf_dir):
    kind = F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("K"), (F.col("user_id") % 4).cast("string")))
    e = table(spark, sf_dir, "events")
    return e.groupBy(schema.model_label(F.col("event_type"), kind).alias("label")).agg(F.count(F.lit(1)).alias("n"))


_LABELLED = """labelled AS (
  SELECT CASE WHEN event_type = 'view' AND user_id % 2 = 0 THEN 'view'
              ELSE event_type || '+' || CAST(user_id % 2 AS VARCHAR) END AS model, value FROM events)"""


@query(
    "b11_match_names",
    f"""WITH {_LABELLED} SELECT model, count(*) AS n, round(sum(value), 4) AS total FROM labelled
WHERE model = 'view' OR model LIKE 'click+%' GROUP BY model""",
)
def b11(spark, sf_dir):
    """'view' exists exactly, so its variants stay out; 'click' only as prefix, so all of them match."""
    two = (F.col("user_id") % 2).cast("string")
    labelled = table(spark, sf_dir, "events").select(
        F.when((F.col("event_type") == "view") & (F.col("user_id") % 2 == 0), "view")
        .otherwise(F.concat_ws("+", "event_type", two)).alias("model"),
        "value",
    )
    return schema.match_many(labelled, ["view", "click"]).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), rd(F.sum("value"), 4).alias("total")
    )


# ---- profile ---------------------------------------------------------------------------

_GAPS_SQL = """gaps AS (SELECT nullif(tax, 0.0) AS tax, nullif(lines, 1) AS lines, nullif(transmission, 'A') AS transmission,
  CASE WHEN mpg = 50 THEN CAST('nan' AS DOUBLE) ELSE mpg END AS mpg, price FROM listings)"""


def _gaps(spark, sf_dir):
    return fx.listings(spark, sf_dir).select(
        F.nullif(F.col("tax"), F.lit(0.0)).alias("tax"), F.nullif(F.col("lines"), F.lit(1)).alias("lines"),
        F.nullif(F.col("transmission"), F.lit("A")).alias("transmission"),
        F.when(F.col("mpg") == 50, float("nan")).otherwise(F.col("mpg")).alias("mpg"), "price",
    )


@query(
    "c1_missing_counts",
    f"""WITH {fx.LISTINGS}, {_GAPS_SQL}, m AS (SELECT count(*) FILTER (tax IS NULL) AS tax, count(*) FILTER (lines IS NULL) AS lines,
  count(*) FILTER (transmission IS NULL) AS transmission, count(*) FILTER (isnan(mpg)) AS mpg,
  count(*) FILTER (price IS NULL) AS price FROM gaps)
SELECT v.c AS "column", v.n AS missing_count FROM m, LATERAL (VALUES ('tax', tax), ('lines', lines),
 ('transmission', transmission), ('mpg', mpg), ('price', price)) v(c, n) WHERE v.n > 0""",
)
def c1(spark, sf_dir):
    return profile.missing_counts(_gaps(spark, sf_dir))


@query(
    "c2_numeric_summary",
    f"""WITH {fx.LISTINGS}, long AS (
  SELECT 'price' AS c, price AS v FROM listings UNION ALL SELECT 'year', CAST(year AS DOUBLE) FROM listings
  UNION ALL SELECT 'mileage', mileage FROM listings UNION ALL SELECT 'tax', tax FROM listings
  UNION ALL SELECT 'mpg', mpg FROM listings UNION ALL SELECT 'engineSize', CAST(engineSize AS DOUBLE) FROM listings)
SELECT c AS "column", count(v) AS "count", round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std,
  round(min(v), 4) AS min, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50,
  round(quantile_cont(v, 0.75), 4) AS p75, round(max(v), 4) AS max FROM long GROUP BY c""",
)
def c2(spark, sf_dir):
    out = profile.numeric_summary(fx.listings(spark, sf_dir), [*fx.NUMERIC, "price"])
    return rounded(out, "mean", "std", "min", "p25", "p50", "p75", "max", digits=4)


@query(
    "c3_top_levels",
    f"""WITH {fx.LISTINGS}, long AS (SELECT 'brand' AS c, brand AS level FROM listings
  UNION ALL SELECT 'model', nullif(model, 'SMALL') FROM listings UNION ALL SELECT 'fuelType', fuelType FROM listings
  UNION ALL SELECT 'lines', CAST(lines AS VARCHAR) FROM listings),
n AS (SELECT c, level, count(*) AS n FROM long GROUP BY c, level),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, level ASC NULLS LAST) AS k FROM n)
SELECT c AS "column", level, n AS "count", CAST(k AS INTEGER) AS rank FROM r WHERE k <= 10""",
)
def c3(spark, sf_dir):
    df = fx.listings(spark, sf_dir).withColumn("model", F.nullif(F.col("model"), F.lit("SMALL")))
    return profile.top_levels(df, ["brand", "model", "fuelType", "lines"])


@query(
    "c4_shape",
    f"""WITH {fx.LISTINGS}, {_GAPS_SQL}, s AS (SELECT count(*) AS n, count(tax) AS tax, count(lines) AS lines,
  count(transmission) AS transmission, count(mpg) AS mpg, count(price) AS price FROM gaps)
SELECT v.c AS "column", v.t AS dtype, v.r AS role, v.k AS non_null, s.n AS n_rows, 5 AS n_cols, 2 AS n_numeric,
 2 AS n_categorical FROM s, LATERAL (VALUES ('tax', 'double', 'numeric', tax), ('mpg', 'double', 'numeric', mpg),
 ('lines', 'int', 'categorical', lines), ('transmission', 'string', 'categorical', transmission),
 ('price', 'double', 'target', price)) v(c, t, r, k)""",
)
def c4(spark, sf_dir):
    df = _gaps(spark, sf_dir)
    return profile.shape_table(df, schema.infer_roles(df, "price"))


@query(
    "c5_correlation",
    f"""WITH {fx.LISTINGS}, l AS (SELECT nullif(tax, 0.0) AS tax, mileage, mpg, price FROM listings)
SELECT v.a AS col_a, v.b AS col_b, round(v.r, 9) + 0.0 AS corr FROM (SELECT corr(tax, mileage) AS tm, corr(tax, mpg) AS tg,
 corr(tax, price) AS tp, corr(mileage, mpg) AS mg, corr(mileage, price) AS mp, corr(mpg, price) AS gp FROM l) s,
LATERAL (VALUES ('tax', 'tax', 1.0::DOUBLE), ('mileage', 'mileage', 1.0), ('mpg', 'mpg', 1.0), ('price', 'price', 1.0),
 ('tax', 'mileage', tm), ('mileage', 'tax', tm), ('tax', 'mpg', tg), ('mpg', 'tax', tg), ('tax', 'price', tp),
 ('price', 'tax', tp), ('mileage', 'mpg', mg), ('mpg', 'mileage', mg), ('mileage', 'price', mp), ('price', 'mileage', mp),
 ('mpg', 'price', gp), ('price', 'mpg', gp)) v(a, b, r)""",
)
def c5(spark, sf_dir):
    df = fx.listings(spark, sf_dir).withColumn("tax", F.nullif(F.col("tax"), F.lit(0.0)))
    return rounded(profile.correlation_matrix(df, ["tax", "mileage", "mpg", "price"]), "corr", digits=9)
