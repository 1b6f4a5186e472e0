"""Feature functions, fitted transforms and row partitioning."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import assembly, encode, features, folds, numeric, select
from plumbline.plans import fixtures as fx
from plumbline.plans.catalog import query
from plumbline.plans.fixtures import hash_sql, rd, rounded, table
from plumbline.session import cut_lineage


def _gappy(spark, sf_dir):
    """Listings with missing years, mileages and brands."""
    return fx.listings(spark, sf_dir).withColumns(
        {
            "year": F.nullif(F.col("year"), F.lit(1995)),
            "mileage": F.when(F.col("mpg") != 50, F.col("mileage")),
            "brand": F.nullif(F.col("brand"), F.lit("Brand#1")),
        }
    )


_GAPPY = """gappy AS (SELECT * REPLACE (nullif(year, 1995) AS year,
  CASE WHEN mpg <> 50 THEN mileage END AS mileage, nullif(brand, 'Brand#1') AS brand) FROM listings)"""


@query(
    "d2_vehicle_age",
    f"""WITH {fx.LISTINGS}, {_GAPPY} SELECT CAST(CASE WHEN year IS NOT NULL THEN greatest(2025 - year, 0) END AS DOUBLE)
AS vehicle_age, count(*) AS n FROM gappy GROUP BY 1""",
)
def d2(spark, sf_dir):
    df, _, _ = features.add_interactions(_gappy(spark, sf_dir))
    return df.groupBy("vehicle_age").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d3_mileage_bin",
    f"""WITH {fx.LISTINGS}, {_GAPPY} SELECT CASE WHEN mileage IS NULL THEN NULL WHEN mileage <= 10000 THEN 'very_low'
 WHEN mileage <= 30000 THEN 'low' WHEN mileage <= 60000 THEN 'mid' WHEN mileage <= 100000 THEN 'high'
 ELSE 'very_high' END AS mileage_bin, count(*) AS n, round(max(mileage), 2) AS top FROM gappy GROUP BY 1""",
)
def d3(spark, sf_dir):
    df, _, _ = features.add_interactions(_gappy(spark, sf_dir))
    return df.groupBy("mileage_bin").agg(F.count(F.lit(1)).alias("n"), rd(F.max("mileage"), 2).alias("top"))


@query(
    "d4_age_products",
    f"""WITH {fx.LISTINGS}, {_GAPPY}, a AS (SELECT coalesce(CASE WHEN year IS NOT NULL THEN greatest(2025 - year, 0) END, 0) AS age,
 coalesce(mileage, 0.0) AS m, row_key FROM gappy)
SELECT row_key, round(age * m, 4) AS age_x_mileage, round(m / greatest(age, 1), 6) AS mileage_per_year FROM a""",
)
def d4(spark, sf_dir):
    df, _, _ = features.add_interactions(_gappy(spark, sf_dir))
    return df.select("row_key", rd("age_x_mileage", 4).alias("age_x_mileage"), rd("mileage_per_year").alias("mileage_per_year"))


@query(
    "d5_brand_model",
    f"""WITH {fx.LISTINGS}, {_GAPPY} SELECT coalesce(brand, 'nan') || '__' || coalesce(model, 'nan') AS brand_model,
count(*) AS n FROM gappy GROUP BY 1""",
)
def d5(spark, sf_dir):
    df, _, _ = features.add_interactions(_gappy(spark, sf_dir))
    return df.groupBy("brand_model").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d7_monotone_direction",
    f"""WITH {fx.LISTINGS}, names AS (SELECT DISTINCT unnest(['num__mileage', 'km_' || model, 'Year_' || CAST(year AS VARCHAR),
 'engineSize_' || CAST(engineSize AS VARCHAR), 'fuel_' || fuelType]) AS feature FROM listings)
SELECT feature, CASE WHEN regexp_matches(lower(feature), 'mileage|odometer|km') THEN -1
 WHEN regexp_matches(lower(feature), 'year') THEN 1 WHEN regexp_matches(lower(feature), 'engine|displacement') THEN 1
 ELSE 0 END AS direction FROM names""",
)
def d7(spark, sf_dir):
    names = F.explode(
        F.array(
            F.lit("num__mileage"), F.concat(F.lit("km_"), "model"), F.concat(F.lit("Year_"), F.col("year").cast("string")),
            F.concat(F.lit("engineSize_"), F.col("engineSize").cast("string")), F.concat(F.lit("fuel_"), "fuelType"),
        )
    )
    df = fx.listings(spark, sf_dir).select(names.alias("feature")).distinct()
    return df.select("feature", features.monotone_direction(F.col("feature")).alias("direction"))


@query(
    "d8_joined_text",
    """SELECT doc_id, md5(coalesce(nullif(lang, 'en'), 'nan') || ' ' || source || ' ' || text) AS text_md5,
length(coalesce(nullif(lang, 'en'), 'nan') || ' ' || source || ' ' || text) AS text_length FROM documents""",
)
def d8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("lang", F.nullif(F.col("lang"), F.lit("en")))
    text = features.joined_text("lang", "source", "text")
    return docs.select("doc_id", F.md5(text).alias("text_md5"), F.length(text).cast("bigint").alias("text_length"))


@query("d9_text_vectors")
def d9(spark, sf_dir):
    """Dense text columns learnt from the documents themselves, averaged per language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", features.joined_text("lang", "source", "text").alias("t"))
    model = features.fit_text_vectors(docs, "t", dim=8)
    out = features.text_vector_columns(model, docs, 8)
    return out.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"text_emb_{i}").alias(f"text_emb_{i}") for i in range(8)]
    )


# ---- encodings -------------------------------------------------------------------------


def _held_out(spark, sf_dir):
    df = fx.folded(spark, sf_dir).withColumn("model", F.nullif(F.col("model"), F.lit("SMALL")))
    return df.filter("outer_fold <> 0"), df.filter("outer_fold = 0")


@query(
    "e1_one_hot",
    f"""WITH {fx.FOLDED}, h AS (SELECT coalesce(nullif(model, 'SMALL'), '__missing__') AS level, outer_fold FROM folded),
tr AS (SELECT DISTINCT level FROM h WHERE outer_fold <> 0 AND level <> 'LARGE')
SELECT tr.level, CAST(count(h.level) AS DOUBLE) AS ones FROM tr LEFT JOIN h ON h.level = tr.level AND h.outer_fold = 0 GROUP BY tr.level""",
)
def e1(spark, sf_dir):
    """Slots fitted on training rows without one level; held-out rows of that level are all zero."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    train, held = _held_out(spark, sf_dir)
    stages, out = encode.one_hot_stages(["model"])
    fitted = Pipeline(stages=stages).fit(train.filter("model is null or model <> 'LARGE'"))
    labels = fitted.stages[1].labelsArray[0]
    hot = fitted.transform(held).select(vector_to_array(out[0]).alias("v"))
    sums = hot.agg(*[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(len(labels))])
    cells = F.array(*[F.struct(F.lit(lv).alias("level"), F.col(f"s{i}").alias("ones")) for i, lv in enumerate(labels)])
    return sums.select(F.inline(cells))


@query(
    "e2_dummy_alignment",
    f"""WITH {fx.FOLDED}, tr AS (SELECT DISTINCT fuelType AS level FROM folded WHERE outer_fold <> 0 AND fuelType <> '5-LOW'),
va AS (SELECT fuelType FROM folded WHERE outer_fold = 0 AND fuelType <> '1-URGENT')
SELECT 'fuelType_' || level AS "column", CAST(count(fuelType) AS DOUBLE) AS ones FROM tr LEFT JOIN va ON fuelType = level GROUP BY level""",
)
def e2(spark, sf_dir):
    """The training layout rules: a level only in validation is dropped, one only in training is 0."""
    df = fx.folded(spark, sf_dir).select("fuelType", "outer_fold")
    train = df.filter("outer_fold <> 0 and fuelType <> '5-LOW'")
    valid = df.filter("outer_fold = 0 and fuelType <> '1-URGENT'")
    _, wide = encode.align_dummies(train, valid, ["fuelType"])
    cols = [c for c in wide.columns if c.startswith("fuelType_")]
    return wide.agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in cols]).unpivot([], [F.col(f"`{c}`") for c in cols], "column", "ones")


_TE_FIT = """tr AS (SELECT * REPLACE (nullif(model, 'SMALL') AS model) FROM folded WHERE outer_fold <> 0),
g AS (SELECT avg(y_log) AS g FROM tr),
enc AS (SELECT c, level, n, (greatest(n, 3) * m + 10.0 * g) / (greatest(n, 3) + 10.0) AS e FROM (
  SELECT 'brand' AS c, brand AS level, count(*) AS n, avg(y_log) AS m FROM tr GROUP BY brand
  UNION ALL SELECT 'model', model, count(*), avg(y_log) FROM tr WHERE model IS NOT NULL GROUP BY model), g)"""


@query(
    "e3_target_encoding_fit",
    f"""WITH {fx.FOLDED}, {_TE_FIT} SELECT c AS "column", level, n, round(e, 9) AS encoding FROM enc""",
)
def e3(spark, sf_dir):
    train, _ = _held_out(spark, sf_dir)
    return rounded(encode.target_encoding(train, ["brand", "model"], "y_log", min_leaf=3), "encoding", digits=9)


@query(
    "e4_target_encoding_apply",
    f"""WITH {fx.FOLDED}, {_TE_FIT}, va AS (SELECT * REPLACE (nullif(model, 'SMALL') AS model) FROM folded WHERE outer_fold = 0)
SELECT row_key, round(coalesce(b.e, g), 9) AS brand__te, round(coalesce(m.e, g), 9) AS model__te
FROM va CROSS JOIN g LEFT JOIN enc b ON b.c = 'brand' AND b.level = brand LEFT JOIN enc m ON m.c = 'model' AND m.level = model""",
)
def e4(spark, sf_dir):
    train, held = _held_out(spark, sf_dir)
    table_ = cut_lineage(encode.target_encoding(train, ["brand", "model"], "y_log", min_leaf=3, with_overall=True))
    overall = table_.first()["overall"]
    out = encode.apply_target_encoding(held, table_, overall, ["brand", "model"])
    return rounded(out, "brand__te", "model__te", digits=9).select("row_key", "brand__te", "model__te")


@query(
    "e5_out_of_fold_encoding",
    f"""WITH {fx.PREDICTIONS} SELECT outer_fold, brand, count(*) AS n, round(min(ln(y_pred)), 9) AS brand__te FROM predictions
GROUP BY outer_fold, brand""",
)
def e5(spark, sf_dir):
    out = encode.out_of_fold_encoding(fx.folded(spark, sf_dir), ["brand"], "y_log", "outer_fold")
    return out.groupBy("outer_fold", "brand").agg(F.count(F.lit(1)).alias("n"), rd(F.min("brand__te"), 9).alias("brand__te"))


@query(
    "e6_yeo_johnson",
    f"""WITH {fx.LISTINGS}, x AS (SELECT mileage - 20000 AS a, mpg - 25 AS b FROM listings), t AS (
 SELECT CASE WHEN a >= 0 THEN (pow(a + 1, 0.3) - 1) / 0.3 ELSE -(pow(1 - a, 1.7) - 1) / 1.7 END AS a3,
        CASE WHEN b >= 0 THEN ln(b + 1) ELSE -(pow(1 - b, 2.0) - 1) / 2.0 END AS b0,
        CASE WHEN b >= 0 THEN (pow(b + 1, 2.0) - 1) / 2.0 ELSE -ln(1 - b) END AS b2 FROM x)
SELECT count(*) AS n, round(avg(a3), 2) AS a3_mean, round(min(a3), 3) AS a3_min, round(max(a3), 6) AS a3_max,
 round(avg(b0), 6) AS b0_mean, round(avg(b2), 6) AS b2_mean, round(stddev_pop(b2), 6) AS b2_std FROM t""",
)
def e6(spark, sf_dir):
    df = fx.listings(spark, sf_dir).select((F.col("mileage") - 20000).alias("a"), (F.col("mpg") - 25).alias("b"))
    t = df.select(
        numeric.yeo_johnson("a", 0.3).alias("a3"), numeric.yeo_johnson("b", 0.0).alias("b0"), numeric.yeo_johnson("b", 2.0).alias("b2")
    )
    return t.agg(
        F.count(F.lit(1)).alias("n"), rd(F.avg("a3"), 2).alias("a3_mean"), rd(F.min("a3"), 3).alias("a3_min"),
        rd(F.max("a3")).alias("a3_max"), rd(F.avg("b0")).alias("b0_mean"), rd(F.avg("b2")).alias("b2_mean"),
        rd(F.stddev_pop("b2")).alias("b2_std"),
    )


@query("e6_power_fit")
def e6_fit(spark, sf_dir):
    """Maximum-likelihood lambdas with the moments of the transformed columns."""
    fit = numeric.fit_power(fx.stored_folded(spark, sf_dir), ["mileage", "mpg", "engineSize", "tax"])
    return fit.table(spark)


@query("e7_dropped_columns", "SELECT 'flat' AS \"column\", 'ZeroVariance' AS reason")
def e7(spark, sf_dir):
    fit = numeric.fit_power(fx.listings(spark, sf_dir).withColumn("flat", F.lit(1.5)), ["year", "flat", "mpg"])
    return spark.createDataFrame(sorted(fit.dropped.items()), "column string, reason string")


@query("e8_quantile_normal")
def e8(spark, sf_dir):
    df = fx.listings(spark, sf_dir)
    fit = numeric.fit_quantiles(df, ["mileage", "mpg"])
    out = numeric.quantile_normal(numeric.quantile_normal(df, "mileage", fit, "zm"), "mpg", fit, "zg")
    return out.agg(
        F.count("zm").alias("n"), F.avg("zm").alias("mileage_mean"), F.stddev_pop("zm").alias("mileage_std"),
        F.min("zm").alias("mileage_min"), F.max("zm").alias("mileage_max"), F.avg("zg").alias("mpg_mean"),
    )


@query(
    "e9_standard_scale",
    f"""WITH {fx.LISTINGS}, s AS (SELECT avg(mileage) AS a, stddev_pop(mileage) AS b, avg(mpg) AS c, stddev_pop(mpg) AS d FROM listings)
SELECT row_key, round((mileage - a) / b, 8) + 0.0 AS mileage_z, round((mpg - c) / d, 8) + 0.0 AS mpg_z FROM listings, s""",
)
def e9(spark, sf_dir):
    df = fx.listings(spark, sf_dir)
    fit = numeric.standard_scale_fit(df, ["mileage", "mpg"])
    return df.select(
        "row_key", *[rd(F.expr(numeric.standard_scale_sql(c, fit[c])), 8).alias(f"{c}_z") for c in ("mileage", "mpg")]
    )


def _scaled(spark, sf_dir):
    """Standardised numerics, two noise columns and the log target."""
    from plumbline.functions.keys import seeded_uniform

    df = fx.stored_folded(spark, sf_dir)
    cols = list(fx.NUMERIC)
    fit = numeric.standard_scale_fit(df, cols)
    noise = {f"noise{i}": seeded_uniform("row_key", 900 + i) - 0.5 for i in range(2)}
    return df.withColumns({c: F.expr(numeric.standard_scale_sql(c, fit[c])) for c in cols} | noise), [*cols, *noise]


@query("e10_lasso_selection")
def e10(spark, sf_dir):
    df, cols = _scaled(spark, sf_dir)
    s = select.select_lasso(folds.with_folds(df, "row_key", 10, 7, "cv"), cols, "y_log", "cv")
    rows = list(zip(s.features, s.mask, s.coefficients))
    return spark.createDataFrame([(f, bool(m), float(c), s.alpha) for f, m, c in rows], "feature string, selected boolean, coef double, alpha double")


@query("e11_genetic_selection")
def e11(spark, sf_dir):
    df, cols = _scaled(spark, sf_dir)
    s = select.select_genetic(folds.with_holdout(df, "row_key"), cols, "y_log", "is_valid")
    rows = list(zip(s.features, s.mask, s.coefficients))
    return spark.createDataFrame([(f, bool(m), float(c)) for f, m, c in rows], "feature string, selected boolean, coef double")


@query(
    "e12_raw_pass_through",
    f"""WITH {fx.LISTINGS}, code AS (SELECT model, dense_rank() OVER (ORDER BY model) - 1 AS c FROM (SELECT DISTINCT model FROM listings))
SELECT row_key, mileage, mpg, CAST(c AS DOUBLE) AS model_code FROM listings JOIN code USING (model)""",
)
def e12(spark, sf_dir):
    """Raw policy: numbers unchanged and levels as plain codes in level order."""
    from pyspark.ml.functions import vector_to_array

    roles = fx.Roles("price", ("mileage", "mpg"), ("model",))
    df = fx.folded(spark, sf_dir)
    feats = assembly.fit_features(df, roles, assembly.Policy("raw"), "y_log", "row_key")
    v = vector_to_array("features")
    return feats.transform(df).select("row_key", v[0].alias("mileage"), v[1].alias("mpg"), v[2].alias("model_code"))


@query("e13_policy_pipeline")
def e13(spark, sf_dir):
    """Two policies end to end: mean of every assembled feature over the held-out fold."""
    from pyspark.ml.functions import vector_to_array

    df = fx.stored_folded(spark, sf_dir)
    train, held = df.filter("outer_fold <> 0"), df.filter("outer_fold = 0")
    roles = fx.Roles("price", ("mileage", "mpg", "tax"), ("brand", "fuelType"))
    out = None
    for name in ("RandomForest", "LinearRegression"):
        feats = assembly.fit_features(train, roles, assembly.policy_for(name), "y_log", "row_key")
        names = F.array(*[F.lit(n) for n in feats.feature_names])
        part = (
            feats.transform(held)
            .select(F.posexplode(vector_to_array("features")).alias("i", "v"))
            .groupBy("i")
            .agg(F.avg("v").alias("mean"), F.count("v").alias("n"))
            .select(F.lit(name).alias("policy"), F.element_at(names, F.col("i") + 1).alias("feature"), "mean", "n")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("e14_selection_stability")
def e14(spark, sf_dir):
    """Selection per outer fold, then how often each feature was chosen."""
    from plumbline.plans.experiment import selection_frequency

    df, cols = _scaled(spark, sf_dir)
    rows = []
    for fold in range(fx.FOLDS):
        part = folds.with_folds(df.filter(F.col("outer_fold") != fold), "row_key", 10, 7 + fold, "cv")
        s = select.select_lasso(part, cols, "y_log", "cv")
        rows += [("LinearRegression", fold, f, bool(m), float(c)) for f, m, c in zip(s.features, s.mask, s.coefficients)]
    return selection_frequency(
        spark.createDataFrame(rows, "model string, outer_fold int, feature string, selected boolean, coef double")
    )


# ---- row partitioning ------------------------------------------------------------------


@query("f1_kfold", f"WITH {fx.FOLDED} SELECT row_key, outer_fold FROM folded")
def f1(spark, sf_dir):
    return fx.folded(spark, sf_dir).select("row_key", "outer_fold")


@query(
    "f1_exact_kfold",
    f"""WITH {fx.LISTINGS} SELECT row_key, CAST((row_number() OVER (ORDER BY md5(concat_ws('|', row_key, '42')) || row_key) - 1) % 5
AS INTEGER) AS outer_fold FROM listings""",
)
def f1_exact(spark, sf_dir):
    """Fold sizes that differ by at most one."""
    keys = cut_lineage(fx.listings(spark, sf_dir, even=True).select("row_key"))  # written: read again for the join
    return folds.with_exact_folds(keys, "row_key", 5, 42).select("row_key", "outer_fold")


@query(
    "f2_nested_folds",
    f"""WITH {fx.FOLDED}, o AS (SELECT CAST(range AS INTEGER) AS split FROM range(3)),
n AS (SELECT row_key, CAST({hash_sql('row_key', 42)} % 3 AS INTEGER) AS outer_fold FROM listings)
SELECT split, outer_fold, CASE WHEN outer_fold <> split THEN
 CAST(CAST('0x' || substr(md5(concat_ws('|', row_key, CAST(43 + split AS VARCHAR))), 1, 8) AS BIGINT) % 2 AS INTEGER) END AS inner_fold,
 count(*) AS n FROM n, o GROUP BY 1, 2, 3""",
)
def f2(spark, sf_dir):
    df = folds.nested_folds(fx.listings(spark, sf_dir), "row_key", 3, 2, 42)
    long = df.select("outer_fold", F.posexplode("inner_folds").alias("split", "inner_fold"))
    return long.groupBy("split", "outer_fold", "inner_fold").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f3_holdout",
    f"""WITH {fx.LISTINGS} SELECT {hash_sql('row_key', 42)} / 4294967296.0 < 0.25 AS is_valid, count(*) AS n,
round(sum(mpg), 2) AS mpg FROM listings GROUP BY 1""",
)
def f3(spark, sf_dir):
    df = folds.with_holdout(fx.listings(spark, sf_dir), "row_key", 0.25, 42)
    return df.groupBy("is_valid").agg(F.count(F.lit(1)).alias("n"), rd(F.sum("mpg"), 2).alias("mpg"))


@query(
    "f4_sample",
    f"""WITH {fx.FOLDED}, r AS (SELECT row_key, outer_fold, row_number() OVER (PARTITION BY outer_fold
ORDER BY {hash_sql('row_key', 5)}, row_key) AS k FROM folded)
SELECT outer_fold, row_key, CAST(k AS INTEGER) AS sample_rank FROM r WHERE k <= 120""",
)
def f4(spark, sf_dir):
    df = fx.folded(spark, sf_dir).select("outer_fold", "row_key")
    return folds.sample_per_group(df, ["outer_fold"], "row_key", 120, 5)


@query(
    "f4_sample_rows",
    f"""WITH {fx.LISTINGS} SELECT row_key, price FROM listings ORDER BY {hash_sql('row_key', 5)}, row_key LIMIT 200""",
)
def f4_rows(spark, sf_dir):
    return folds.sample_rows(fx.listings(spark, sf_dir).select("row_key", "price"), "row_key", 200, 5)


@query(
    "f5_evenly_spaced",
    f"""WITH {fx.LISTINGS}, s AS (SELECT row_key FROM listings ORDER BY {hash_sql('row_key', 5)}, row_key LIMIT 200),
p AS (SELECT row_key, row_number() OVER (ORDER BY row_key) - 1 AS i FROM s)
SELECT row_key, CAST(i AS INTEGER) AS instance_index FROM p
WHERE i IN (SELECT CAST(floor(range * 199.0 / 6) AS BIGINT) FROM range(7))""",
)
def f5(spark, sf_dir):
    sample = folds.sample_rows(fx.listings(spark, sf_dir).select("row_key"), "row_key", 200, 5)
    return folds.evenly_spaced(sample, ["row_key"], 7)


@query(
    "g6_balanced_weights",
    f"""WITH {fx.LISTINGS}, c AS (SELECT engineSize, count(*) AS n FROM listings GROUP BY 1),
k AS (SELECT sum(n) AS n, count(*) AS k FROM c)
SELECT engineSize, c.n AS rows, round(k.n / (k.k * c.n), 9) AS weight FROM c, k""",
)
def g6(spark, sf_dir):
    df = encode.balanced_weights(fx.listings(spark, sf_dir), "engineSize")
    return df.groupBy("engineSize").agg(F.count(F.lit(1)).alias("rows"), rd(F.max("weight"), 9).alias("weight"))
