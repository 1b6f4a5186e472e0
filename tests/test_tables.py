import os
import tempfile

import pytest
from pyspark.sql import functions as F

from plumbline.operators import profile, schema
from plumbline.sources import csv_folder, sinks


def test_safe_names_and_collisions():
    got = schema.safe_names(["a b", "a-b", "a__b", "1x", "£", "_t_", "ok"])
    assert list(got.values()) == ["a_b", "a_b_1", "a_b_2", "f_1x", "f", "t", "ok"]


def test_roles_follow_type_and_cardinality(spark):
    rows = [(i, i % 3, float(i), "x", i % 2 == 0, 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "wide long, few int, real double, text string, flag boolean, y double")
    r = schema.infer_roles(df, "y")
    assert r.numeric == ("wide", "real", "flag") and r.categorical == ("few", "text")


def test_twenty_levels_is_categorical_and_nulls_do_not_count(spark):
    df = spark.createDataFrame([(i % 20, i % 21, 1.0) for i in range(200)] + [(None, None, 1.0)], "a int, b int, y double")
    assert schema.infer_roles(df, "y").categorical == ("a",)


def test_coerce_modes(spark):
    df = spark.createDataFrame([("1.5", 3), ("x", 4), (None, 5)], "n string, c int")
    out = schema.coerce_types(df, ["n", "missing"], ["c"])
    assert [r["n"] for r in out.collect()] == [1.5, None, None] and dict(out.dtypes)["c"] == "string"
    with pytest.raises(Exception, match="non-numeric"):
        schema.coerce_types(df, ["n"], errors="raise").collect()


def test_match_one(spark):
    df = spark.createDataFrame([("A",), ("A+x",), ("B+x",), ("C+x",), ("C+y",)], "model string")
    assert schema.match_one(df, "A") == "A" and schema.match_one(df, "B") == "B+x" and schema.match_one(df, "Z") is None
    with pytest.raises(ValueError, match="ambiguous"):
        schema.match_one(df, "C")


def test_duplicate_cells_fail_and_lookup_ignores_case(spark):
    from plumbline.operators import compare

    df = spark.createDataFrame([(1, "A", 1.0), (1, "A", 2.0)], "outer_fold int, model string, MedAE double")
    with pytest.raises(Exception, match="duplicate cell"):
        compare.to_long(df, ["medae"]).collect()


def test_small_results_table(spark):
    """Two models on three folds; single-fold models get zero-width intervals."""
    from plumbline.operators import compare

    rows = [(f, m, v) for m, vs in {"A": [3.0, 4.0, 5.0], "B": [2.0, 3.0, 3.5]}.items() for f, v in enumerate(vs)]
    df = spark.createDataFrame([*rows, (0, "One", 1.0)], "outer_fold int, model string, MAE double")
    s = {r["model"]: r for r in compare.metric_summary(df).collect()}
    assert s["A"]["n"] == 3 and s["A"]["mean"] == 4.0 and s["A"]["ci_half_width"] == pytest.approx(4.302652729749464 / 3**0.5)
    assert s["One"]["std"] == 0.0 and s["One"]["ci_low"] == s["One"]["ci_high"] == 1.0
    d = {r["model"]: r for r in compare.baseline_delta(df, baseline="A").collect()}
    assert d["B"]["delta_mean"] == pytest.approx(7 / 6) and d["One"]["n"] == 1
    assert compare.best_model(df, "mae").first()["best_model"] == "One"
    with pytest.raises(ValueError):
        compare.baseline_delta(df, baseline="Q")
    batch = compare.comparison_batch(df, ["MAE"], "Q").collect()
    assert all(r["delta_mean"] is None for r in batch)


def test_text_format_has_thousands_separators(spark):
    from plumbline.operators import compare

    df = spark.createDataFrame([(1, "A", 12345.678), (2, "A", 12345.678)], "outer_fold int, model string, MSE double")
    assert compare.summarize_mean_std(df, 2, as_text=True).first()["MSE_mean"] == "12,345.68"


def test_profile_counts_null_levels_and_pairwise_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), (None, None, 3.0), (None, 3.0, 6.0), ("b", 4.0, 8.0)], "c string, x double, y double")
    top = [(r["level"], r["count"]) for r in profile.top_levels(df, ["c"]).orderBy("rank").collect()]
    assert top[0] == (None, 2)
    assert {r["column"]: r["missing_count"] for r in profile.missing_counts(df).collect()} == {"c": 2, "x": 1}
    corr = {(r["col_a"], r["col_b"]): r["corr"] for r in profile.correlation_matrix(df, ["x", "y"]).collect()}
    assert corr[("x", "y")] == pytest.approx(1.0) and len(corr) == 4


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_csv_folder(spark):
    root = tempfile.mkdtemp(prefix="plumbline-csv-")
    _write(f"{root}/a.csv", " model,price,tax(£)\n Fiesta,100,5\n")
    _write(f"{root}/sub/b.csv", "price,model,mpg\n200,Golf,50.5\n300,Polo,\n")
    _write(f"{root}/cars.csv", "price\n999\n")
    cfg = csv_folder.CsvFolder(root, exclude=("cars.csv",))
    df = csv_folder.read_csv_folder(spark, cfg)
    assert set(df.columns) == {"model", "price", "tax", "mpg", "_source_file"}
    got = {r["price"]: r for r in df.collect()}
    assert got[100]["model"] == " Fiesta" and got[100]["tax"] == 5 and got[100]["mpg"] is None
    assert got[200]["_source_file"] == f"{root}/sub/b.csv"
    flat = csv_folder.read_csv_folder(spark, csv_folder.CsvFolder(root, recursive=False, exclude=("cars.csv",)))
    assert flat.count() == 1
    with pytest.raises(FileNotFoundError):
        csv_folder.read_csv_folder(spark, csv_folder.CsvFolder(root, pattern="*.tsv"))


def test_csv_folder_separator_encoding_and_schema(spark):
    from pyspark.sql import types as T

    root = tempfile.mkdtemp(prefix="plumbline-csv-")
    with open(f"{root}/x.csv", "wb") as f:
        f.write("Preis;tax(£)\n7;é\n".encode("latin-1"))
    schema_ = T.StructType([T.StructField("preis", T.LongType())])
    cfg = csv_folder.CsvFolder(root, sep=";", encoding="ISO-8859-1", lower_names=True, schema=schema_, add_source=False)
    row = csv_folder.read_csv_folder(spark, cfg).first()
    assert row["preis"] == 7 and row["tax"] == "é"


def test_json_merge_keeps_other_keys(spark):
    path = tempfile.mkdtemp(prefix="plumbline-json-") + "/p"
    sinks.write_merged_json(spark, spark.createDataFrame([("a", 1), ("b", 2)], "model string, v int"), path)
    sinks.write_merged_json(spark, spark.createDataFrame([("b", 3), ("c", 4)], "model string, v int"), path)
    got = {r["model"]: r["v"] for r in sinks.read_merged_json(spark, path).collect()}
    assert got == {"a": 1, "b": 3, "c": 4} and sinks.latest_version(spark, path) == 2


def test_dropped_log_appends(spark):
    path = tempfile.mkdtemp(prefix="plumbline-log-") + "/log"
    for fold in (1, 2):
        sinks.append_dropped(spark, path, {"year": "BracketError"}, "run", fold)
    assert sinks.read_dropped(spark, path).filter(F.col("error_type") == "BracketError").count() == 2
