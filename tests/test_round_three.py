"""Steps that read their rows many times read written rows, and give the same results."""

import numpy as np
import pytest
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from plumbline.functions import keys
from plumbline.operators import explain, folds, trials
from plumbline.operators import models as ops
from plumbline.plans import experiment as ex
from plumbline.plans.queries import explanation, models, properties, tables
from plumbline.plans import fixtures as fx


def _star(spark, path, n=60):
    """A small star of rows of its own."""
    i = F.col("id")
    price = (i * 37 % 1000).cast("double") + 500.0
    spark.range(n).select(
        (i % 20).alias("l_orderkey"), (i % 7).alias("l_partkey"), (i % 3).alias("l_suppkey"), i.cast("int").alias("l_linenumber"),
        (i % 50 + 1).cast("double").alias("l_quantity"), price.alias("l_extendedprice"), F.lit(0.05).alias("l_discount"),
        (i % 9 / 100).alias("l_tax"), F.lit("N").alias("l_returnflag"),
    ).write.parquet(f"{path}/lineitem.parquet")
    spark.range(20).select(
        i.alias("o_orderkey"), F.lit("1995-01-01").cast("timestamp").alias("o_orderdate"), F.lit("5-LOW").alias("o_orderpriority")
    ).write.parquet(f"{path}/orders.parquet")
    spark.range(7).select(
        i.alias("p_partkey"), F.concat(F.lit("Brand#"), (i % 2).cast("string")).alias("p_brand"), F.lit("SMALL").alias("p_type"), i.cast("int").alias("p_size")
    ).write.parquet(f"{path}/part.parquet")
    return str(path)


def _sources(df):
    return {f.rsplit("/", 2)[-2] for f in df.inputFiles()}


def test_predictions_are_read_from_written_rows(spark, tmp_path):
    out = fx.predictions(spark, _star(spark, tmp_path))
    assert not any(s in ("lineitem.parquet", "orders.parquet") for s in _sources(out))
    assert out.count() == 60 and out.columns == ["outer_fold", "row_key", "brand", "y_true", "y_pred"]


def test_a_stack_is_fitted_on_written_rows(spark, tmp_path, monkeypatch):
    seen = []
    plain = models.models.Stacked.fit
    monkeypatch.setattr(models.models.Stacked, "fit", lambda self, df, *a, **k: (seen.append(df), plain(self, df, *a, **k))[1])
    models.g13(spark, _star(spark, tmp_path)).collect()
    assert seen and not any("lineitem.parquet" in _sources(df) for df in seen)


def test_a_power_fit_reads_written_rows(spark, tmp_path, monkeypatch):
    from plumbline.operators import numeric

    seen = []
    plain = numeric.fit_power
    monkeypatch.setattr(numeric, "fit_power", lambda df, cols: (seen.append(df), plain(df, cols))[1])
    tables.a7(spark, _star(spark, tmp_path)).collect()
    assert len(seen) == 2 and not any("lineitem.parquet" in _sources(df) for df in seen)


def test_an_experiment_refits_on_the_rows_its_run_wrote(spark, tmp_path):
    star = _star(spark, tmp_path / "star")
    df = fx.listings(spark, star).select("row_key", "price", "mileage", "mpg", "brand")
    e = ex.Experiment(df, "price", models._config(n_trials=1), ["DecisionTree"], models._SPACE, {"DecisionTree": models._POLICY})
    e.run()
    assert "lineitem.parquet" not in _sources(e.outcome.rows) and e.outcome.rows.count() == 60
    assert not any("lineitem.parquet" in _sources(entry.rows) for entry in e.outcome.entries)


def test_exact_folds_with_repeated_and_missing_keys(spark):
    keys = ["a", "b", "b", None, "c", "d", None, "b", "e"]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int")
    got = {r["i"]: r["outer_fold"] for r in folds.with_exact_folds(df, "k", 4).collect()}
    import hashlib

    def order(k):
        return "" if k is None else hashlib.md5(f"{k}|42".encode()).hexdigest() + k

    # missing keys come first and drop out; equal keys share their first position
    assert got == {i: sum(order(o) < order(k) for o in keys) % 4 for i, k in enumerate(keys) if k is not None}


def test_exact_folds_write_the_digest_of_no_row(spark, monkeypatch):
    written = []
    plain = folds.cut_lineage
    monkeypatch.setattr(folds, "cut_lineage", lambda df: (written.append(df.columns), plain(df))[1])
    out = folds.with_exact_folds(spark.range(1000).select(F.col("id").cast("string").alias("k")), "k", 5)
    assert {r["count"] for r in out.groupBy("outer_fold").count().collect()} == {200}
    assert written and not any("__h" in cols for cols in written)


def test_held_out_rows_of_fold_models_are_written(spark, tmp_path):
    star = _star(spark, tmp_path, 400)
    entries = explanation._fold_entries(spark, star, "DecisionTree", {"max_depth": 2}, "tree")
    # a fold's rows are one written table: nothing is left to encode or filter
    assert all("Join" not in e.rows._jdf.queryExecution().optimizedPlan().toString() for e in entries)
    assert sum(e.rows.count() for e in entries) == 400


def test_replacing_a_feature_leaves_the_others(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>")
    for j in range(3):
        got = df.withColumn("c", F.struct(F.lit(j).alias("fidx"), F.lit(9.0).alias("gval"))).select(explain._replaced().alias("r"))
        assert got.first()[0] == [9.0 if i == j else v for i, v in enumerate([1.0, 2.0, 3.0])]
        assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_checked_values_tell_a_wrong_walk(spark):
    class Fitted:
        def predict(self, df, out):
            return df.withColumn(out, F.lit(3.0))

    rows = spark.createDataFrame([("a",), ("b",)], "row_key string")
    e = explain.Entry("m", "m", 0, Fitted(), rows, ["f", "g"])
    exact = spark.createDataFrame([(k, f, v) for k in "ab" for f, v in (("f", 1.0), ("g", 2.0))], "row_key string, feature string, phi double")
    for walk, same in ((1.0, True), (1.5, False)):
        walked = spark.createDataFrame([("a", "f", walk)], "row_key string, feature string, phi double")
        assert properties._checked_values(e, exact, walked).first().asDict() == {"n": 2, "additive": True, "same_as_walks": same}


def test_residual_fits_are_given_narrow_rows(spark, tmp_path, monkeypatch):
    seen = []
    plain = properties.cut_lineage
    monkeypatch.setattr(properties, "cut_lineage", lambda df: (seen.append(df.columns), plain(df))[1])
    monkeypatch.setattr(properties.models, "build_model", lambda *a, **k: (_ for _ in ()).throw(StopIteration))
    try:
        properties.g8_to_g12(spark, _star(spark, tmp_path))
    except StopIteration:
        pass
    assert seen == [["row_key", "outer_fold", "features", "y"]]


@pytest.mark.parametrize("ties", [True, False])
def test_median_pruning_by_blocks_against_brute_force(spark, ties):
    """Blocks far shorter than the study; open trials, one without a loss and NaN among them."""
    rng = np.random.default_rng(7)
    rows = []
    for t in range(150):
        for step in (1, 2, 3):
            loss = float(rng.integers(0, 4)) if ties else float(rng.normal() - t / 100)
            rows.append(("a" if t % 5 else None, t, step, None if t == 31 else float("nan") if t == 47 else loss, bool(rng.random() < 0.7)))
    df = spark.createDataFrame(rows, "study_name string, trial_number int, step int, loss double, done boolean")
    want = trials.median_pruning(df, complete="done", startup=4).collect()
    for block in (1, 4, 16):
        assert sorted(map(str, trials.median_pruning(df, complete="done", startup=4, block=block).collect())) == sorted(map(str, want))
    order = lambda v: (0, 0.0) if v is None else (2, 0.0) if v != v else (1, v)
    for r in want:
        mine = [x for x in rows if x[0] == r["study_name"]]
        seen = sorted((v for _, t, k, v, done in mine if k == r["step"] and t < r["trial_number"] and done), key=order)
        own = [v for _, t, k, v, _ in mine if t == r["trial_number"] and k <= r["step"] and v is not None]
        assert r["earlier_trials"] == len(seen)
        if own and None not in seen[len(seen) // 2 - 1 :] and len(seen) >= 4 and r["step"] > 1:
            best, n = min(own, key=order), len(seen)
            middle = seen[n // 2] if n % 2 else (seen[n // 2 - 1] + seen[n // 2]) / 2
            assert r["prune"] == (order(best) > order(middle)), r
        else:
            assert not r["prune"]


def test_a_blocks_rows_stay_few(spark):
    """What a block fetches does not grow with the trials before it."""
    n, block = 4000, 100
    df = spark.range(n).select(F.lit("a").alias("s"), F.lit(1).alias("step"), (F.xxhash64("id") / 1e9).alias("loss"), F.lit(True).alias("__done"), F.floor(F.col("id") / block).alias("__blk"))
    blocks = df.groupBy("s", "step", "__blk").agg((F.first("__blk") * block).alias("__n0"))
    got = trials._stretches(df, blocks, ["s", "step"], n // block, block).groupBy("__blk").agg(F.sum("__cnt").alias("n")).collect()
    assert len(got) == n // block - 1 and max(r["n"] for r in got) <= 4 * block


def test_parameter_cells_are_written_once(spark, tmp_path):
    log = spark.range(40).select(
        *[F.lit("m").alias(c) for c in trials.GROUP], F.lit("COMPLETE").alias("state"), (F.col("id") % 9).cast("double").alias("value"),
        (F.col("id") % 2).cast("string").alias("param__u"),
    )
    log.write.parquet(f"{tmp_path}/log.parquet")
    cells = trials.parameter_cells(spark.read.parquet(f"{tmp_path}/log.parquet"))
    assert "log.parquet" not in _sources(cells) and cells.agg(F.sum("cnt")).first()[0] == 40


def test_memberships_are_computed_once_for_each_row(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.dense([1.0, 2.0]),), (Vectors.dense([3.0, 0.0]),)], ["features"])
    fitted = models.models.FuzzyFitted([[0.0, 0.0], [4.0, 1.0], [2.0, 2.0]], 2.0)
    out = fitted.with_memberships(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sqrt(") <= 3  # one for each rule
    for r in out.collect():
        inv = np.array([sum((a - b) ** 2 for a, b in zip(r["__raw"], c)) ** -1.0 for c in fitted.centres])
        assert np.allclose(r["features"].toArray(), inv / inv.sum())


def test_moments_make_no_object_for_each_row(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from plumbline.operators import select

    monkeypatch.setattr(DataFrame, "mapInPandas", None)  # arrays would come as one object for each row
    df = spark.range(30).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") * 2.0).alias("y"))
    got = select.moments_by(df, ["a", "b"], "y", "g")
    rows = np.array([[1.0, i, i % 7, i * 2.0] for i in range(30)])
    for g in (0, 1):
        assert np.allclose(got[g].matrix, rows[g::2].T @ rows[g::2])


def _rows(spark, n=400):
    i = F.col("id")
    x = F.array((i % 20).cast("double"), (i * 7 % 13).cast("double"), (i * 11 % 17 / 4), F.rand(1))
    df = spark.range(n, numPartitions=3).select(F.concat(F.lit("k"), i.cast("string")).alias("row_key"), array_to_vector(x).alias("features"), x.alias("x"))
    return df.select("row_key", "features", (F.col("x")[0] * F.col("x")[1] / 10 + F.col("x")[2]).alias("y"), F.lit("wide").alias("more"))


def test_shares_of_hashes_without_numbers(spark):
    df = spark.range(2000).select(F.when(F.col("id") > 0, F.col("id").cast("string")).alias("k"))
    for share in (-0.5, 0.0, 1e-12, 0.3, 0.8, 1 - 2**-33, 1.0, 2.0):
        same = keys.seeded_below("k", 7, share) == (keys.seeded_uniform("k", 7) < share)
        assert df.filter(same).count() == 2000, share
    one = df.filter("k = '5'").select(keys.seeded_uniform("k", 7)).first()[0]  # a share that a row hits
    assert not df.filter("k = '5'").select(keys.seeded_below("k", 7, one)).first()[0]
    assert df.filter("k = '5'").select(keys.seeded_below("k", 7, one + 2**-32)).first()[0]


@pytest.mark.parametrize("weight", [None, "w"])
def test_bags_are_drawn_once_and_kept_narrow(spark, monkeypatch, weight):
    seen = {}
    plain = ops.MLRegressor.fit

    def fit(self, df, label, weight=None, valid=None):
        seen[len(seen)] = (df.storageLevel.useMemory, sorted(df.columns), df.agg(F.sum("__bag"), F.count("*"), F.min("__bag")).first())
        return plain(self, df, label, weight, valid)

    monkeypatch.setattr(ops.MLRegressor, "fit", fit)
    df = _rows(spark).withColumn("w", F.when(F.col("y") > 3, 2.0).when(F.col("y") > 1, 0.0))
    ops.build_model("Bagging", {"n_estimators": 2, "base": "DecisionTree", "max_samples": 0.8}).fit(df, "y", weight)
    for bag, (kept, columns, found) in seen.items():
        u = keys.seeded_uniform(F.concat_ws("#", "row_key", F.lit(bag)), 42)
        count = sum((F.when(u >= step, 1.0).otherwise(0.0) for step in np.exp(-0.8) * np.cumsum([0.8**k / np.prod(range(1, k + 1)) for k in range(20)])), F.lit(0.0))
        want = df.withColumn("b", count * (F.col(weight) if weight else 1.0)).filter("b > 0").agg(F.sum("b"), F.count("*"), F.min("b")).first()
        assert kept and columns == ["__bag", "features", "y"] and tuple(found) == tuple(want)
    assert len(seen) == 2


def test_a_round_makes_its_rows_once(spark, monkeypatch):
    seen = []
    plain = ops.DecisionTreeRegressor.fit
    monkeypatch.setattr(ops.DecisionTreeRegressor, "fit", lambda self, df: (seen.append((df.storageLevel.useMemory, df.columns)), plain(self, df))[1])
    ops.LeafBoost(n_estimators=2, subsample=0.8, colsample_bytree=0.5, max_depth=2).fit(_rows(spark), "y")
    assert seen == [(True, ["__sub", "__g", "__h", "__z"])] * 2


@pytest.mark.parametrize("depth, share", [(2, 0.5), (5, 1.0)])
def test_steps_by_comparisons_equal_those_by_leaves(spark, depth, share):
    rows = _rows(spark)
    fitted = ops.LeafBoost(n_estimators=4, max_depth=depth, colsample_bytree=share, learning_rate=0.3).fit(rows, "y")
    odd = spark.range(6).select(array_to_vector(F.array(*[F.lit(v) for v in (float("nan"), -0.0, float("inf"), 0.5)])).alias("features"))
    for df in (rows, odd):
        want = df.withColumn("p", F.lit(fitted.start))
        for tree, leaf in zip(fitted.trees, fitted.leaves):
            want = ops.add_leaf_values(want, tree, leaf, "p")
            assert ops.tree_value(tree, leaf, F.col("x")) is not None
        assert [r.p for r in fitted.predict(df, "p").select("p").collect()] == [r.p for r in want.select("p").collect()]
        by_one = df.withColumn("p", F.lit(fitted.start))
        for step in zip(fitted.trees, fitted.leaves):
            by_one = ops.add_steps(by_one, [step], "p")
        assert [r.p for r in by_one.select("p").collect()] == [r.p for r in want.select("p").collect()]


def test_splits_of_levels_go_by_leaves(spark):
    level = StringIndexer(inputCol="l", outputCol="c", stringOrderType="alphabetAsc")
    df = spark.range(300).select(F.concat(F.lit("l"), (F.col("id") % 4).cast("string")).alias("l"), (F.col("id") % 4 * 3 % 5).cast("double").alias("y"))
    df = VectorAssembler(inputCols=["c"], outputCol="features").transform(level.fit(df).transform(df))
    fitted = ops.LeafBoost("squared", n_estimators=12, subsample=1.0, max_depth=3, learning_rate=0.7, reg_lambda=0.0).fit(df, "y")
    assert ops.tree_value(fitted.trees[0], {}, F.col("x")) is None
    assert fitted.predict(df, "p").filter("abs(p - y) > 0.01").count() == 0
