import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import ordering, stats


def test_exact_quantiles_small_groups_nulls_and_ties(spark):
    rows = [("a", 1.0), ("a", 2.0), ("b", 5.0), ("c", 1.0), ("c", 1.0), ("c", 3.0), ("a", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in ordering.exact_quantiles(df, ["g"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).collect()}
    for g, vs in {"a": [1, 2], "b": [5], "c": [1, 1, 3]}.items():
        want = np.percentile(vs, [25, 50, 75])
        assert [got[g]["q1"], got[g]["q2"], got[g]["q3"]] == pytest.approx(list(want))


@pytest.mark.parametrize(("accuracy", "target"), [(50, 50), (200, 10**6), (4, 50)])
def test_exact_quantiles_through_the_bracket(spark, accuracy, target):
    """Groups larger than the sketch accuracy take the bracketed way and stay exact."""
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.lognormal(size=4000), np.full(1500, 1.0)])
    df = spark.createDataFrame([(0, float(v)) for v in values], "g int, v double").repartition(5)
    probs = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p73": 0.731, "p100": 1.0}
    row = ordering.exact_quantiles(df, ["g"], "v", probs, accuracy=accuracy, target=target).first()
    for n, p in probs.items():
        assert row[n] == pytest.approx(np.percentile(values, 100 * p), rel=1e-12)


@pytest.mark.parametrize("target", [50, 10**6])
def test_ordered_counts_against_brute_force(spark, target):
    """With a few values to a task and with all in one."""
    rng = np.random.default_rng(1)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 900), rng.integers(0, 200, 900))]
    df = spark.createDataFrame(rows, "g int, v double")
    for r in ordering.ordered_counts(df, ["g"], "v", neighbours=True, target=target).collect():
        mine = [v for g, v in rows if g == r["g"]]
        assert r["cnt"] == mine.count(r["v"])
        assert r["before"] == sum(v < r["v"] for v in mine)
        assert r["below"] == max((v for v in mine if v < r["v"]), default=None)
        assert r["at_least"] == r["v"]


@pytest.mark.parametrize("target", [50, 10**6])
def test_ordered_counts_null_keys_and_weight_zero(spark, target):
    df = spark.createDataFrame([(None, 1.0, 1), (None, 2.0, 0), (None, 3.0, 1)], "g string, v double, w int")
    got = {r["v"]: r for r in ordering.ordered_counts(df, ["g"], "v", weight=F.col("w"), neighbours=True, target=target).collect()}
    assert got[2.0]["before"] == 1 and got[2.0]["below"] == 1.0 and got[2.0]["at_least"] == 3.0


def test_student_t(spark):
    df = spark.createDataFrame(
        [(12.706204736174698, 1), (4.302652729749464, 2), (2.7764451051977987, 4), (2.570581835636314, 5), (1.9623414611334487, 999), (1.9623391, 1001)],
        "t double, nu int",
    )
    for r in df.select("t", "nu", stats.t_two_sided_p(F.col("t"), F.col("nu")).alias("p"), stats.t_critical(0.95, F.col("nu")).alias("c")).collect():
        assert r["p"] == pytest.approx(0.05, abs=1e-6)
        assert r["c"] == pytest.approx(r["t"], rel=1e-5)


def test_normal_tail_and_quantile(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.959963984540054,), (5.9,), (6.1,), (9.0,)], "z double")
    for r in df.select("z", stats.normal_two_sided_p(F.col("z")).alias("p")).collect():
        assert r["p"] == pytest.approx(math.erfc(r["z"] / math.sqrt(2)), rel=1e-6, abs=1e-15)
    q = spark.createDataFrame([(0.5,), (0.975,), (0.001,), (0.0,)], "p double").select(stats.normal_quantile(F.col("p")).alias("z"))
    assert [r["z"] for r in q.collect()] == pytest.approx([0.0, 1.959964, -3.090232, -5.199338], abs=1e-5)


def _signed_rank(d):
    d = [x for x in d if x != 0]
    mags = sorted(abs(x) for x in d)
    rank = {m: np.mean([i + 1 for i, v in enumerate(mags) if v == m]) for m in mags}
    return sum(rank[abs(x)] for x in d if x > 0), len(d)


def test_signed_rank_exact_against_enumeration(spark):
    from plumbline.operators.compare import paired_p_values

    rng = np.random.default_rng(3)
    groups = {g: [float(x) for x in rng.normal(0.3, 1, n)] for g, n in (("a", 3), ("b", 5), ("c", 9))}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, d double")
    for r in paired_p_values(df, ["g"]).collect():
        w, n = _signed_rank(groups[r["g"]])
        low = min(w, n * (n + 1) / 2 - w)
        hits = sum(sum(i + 1 for i, on in enumerate(m) if on) <= low for m in itertools.product((0, 1), repeat=n))
        assert r["wilcoxon_p"] == pytest.approx(min(1.0, 2 * hits / 2**n))


def test_signed_rank_ties_use_the_normal_approximation(spark):
    from plumbline.operators.compare import paired_p_values

    d = [1.0, 1.0, -1.0, 2.0, 3.0, 3.0, -4.0, 5.0]
    df = spark.createDataFrame([("g", x) for x in d], "g string, d double")
    w, n = _signed_rank(d)
    low, mean = min(w, n * (n + 1) / 2 - w), n * (n + 1) / 4
    ties = (3**3 - 3) + (2**3 - 2)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    want = math.erfc(abs((low - mean) / sd) / math.sqrt(2))
    assert paired_p_values(df, ["g"]).first()["wilcoxon_p"] == pytest.approx(want, rel=1e-9)


def test_no_spread_and_all_zero_differences_give_null(spark):
    from plumbline.operators.compare import paired_p_values

    df = spark.createDataFrame([("same", 1.0), ("same", 1.0), ("zero", 0.0), ("zero", 0.0)], "g string, d double")
    got = {r["g"]: r for r in paired_p_values(df, ["g"]).collect()}
    assert got["same"]["paired_t_p"] is None and got["zero"]["wilcoxon_p"] is None
