"""The ordinal fit on data with known weights, and held-out accuracy."""

import random

import numpy as np
import pytest

from plumbline.llm import toxicity


def test_ordinal_fit_finds_order_and_weights():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 6)) < 0.3
    score = x @ np.array([2.0, 1.5, 0, 0, -1, 0]) + rng.logistic(size=4000)
    grades = (score > 1).astype(int) + (score > 2.5) + (score > 4)
    rows, columns = np.nonzero(x)
    w, theta = toxicity.fit_ordinal(rows, columns, grades, 6, 3)
    assert np.allclose(w, [2, 1.5, 0, 0, -1, 0], atol=0.35) and np.allclose(theta, [1, 2.5, 4], atol=0.35)
    assert (np.diff(theta) > 0).all()


def made(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(40)]
        bad = i % 5 == 0
        for _ in range(rng.randint(1, 6) if bad else 0):
            words[rng.randrange(40)] = rng.choice(["zounds", "zooks!", "ZILCH", f"zarf{rng.choice('abc')}{rng.choice('def')}"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark, documents):
    rows, labels = made(1500, 1)
    odd = [(5000, None), (5001, ""), (None, "zounds zooks zilch"), (5002, "zounds " * 50_000), (5000, "clean words")]
    known = [x for x in labels if x[0] % 3] + [(1, None), (None, 1), (9999, 1), (1, 0)]
    out = toxicity.grade(documents(rows + odd), spark.createDataFrame(known, "doc_id long, toxic int")).collect()
    assert len(out) == len(rows) + len(odd)
    truth = {i: bool(t) for i, t in labels if i % 3 == 0}
    hits = [r["toxic"] == truth[r["doc_id"]] for r in out if r["doc_id"] in truth]
    assert np.mean(hits) > 0.97
    by = {r["doc_id"]: r for r in out}
    assert not by[5001]["toxic"] and by[5002]["toxic"] and by[None]["toxic"]
    for r in out:
        p = r["at_least"]
        assert p == sorted(p, reverse=True) and r["severity"] == pytest.approx(sum(p))
    several = [sum(w.strip("!").lower()[:1] == "z" for w in set(t.split())) for _, t in rows]
    order = {i: by[i]["severity"] for i, _ in rows}
    assert np.mean([order[i] for i, n in enumerate(several) if n >= 4]) > np.mean([order[i] for i, n in enumerate(several) if n == 1])


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1)]])
def test_without_both_kinds_nothing_is_toxic(spark, documents, labels):
    out = toxicity.grade(documents([(1, "a"), (2, None)]), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert [r["toxic"] for r in out.collect()] == [False, False]
    assert toxicity.grade(documents([]), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0
