"""Toxicity grades by cumulative-link ordinal regression on the words of a text and their beginnings.

Grades 0 .. K share one weight for each word or beginning; ordered thresholds tell them apart:
P(grade >= k) = sigmoid(w . x - theta_k). The expected severity is the sum of these probabilities.

The fit uses at most `sample` labelled documents, those with the smallest hashes of their id (all
statistics of the fit are of this sample; near copies in it count once). Labels that only say yes
or no are graded by how many distinct words of a text go with "yes": `CUTS`. Scoring is one pass over
all whole texts, without a shuffle; what is broadcast are the weights of at most `vocabulary` words.

Defined results: a null or empty text scores as a text without known words; a null id stays;
repeated rows are scored each; labels without a value or document are ignored, of several labels for
a document the largest counts; without labels of both kinds nothing is toxic; an empty table gives
an empty table; other columns are not carried.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import hashed_sample, pieces, texts
from plumbline.session import cut_lineage

SAMPLE, VOCABULARY, MIN_DOCS = 10_000, 20_000, 4
#: A flagged text with at least so many distinct telling words has grade 2, 3.
CUTS = (2, 4)
#: A word is telling if so large a share of the sample's texts with it is flagged, in at least so many texts.
TELLING_SHARE, TELLING_DOCS = 0.9, 8
EPOCHS, RATE, L2 = 200, 0.1, 2e-4
WORD = r"[^\W\d_]+"
#: Lengths of the beginnings of words that are features beside the words: stems that are compounded.
BEGINNINGS = (4, 5, 6, 7)


def words(text: str) -> set[str]:
    return set(re.findall(WORD, text.lower()))


def features(found: set[str] | list[str]) -> set[str]:
    """The words and their beginnings, which end in a star."""
    out = set(found)
    for k in BEGINNINGS:
        out.update([w[:k] + "*" for w in found if len(w) >= k])
    return out


@dataclass(frozen=True)
class OrdinalModel:
    """Weights of words and the thresholds of the grades 1 .. K, in rising order."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def probabilities(self, found: set[str]) -> list[float]:
        """P(grade >= k) for k = 1 .. K."""
        score = sum(map(self.weights.get, features(found) & self.weights.keys()))
        return [1 / (1 + np.exp(-np.clip(score - t, -500, 500))) for t in self.thresholds]


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, size: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood with an L2 penalty, by Adam. rows, columns: the places of ones in the features.

    The thresholds are a first one plus exponentials, so their order can't break.
    """
    n = len(grades)
    share = np.array([np.clip((grades >= k).mean(), 1e-3, 1 - 1e-3) for k in range(1, top + 1)])
    start = np.maximum.accumulate(np.log((1 - share) / share) + 1e-3 * np.arange(top))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    w = np.zeros(size)
    m, v = np.zeros(size + top), np.zeros(size + top)
    for step in range(1, EPOCHS + 1):
        gaps = np.exp(free[1:])
        theta = free[0] + np.concatenate([[0], np.cumsum(gaps)])
        eta = np.bincount(rows, w[columns], n)
        away = np.clip(theta[None, :] - eta[:, None], -500, 500)
        upper = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(away)), np.zeros((n, 1))], axis=1)
        slope = upper * (1 - upper)
        at = np.arange(n)
        p = np.maximum(upper[at, grades] - upper[at, grades + 1], 1e-9)
        d_eta = -(slope[at, grades] - slope[at, grades + 1]) / p / n
        d_theta = np.array([(((grades == k) * slope[:, k] - (grades == k - 1) * slope[:, k]) / p).sum() / n for k in range(1, top + 1)])
        tail = np.cumsum(d_theta[::-1])[::-1]
        grad = np.concatenate([np.bincount(columns, d_eta[rows], size) + L2 * w, tail[:1], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, free = w - move[:size], free - move[size:]
    return w, free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))])


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, sample: int) -> DataFrame:
    """(toxic, word list) of the labelled sample, one row for texts that share two minima of word hashes."""
    chosen = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    chosen = hashed_sample(chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), sample, "doc_id")

    def run(batches):
        for whole in batches:
            for batch in pieces(whole):
                found = [sorted(words(t)) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.string()))], ["toxic", "words"])

    rows = docs.join(F.broadcast(chosen), "doc_id").select("toxic", "text").mapInArrow(run, "toxic int, words array<string>")
    least = lambda seed: F.array_min(F.transform("words", lambda w: F.xxhash64(F.lit(seed), w)))
    rows = rows.withColumns({"a": least(1), "b": least(2)})
    return cut_lineage(rows.groupBy("a", "b").agg(F.max(F.struct("toxic", "words")).alias("r")).select("r.toxic", "r.words"))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE, vocabulary: int = VOCABULARY
) -> OrdinalModel:
    rows = _sample(docs, labels, id_col, label_col, sample)
    total, flagged = (int(x or 0) for x in rows.agg(F.count("*"), F.sum("toxic")).first())
    if not 0 < flagged < total:
        return OrdinalModel({}, tuple(500.0 for _ in range(len(CUTS) + 1)))

    def spread(batches):
        for batch in batches:
            for part in (batch.slice(k, 200) for k in range(0, batch.num_rows, 200)):
                each = [sorted(features(w)) for w in part.column("words").to_pylist()]
                flags = np.repeat(np.array(part.column("toxic").to_pylist(), np.int32), [len(e) for e in each])
                yield pa.RecordBatch.from_arrays([pa.array(flags), pa.array([f for e in each for f in e], pa.string())], ["toxic", "feature"])

    n, hit = F.count("*").alias("n"), F.sum("toxic").alias("hit")
    counted = rows.mapInArrow(spread, "toxic int, feature string").groupBy("feature").agg(n, hit).filter(F.col("n") >= MIN_DOCS)
    expected = F.col("n") * flagged / total
    surprise = F.abs(F.col("hit") - expected) / F.sqrt(expected * (1 - flagged / total))
    kept = counted.orderBy(surprise.desc(), "feature").limit(vocabulary).collect()
    place = {r["feature"]: i for i, r in enumerate(kept)}
    telling = {r["feature"] for r in kept if r["n"] >= TELLING_DOCS and r["hit"] >= TELLING_SHARE * r["n"]}
    known = docs.sparkSession.sparkContext.broadcast((place, telling))

    def run(batches):
        at, tell = known.value
        for batch in batches:
            found = batch.column("words").to_pylist()
            ids = [[at[f] for f in features(ws) if f in at] for ws in found]
            told = [sum(not features([w]).isdisjoint(tell) for w in ws) for ws in found]
            arrays = [batch.column("toxic"), pa.array(ids, pa.list_(pa.int32())), pa.array(told, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["toxic", "ids", "told"])

    grades, columns, sizes = [], [], []
    for r in rows.mapInArrow(run, "toxic int, ids array<int>, told int").toLocalIterator():
        grades.append(1 + sum(r["told"] >= c for c in CUTS) if r["toxic"] else 0)
        columns.append(np.array(r["ids"], np.int64))
        sizes.append(len(r["ids"]))
    w, theta = fit_ordinal(np.repeat(np.arange(len(sizes)), sizes), np.concatenate(columns), np.array(grades), len(place), len(CUTS) + 1)
    return OrdinalModel({word: float(w[i]) for word, i in place.items() if abs(w[i]) > 1e-3}, tuple(map(float, theta)))


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, severity (expected grade), grade (the likeliest), at_least (P(grade >= k) for k = 1 .. K)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def run(batches):
        m = OrdinalModel(*shared.value)
        for whole in batches:
            for batch in pieces(whole):
                p = [m.probabilities(words(t)) for t in batch.column("text").to_pylist()]
                each = [np.diff([0.0, *(1 - x for x in q), 1.0]) for q in p]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([float(sum(q)) for q in p], pa.float64()),
                        pa.array([int(e.argmax()) for e in each], pa.int32()),
                        pa.array([[float(x) for x in q] for q in p], pa.list_(pa.float64())),
                    ],
                    ["doc_id", "severity", "grade", "at_least"],
                )

    return docs.mapInArrow(run, "doc_id long, severity double, grade int, at_least array<double>")


def grade(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> DataFrame:
    rows = texts(docs, id_col, text_col)
    return score(rows, train(rows, labels, id_col, label_col, **options)).withColumn("toxic", F.col("at_least")[0] >= 0.5)
