"""Feature selection from sufficient statistics.

Rows are read once. Executors reduce them to small cross-product matrices; the searches below
only ever see p x p numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# the matrices must fit the driver: p columns cost (p + 2)**2 numbers per group
MAX_FEATURES = 2_000


@dataclass(frozen=True)
class Moments:
    """Sums of products of (1, x_1..x_p, y) over a set of rows."""

    matrix: np.ndarray

    @property
    def n(self) -> float:
        return self.matrix[0, 0]

    def __add__(self, other: "Moments") -> "Moments":
        return Moments(self.matrix + other.matrix)

    def __sub__(self, other: "Moments") -> "Moments":
        return Moments(self.matrix - other.matrix)

    def centred(self) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, float]:
        """(X'X, X'y, y'y) about the means, then the means of x and y."""
        m, n = self.matrix, self.n
        mean = m[0, 1:] / n
        c = m[1:, 1:] - n * np.outer(mean, mean)
        return c[:-1, :-1], c[:-1, -1], c[-1, -1], mean[:-1], mean[-1]

    def mse(self, w: np.ndarray, intercept: float) -> float:
        v = np.concatenate([[intercept], w, [-1.0]])
        return float(v @ self.matrix @ v / self.n)


Weigh = Callable[[np.ndarray, np.ndarray], np.ndarray]


def moments_by(
    df: DataFrame,
    features: Sequence[str] | str,
    y: str,
    group: str | None = None,
    weigh: Weigh | None = None,
    weight: str | None = None,
) -> dict[int, Moments]:
    """Cross-product sums per integer group (or 0), in one pass.

    ``features`` is a list of columns or the name of one array column. ``weigh`` gives row
    weights from a batch's feature matrix and target, ``weight`` names a column of them. A task gives
    one row for each group, the packed upper triangle, and those are added up in two steps.
    """
    if isinstance(features, str):
        x = [F.col(features).alias("x")]
    else:
        x = [F.array(*[F.col(c).cast("double") for c in features]).alias("x")]
    rows = df.select(
        (F.col(group) if group else F.lit(0)).cast("int").alias("g"), *x, F.col(y).cast("double").alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
    ).filter(F.col("g").isNotNull() & F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull()))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            # the numbers of all arrays lie in one buffer: no object for each row
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            if x.shape[1] > MAX_FEATURES:
                raise ValueError(f"more than {MAX_FEATURES} features")
            data = np.column_stack([np.ones(len(y)), x, y])
            w = batch.column("w").to_numpy(zero_copy_only=False) * (1.0 if weigh is None else weigh(x, y))
            weighted = data * w[:, None]
            g = batch.column("g").to_numpy(zero_copy_only=False)
            for key in np.unique(g):
                at = g == key
                sums[int(key)] = sums.get(int(key), 0.0) + data[at].T @ weighted[at]
        for key, m in sums.items():
            packed = m[np.triu_indices(len(m))].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([packed], pa.binary())], names=["g", "sums"])

    def added(frame: pd.DataFrame) -> bytes:
        total = np.frombuffer(frame["sums"].iloc[0]).copy()
        for s in frame["sums"].iloc[1:]:
            total += np.frombuffer(s)
        return total.tobytes()

    def some(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [key[0]], "sums": [added(frame)]})

    # A task's row is p * p / 2 numbers: groups of tasks are added up apart, then the groups.
    told = rows.mapInArrow(partial, "g int, sums binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    step = told.groupBy("g", "part").applyInPandas(some, "g int, sums binary")
    out = {}
    for r in sorted(step.groupBy("g").applyInPandas(some, "g int, sums binary").collect()):
        packed = np.frombuffer(bytes(r["sums"]))
        side = round(((8 * len(packed) + 1) ** 0.5 - 1) / 2)
        full = np.zeros((side, side))
        full[np.triu_indices(side)] = packed
        out[r["g"]] = Moments(full + np.triu(full, 1).T)
    return out


def ridge(m: Moments, alpha: float) -> tuple[np.ndarray, float]:
    xx, xy, _, mx, my = m.centred()
    w = np.linalg.lstsq(xx + alpha * np.eye(len(xy)), xy, rcond=None)[0]
    return w, float(my - mx @ w)


def lasso(m: Moments, alpha: float, start: np.ndarray | None = None, max_iter: int = 20_000, tol: float = 1e-7) -> np.ndarray:
    """Minimise mean squared error / 2 + alpha * |w|_1 by coordinate descent on X'X."""
    xx, xy, _, _, _ = m.centred()
    xx, xy = xx / m.n, xy / m.n
    w = np.zeros(len(xy)) if start is None else start.copy()
    grad = xy - xx @ w
    for _ in range(max_iter):
        moved = 0.0
        for j in range(len(w)):
            if xx[j, j] <= 0:
                continue
            old = w[j]
            r = grad[j] + xx[j, j] * old
            w[j] = np.sign(r) * max(abs(r) - alpha, 0.0) / xx[j, j]
            if w[j] != old:
                grad -= xx[:, j] * (w[j] - old)
                moved = max(moved, abs(w[j] - old))
        if moved < tol:
            break
    return w


@dataclass(frozen=True)
class Selection:
    features: list[str]
    mask: list[bool]
    coefficients: list[float]
    alpha: float | None = None

    @property
    def kept(self) -> list[str]:
        return [f for f, keep in zip(self.features, self.mask) if keep]


def select_lasso(
    df: DataFrame, features: Sequence[str], y: str, cv_fold: str, alphas: Sequence[float] | None = None
) -> Selection:
    """Cross-validated LASSO; keeps the features whose |coefficient| reaches the median.

    The moments of k-1 folds are the total minus one fold, so all fits share one pass.
    """
    alphas = np.logspace(-4, 1, 50) if alphas is None else np.asarray(alphas, dtype=float)
    parts = moments_by(df, features, y, cv_fold)
    total = Moments(sum(m.matrix for m in parts.values()))
    errors = np.zeros(len(alphas))
    order = np.argsort(alphas)[::-1]
    for held in parts.values():
        train = total - held
        _, _, _, mx, my = train.centred()
        w = None
        for i in order:  # strongest penalty first, each solution starts the next
            w = lasso(train, alphas[i], w)
            errors[i] += held.mse(w, my - mx @ w)
    best = float(alphas[int(np.argmin(errors))])
    coef = lasso(total, best)
    size = np.abs(coef)
    mask = size >= np.median(size)
    return Selection(list(features), mask.tolist(), coef.tolist(), best)


def select_genetic(
    df: DataFrame,
    features: Sequence[str],
    y: str,
    is_valid: str,
    population: int = 24,
    generations: int = 20,
    mutation: float = 0.05,
    crossover: float = 0.8,
    size_penalty: float = 0.01,
    seed: int = 42,
) -> Selection:
    """Evolve a feature subset that minimises validation MSE of a ridge fit plus a size penalty."""
    features = list(features)
    p = len(features)
    keep_all = Selection(features, [True] * p, [float("nan")] * p)
    if p <= 1:
        return keep_all
    parts = moments_by(df, features, y, is_valid)
    if set(parts) != {0, 1} or parts[0].n + parts[1].n < 8:
        return keep_all
    train, valid = parts[0], parts[1]
    rng = np.random.default_rng(seed)
    known: dict[bytes, float] = {}

    def cost(mask: np.ndarray) -> float:
        key = mask.tobytes()
        if key not in known:
            idx = np.flatnonzero(mask) + 1
            cells = np.ix_([0, *idx, p + 1], [0, *idx, p + 1])
            w, b = ridge(Moments(train.matrix[cells]), 1.0)
            known[key] = Moments(valid.matrix[cells]).mse(w, b) + size_penalty * mask.mean()
        return known[key]

    size = max(4, population)
    masks = rng.random((size, p)) < 0.5
    masks[0] = True
    for _ in range(max(1, generations)):
        masks[~masks.any(axis=1), rng.integers(p)] = True  # an empty set is no candidate
        order = np.argsort([cost(m) for m in masks], kind="stable")
        masks = masks[order][:size]
        # Better masks are parents more often; a child takes every feature from either parent.
        chance = np.arange(len(masks), 0, -1) / (len(masks) * (len(masks) + 1) / 2)
        first, second = (masks[rng.choice(len(masks), size, p=chance)] for _ in range(2))
        mixes = (rng.random((size, 1)) < crossover) & (rng.random((size, p)) < 0.5)
        children = np.where(mixes, second, first) ^ (rng.random((size, p)) < mutation)
        masks = np.unique(np.concatenate([masks, children[children.any(axis=1)]]), axis=0)
    best = min(masks, key=cost)
    idx = np.flatnonzero(best) + 1
    w, _ = ridge(Moments(train.matrix[np.ix_([0, *idx, p + 1], [0, *idx, p + 1])]), 1.0)
    coef = np.zeros(p)
    coef[best] = w
    return Selection(features, best.tolist(), coef.tolist())


def quantile_regression(
    df: DataFrame, features: Sequence[str] | str, y: str, q: float = 0.75, alpha: float = 0.001,
    rounds: int = 60, floor: float = 1e-4, tol: float = 1e-5, weight: str | None = None,
) -> tuple[np.ndarray, float]:
    """Pinball-loss linear fit by reweighted least squares; each round is one pass of sums.

    The weight of a row is the pinball slope over |residual|, so the weighted squares equal the
    pinball loss at the fixed point. The penalty is the L1 size, reweighted the same way.
    """
    start = moments_by(df, features, y, weight=weight)[0]
    n = start.n  # rows, or the sum of their weights
    w, b = ridge(start, 0.0)
    # Least squares moved to the quantile of its residuals: from there few rounds are left.
    x = F.col(features) if isinstance(features, str) else F.array(*[F.col(c).cast("double") for c in features])
    line = F.aggregate(F.zip_with(x, F.lit([float(v) for v in w]), lambda a, c: a * c), F.lit(float(b)), lambda a, v: a + v)
    b += float(df.agg(F.percentile_approx(F.col(y).cast("double") - line, q)).first()[0] or 0.0)
    for _ in range(rounds):

        def weigh(x: np.ndarray, t: np.ndarray, w=w, b=b) -> np.ndarray:
            r = t - x @ w - b
            return np.where(r >= 0, q, 1 - q) / np.maximum(np.abs(r), floor)

        m = moments_by(df, features, y, weigh=weigh, weight=weight)[0].matrix
        pull = np.r_[0.0, n * alpha / np.maximum(np.abs(w), 1e-8)]
        new = np.linalg.lstsq(m[:-1, :-1] + np.diag(pull), m[:-1, -1], rcond=None)[0]
        moved = np.max(np.abs(np.r_[b, w] - new))
        b, w = float(new[0]), new[1:]
        if moved < tol * (1 + np.max(np.abs(new))):
            break
    return w, b
