"""Additive models as intervals: what explanations need of trees, forests, boosted trees and their stacks.

A leaf is a product of intervals, one for each feature on its path, and a tree ensemble is a sum of leaf
values over the boxes that hold a row. Together with an offset and linear weights this covers all
models here that are sums of trees and linear parts. The boxes come from the fitted model, which the
driver holds anyway, and reach the workers by broadcast below a checked size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial
from typing import Any

import numpy as np

from plumbline.operators import models as m

#: Numbers in all boxes together that a broadcast may hold (400 MB).
MOST_NUMBERS = 50_000_000


@dataclass(frozen=True)
class Box:
    """A leaf: its value, and the intervals (open below, closed above) of the features on its path."""

    value: float
    features: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def holds(self, x: np.ndarray) -> np.ndarray:
        """For each row and feature of the path, whether the interval holds the row's value."""
        part = x[:, self.features]
        return (part > self.lo) & (part <= self.hi)


@dataclass(frozen=True)
class Additive:
    """offset + weights . x + the value of every box that holds x."""

    offset: float
    weights: np.ndarray
    boxes: tuple[Box, ...]

    def __add__(self, other: Additive) -> Additive:
        return Additive(self.offset + other.offset, self.weights + other.weights, self.boxes + other.boxes)

    def times(self, factor: float) -> Additive:
        boxes = tuple(Box(b.value * factor, b.features, b.lo, b.hi) for b in self.boxes)
        return Additive(self.offset * factor, self.weights * factor, boxes)

    def checked(self) -> Additive:
        size = sum(3 * len(b.features) + 1 for b in self.boxes)
        if size > MOST_NUMBERS:
            raise ValueError(f"the model has {size} numbers in its boxes, more than {MOST_NUMBERS}: explain it by walks")
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = self.offset + x @ self.weights
        for b in self.boxes:
            out = out + b.value * b.holds(x).all(axis=1)
        return out


_LINE = re.compile(r"^( *)(If|Else|Predict:) ?\(?(?:feature (\d+) (<=|>|in|not in) )?([^)]*)\)?$")


def printed_lines(text: str) -> list[tuple[int, str, str | None, str | None, str]]:
    """(indent, If, Else or Predict:, feature, sign, threshold or value) of each line of a printed tree."""
    found = filter(None, map(_LINE.match, text.splitlines()))
    return [(len(f[1]), *f.groups()[1:]) for f in found]


def tree_boxes(text: str, features: list[int] | None = None) -> list[Box]:
    """Leaves of one tree from its printed form, left to right; ``features`` renumbers a slice's."""
    out: list[Box] = []
    path: list[tuple[int, int, bool, float]] = []  # indent, feature, goes left, threshold
    for indent, kind, feature, sign, rest in printed_lines(text):
        path = [p for p in path if p[0] < indent]
        if kind == "Predict:":
            box: dict[int, tuple[float, float]] = {}
            for _, j, left, at in path:
                lo, hi = box.get(j, (-np.inf, np.inf))
                box[j] = (lo, min(hi, at)) if left else (max(lo, at), hi)
            used = sorted(box)
            own = [j if features is None else features[j] for j in used]
            out.append(Box(float(rest), np.array(own, int), np.array([box[j][0] for j in used]), np.array([box[j][1] for j in used])))
        elif sign in ("in", "not in"):
            raise ValueError("only splits of numbers")
        else:
            path.append((indent, int(feature), sign == "<=", float(rest)))
    return out


def _one_tree(model: Any, width: int) -> Additive:
    return Additive(0.0, np.zeros(width), tuple(tree_boxes(model.toDebugString)))


def additive(fitted: Any, width: int) -> Additive | None:
    """The additive form of a fitted model of ``width`` features, or None if it has none."""
    zero = Additive(0.0, np.zeros(width), ())
    if isinstance(fitted, m.LinearFitted):
        return Additive(float(fitted.intercept), np.array(fitted.weights, float), ())
    if isinstance(fitted, m.MLFitted):
        model = fitted.model
        if hasattr(model, "coefficients") and hasattr(model, "intercept"):
            return Additive(float(model.intercept), model.coefficients.toArray(), ())
        if hasattr(model, "treeWeights"):
            shares = list(model.treeWeights)
            if type(model).__name__.startswith("RandomForest"):  # its weights are 1 and it takes the mean
                shares = [1.0 / len(shares)] * len(shares)
            out = zero
            parts = re.split(r"^ *Tree \d+ \(weight [^)]*\):\n", model.toDebugString, flags=re.M)[1:]
            boxes = [Box(b.value * w, b.features, b.lo, b.hi) for w, text in zip(shares, parts) for b in tree_boxes(text)]
            return Additive(out.offset, out.weights, tuple(boxes))
        return _one_tree(model, width) if hasattr(model, "depth") else None
    if isinstance(fitted, m.LeafBoostFitted):
        boxes: list[Box] = []
        for tree, leaf in zip(fitted.trees, fitted.leaves):
            slicer = getattr(tree, "slicer", None)
            inner = tree.tree if slicer is not None else tree
            found = tree_boxes(inner.toDebugString, slicer.getIndices() if slicer is not None else None)
            boxes += [Box(float(leaf.get(i, 0.0)), b.features, b.lo, b.hi) for i, b in enumerate(found)]
        return Additive(float(fitted.start), np.zeros(width), tuple(boxes))
    if isinstance(fitted, (m.MeanFitted, m.BlendFitted, m.StackFitted)):
        if isinstance(fitted, m.StackFitted):
            members, shares = [fitted.base, *fitted.residuals], [1.0] * (1 + len(fitted.residuals))
        else:
            members = fitted.members
            shares = fitted.weights if isinstance(fitted, m.BlendFitted) else [1 / len(members)] * len(members)
        out = zero
        for member, share in zip(members, shares):
            part = additive(member, width)
            if part is None:
                return None
            out = out + part.times(share)
        return out
    return None


# ---- Shapley values against background rows ----------------------------------------------


def _shares(depth: int) -> tuple[np.ndarray, np.ndarray]:
    """What a feature gets of a leaf that is reached if all `a` come from the row and all `b` from the background.

    [a, b] for one of the row's features, and for one of the background's.
    """
    gain, loss = np.zeros((depth + 1, depth + 1)), np.zeros((depth + 1, depth + 1))
    for a in range(depth + 1):
        for b in range(depth + 1 - a):
            if a:
                gain[a, b] = factorial(a - 1) * factorial(b) / factorial(a + b)
            if b:
                loss[a, b] = factorial(a) * factorial(b - 1) / factorial(a + b)
    return gain, loss


class BoxShapley:
    """Shapley values of an additive model: exact, averaged over the background rows.

    For a leaf, a row and a background row are only told apart by which intervals hold their
    values. Equal patterns are counted once, so a batch costs its rows times the length of the
    path, and the distinct patterns that occur, not all that could.
    """

    def __init__(self, model: Additive, background: np.ndarray):
        self.model, self.mean = model, background.mean(axis=0)
        self.expected = float(model.predict(background).mean())
        depth = max((len(b.features) for b in model.boxes), default=0)
        self.gain, self.loss = _shares(depth)
        self.other = []
        for b in model.boxes:
            held, times = np.unique(b.holds(background), axis=0, return_counts=True)
            self.other.append((held, times / len(background)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        phi = self.model.weights * (x - self.mean)
        for box, (theirs, share) in zip(self.model.boxes, self.other):
            if box.value == 0 or not len(box.features):
                continue
            held = box.holds(x)
            code = held @ (1 << np.arange(held.shape[1], dtype=np.int64))
            _, first, place = np.unique(code, return_index=True, return_inverse=True)
            mine = held[first][:, None, :]
            only, lost = mine & ~theirs, ~mine & theirs
            reached = (mine | theirs).all(axis=2) * share
            a, b = only.sum(axis=2), lost.sum(axis=2)
            worth = np.einsum("ij,ijk->ik", self.gain[a, b] * reached, only) - np.einsum("ij,ijk->ik", self.loss[a, b] * reached, lost)
            phi[:, box.features] += box.value * worth[place]
        return phi


# ---- partial dependence -----------------------------------------------------------------


class BoxGrid:
    """Predictions of all rows with one feature set to each value of a grid."""

    def __init__(self, model: Additive, grids: dict[int, list[float]], block: int = 2_000):
        self.model, self.block = model, block
        self.grids = {j: np.array(v) for j, v in grids.items()}
        self.worth = {}
        values = np.array([b.value for b in model.boxes])
        for j, grid in self.grids.items():
            inside = np.ones((len(model.boxes), len(grid)), bool)
            for k, b in enumerate(model.boxes):
                for lo, hi in zip(b.lo[b.features == j], b.hi[b.features == j]):
                    inside[k] = (grid > lo) & (grid <= hi)
            self.worth[j] = values[:, None] * inside

    def __call__(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(feature, rows x grid) for each feature; leaves are taken in blocks, so memory stays bounded."""
        boxes, n = self.model.boxes, len(x)
        linear = self.model.offset + x @ self.model.weights
        out = {j: (linear - self.model.weights[j] * x[:, j])[:, None] + self.model.weights[j] * grid for j, grid in self.grids.items()}
        for start in range(0, len(boxes), self.block):
            some = boxes[start : start + self.block]
            failing = np.zeros((n, len(some)), np.int32)
            alone = np.full((n, len(some)), -1, np.int32)  # the last feature that fails
            for k, b in enumerate(some):
                out_of = ~b.holds(x)
                failing[:, k] = out_of.sum(axis=1)
                if len(b.features):
                    alone[:, k] = b.features[out_of.shape[1] - 1 - out_of[:, ::-1].argmax(axis=1)]
            for j in self.grids:
                reach = (failing == 0) | ((failing == 1) & (alone == j))
                out[j] += reach.astype(float) @ self.worth[j][start : start + self.block]
        yield from out.items()
