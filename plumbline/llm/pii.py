"""Personal data: base patterns, and a skip-chain conditional random field that adds to them.

Nodes of the field are the words that hold a digit or an at sign; all other words are outside by
definition and only serve as context, so the field stays small and exact about them. Labels are
outside, email, ip, card and phone. Neighbouring nodes are joined by chain potentials; nodes whose
words are the same, or hold the same digits, are joined by skip potentials wherever they stand in
the document (each occurrence with the one before: edges grow with the nodes, not their square).
Loopy message passing runs over all documents of a slice at once.

The weights are trained by pseudo-likelihood on the labels that the base patterns give, on a
bounded sample: the TRAIN_DOCS documents with such words and of up to TRAIN_CHARS characters that
have the smallest hashes of their text. Skip potentials are drawn towards agreement, their prior.

Base spans are always kept; the field adds spans that overlap none of them, at a posterior of at
least `confidence`. Matching is anchored so that long runs cost linear time.

Defined results: a null or empty text has no spans; null ids stay; repeated rows get the same spans;
an empty table gives an empty table (and an untrained field adds nothing); the spans go by row, so
other columns pass through untouched. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from plumbline.llm.common import hashed_sample, in_small_batches, pieces

KINDS = ("email", "ip", "card", "phone")
LABELS = ("outside", *KINDS)
TRAIN_DOCS, TRAIN_CHARS, EPOCHS = 2000, 20_000, 60
FEATURES = 1 << 13
ITERATIONS, DAMPING, CONFIDENCE = 8, 0.5, 0.9
AGREEMENT = 1.5

SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("base", BooleanType())])
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_IP = r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)"  # a match starts where its digits start
_CARD = r"[0-9](?:[\x20-]?[0-9])+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_SPACE, _SIGN, _EDGE = r"[\x20\x09-\x0D]", r"[0-9@]", ".,;:!?#$%&*|\"'<>[]{}"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Left of an at sign stands the longest run of local characters, right of it a domain."""
    low, at = 0, text.find("@")
    while at >= 0:
        start, end = at, at + 1
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := re.compile(_DOMAIN).match(text, at + 1)):
            end = m.end()
            yield start, end
        low, at = end, text.find("@", end)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    if re.search(_SIGN, text) is None:
        return []
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in re.finditer(_IP, text) if "." in text else ():
        if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m.groups())):
            out.append(("ip", *m.span()))
    for m in re.finditer(_CARD, text):
        digits = re.sub(r"[\x20-]", "", m.group()) if m.end() - m.start() <= 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(_PHONE, text) if "+" in text else ():
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def nodes(text: str) -> list[tuple[int, int]]:
    """Words that hold a digit or an at sign."""
    out, at, sign, space = [], 0, re.compile(_SIGN), re.compile(_SPACE)
    while m := sign.search(text, at):
        start = 1 + max(at - 1, *(text.rfind(c, at, m.start()) for c in " \t\n\x0b\x0c\r"))
        stop = space.search(text, m.end())
        end = stop.start() if stop else len(text)
        out.append((start, end))
        at = end
    return out


def _shape(word: str) -> str:
    def run(m):
        n = len(m.group())
        return f"9{n if n < 5 else 'm' if n < 8 else 'l' if n < 16 else 'c' if n < 20 else 'x'}"

    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", run, word[:80]))[:24]


def _core(text: str, start: int, end: int) -> tuple[int, int]:
    """Without punctuation around; brackets and plus signs may belong to a number."""
    while start < end - 1 and text[start] in _EDGE:
        start += 1
    while end > start + 1 and text[end - 1] in _EDGE:
        end -= 1
    return start, end


class Graph:
    """Nodes of several texts with their features and edges."""

    def __init__(self):
        self.where: list[tuple[int, int, int]] = []  # text, start, end
        self.features: list[list[int]] = []
        self.label: list[int] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def add(self, number: int, text: str, base: list[Span]) -> None:
        last: dict[str, int] = {}
        before = None
        own = sorted((a, b, k) for k, a, b in base)
        at = 0
        for start, end in nodes(text):
            i = len(self.where)
            a, b = _core(text, start, end)
            word = text[a:b]
            left = text[max(0, start - 40) : start].split()[-1:] or [""]
            right = text[end : end + 40].split()[:1] or [""]
            digits = re.sub(r"[^0-9]", "", word) if b - a <= 200 else ""
            valid = f"v{luhn(digits)}" if 16 <= len(digits) <= 19 else "v"
            names = ("b", valid, "s" + _shape(word), "p" + left[0].lower()[-20:], "n" + right[0].lower()[:20], "l" + _shape(left[0]), "r" + _shape(right[0]), f"@{'@' in word}")
            self.features.append([zlib.crc32(x.encode()) % FEATURES for x in names])
            while at < len(own) and own[at][1] <= start:
                at += 1
            hit = [k for x, y, k in own[at : at + 4] if x < end and y > start]
            self.label.append(LABELS.index(hit[0]) if hit else 0)
            self.where.append((number, a, b))
            if before is not None and start - before[1] <= 3 and not text[before[1] : start].strip():
                self.chain.append((before[0], i))
            for key in {"w" + word.lower(), "d" + digits if len(digits) > 4 else "w" + word.lower()}:
                if key in last:
                    self.skip.append((last[key], i))
                last[key] = i
            before = (i, end)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.array([*self.chain, *self.skip], np.int64).reshape(-1, 2)
        return pairs, np.array([0] * len(self.chain) + [1] * len(self.skip), np.int64)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def posteriors(unary: np.ndarray, pairs: np.ndarray, kind: np.ndarray, potentials: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Loopy sum-product with damping. potentials[kind][label of the first, label of the second]."""
    n, k = unary.shape
    source = np.concatenate([pairs[:, 0], pairs[:, 1]])
    target = np.concatenate([pairs[:, 1], pairs[:, 0]])
    table = np.concatenate([potentials[kind], potentials[kind].transpose(0, 2, 1)])
    back = np.roll(np.arange(len(source)), len(pairs))  # the message the other way
    message = np.zeros((len(source), k))

    def belief():
        out = unary.copy()
        for y in range(k):
            out[:, y] += np.bincount(target, message[:, y], n)
        return out

    for _ in range(iterations if len(pairs) else 0):
        new = _logsumexp((belief()[source] - message[back])[:, :, None] + table, 1)
        new -= _logsumexp(new, 1)[:, None]
        message = DAMPING * message + (1 - DAMPING) * new
    b = belief()
    return np.exp(b - _logsumexp(b, 1)[:, None])


class Field:
    """Weights of features, and the two kinds of pair potentials."""

    def __init__(self):
        self.unary = np.zeros((FEATURES, len(LABELS)))
        self.pair = np.stack([np.zeros((len(LABELS),) * 2), AGREEMENT * np.eye(len(LABELS))])
        self.trained = False

    def scores(self, g: Graph) -> np.ndarray:
        return self.unary[np.array(g.features, np.int64)].sum(axis=1)

    def fit(self, g: Graph, epochs: int = EPOCHS) -> Field:
        """Pseudo-likelihood by Adam, with all labels of neighbours given."""
        if not g.where:
            return self
        x, y = np.array(g.features, np.int64), np.array(g.label, np.int64)
        pairs, kind = g.edges()
        one, prior = np.eye(len(LABELS)), self.pair.copy()
        grads = [np.zeros_like(self.unary), np.zeros_like(self.pair)]
        m, v = [g * 0 for g in grads], [g * 0 for g in grads]
        for step in range(1, epochs + 1):
            z = self.scores(g)
            a, b = pairs[:, 0], pairs[:, 1]
            for c in range(len(LABELS)):
                z[:, c] += np.bincount(b, self.pair[kind, y[a], c], len(y)) + np.bincount(a, self.pair[kind, c, y[b]], len(y))
            p = np.exp(z - _logsumexp(z, 1)[:, None]) - one[y]
            gu = np.stack([np.bincount(x.ravel(), np.repeat(p[:, c], x.shape[1]), FEATURES) for c in range(len(LABELS))], 1)
            gp = np.zeros_like(self.pair)
            np.add.at(gp, (kind, y[a]), p[b])
            np.add.at(gp.transpose(0, 2, 1), (kind, y[b]), p[a])
            gp[1] = (gp[1] + gp[1].T) / 2
            grads = [gu / len(y) + 1e-4 * self.unary, gp / len(y) + 1e-3 * (self.pair - prior)]
            for i, w in enumerate((self.unary, self.pair)):
                m[i] = 0.9 * m[i] + 0.1 * grads[i]
                v[i] = 0.99 * v[i] + 0.01 * grads[i] ** 2
                w -= 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        self.trained = True
        return self

    def spans(self, texts: list[str], confidence: float = CONFIDENCE) -> list[list[tuple[str, int, int, bool]]]:
        """For each text base and added spans, by kind as listed, then start."""
        g, base = Graph(), [base_spans(t) for t in texts]
        for i, t in enumerate(texts):
            g.add(i, t, base[i])
        out = [[(*s, True) for s in b] for b in base]
        if self.trained and g.where:
            p = posteriors(self.scores(g), *g.edges(), self.pair)
            best, chained = p.argmax(axis=1), {b: a for a, b in g.chain}
            added: dict[int, tuple[str, int, int, int]] = {}  # last node of a span -> kind, text, start, end
            for i in np.flatnonzero((best > 0) & (p.max(axis=1) >= confidence)).tolist():
                number, start, end = g.where[i]
                kind, first = LABELS[best[i]], start
                if (before := chained.get(i)) in added and added[before][0] == kind:
                    first = added.pop(before)[2]
                added[i] = (kind, number, first, end)
            for kind, number, start, end in added.values():
                if all(b <= start or a >= end for _, a, b in base[number]):
                    out[number].append((kind, start, end, False))
        order = {k: i for i, k in enumerate(KINDS)}
        return [sorted(s, key=lambda x: (order[x[0]], x[1])) for s in out]


def train(docs: DataFrame, text_col: str = "text", sample: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> Field:
    t = F.col(f"`{text_col}`")
    rows = docs.select(t.alias("text")).filter((F.length("text") <= chars) & F.col("text").rlike(_SIGN))
    chosen = hashed_sample(rows, sample, "text").toLocalIterator()
    g = Graph()
    for i, r in enumerate(chosen):
        g.add(i, r["text"], base_spans(r["text"]))
    return Field().fit(g)


def find(docs: DataFrame, text_col: str = "text", field: Field | None = None, confidence: float = CONFIDENCE) -> DataFrame:
    """(row: the whole input row, text, spans: array of kind, start, end, base)."""
    field = field or train(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((field.unary, field.pair, field.trained))
    columns = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = in_small_batches(docs).select(columns, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        f = Field()
        f.unary, f.pair, f.trained = shared.value
        for whole in batches:
            for batch in pieces(whole):
                found = f.spans(batch.column("text").to_pylist(), confidence)
                spans = [[dict(zip(("kind", "start", "end", "base"), s)) for s in x] for x in found]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(spans, kind)], ["row", "text", "spans"])

    return rows.mapInArrow(run, StructType([*rows.schema, StructField("spans", ArrayType(SPAN))]))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None, **options) -> DataFrame:
    """The rows with every span replaced by its kind in brackets; where spans overlap, the first one counts.

    A null text stays null. length_col, if given, gets the new length.
    """
    pieces_of = """aggregate(array_sort(spans, (a, b) -> case when a.start != b.start then int(sign(a.start - b.start)) else int(sign(b.end - a.end)) end),
        named_struct('at', 0L, 'done', cast(array() as array<string>)),
        (s, x) -> if(x.start < s.at, named_struct('at', greatest(s.at, x.end), 'done', s.done), named_struct('at', x.end, 'done',
            concat(s.done, array(substring(text, int(s.at + 1), int(x.start - s.at)), concat('[', upper(x.kind), ']'))))),
        s -> concat(array_join(s.done, ''), substring(text, int(s.at + 1))))"""
    found = find(docs, text_col, **options).withColumn("clean", F.when(F.col(f"row.`{text_col}`").isNotNull(), F.expr(pieces_of)))
    new = {text_col: F.col("clean").alias(text_col)}
    if length_col:
        new[length_col] = F.length("clean").cast(docs.schema[length_col].dataType).alias(length_col)
    return found.select(*(new.get(c, F.col(f"row.`{c}`").alias(c)) for c in docs.columns))
