"""Base spans against the plain patterns; marginals against enumeration; what the field adds."""

import itertools
import random
import re

import numpy as np

from plumbline.llm import pii

# The patterns that base spans follow.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("a1 23.@+-(%\n4b5") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == plain(t), t


def test_long_runs_take_linear_time():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "a@" * 100_000, "+1" + " " * 200_000, "1." * 100_000, "1 " * 100_000):
        pii.base_spans(t)
        pii.nodes(t)


def test_marginals_on_a_tree_and_near_them_on_a_loop():
    rng = np.random.default_rng(2)
    for edges, bound in (([(0, 1), (1, 2), (1, 3)], 1e-3), ([(0, 1), (1, 2), (2, 3), (0, 3)], 0.1)):
        pairs, kind = np.array(edges), np.array([k % 2 for k in range(len(edges))])
        unary, tables = rng.normal(size=(4, 5)), rng.normal(size=(2, 5, 5)) * 0.5
        exact = np.zeros((4, 5))
        for y in itertools.product(range(5), repeat=4):
            w = np.exp(sum(unary[i, y[i]] for i in range(4)) + sum(tables[k, y[a], y[b]] for (a, b), k in zip(edges, kind)))
            for i in range(4):
                exact[i, y[i]] += w
        exact /= exact.sum(axis=1, keepdims=True)
        assert np.abs(pii.posteriors(unary, pairs, kind, tables, 60) - exact).max() < bound


def corpus():
    rng = random.Random(8)
    rows = []
    for i in range(150):
        card = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card += next(c for c in "0123456789" if pii.luhn(card + c))
        phone = f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
        rows.append((i, f"Call {phone} or mail u{i}@mail.example.com from 10.0.0.{i % 250} with {card} by {rng.randint(1, 99)} of {rng.randint(100, 2000)} ."))
    return rows


def test_field_adds_repeats_and_keeps_base(documents):
    more = [(900, "Call +1 (377) 555-0271 now, then 555-0271, or 17 of 300 ."), (901, None), (902, ""), (None, "u1@mail.example.com"), (903, "x" * 200_000 + " 10.0.0.1")]
    docs = documents(corpus() + more + more[:1])
    got = pii.find(docs, field=pii.train(documents(corpus()))).collect()
    assert len(got) == 150 + 6
    for r in got:
        spans = [(s["kind"], s["start"], s["end"]) for s in r["spans"]]
        assert [s for s, x in zip(spans, r["spans"]) if x["base"]] == plain(r["text"])
        added = [s for s, x in zip(spans, r["spans"]) if not x["base"]]
        for k, a, b in added:
            assert all(b <= x or a >= y for _, x, y in plain(r["text"]))
        if r["row"]["doc_id"] == 900:
            assert [r["text"][a:b] for _, a, b in added] == ["555-0271"]


def test_redaction(documents):
    docs = documents([(1, "mail a.b@x.org, 10.0.0.1 é😀 10.0.0.2"), (2, None), (3, "plain")])
    out = pii.redact(docs, "text", "n_chars", field=pii.Field())
    assert out.schema.simpleString() == docs.schema.simpleString()
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["spans"]) for r in out.collect()}
    assert got == {1: ("mail [EMAIL], [IP] é😀 [IP]", 26, "s"), 2: (None, None, "s"), 3: ("plain", 5, "s")}


def test_empty_table(documents):
    assert pii.find(documents([])).count() == 0
