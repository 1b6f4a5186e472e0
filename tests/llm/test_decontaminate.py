"""Approximate matches against plain dynamic programming."""

import random

from plumbline.llm import decontaminate as dc


def sellers(pattern, text, k):
    column, best = list(range(len(pattern) + 1)), None
    for at, c in enumerate(text):
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(column[i] + (p != c), column[i + 1] + 1, new[-1] + 1))
        column = new
        if column[-1] <= k and (best is None or column[-1] < best[0]):
            best = (column[-1], at + 1)
    return best


def test_bit_parallel_distance():
    rng = random.Random(4)
    for _ in range(2000):
        p = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 70)))
        t = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 90)))
        k = rng.randint(0, 20)
        assert dc.best_end(dc.masks(p), len(p), t, k) == sellers(p, t, k)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(n))


def edited(rng, text, n):
    s = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(s)), rng.random()
        if kind < 0.4:
            s[at] = "z"
        elif kind < 0.7:
            s.insert(at, "z")
        else:
            del s[at]
    return "".join(s)


def test_items_equal_brute_force(spark, documents):
    rng = random.Random(6)
    items = [(j, words(rng, rng.randint(12, 40))) for j in range(12)]
    texts = []
    for _ in range(40):
        j, t = rng.choice(items)
        k = dc.budget(len(t), dc.RATE)
        inside = edited(rng, t, rng.choice([0, 1, k // 2, k, k + 12]))
        texts.append(f"{words(rng, 30)} {inside.title()}\n\n{words(rng, 5)}".replace(" ", "  ", 5))
    texts += ["", None, words(rng, 300)]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[0])]
    table = [*items, (50, items[0][1].upper()), (51, None), (None, items[1][1]), (52, "short"), (53, "")]
    found = dc.find_items(documents(rows), spark.createDataFrame(table, "item_id long, text string"), block_chars=500)
    got = found.collect()
    assert len(got) == len(rows)
    known = [(j, dc.normalise(t)) for j, t in table if j is not None and t and len(t) >= dc.MIN_ITEM]
    for r in got:
        text = r["row"]["text"] or ""
        want = {j for j, t in known if sellers(t, dc.normalise(text), dc.budget(len(t), dc.RATE))}
        assert {h["item_id"] for h in r["hits"]} == want
        for h in r["hits"]:
            t = dict(known)[h["item_id"]]
            part = dc.normalise(text[h["start"] : h["end"]])
            assert sellers(t[::-1], part[::-1], 10**6)[0] <= h["distance"] <= dc.budget(len(t), dc.RATE)


def test_stage_keeps_rows_as_they_are(spark, documents):
    rng = random.Random(7)
    item = words(rng, 20)
    docs = documents([(1, f"before {item} after"), (2, words(rng, 60)), (3, None), (None, "x")])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = dc.keep_clean(docs, items)
    assert kept.schema == docs.schema
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "None"]
    assert dc.keep_clean(docs, items.limit(0)).count() == 4
    assert dc.keep_clean(documents([]), items).count() == 0


def test_lower_case_keeps_the_length():
    assert len(dc.lowered("İstanbul ẞ Σ")) == len("İstanbul ẞ Σ")
