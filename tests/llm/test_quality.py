"""Counts against a plain count, the fit on votes with a known truth, and what is kept."""

import random
import re

from plumbline.llm import quality

SPACE = r"[\x20\x09-\x0D]+"
GOOD = "The quick brown fox, number {0}, jumps over a lazy dog{0} and then {0}sleeps until{0} noon{0}. "


def prose(n, seed):
    rng = random.Random(seed)
    return ". ".join(" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(8)) for _ in range(n // 8)) + "."


def plain(text):
    text = text or ""
    words = [w for w in re.split(SPACE, text) if w]
    lines = [x for x in text.split("\n") if re.sub(SPACE, "", x)]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {p for v in seen.values() if len(v) > 1 for i in v for p in (i, i + 1, i + 2)}
    return (
        len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered),
    )


TEXTS = [
    "", None, " \t\n ", "one", "a b a b a b a b", "x\nx\n\n x\nx", "  wide\x0bspaces\x0chere é😀", "a|b <c> #$%&*",
    prose(80, 1), "go on " * 60, "same line of words\n" * 30, prose(4000, 2) * 3, prose(8, 3) + " " + prose(8, 3),
]


def test_counts_equal_a_plain_count(documents):
    judged, _ = quality.judge(documents(list(enumerate(TEXTS))))
    got = {r["row"]["doc_id"]: r for r in judged.collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain(t), i
        failed = plain(t)[0] < 50 or 100 * plain(t)[4] > 50 * plain(t)[0]
        assert r["base_failed"] == failed
        assert not (failed and r["kept"])


def test_clean_stays_and_junk_goes(documents):
    clean = [(i, prose(120, i)) for i in range(60)]
    junk = [(100 + i, " ".join(w + "%%%" for w in prose(120, 100 + i).split())) for i in range(6)]
    junk += [(200 + i, prose(120, 200 + i).upper().replace(" ", "!! ")) for i in range(6)]
    docs = documents(clean + junk + clean[:1] + [(None, clean[0][1])])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted([i for i, _ in clean] + [0]) and None in ids


def test_fit_finds_planted_shares():
    rng = random.Random(5)
    counts = {}
    for _ in range(4000):
        good = rng.random() < 0.8
        votes = ""
        for _, _, positive in quality.RULES:
            x = rng.random()
            votes += ("+" if positive and x < 0.7 else "0") if good else ("-" if x < 0.4 else "0")
        counts[votes] = counts.get(votes, 0) + 1
    model = quality.fit(counts)
    assert abs(model.good - 0.8) < 0.05
    assert all(abs(t["-"][1] - 0.4) < 0.1 for t in model.shares)
    assert model.posterior("0" * len(quality.RULES)) > 0.5 > model.posterior("--" + "0" * (len(quality.RULES) - 2))


def test_no_python_in_the_plan(documents):
    judged, _ = quality.judge(documents([(1, prose(60, 1))]))
    plan = judged._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(documents):
    assert quality.judge(documents([]))[0].count() == 0
