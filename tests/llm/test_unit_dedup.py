"""Repeats against a plain pass over the documents in order."""

import random

import pytest

from plumbline.llm import unit_dedup as ud


def plain(rows, unit, min_words):
    """Rows in the order of their ids, those of one id and those without in any order: only one such pair has text here."""
    seen, places = {}, {}
    for key, text in sorted(((ud.LAST if i is None else i, t) for i, t in rows if t is not None), key=lambda x: x[0]):
        for k, u in enumerate(ud.units(text, unit)):
            if seen.setdefault(u[3], (key, text, k)) != (key, text, k):
                places.setdefault((key, text), set()).add(k)
    return {key: sorted(p) for key, p in places.items()}


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(n)).capitalize()


@pytest.mark.parametrize("unit", ["line", "sentence", "paragraph"])
def test_removed_equals_plain(documents, unit):
    rng = random.Random(3)
    passage = ". ".join(sentence(rng, 12) for _ in range(5)) + "."
    mark = {"line": "\n", "sentence": " ", "paragraph": "\n\n"}[unit]
    rows = []
    for i in range(40):
        own = [sentence(rng, 9) + "." for _ in range(4)] + ["Of.", "Las las."]
        if i % 3 == 0:
            own.insert(rng.randrange(6), passage.upper() if i % 2 else passage)
        rows.append((i, mark.join(own)))
    rows += [(50, rows[0][1]), (None, rows[1][1]), (51, ""), (52, None), (53, " \n\n "), (7, rows[7][1])]
    got = ud.dedup(documents(rows), unit=unit, min_words=20).collect()
    assert len(got) == len(rows)
    places = plain(rows, unit, 20)
    texts = sorted((str(i), str(t)) for i, t in rows)
    for r, (i, t) in zip(sorted(got, key=lambda r: (str(r["doc_id"]), str(r["text"]))), texts):
        assert str(r["doc_id"]) == i
    by = {(i, t): ud.stretches(t, places.get((ud.LAST if i is None else i, t), []), unit, 20) for i, t in rows if t}
    for (i, t), cut in by.items():
        r = next(r for r in got if r["doc_id"] == i and (r["text"] == t or r["removed"]))
        assert [(x["start"], x["end"]) for x in r["removed"]] == cut
        at, kept = 0, ""
        for a, b in cut:
            kept, at = kept + t[at:a], b
        assert r["text"] == kept + t[at:]
    full = [r for r in got if r["doc_id"] is not None and r["doc_id"] % 3 == 0 and 0 < r["doc_id"] < 40]
    assert all(r["removed"] for r in full)
    assert all(not r["removed"] for r in got if r["doc_id"] in (0, 1, 2, 4, 5, 51, 52, 53))


def test_empty_table(documents):
    assert ud.dedup(documents([])).count() == 0


def test_short_lines_go_and_the_earliest_stays(documents):
    rows = [(i, f"Own words {i}\nAll rights  reserved.\nMore of {i}") for i in range(5)] + [(9, "ALL rights reserved.\n!!\n!!")]
    got = {r["doc_id"]: r["text"] for r in ud.dedup(documents(rows)).collect()}
    assert got == {0: rows[0][1], **{i: f"Own words {i}\n\nMore of {i}" for i in range(1, 5)}, 9: "\n!!\n"}


def test_passages_that_start_and_end_in_mid_sentence(documents):
    rng = random.Random(5)
    own = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    rows, passages = [], [own(n) for n in (20, 30, 60)]
    for k, p in enumerate(passages):
        rows.append((k, f"{own(15)} {p} {own(9)}."))
        rows.append((10 + k, f"{own(3)} {p.title() if k == 1 else p} {own(12)}. {own(30)}"))
        rows.append((20 + k, f"{own(4)}. {p.replace(' ', '. ', 1)}\n{own(5)}"))
    short = own(19)
    rows += [(30, f"{own(5)} {short} {own(5)}"), (31, f"{own(6)} {short} {own(6)}")]
    got = {r["doc_id"]: r for r in ud.dedup(documents(rows)).collect()}
    for i, t in rows:
        cut = [t[r["start"] : r["end"]] for r in got[i]["removed"]]
        expected = [passages[i % 10]] if 10 <= i < 30 else []
        assert [" ".join(ud.words_of(c)) for c in cut] == expected, i


def test_a_text_that_repeats_itself_keeps_the_first(documents):
    rows = [(1, "las " * 100), (2, "las " * 40 + "\n" + "of it " * 30)]
    got = {r["doc_id"]: ud.words_of(r["text"]) for r in ud.dedup(documents(rows)).collect()}
    assert got[1] == ["las"] * 10
    assert got[2][:2] == ["of", "it"] and len(got[2]) < 20


def test_rows_that_share_an_id_or_have_none_keep_their_own_text(documents):
    rows = [
        (1, "shared line\nfirst own"),
        (None, "shared line\nnull one"),
        (None, "something unique\nnull two"),
        (5, "five unique head\nshared line"),
        (5, "another head of five\nfive tail"),
        (7, "said twice by seven"),
        (7, "said twice by seven"),
    ]
    got = sorted((str(r["doc_id"]), r["text"]) for r in ud.dedup(documents(rows)).collect())
    assert got == sorted(
        [
            ("1", "shared line\nfirst own"),
            ("None", "\nnull one"),
            ("None", "something unique\nnull two"),
            ("5", "five unique head\n"),
            ("5", "another head of five\nfive tail"),
            ("7", "said twice by seven"),
            ("7", "said twice by seven"),
        ]
    )


def test_the_registered_path_against_a_plain_pass(documents):
    """Lines and passages as the query removes them: every line that stands earlier, and runs of words that do."""
    rng = random.Random(11)
    own = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(n))
    shared, lines = [own(n) for n in (20, 25, 55)], [own(n) for n in (1, 4, 30)]
    rows = []
    for i in range(24):
        parts = [own(rng.randint(5, 30)) for _ in range(3)]
        if i % 2:
            parts[1] = f"{own(rng.randint(1, 9))} {shared[i % 3]} {own(rng.randint(1, 9))}"
        if i % 3 == 0:
            parts.insert(rng.randrange(4), lines[(i // 3) % 3])
        rows.append((i if i % 8 else None, "\n".join(parts)))
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen_lines, seen, expected = set(), set(), {}
    with_id = [r for r in order if r[0] is not None]
    for i, t in with_id:
        gone = set()
        words = [(m, n) for n, line in enumerate(t.split("\n")) for m in line.split()]
        at = 0
        for n, line in enumerate(t.split("\n")):
            size = len(line.split())
            if line in seen_lines:
                gone.update(range(at, at + size))
            at += size
        flat = [m for m, _ in words]
        hit = [tuple(flat[j : j + 10]) in seen for j in range(len(flat) - 9)]
        j = 0
        while j < len(hit):
            e = j
            while e < len(hit) and hit[e]:
                e += 1
            if e - j + 9 >= 20:
                gone.update(range(j, e + 9))
            j = max(e, j + 1)
        expected[i] = [m for n, m in enumerate(flat) if n not in gone]
        seen_lines.update(t.split("\n"))
        seen.update(tuple(flat[j : j + 10]) for j in range(len(flat) - 9))
    got = {r["doc_id"]: r["text"].split() for r in ud.dedup(documents(rows)).collect() if r["doc_id"] is not None}
    assert got == expected


def test_windows_of_a_batch_are_those_of_each_text():
    """Anchors and windows against a text taken alone, with words found one by one."""
    import numpy as np

    rng = random.Random(2)
    texts = ["", "One two.", " ".join(rng.choice("ab cd ef\ngh. I J! ÄÖ?".split(" ")) for _ in range(300)), "\n\n", "x " * 40, "A b\x1cc\x85d " * 20]
    k, w = 4, 5
    both = ud.Windows(texts, k)
    anchors = set(both.anchors(w).tolist())
    for i, t in enumerate(texts):
        words = ud.words_of(t)
        assert both.starts[i + 1] - both.starts[i] == len(words)
        alone = ud.Windows([t], k)
        own = both.text(i, k)
        assert both.h[own].tolist() == alone.h.tolist()
        assert {a - own.start for a in anchors if own.start <= a < own.stop} == set(alone.anchors(w).tolist())
        same = {tuple(words[j : j + k]): h for j, h in enumerate(alone.h.tolist())}
        assert len(set(same.values())) == len(same)
        line = [n for n, x in enumerate(t.lower().split("\n")) for _ in ud.words_of(x)]
        assert both.line[both.starts[i] : both.starts[i + 1]].tolist() == line
        lo = alone.h.tolist()
        assert set(alone.anchors(w).tolist()) == {max(j for j in range(s, s + w) if lo[j] == min(lo[s : s + w])) for s in range(len(lo) - w + 1)}
        assert np.all(both.whole[own])
