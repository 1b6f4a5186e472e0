"""Ids through shared chunks against the library."""

import random

import numpy as np
import pytest

from plumbline.llm import bpe
from plumbline.llm import chunk_bpe as c

pytest.importorskip("public_tokenizers")
WORDS = bpe.rank_file("byte_bpe_50k.json")
SMALL = (32, 64, 256)


def texts():
    random.seed(7)
    alphabet = "ab  \n\n'rsve lt.!1٣é😀 \t"
    noise = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 1500))) for _ in range(30)]
    shared = "".join(random.choice(alphabet) for _ in range(2000))
    return [
        *noise,
        *(f"{x[:50]}{shared}{x[50:90]}" for x in noise),
        *[shared] * 5,
        "It's the end,\n\n\n of  all\t things... naïve Ünïcode 123",
        "",
        None,
        "a <|endoftext|>b<|endoftext|>",
        "<|endoftext|>",
        shared + "  <|endoftext|>" + shared + "<|endoftext|><|endoftext|>  " + shared,
        "x" * 5000 + " " * 3000 + "y",
        "'" * 700,
        "\n" * 900 + "a",
        "'re" * 400,
        ("Long words and blanks.  \n" * 3000),
    ]


def test_ids_and_text_equal_the_library(documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS())
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts())] + [(5, "twice"), (5, "twice")]
    got = c.decode(c.encode(documents(rows), WORDS, sizes=SMALL), WORDS).collect()
    left = sorted((r["doc_id"] or -1, bytes(r["ids"]), r["decoded"], r["n_tokens"]) for r in got)
    right = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        right.append((i or -1, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False), len(ids)))
    assert left == sorted(right)


def test_joins_are_repaired_wherever_the_cuts_are():
    e = c.encoder(WORDS())
    random.seed(3)
    for t in texts():
        for _ in range(3):
            t = t or ""
            at = sorted(random.sample(range(len(t) + 1), min(len(t), random.randint(0, 12))))
            parts = [t[a:b] for a, b in zip([0, *at], [*at, len(t)])]
            ids = [x for s in e.segments(t) if isinstance(s, str) for x in e.encode(s)[0].tolist()]
            if "<|" in t or not t:
                continue
            got = c.repaired([e.encode(p) for p in parts], e)
            assert np.concatenate([p[0] for p in got]).tolist() == ids
            # Where pre-tokens begin is right as well: later joins rely on it.
            starts, n = [], 0
            for p in got:
                starts += (p[1] + n).tolist()
                n += len(p[0])
            assert starts == e.encode(t)[1].tolist()


def test_chunks_depend_on_content():
    random.seed(5)
    text = "".join(random.choice("abcdefghij é😀 ") for _ in range(20_000)).encode()
    ends = c.cuts(text, *SMALL)
    assert ends[-1] == len(text) and all(0 < b - a <= SMALL[2] + 3 for a, b in zip([0, *ends], ends))
    for a, b in zip([0, *ends], ends):
        text[a:b].decode()
    other = b"some words before " + text
    again = c.cuts(other, *SMALL)
    moved = {other[a:b] for a, b in zip([0, *again], again)}
    assert len(moved & {text[a:b] for a, b in zip([0, *ends], ends)}) > 0.8 * len(ends)
    assert c.cuts(b"", *SMALL) == [] and c.cuts(b"short", *SMALL) == [5]


def test_a_chunk_that_many_documents_share_is_encoded_once(spark, documents):
    random.seed(9)
    shared = "".join(random.choice("abcdefgh ij") for _ in range(3000))
    docs = documents([(i, f"{i} {shared} {i}") for i in range(40)])
    found = c.shared_chunks(c._rows(docs, "doc_id", "text"), WORDS, SMALL)
    assert found.agg({"n": "max"}).first()[0] == 40


def test_empty_table(documents):
    assert c.decode(c.encode(documents([]), WORDS), WORDS).count() == 0
