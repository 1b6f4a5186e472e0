"""Encoding, decoding and counting against the libraries."""

import hashlib

import numpy as np
import pytest

from plumbline.llm import bpe, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = bpe.rank_file("byte_bpe_multi_50k.tiktoken")
WORDS = bpe.rank_file("byte_bpe_50k.json")
TEXTS = [
    (1, "It's the end,\n\n\n of  all\t things... naïve Ünïcode 123"),
    (2, ""),
    (3, None),
    (None, "no id"),
    (4, "x" * 30_000 + " " * 5_000 + "y"),
    (5, "a <|endoftext|>b<|endoftext|>"),
    (6, "emoji 😀 हिन्दी ᚠᛇᚻ ႔0\U00010940 \x1c\x85 end ՘՘ ࢏"),
    (7, "twice"),
    (7, "twice"),
    (8, ("Long words and blanks.  \n" * 9000)),
]


def test_ids_and_bytes_equal_the_library(documents):
    encoding = bpe.load(RANKS(), public_tokenizers.PATTERN)
    docs = documents(TEXTS)
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, chunk=1000)
    rows = bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(TEXTS)
    left = sorted((r["doc_id"] or -1, bytes(r["ids"]), bytes(r["decoded"]), r["n_tokens"]) for r in rows)
    right = []
    for i, t in TEXTS:
        ids = np.array(encoding.encode_ordinary(t or ""), "<u4")
        right.append((i or -1, ids.tobytes(), (t or "").encode(), len(ids)))
    assert left == sorted(right)


def test_cuts_are_at_boundaries():
    text = TEXTS[0][1] * 50
    parts = list(bpe.safe_chunks(text, 40))
    assert "".join(parts) == text and len(parts) > 5
    assert list(bpe.safe_chunks("x" * 1000, 40)) == ["x" * 1000]


@pytest.mark.parametrize("table_size", [3, 1000])
def test_counts_equal_the_library(documents, table_size):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS())
    got = token_counts.count_tokens(documents(TEXTS), WORDS, table_size=table_size).collect()
    left = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got)
    right = sorted((i or -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS)
    assert left == right


def test_known_characters_split_alike():
    s = token_counts.splitter(WORDS())
    for c in map(chr, range(token_counts.KNOWN)):
        t = f"a{c}b1{c}{c}2 {c}! '{c}s"
        assert s.split(t) == [t[a:b] for _, (a, b) in s.library.pre_tokenizer.pre_tokenize_str(t)], hex(ord(c))


def test_empty_table(documents):
    docs = documents([])
    assert bpe.decode(bpe.encode(docs, RANKS, "x"), RANKS, "x").count() == 0
    assert token_counts.count_tokens(docs, WORDS).count() == 0


def test_digest_of_no_ids():
    assert hashlib.sha256(np.array([], "<u4").tobytes()).hexdigest().startswith("e3b0c442")
