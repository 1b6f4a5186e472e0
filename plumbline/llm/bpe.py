"""Byte-level BPE with a local rank file: texts to ids, ids to bytes.

Both directions are narrow: one pass over the rows, no shuffle, and what a task holds is one slice
of a batch. The rank file is named by a function that each worker calls, so a path that differs
between machines works; it is read once for each worker.

Defined results: a null or empty text gives no ids and empty bytes; a null id column value stays;
repeated rows give repeated rows; an empty table gives an empty table; other columns are not carried.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import once, pieces, texts

#: Characters after which a long text may be cut; shorter texts are encoded whole.
CHUNK = 100_000


def rank_file(name: str) -> Callable[[], str]:
    """Path of a public vocabulary, looked up where it is used."""

    def path() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return path


def load(path: str, pattern: str):
    """A tiktoken encoding without special tokens."""
    import tiktoken

    def make():
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return once(("bpe", path, pattern), make)


def safe_chunks(text: str, limit: int = CHUNK) -> Iterator[str]:
    """Cuts a long text only before white space that follows other characters.

    No match of the pattern contains white space after another character, and the look-ahead of a
    run of white space sees only what follows the run: the matches of the parts are those of the
    whole. A text without such a place is not cut.
    """
    import re

    boundary = once(("bpe boundary",), lambda: re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n\t\r])"))
    start = 0
    while len(text) - start > limit:
        cut = boundary.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(encoding, text: str, limit: int = CHUNK) -> np.ndarray:
    if len(text) <= limit:
        return np.array(encoding.encode_ordinary(text), dtype="<u4")
    return np.concatenate([np.array(encoding.encode_ordinary(x), dtype="<u4") for x in safe_chunks(text, limit)])


def encode(
    docs: DataFrame, ranks: Callable[[], str], pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK
) -> DataFrame:
    """doc_id, n_tokens, ids: little-endian unsigned 32-bit integers in a binary column."""

    def run(batches):
        encoding = load(ranks(), pattern)
        for whole in batches:
            for batch in pieces(whole):
                ids = [encode_text(encoding, t, chunk) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                    ["doc_id", "n_tokens", "ids"],
                )

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: Callable[[], str], pattern: str) -> DataFrame:
    """Adds `decoded`, the raw bytes of the ids. Invalid ids raise."""

    def run(batches):
        encoding = load(ranks(), pattern)
        for whole in batches:
            for batch in pieces(whole, "ids"):
                out = [encoding.decode_bytes(np.frombuffer(x or b"", dtype="<u4").tolist()) for x in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    kept = encoded.select("doc_id", "n_tokens", "ids")
    return kept.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
