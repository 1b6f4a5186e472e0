"""Token counts by a two-tier lookup, without a shuffle of pre-tokens.

The pre-tokens that are most frequent in a bounded sample of the texts (`SAMPLE` texts, those with the
smallest hashes) form, with their token lengths, the compact table that is broadcast (at most
`table_size` entries of at most `WORD_LIMIT` characters). One pass over all texts looks every
pre-token up in that table; misses are encoded by the library, together for a slice of texts, and kept
in a bounded cache of the worker. The table decides only the speed: a pre-token's length is the
library's in either tier.

Defined results: a null or empty text has 0 tokens; special strings inside a text become one token
each, the library's default; a null id stays; repeated rows are counted each; an empty table gives
an empty table; other columns are not carried.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import hashed_sample, once, pieces, texts

#: Entries of the broadcast table and of a worker's cache.
TABLE_SIZE, CACHE_SIZE = 40_000, 400_000
#: Texts that the table is fitted on, of at most so many characters each.
SAMPLE, SAMPLE_LENGTH = 2_000, 20_000
#: Longer pre-tokens are always encoded: neither the table nor the cache holds them.
WORD_LIMIT = 64
#: Up to here the library's pattern tables and those below agree for every character (tested); texts
#: with other characters are split by the library itself.
KNOWN = 0x558


def _known_pattern() -> re.Pattern:
    """The library's split for characters below KNOWN, as plain character sets.

    Alternatives that start alike keep their order, so the matches are the same.
    """
    import regex

    def those(kind: str) -> str:
        return re.escape("".join(c for c in map(chr, range(KNOWN)) if regex.match(kind, c)))

    letters, digits, space = those(r"\p{L}"), those(r"\p{N}"), those(r"\s")
    return re.compile(
        rf" ?[{letters}]+| ?[{digits}]+|'(?:[stmd]|re|ve|ll)| ?[^{space}{letters}{digits}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


class Splitter:
    """Splits texts into pre-tokens and special strings as the library does."""

    def __init__(self, path: str):
        # Tasks share out the cores; threads of the library's own would only wait for them.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known, self.unknown = _known_pattern(), re.compile(f"[^\\x00-{chr(KNOWN - 1)}]")
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def split(self, text: str) -> list[str]:
        if self.unknown.search(text) is None:
            return self.known.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def parts(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens outside special strings, and the number of special strings."""
        if self.special is None or self.special.search(text) is None:
            return self.split(text), 0
        out = self.special.split(text)
        return [w for x in out for w in self.split(x)], len(out) - 1

    def lengths(self, words: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch(words, add_special_tokens=False)]


def splitter(path: str) -> Splitter:
    return once(("splitter", path), lambda: Splitter(path))


def frequent_lengths(rows: DataFrame, vocabulary: Callable[[], str], table_size: int = TABLE_SIZE, sample: int = SAMPLE) -> dict[str, int]:
    """Token lengths of the most frequent pre-tokens of the `sample` texts with the smallest hashes.

    The sample depends on the rows alone, and is counted where it is gathered: no pre-token is shuffled.
    """

    def run(batches):
        s, counts = splitter(vocabulary()), Counter()
        for whole in batches:
            for batch in pieces(whole):
                for t in batch.column("text").to_pylist():
                    counts.update(w for w in s.parts(t)[0] if len(w) <= WORD_LIMIT)
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:table_size]
        words = [w for w, _ in top]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(s.lengths(words) if words else [], pa.int64())], ["word", "n"])

    short = rows.filter(F.length("text") <= SAMPLE_LENGTH)
    drawn = hashed_sample(short, sample, "doc_id", "text").select("text").coalesce(1)
    return {r["word"]: r["n"] for r in drawn.mapInArrow(run, "word string, n long").collect()}


def count_tokens(
    docs: DataFrame,
    vocabulary: Callable[[], str],
    id_col: str = "doc_id",
    text_col: str = "text",
    table_size: int = TABLE_SIZE,
    cache_size: int = CACHE_SIZE,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_pretokens, n_misses (pre-tokens that the table did not hold)."""
    rows = texts(docs, id_col, text_col)
    table = rows.sparkSession.sparkContext.broadcast(frequent_lengths(rows, vocabulary, table_size))

    def run(batches):
        s, first = splitter(vocabulary()), table.value
        cache = once(("token lengths", vocabulary()), dict)
        for whole in batches:
            for batch in pieces(whole, limit=1_000_000):
                split = [s.parts(t) for t in batch.column("text").to_pylist()]
                misses = [[w for w in words if w not in first] for words, _ in split]
                if len(cache) > cache_size:
                    cache.clear()
                new = list({w for m in misses for w in m if w not in cache})
                here = dict(zip(new, s.lengths(new))) if new else {}
                cache.update((w, n) for w, n in here.items() if len(w) <= WORD_LIMIT)
                n_tokens = []
                for (words, n_special), missed in zip(split, misses):
                    n = n_special + sum(map(first.get, words, [0] * len(words)))
                    n += sum(cache[w] if w in cache else here[w] for w in missed)
                    n_tokens.append(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.compute.cast(pa.compute.binary_length(batch.column("text")), pa.int64()),
                        pa.array(n_tokens, pa.int64()),
                        pa.array([len(w) for w, _ in split], pa.int64()),
                        pa.array([len(m) for m in misses], pa.int64()),
                    ],
                    ["doc_id", "n_bytes", "n_tokens", "n_pretokens", "n_misses"],
                )

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, n_pretokens long, n_misses long")
