"""Removes units of text that an earlier document holds already, by digests of normalised units.

Units are lines: lower case, one blank between words, a 128-bit digest. Equal digests are grouped over
all documents; the occurrence with the smallest (document id, place) stays, and every other goes,
however short it is. Passages that are copied into other documents often start in the middle of a line
or of a sentence, so stretches of at least `min_words` words that occur earlier go too, wherever they
start and end. Windows of half as many words are compared for that (`passages` says which). Shorter
phrases that meet by chance within lines stay. Removed stretches are given in the original text.

On request, units are lines, paragraphs or sentences alone (a sentence also ends before a capitalised
word and has no mark at its end). A repeat is then removed if the run of neighbouring repeats it is in
has at least `min_words` words.

Only digests, ids and places are shuffled for grouping, counted before the shuffle; digests that
occur once drop out. A digest with very many occurrences is a hot key of a join with a written
table, which Spark splits.

Documents rank by their id; where an id is missing (these rank last) or occurs more than once, by a
hash of the text as well. Each such row is a document of its own.

Defined results: a null text stays null and has no units; an empty text stays empty; rows that are equal
in id and text are one document and keep the same; rows of one id with different texts, and rows
without id, only lose what stays elsewhere; an empty table gives an empty table; other columns are not carried.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from plumbline.llm.common import hash_bits, hash_found, in_small_batches, pieces
from plumbline.session import cut_lineage

MIN_WORDS = 20
#: Patterns of units: what stands between two boundaries.
UNITS = {"line": r"[^\n]+", "paragraph": r"(?:[^\n]|\n(?!\s*\n))+", "sentence": r"[^\s.!?]++(?:[^\S\n]++(?![A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ])[^\s.!?]++)*+"}
WORD = r"[^\s.!?]+"
LAST = (1 << 63) - 1


def units(text: str, unit: str) -> list[tuple[int, int, int, str]]:
    """(start, end, words, normalised) of the units with a word."""
    out = []
    for m in re.finditer(UNITS[unit], text):
        words = m.group().lower().split()
        if words:
            out.append((m.start(), m.end(), len(words), " ".join(words)))
    return out


def _keys(docs: DataFrame, unit: str) -> DataFrame:
    """(id, sub, place, h1, h2): a row for each unit."""

    def run(batches):
        import xxhash

        for whole in batches:
            for batch in pieces(whole):
                digests, counts = [], []
                for t in batch.column("text").to_pylist():
                    own = units(t, unit)
                    counts.append(len(own))
                    digests.extend(xxhash.xxh3_128_digest(u[3].encode()) for u in own)
                h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                at = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(h[:, k]), pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("sub"), *lists], ["id", "sub", "a", "b"])

    listed = docs.select("id", "sub", "text").mapInArrow(run, "id long, sub long, a array<long>, b array<long>")
    each = listed.select("id", "sub", F.posexplode(F.arrays_zip("a", "b")).alias("place", "h"))
    return each.select("id", "sub", "place", F.col("h.a").alias("h1"), F.col("h.b").alias("h2"))


def repeats(docs: DataFrame, unit: str) -> DataFrame:
    """(id, sub, places): the units of a document that occur earlier in the ranking."""
    keys = _keys(docs, unit)
    first = F.min(F.struct("id", "sub", "place")).alias("first")
    several = cut_lineage(keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), first).filter("n > 1").select("h1", "h2", "first"))
    later = keys.join(several, ["h1", "h2"]).filter(_elsewhere() | (F.col("place") != F.col("first.place")))
    return later.groupBy("id", "sub").agg(F.collect_set("place").alias("places"))


def _elsewhere() -> Column:
    return (F.col("id") != F.col("first.id")) | (F.col("sub") != F.col("first.sub"))


def stretches(text: str, places: list[int], unit: str, min_words: int) -> list[tuple[int, int]]:
    """Original offsets of the runs of repeats that are long enough."""
    repeated, own = set(places), units(text, unit)
    out, k = [], 0
    while k < len(own):
        n, words = k, 0
        while n < len(own) and n in repeated:
            words += own[n][2]
            n += 1
        if words >= min_words:
            # Up to the next unit if that stays, so that marks and blanks go along.
            out.append((own[k][0], own[n][0] if n < len(own) and "\n" not in text[own[n - 1][1] : own[n][0]] else _tail(text, own[n - 1][1])))
        k = max(n, k + 1)
    return out


def _tail(text: str, end: int) -> int:
    """Behind the marks that close a unit."""
    while end < len(text) and text[end] in ".!?":
        end += 1
    return end


def merged(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order; those with only white space between them are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and (a <= out[-1][1] or not text[out[-1][1] : a].strip()):
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def words_of(text: str) -> list[str]:
    """The words of a text in lower case, without the marks that end sentences."""
    return re.findall(WORD, text.lower())


#: Bytes between words become blanks; line feeds stay for now. Other white space is beyond ASCII.
_BLANKS = bytes(32 if c in b".!?\t\r\x0b\x0c\x1c\x1d\x1e\x1f" else c for c in range(256))
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_MIX, _STEP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


class Windows:
    """The windows of k words of several texts at once: a hash for each, and where texts and lines begin.

    Words are numbered by a dictionary of the batch, so that each one is hashed once.
    """

    def __init__(self, texts: list[str], k: int):
        import xxhash

        plain = [_WIDE_SPACE.sub(" ", t.lower()).encode().translate(_BLANKS) for t in texts]
        joined = b" \r ".join(plain).replace(b"\n", b" \n ")
        words = pa.compute.split_pattern(pa.array([joined], pa.large_binary()), b" ").flatten()
        coded = words.filter(pa.compute.greater(pa.compute.binary_length(words), 0)).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        kind = np.array([0 if w == b"\n" else 1 if w == b"\r" else 2 for w in distinct], np.int8)
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], np.uint64)
        ids = coded.indices.to_numpy(zero_copy_only=False) if len(coded) else np.zeros(0, np.int64)
        kinds = kind[ids]
        is_word = kinds == 2
        #: For each text, the number of words before it; for each word, the line of its text it is in.
        self.starts = np.concatenate([[0], np.cumsum(is_word)[kinds == 1], [is_word.sum()]]).astype(np.int64)
        line = np.cumsum(kinds == 0)[is_word]
        text_of = np.cumsum(kinds == 1)[is_word]
        before = np.concatenate([[0], np.cumsum(kinds == 0)[kinds == 1]])
        self.line = line - before[text_of]
        h = hashes[ids[is_word]]
        n = max(0, len(h) - k + 1)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * _STEP + h[j : j + n]
        out ^= out >> np.uint64(32)
        self.h = out * _MIX
        #: Windows that are inside one text.
        self.whole = text_of[:n] == text_of[k - 1 : k - 1 + n]

    def text(self, i: int, k: int) -> slice:
        """The windows of one text."""
        return slice(int(self.starts[i]), max(int(self.starts[i]), int(self.starts[i + 1]) - k + 1))

    def anchors(self, w: int) -> np.ndarray:
        """Positions of the last minimum of every w neighbouring windows of a text: equal passages have equal anchors."""
        n = len(self.h) - w + 1
        if n < 1:
            return np.zeros(0, np.int64)
        # Neighbours of two texts have a broken window between them.
        broken = np.concatenate([[0], np.cumsum(~self.whole)])
        low, at = self.h[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, w):
            less = self.h[j : j + n] <= low
            np.copyto(low, self.h[j : j + n], where=less)
            at[less] = j
        inside = broken[w:] == broken[:n]
        return np.unique((at + np.arange(n))[inside])


def line_places(text: str, units_: list[int]) -> np.ndarray:
    """Which lines of the text, counted with empty ones, the given units are."""
    own = [n for n, line in enumerate(text.split("\n")) if line.strip()]
    return np.array([own[u] for u in units_ if u < len(own)], np.int64)


def inside_lines(line: np.ndarray, gone: np.ndarray, k: int) -> np.ndarray:
    """The windows of a text that are inside one of the given lines; `line` is the line of each word."""
    n = max(0, len(line) - k + 1)
    return (line[:n] == line[k - 1 : k - 1 + n]) & np.isin(line[:n], gone)


def removals(text: str, lines: list[int], later: list[int], k: int, min_words: int) -> list[tuple[int, int]]:
    """Original offsets of the repeated lines, and of the runs of repeated windows that have enough words."""
    own = units(text, "line") if lines else []
    spans = [own[n][:2] for n in sorted(lines) if n < len(own)]
    if not later:
        return merged(text, spans)
    starts, ends = np.array([m.span() for m in re.finditer(WORD, text)], np.int64).reshape(-1, 2).T
    gone = np.zeros(max(0, len(starts) - k + 1), bool)
    for a, b in spans:
        first, last = np.searchsorted(starts, [a, b])
        gone[first : max(first, last - k + 1)] = True
    at = np.array(later, np.int64)
    gone[at[at < len(gone)]] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
    for first, last in zip(edge[::2], edge[1::2] + k - 1):  # words of a run
        if last - first >= min_words:
            end = int(ends[last - 1])
            # Up to the next word if that stays, so that marks and blanks go along.
            joined = last < len(starts) and "\n" not in text[end : starts[last]]
            spans.append((int(starts[first]), int(starts[last]) if joined else _tail(text, end)))
    return merged(text, spans)


def passages(docs: DataFrame, lines: DataFrame, k: int, w: int) -> DataFrame:
    """(id, sub, lines, parts): parts are the windows of k words that occur earlier, if in w in a row; not those inside `lines`.

    A passage of k + w - 1 words or more has the same anchors wherever it occurs. Only what is
    fewer than w windows from a repeated anchor goes on to the comparison of all windows, which
    finds where a passage starts and ends to the word. Which anchors are repeated reaches the
    workers as a bit array of bounded size; anchors that only seem so bring more windows to compare.
    """
    keys = docs.select("text").mapInArrow(_anchored(k, w), "h array<long>").select(F.explode("h").alias("h"))
    several = cut_lineage(keys.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    bits = docs.sparkSession.sparkContext.broadcast(hash_bits(several, "h"))
    every = docs.join(lines, ["id", "sub"], "left").select("id", "sub", "text", "lines")
    every = every.mapInArrow(_compared(k, w, bits), "id long, sub long, at array<int>, h array<long>")
    every = cut_lineage(every.select("id", "sub", F.inline(F.arrays_zip("at", "h"))))
    first = F.min(F.struct("id", "sub", "at")).alias("first")
    firsts = cut_lineage(every.groupBy("h").agg(F.count("*").alias("n"), first).filter("n > 1").select("h", "first"))
    # In its own document, a repeat starts where the first occurrence has ended.
    later = every.join(firsts, "h").filter(_elsewhere() | (F.col("at") >= F.col("first.at") + k))
    parts = later.groupBy("id", "sub").agg(F.collect_set("at").alias("parts"))
    return lines.join(parts, ["id", "sub"], "full")


def _lists(values: list[np.ndarray], kind) -> pa.Array:
    ends = pa.array(np.concatenate([[0], np.cumsum([len(v) for v in values])]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values).astype(kind)))


def _anchored(k: int, w: int):
    """The hashes of the anchors of each text."""

    def run(batches):
        for whole in batches:
            for batch in pieces(whole):
                found = Windows(batch.column("text").to_pylist(), k)
                yield pa.RecordBatch.from_arrays([_lists([found.h[found.anchors(w)].view(np.int64)], np.int64)], ["h"])

    return run


def _compared(k: int, w: int, bits):
    """All windows near repeated anchors and not inside the given lines."""

    def run(batches):
        repeated = bits.value
        for whole in batches:
            for batch in pieces(whole):
                ats, hashes = [], []
                texts = batch.column("text").to_pylist()
                found = Windows(texts, k)
                near = found.anchors(w)
                near = near[hash_found(repeated, found.h[near])]
                ends = np.zeros(len(found.h) + 1, np.int64)
                np.add.at(ends, np.clip(near - w + 1, 0, len(found.h)), 1)
                np.add.at(ends, np.clip(near + w, 0, len(found.h)), -1)
                close = (np.cumsum(ends[:-1]) > 0) & found.whole
                for i, (t, lines) in enumerate(zip(texts, batch.column("lines").to_pylist())):
                    own = found.text(i, k)
                    here = close[own]
                    if lines and here.any():
                        here = here & ~inside_lines(found.line[found.starts[i] : found.starts[i + 1]], line_places(t, lines), k)
                    at = np.flatnonzero(here)
                    ats.append(at)
                    hashes.append(found.h[own][at].view(np.int64))
                columns = [batch.column("id"), batch.column("sub"), _lists(ats, np.int32), _lists(hashes, np.int64)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "sub", "at", "h"])

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text (without the repeats), removed: array of start and end in the original text, in code points.

    Without a unit, repeated lines of any length go, and other passages of at least `min_words` words;
    with one, only runs of such units.
    """
    rows = in_small_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.col(text_col).alias("text")
    )
    # Ids that don't name one row: none in most tables, so the join is by broadcast there.
    many = cut_lineage(rows.groupBy("id").agg(F.count("*").alias("n")).filter((F.col("n") > 1) | (F.col("id") == LAST)).select("id"))
    rows = rows.join(many.withColumn("many", F.lit(True)), "id", "left")
    rows = rows.withColumn("sub", F.when(F.col("many"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop("many")
    given = rows.filter("text is not null").select("id", "sub", "text")
    k = (min_words + 1) // 2
    if unit is None:
        lines = repeats(given, "line").withColumnRenamed("places", "lines")
        found = cut_lineage(passages(given, lines, k, min_words - k + 1))
    else:
        found = cut_lineage(repeats(given, unit).select("id", "sub", F.lit(None).cast("array<int>").alias("lines"), F.col("places").alias("parts")))
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("removed", ArrayType(span))])

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for batch in pieces(whole):
                texts, removed = [], []
                for t, l, p in zip(*(batch.column(c).to_pylist() for c in ("text", "lines", "parts"))):
                    cut = [] if not t or not (l or p) else removals(t, l or [], p or [], k, min_words) if unit is None else stretches(t, p, unit, min_words)
                    at, kept = 0, []
                    for a, b in cut:
                        kept.append(t[at:a])
                        at = b
                    texts.append("".join([*kept, t[at:]]) if cut else t)
                    removed.append([{"start": a, "end": b} for a, b in cut])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(removed, kind)], ["doc_id", "text", "removed"])

    return rows.join(found, ["id", "sub"], "left").select("doc_id", "text", "lines", "parts").mapInArrow(run, schema)
