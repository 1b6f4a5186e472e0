"""BPE ids through content-defined chunks that documents share.

A rolling hash over the last 32 bytes cuts every text where its low bits are zero, so that a passage is
cut alike wherever it stands. A first pass counts the digests of all chunks. A chunk that occurs again
is encoded once for the whole table; what stands between such chunks is encoded in its place, once
as well. The parts of a document then meet and their joins are repaired: from a boundary of
pre-tokens that the cut can't have moved, the text over the join is encoded again, over more and
more of the right part, until its pre-tokens and those of the right part begin at the same place.
From there on both agree, because the split into pre-tokens looks ahead only. So the ids are those
of the whole text, wherever the cuts are.

Which chunks are shared travels to the workers as a bit array of bounded size; a chunk that is taken
for shared by mistake is encoded apart, with the same result. Chunks that hold more than a
thousandth of all shared occurrences (a thousand at most) are joined by broadcast, the others by their digest.

Special strings of the vocabulary become their ids, as the library does by default, and end a text
for what stands before them. Words are looked up in a bounded cache of the worker before the library encodes them.

Defined results: a null or empty text gives no ids; a null id stays; repeated rows give repeated
rows; a text is never cut off, and one without cuts by content is cut every `MOST` bytes; an empty
table gives an empty table; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut_dense, hash_bits, hash_found, in_small_batches, once, pieces
from plumbline.llm.token_counts import WORD_LIMIT, Splitter, splitter
from plumbline.session import cut_lineage

#: Bytes of a chunk: at least, about (a power of two), at most.
LEAST, USUAL, MOST = 256, 1024, 16_384
#: Bytes that a boundary must stand before the end of what was seen; the pattern looks three characters ahead at most.
MARGIN = 12
#: Words that a worker keeps.
CACHE_SIZE = 300_000
#: Bytes of the right part that the first repair looks at.
WINDOW = 32


def _gear() -> np.ndarray:
    """A random number for each byte, from a rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def rolling(data: np.ndarray) -> np.ndarray:
    """For each byte, a hash of the 32 bytes that end there."""
    h = GEAR[data]
    for s in (1, 2, 4, 8, 16):
        h[s:] += h[:-s] << np.uint32(s)
    return h


def cuts(data: bytes, least: int = LEAST, usual: int = USUAL, most: int = MOST) -> list[int]:
    """Ends of the chunks of a text, always between two characters."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    # A rolling hash that is uniform in its high bits: the low ones depend on few bytes.
    offered = np.flatnonzero(rolling(raw) >> np.uint32(32 - (usual.bit_length() - 1)) == 0) + 1
    inside = (raw & 0xC0) == 0x80  # not the first byte of a character
    out, at = [], 0

    def forced(end: int) -> None:
        nonlocal at
        while end - at > most:
            cut = at + most
            while inside[cut]:
                cut -= 1
            out.append(cut)
            at = cut

    for c in offered.tolist():
        while c < n and inside[c]:
            c += 1
        if c - at < least or c >= n:
            continue
        forced(c)
        if c > at:
            out.append(c)
            at = c
    forced(n)
    out.append(n)
    return out


def digest(chunk: bytes) -> tuple[int, int]:
    pair = np.frombuffer(blake2b(chunk, digest_size=16).digest(), np.int64)
    return int(pair[0]), int(pair[1])


class Encoder:
    """Ids of a text and where its pre-tokens begin, through a cache of words."""

    def __init__(self, path: str, cache_size: int = CACHE_SIZE):
        self.split: Splitter = splitter(path)
        library = self.split.library
        self.type = np.dtype("<u2" if library.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache_size = cache_size
        self.special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self.bytes_of = self._bytes(library)
        self.length = np.array([len(b) for b in self.bytes_of], np.int64)

    @staticmethod
    def _bytes(library) -> list[bytes]:
        """The bytes of each id. Byte-level vocabularies write printable bytes as themselves, others from 256 on."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        code = {chr(b): b for b in plain}
        code.update((chr(256 + k), b) for k, b in enumerate(b for b in range(256) if b not in plain))
        return [bytes(code.get(c, 0) for c in library.id_to_token(i) or "") for i in range(library.get_vocab_size())]

    def segments(self, text: str) -> list[str | int]:
        """The text between special strings, and the ids of these."""
        if self.split.special is None or self.split.special.search(text) is None:
            return [text]
        out, at = [], 0
        for m in self.split.special.finditer(text):
            out += [text[at : m.start()], self.special[m.group()]]
            at = m.end()
        return [x for x in (*out, text[at:]) if x != ""]

    def words(self, text: str) -> list[bytes]:
        """The ids of each pre-token, as bytes."""
        words, cache = self.split.split(text), self.cache
        new = {w for w in words if w not in cache}
        if not new:
            return list(map(cache.__getitem__, words))
        known = {w: self.older[w] for w in new if w in self.older}
        rest = list(new.difference(known))
        if rest:
            made = self.split.library.encode_batch_fast(rest, add_special_tokens=False)
            known.update((w, np.array(e.ids, self.type).tobytes()) for w, e in zip(rest, made))
        out = [cache[w] if w in cache else known[w] for w in words]
        cache.update((w, x) for w, x in known.items() if len(w) <= WORD_LIMIT)
        if len(cache) > self.cache_size // 2:  # words that are met again move on, the others go
            self.cache, self.older = {}, cache
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the place among them of each pre-token's first one."""
        words = self.words(text)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) // self.type.itemsize
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return np.frombuffer(b"".join(words), self.type), starts

    def text_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids.tolist()])


def encoder(path: str) -> Encoder:
    return once(("chunk encoder", path), lambda: Encoder(path))


Part = tuple[np.ndarray, np.ndarray]  # ids, starts of pre-tokens


def _merge(a: Part, b: Part) -> Part:
    return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1] + len(a[0])])


def repaired(parts: list[Part], e: Encoder) -> list[Part]:
    """Parts whose ids in a row are those of the parts' whole text; each part is encoded on its own."""
    done: list[Part] = []
    for k, right in enumerate(parts):
        if len(right[0]) == 0:
            continue
        if not done:
            done.append(right)
            continue
        # The last boundary at least MARGIN bytes before the join, or the beginning of the text.
        while True:
            ids, starts = done[-1]
            tail, j = 0, len(starts)
            while j > 0 and tail < MARGIN:
                j -= 1
                tail += int(e.length[ids[starts[j] : starts[j + 1] if j + 1 < len(starts) else len(ids)]].sum())
            if tail >= MARGIN or len(done) == 1:
                break
            done[-2:] = [_merge(done[-2], done[-1])]
        from_ = int(starts[j])
        left = e.text_bytes(ids[from_:])
        ids_r, starts_r = right
        last = k == len(parts) - 1
        window = WINDOW
        while True:
            # Pre-tokens of the right part until the window is full.
            begins, size, m = [], 0, 0
            while m < len(starts_r) and size < window:
                begins.append(size)
                size += int(e.length[ids_r[starts_r[m] : starts_r[m + 1] if m + 1 < len(starts_r) else len(ids_r)]].sum())
                m += 1
            all_of_it = m == len(starts_r)
            end = int(starts_r[m]) if not all_of_it else len(ids_r)
            again, again_starts = e.encode((left + e.text_bytes(ids_r[:end])).decode())
            places = np.concatenate([[0], np.cumsum(e.length[again])])
            seen = len(left) + size
            here = {int(places[s]): i for i, s in enumerate(again_starts.tolist())}
            meet = next(
                (b for b, at in enumerate(begins) if len(left) + at in here and (len(left) + at + MARGIN <= seen or (all_of_it and last))), None
            )
            if meet is not None or all_of_it:
                break
            window *= 2
        head = (ids[:from_], starts[:j])
        if meet is None:
            done[-1:] = [head, (again, again_starts)]
        else:
            n = here[len(left) + begins[meet]]
            middle = (again[: again_starts[n]], again_starts[:n])
            skip = int(starts_r[meet])
            done[-1:] = [head, middle, (ids_r[skip:], starts_r[meet:] - skip)]
        done = [p for p in done if len(p[0])]
    return done


MIXED = "row long, doc_id long, seq int, parts int, apart boolean, hi long, lo long, ids binary, starts binary, text binary"  # ids of a whole document have 32 bits, those of parts are narrower


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shared_chunks(rows: DataFrame, vocabulary: Callable[[], str], sizes: tuple[int, int, int]) -> DataFrame:
    """(hi, lo, n): digests of chunks that occur more than once."""

    def run(batches):
        e = encoder(vocabulary())
        for whole in batches:
            for batch in pieces(whole):
                found = []
                for t in batch.column("text").to_pylist():
                    for s in e.segments(t):
                        if isinstance(s, str):
                            data, at = s.encode(), 0
                            for c in cuts(data, *sizes):
                                found.append(digest(data[at:c]))
                                at = c
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), pa.array([w for _, w in found], pa.int64())], ["hi", "lo"])

    digests = rows.select("text").mapInArrow(run, "hi long, lo long")
    return digests.groupBy("hi", "lo").agg(F.count("*").alias("n")).filter("n > 1")


def encode(
    docs: DataFrame,
    vocabulary: Callable[[], str],
    id_col: str = "doc_id",
    text_col: str = "text",
    sizes: tuple[int, int, int] = (LEAST, USUAL, MOST),
) -> DataFrame:
    """doc_id, n_tokens, ids: little-endian unsigned 32-bit integers in a binary column."""
    if min(sizes) < 32 or sizes[1] & (sizes[1] - 1):
        raise ValueError("chunks have at least 32 bytes, and their usual size is a power of two")
    rows = _rows(docs, id_col, text_col)
    sc = rows.sparkSession.sparkContext
    shared = cut_lineage(shared_chunks(rows, vocabulary, sizes))
    n_places = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = sc.broadcast(hash_bits(shared, "hi", "lo"))

    def take_apart(batches):
        """Rows of each document's parts: encoded in place, or the digest of a shared chunk, with its text where the task meets it first."""
        e, known, met = encoder(vocabulary()), bits.value, set()
        for whole in batches:
            for batch in pieces(whole):
                out = []
                for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                    parts = []  # (apart, hi, lo, bytes)
                    for s in e.segments(text):
                        if isinstance(s, int):
                            parts.append((True, None, None, s))
                            continue
                        data, at, apart, open_ = s.encode(), 0, True, -1
                        ends = cuts(data, *sizes)
                        pairs = np.array([digest(data[a:b]) for a, b in zip([0, *ends], ends)], np.int64).reshape(-1, 2)
                        again = hash_found(known, np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))
                        for c, (hi, lo), met_again in zip(ends, pairs.tolist(), again.tolist()):
                            if met_again:
                                parts.append((apart, hi, lo, data[at:c]))
                                open_ = -1
                            elif open_ >= 0:
                                parts[-1] = (*parts[-1][:3], data[open_:c])
                            else:
                                parts.append((apart, None, None, data[at:c]))
                                open_ = at
                            at, apart = c, False
                    n = len(parts)
                    for k, (apart, hi, lo, data) in enumerate(parts):
                        ids = starts = chunk = None
                        if hi is not None:
                            if (hi, lo) not in met:
                                if len(met) > 500_000:
                                    met.clear()
                                met.add((hi, lo))
                                chunk = data
                        elif isinstance(data, int):
                            ids, starts = np.array([data], "<u4" if n == 1 else e.type).tobytes(), _packed(np.zeros(1, np.int64), 1)
                        elif n == 1:
                            ids = np.frombuffer(b"".join(e.words(data.decode())), e.type).astype("<u4").tobytes()
                        else:
                            made, at = e.encode(data.decode())
                            ids, starts = made.tobytes(), _packed(at, len(made))
                        out.append((row, doc_id, k, n, apart, hi, lo, ids, starts, chunk))
                    if n == 0:
                        out.append((row, doc_id, 0, 1, True, None, None, b"", None, None))
                yield _batch(out, MIXED)

    mixed = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text").mapInArrow(take_apart, MIXED)
    mixed = cut_dense(mixed)

    def encode_chunks(batches):
        e = encoder(vocabulary())
        for b in batches:
            out = []
            for hi, lo, text in zip(*(b.column(c).to_pylist() for c in ("hi", "lo", "text"))):
                ids, starts = e.encode(text.decode())
                out.append((hi, lo, ids.tobytes(), _packed(starts, len(ids))))
            yield _batch(out, CODED)

    chunks = mixed.filter("text is not null").groupBy("hi", "lo").agg(F.first("text").alias("text"))
    coded = cut_dense(chunks.mapInArrow(encode_chunks, CODED))
    places = mixed.filter("hi is not null").select("row", "doc_id", "seq", "apart", "hi", "lo")
    # At most a thousand chunks have more than a thousandth of all places each.
    hot = F.broadcast(cut_lineage(shared.filter(F.col("n") * 1000 > n_places).select("hi", "lo")))
    often = places.join(F.broadcast(coded.join(hot, ["hi", "lo"], "left_semi")), ["hi", "lo"])
    others = places.join(hot, ["hi", "lo"], "left_anti").join(coded, ["hi", "lo"])
    named = ("row", "doc_id", "seq", "apart", "ids", "starts")
    own = mixed.filter("parts > 1 and hi is null").select(*named)
    together = own.unionByName(often.select(*named)).unionByName(others.select(*named))

    def put_together(batches):
        e = encoder(vocabulary())
        group: list[tuple] = []

        def closed():
            pieces_, now = [], []
            for _, _, apart, ids, starts in group:
                if apart and now:
                    pieces_ += repaired(now, e)
                    now = []
                ids = np.frombuffer(ids, e.type)
                now.append((ids, _unpacked(starts, len(ids))))
            pieces_ += repaired(now, e)
            return group[0][1], np.concatenate([p[0] for p in pieces_]).astype("<u4").tobytes()

        out, size = [], 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "apart", "ids", "starts"))):
                if group and r[0] != group[0][0]:
                    out.append(closed())
                    size += len(out[-1][1])
                    group = []
                    if size > 1_000_000:
                        yield _batch(out, CLOSED)
                        out, size = [], 0
                group.append(r)
        if group:
            out.append(closed())
        yield _batch(out, CLOSED)

    by_row = together.repartition("row").sortWithinPartitions("row", "seq")
    assembled = by_row.mapInArrow(put_together, CLOSED)
    whole = mixed.filter("parts = 1 and hi is null").select("doc_id", "ids")

    return whole.unionByName(assembled).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


CODED, CLOSED, ENCODED = "hi long, lo long, ids binary, starts binary", "doc_id long, ids binary", "doc_id long, n_tokens long, ids binary"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _TYPES[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _packed(starts: np.ndarray, n: int) -> bytes:
    """A bit for each id: it begins a pre-token."""
    marks = np.zeros(n, bool)
    marks[starts] = True
    return np.packbits(marks).tobytes()


def _unpacked(starts: bytes, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(starts, np.uint8), count=n))


def decode(encoded: DataFrame, vocabulary: Callable[[], str]) -> DataFrame:
    """Adds `decoded`, the text that the library decodes, special tokens included."""

    def run(batches):
        library = splitter(vocabulary()).library
        for whole in batches:
            for b in pieces(whole, "ids"):
                ids = [np.frombuffer(x or b"", "<u4").tolist() for x in b.column("ids").to_pylist()]
                out = library.decode_batch(ids, skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"{ENCODED}, decoded string")
