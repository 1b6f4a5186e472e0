"""Benchmark decontamination: pigeonhole pieces, then Myers' bit-parallel distance.

Texts and items are lower-cased and runs of white space become one blank. An item may match with up
to k errors (`rate` times its length, with pieces of at least MIN_PIECE characters). Cut into k + 1
pieces, at least one piece is untouched in every such match. All pieces are searched at once in one
pass over a text; around each hit the item is verified with Myers' algorithm on a window that
holds every match through that piece.

The items are a query set: they are taken in blocks of at most BLOCK_CHARS characters, each
broadcast and searched in the same pass over the rows, without a shuffle.

Defined results: a null or empty text has no hits; null items and items shorter than MIN_ITEM
characters are no evidence and match nothing; items with equal text are searched once and all their
ids are reported; repeated rows get the same hits each; null ids stay; an empty table gives an empty
table, and without items nothing is hit; the hits go by row, so other columns pass through untouched.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from plumbline.llm.common import in_small_batches, pieces

RATE, MIN_PIECE, MIN_ITEM = 0.08, 8, 20
#: Characters of items that are broadcast at once.
BLOCK_CHARS = 8_000_000

HIT = StructType([StructField(n, LongType()) for n in ("item_id", "start", "end", "distance")])


def lowered(text: str) -> str:
    """Lower case, character by character: the length stays."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return low


def normalise(text: str) -> str:
    return " ".join(lowered(text).split())


def offsets(text: str) -> list[int]:
    """For each character of the normalised text its place in the text, and the end after the last one."""
    out: list[int] = []
    for m in re.finditer(r"\S+", lowered(text)):
        if out:
            out.append(out[-1] + 1)
        out.extend(range(m.start(), m.end()))
    return out


def budget(length: int, rate: float) -> int:
    return max(0, min(int(length * rate), length // MIN_PIECE - 1))


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_end(peq: dict[str, int], m: int, text: str, k: int, anchored: bool = False) -> tuple[int, int] | None:
    """(distance, end) of the best match of a pattern that ends in text, with at most k errors; the
    first of equal ones. It may start anywhere, or only at 0 if anchored."""
    full = (1 << m) - 1
    top = 1 << m - 1
    pv, mv, score, found, left = full, 0, m, None, len(text)
    for at, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | anchored) & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        left -= 1
        if score <= k and (found is None or score < found[0]):
            found = (score, at + 1)
        if score - left > k and found is None:
            return None
    return found


class Block:
    """Items of one block: the automaton over all pieces, and what verification needs."""

    def __init__(self, items: list[tuple[str, list[int]]], rate: float):
        import ahocorasick

        self.items = [(t, ids, budget(len(t), rate), masks(t), masks(t[::-1])) for t, ids in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for j, (t, _, k, _, _) in enumerate(self.items):
            for p in range(k + 1):
                a, b = p * len(t) // (k + 1), (p + 1) * len(t) // (k + 1)
                where.setdefault(t[a:b], []).append((j, a))
        self.find = ahocorasick.Automaton()
        for piece, at in where.items():
            self.find.add_word(piece, (len(piece), at))
        if where:
            self.find.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, distance) in the given text, one for each item and place."""
        norm, out = normalise(text), []
        done: dict[int, tuple[int, int]] = {}  # of each item, the stretch of starts that is dealt with
        for last, (size, at) in self.find.iter(norm) if len(self.find) else ():
            for j, a in at:
                t, ids, k, peq, back = self.items[j]
                start = last + 1 - size - a
                if j in done and done[j][0] <= start <= done[j][1]:
                    continue
                low = max(0, start - k)
                window = norm[low : start + len(t) + k]
                found = best_end(peq, len(t), window, k)
                if found is None:
                    done[j] = (start, start)
                    continue
                d, end = found
                _, length = best_end(back, len(t), window[:end][::-1], d, True)
                begin = low + end - length
                done[j] = (begin - k, begin + len(t) - 1)
                out.append((ids, begin, low + end, d))
        if not out:
            return []
        place = offsets(text)
        return sorted((i, place[a], place[b - 1] + 1, d) for ids, a, b, d in out for i in ids)


def _blocks(items: DataFrame, id_col: str, text_col: str, limit: int):
    """The items in blocks of at most `limit` characters or so, each as (normalised text, ids)."""
    kept = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("t is not null and i is not null")
    total = kept.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-2 * total // limit)) if total > limit else 1
    for k in range(n):
        found: dict[str, list[int]] = {}
        for r in kept.filter(F.pmod(F.xxhash64(F.trim("t")), F.lit(n)) == k).sort("i").toLocalIterator():
            t = normalise(r["t"])
            if len(t) >= MIN_ITEM:
                found.setdefault(t, []).append(r["i"])
        if found:
            yield sorted(found.items())


def find_items(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    rate: float = RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(row: the whole input row, hits: array of item_id, start, end, distance), offsets in code points."""
    context = docs.sparkSession.sparkContext
    columns = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    out = in_small_batches(docs).select(columns, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.array().cast(ArrayType(HIT)).alias("hits"))

    def searcher(shared):
        def run(batches):
            block = Block(shared.value, rate)
            kind = pa.list_(pa.struct([(f.name, pa.int64()) for f in HIT]))
            for whole in batches:
                for batch in pieces(whole):
                    hits = []
                    for t, had in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist()):
                        new = [dict(zip(("item_id", "start", "end", "distance"), h)) for h in block.hits(t)]
                        hits.append((had or []) + new)
                    yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(hits, kind)], ["row", "text", "hits"])

        return run

    for block in _blocks(items, item_id, item_text, block_chars):
        out = out.mapInArrow(searcher(context.broadcast(block)), out.schema)
    return out.select("row", "hits")


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows without a hit, with their own columns."""
    return find_items(docs, items, text_col, **options).filter(F.size("hits") == 0).select("row.*")
