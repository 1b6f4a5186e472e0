"""Merkle manifest of a data set, with witnesses that grow while leaves are appended.

Every row is a leaf, every value of `tree` has a tree of its own over its leaves in the order of the
key, and the subroots, in the order of the tree's name, are the leaves of the last tree. While a level
has more than one node, two neighbours become one; a last one without neighbour is hashed alone.

Leaves are appended to open subtrees (at most one for each height). A leaf starts with an empty
witness; when two open subtrees of the same height meet, the root of each is added to the witnesses
of all leaves of the other. Blocks of `BLOCK` aligned leaves are appended side by side by all tasks; the
block roots are then appended in the same way, and what a block root's witness holds extends those
of its leaves. No task holds more than a block, and N leaves take log N / log BLOCK rounds.

Positions come from a sort by range and a count for each partition and tree, so a tree that holds
most of the rows is spread like the others; equal rows are told apart by an arbitrary number.

Defined results: leaves without key come first, a missing tree name is a tree of its own and the
first one; rows with the same key are ordered by their digests; repeated rows are leaves each; null
fields are `-`, an empty text is `0:`; an empty table has no rows and no root; other columns are neither
hashed nor carried, but for `row`, which the caller may fill.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

#: Leaves that are appended to one another in a task.
BLOCK_BITS = 12
LEFT, RIGHT, ALONE = b"LR-"


def parent(*children: bytes) -> bytes:
    """Digest of a run of nodes, which are joined as lower-case hex."""
    return sha256("".join(c.hex() for c in children).encode()).digest()


def leaf_digest(*fields: str | Column) -> Column:
    """SHA-256 over all fields, each as its number of bytes, a colon and its text, or `-` for null."""

    def framed(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*(framed(F.col(c) if isinstance(c, str) else c) for c in fields)), 256))


class OpenTree:
    """Subtrees that wait for a neighbour, and the witnesses of all leaves so far, for up to `room` leaves, which `height` levels lead up from."""

    def __init__(self, room: int, height: int = 0):
        levels = max((room - 1).bit_length(), height, 1)
        self.n = 0
        self.open: list[tuple[int, int, bytes]] = []  # height, first leaf, root
        self.witness = np.zeros((room, levels, 32), np.uint8)
        self.side = np.zeros((room, levels), np.uint8)  # 0: not yet known

    def append(self, digest: bytes) -> None:
        self.open.append((0, self.n, digest))
        self.n += 1
        while self._meet():
            pass

    def _meet(self) -> bool:
        """Joins the last two open subtrees if they have the same height."""
        if len(self.open) < 2 or self.open[-2][0] != self.open[-1][0]:
            return False
        (height, first, left), (_, second, right) = self.open[-2:]
        self.witness[first:second, height] = np.frombuffer(right, np.uint8)
        self.side[first:second, height] = RIGHT
        self.witness[second : self.n, height] = np.frombuffer(left, np.uint8)
        self.side[second : self.n, height] = LEFT
        self.open[-2:] = [(height + 1, first, parent(left, right))]
        return True

    def close(self, height: int = 0) -> bytes:
        """No leaf follows: what waits goes up alone until one root of at least this height is left."""
        while len(self.open) > 1 or self.open[0][0] < height:
            if not self._meet():
                up, first, digest = self.open[-1]
                self.side[first : self.n, up] = ALONE
                self.open[-1] = (up + 1, first, parent(digest))
        return self.open[0][2]

    def witnesses(self) -> tuple[list[str], list[bytes]]:
        """For each leaf, the way up (a letter for each level) and the siblings on it."""
        height = self.open[0][0]
        side, siblings = self.side[: self.n, :height], self.witness[: self.n, :height]
        ways = [s.tobytes().decode() for s in side]
        return ways, [w[s != ALONE].tobytes() for w, s in zip(siblings, side)]


def climb(leaf: bytes, way: str, siblings: bytes) -> bytes:
    """The root that a leaf and its witness lead to."""
    at = 0
    for step in way:
        if step == "-":
            leaf = parent(leaf)
            continue
        other, at = siblings[at : at + 32], at + 32
        leaf = parent(other, leaf) if step == "L" else parent(leaf, other)
    return leaf


def positioned(leaves: DataFrame, tree: str, *order: str) -> DataFrame:
    """Adds pos (from 0) and total within the tree, without a window over its rows."""
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    told_apart = leaves.withColumn("_any", F.monotonically_increasing_id())
    ranged = told_apart.repartitionByRange(*keys, "_any").sortWithinPartitions(*keys).drop("_any")
    stored = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    runs = stored.groupBy(F.col(tree).alias("_tree"), F.col("_part").alias("_run")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # One row for each partition and tree that meet: at most partitions + trees.
    whole = Window.partitionBy("_tree")
    before = whole.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut_lineage(
        runs.select("_tree", "_run", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(whole).alias("total"))
    )
    joined = stored.join(runs, F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_run")))
    out = joined.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_start"))
    return out.drop("_part", "_at", "_tree", "_run", "_first", "_start")


def appended(nodes: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(tree, pos, total, digest, ...) -> the same rows with way, siblings and top, the root of their tree."""
    size = 1 << block_bits
    schema = nodes.schema

    def block(table: pa.Table) -> pa.Table:
        table = table.take(pa.compute.sort_indices(table.column("pos")))
        total = table.column("total")[0].as_py()
        height = block_bits if total > size else 0
        tree = OpenTree(table.num_rows, height)
        for d in table.column("digest").to_pylist():
            tree.append(d)
        top = tree.close(height)
        ways, siblings = tree.witnesses()
        kept = table.select([f.name for f in schema.fields])
        return (
            kept.append_column("way", pa.array(ways, pa.string()))
            .append_column("siblings", pa.array(siblings, pa.binary()))
            .append_column("top", pa.array([top] * len(ways), pa.binary()))
        )

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    numbered = nodes.groupBy("tree", F.shiftright("pos", block_bits).alias("_block"))
    inner = cut_lineage(numbered.applyInArrow(block, f"{names}, way string, siblings binary, top binary"))
    longest = inner.agg(F.max("total")).first()[0] or 0
    if longest <= size:
        return inner
    roots = inner.filter(F.col("pos") % size == 0).select(
        "tree", F.shiftright("pos", block_bits).alias("pos"), F.ceil(F.col("total") / size).alias("total"), F.col("top").alias("digest")
    )
    upper = appended(roots, block_bits).select(
        F.col("tree").alias("_tree"), F.col("pos").alias("_block"), F.col("way").alias("_way"), F.col("siblings").alias("_siblings"), F.col("top").alias("_top")
    )
    joined = inner.join(upper, F.col("tree").eqNullSafe(F.col("_tree")) & (F.shiftright("pos", block_bits) == F.col("_block")))
    own = [F.col(f.name) for f in schema.fields]
    more = (F.concat("way", "_way").alias("way"), F.concat("siblings", "_siblings").alias("siblings"), F.col("_top").alias("top"))
    return joined.select(*own, *more)


def manifest(leaves: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(tree, key, leaf, row) -> row, leaf, way, siblings (32 bytes each), subroot, root.

    `way` and `siblings` lead from the leaf through its subroot to the root.
    """
    placed = positioned(leaves.select("tree", "key", "leaf", "row"), "tree", "key", "leaf")
    grown = cut_lineage(appended(placed.select("tree", "pos", "total", F.col("leaf").alias("digest"), "row"), block_bits))
    # A row for each tree: its first leaf knows the subroot.
    subroots = grown.filter("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("digest"))
    trees = positioned(subroots, "tree", "name")
    last = appended(trees.select("tree", "pos", "total", "digest", "name"), block_bits)
    last = cut_lineage(last.select("name", F.col("way").alias("_way"), F.col("siblings").alias("_siblings"), F.col("top").alias("root")))
    return grown.join(last, F.col("tree").eqNullSafe(F.col("name"))).select(
        "row",
        F.col("digest").alias("leaf"),
        F.concat("way", "_way").alias("way"),
        F.concat("siblings", "_siblings").alias("siblings"),
        F.col("top").alias("subroot"),
        "root",
    )


def folded(proofs: DataFrame, leaf: str, out: str = "folded_root") -> DataFrame:
    """Adds the root that the digest in column `leaf` and the row's witness lead to."""

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("_given", "way", "siblings")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([climb(*r) for r in rows], pa.binary())], [*b.schema.names, out])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proofs.schema.fields)
    given = proofs.withColumn("_given", F.col(leaf))
    return given.mapInArrow(run, f"{names}, _given binary, `{out}` binary").drop("_given")
