"""Small helpers that the operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import cut_lineage, scratch_path

#: White space that separates words, as bytes: blank, tab, line feed, vertical tab, form feed, return.
SPACE = r"\x20\x09-\x0D"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Lowers the session's rows for an Arrow batch, so that long texts stay small beside a worker's own data."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, rows)
    return df


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), under fixed names: other columns can't clash."""
    return in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, over several tasks.

    The package is pickled by value, so its own module globals are new in every task.
    """
    return sys.modules.setdefault("_plumbline_worker", types.ModuleType("_plumbline_worker")).__dict__


def once(key: tuple, make: Callable):
    cache = worker_cache()
    if key not in cache:
        cache[key] = make()
    return cache[key]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` text bytes, so that what is derived stays small; a row is never cut."""
    sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def cut_narrow(df: DataFrame) -> DataFrame:
    """cut_lineage for tables of ids, with an eighth of the shuffle partitions.

    The number of partitions suits texts, which have a hundred times the bytes of their ids; one file
    for each partition would be many tiny files.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.coalesce(max(6, n // 8)))


def hashed_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most n rows, those with the smallest hashes of their keys.

    A cut at the expected share comes first, so that little more than n rows ever meet in one task.
    """
    total, h = df.count(), F.xxhash64(*keys)
    span = 1 << 40
    share = 1.0 if total <= n else min(1.0, (n + 4 * n**0.5) / total)
    near = df if share >= 1 else df.filter(F.pmod(h, F.lit(span)) < int(share * span))
    return near.orderBy(F.pmod(h, F.lit(span)), *keys).limit(n)


def cut_dense(df: DataFrame) -> DataFrame:
    """cut_lineage for wide columns of numbers, which the denser compression makes a quarter smaller."""
    path = scratch_path(df.sparkSession, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that their owner removes again, at the latest with the `with` block.

    A table is written once and read back, as with cut_lineage; frames that are still to be read after
    the block don't belong here.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*self.paths)

    def write(self, df: DataFrame, *partition_by: str) -> tuple[DataFrame, str]:
        path = scratch_path(self.spark, "scratch")
        self.paths.append(path)
        df.write.partitionBy(*partition_by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, *paths: str) -> None:
        for p in paths:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.paths = [p for p in self.paths if p not in paths]


def marked_slots(positions: DataFrame, slots: int) -> np.ndarray:
    """Which of `slots` numbers occur in the only column, as booleans: slots / 8 bytes reach the driver at most."""
    p = F.col(positions.columns[0]) + 1
    bits = positions.groupBy(F.bitmap_bucket_number(p).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("bits"))
    out = np.zeros(-(-slots // 32768) * 32768, bool)
    for bucket, found in bits.collect():  # at most slots / 32768 rows of 4 KB
        out[(bucket - 1) * 32768 : bucket * 32768] = np.unpackbits(np.frombuffer(bytes(found), np.uint8), bitorder="little").astype(bool)
    return out[:slots]


def hash_bits(rows: DataFrame, *hashes: str, most: int = 1 << 27) -> np.ndarray:
    """A bit array in which two bits of every row are set: 16 bits for each row, at most `most` bits (16 MB).

    The two bits come from both halves of one 64-bit hash, or from two hashes.
    """
    n, size = rows.count(), 1 << 16
    while size < min(16 * n, most):
        size *= 2
    first = F.col(hashes[0])
    second = F.col(hashes[1]) if len(hashes) > 1 else F.shiftrightunsigned(first, 32)
    mask = F.lit(size - 1).cast("long")
    both = F.explode(F.array(first.bitwiseAND(mask), second.bitwiseAND(mask)))
    return np.packbits(marked_slots(rows.select(both), size), bitorder="little")


def hash_found(bits: np.ndarray, first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """Which 64-bit hashes may be among the rows of `hash_bits`; those that are, always."""
    mask = np.uint64(8 * len(bits) - 1)
    first = np.asarray(first).view(np.uint64)
    second = first >> np.uint64(32) if second is None else np.asarray(second).view(np.uint64)

    def is_set(h: np.ndarray) -> np.ndarray:
        h = h & mask
        return bits[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8) & 1 == 1

    return is_set(first) & is_set(second)


def maybe_among(ids: DataFrame) -> Callable[[Column], Column]:
    """A test of a bigint column: true for all values of the only column of `ids`, and for few others.

    Long texts can so be left out before a join by shuffle. What is sent has 16 MB at most; from some ten million
    ids on more others pass. `ids` is read twice, so it should be written.
    """
    h = lambda c: F.xxhash64(c.cast("long"))
    sent = ids.sparkSession.sparkContext.broadcast(hash_bits(ids.select(h(F.col(ids.columns[0])).alias("h")), "h"))
    found = F.pandas_udf(lambda hashes: pd.Series(hash_found(sent.value, hashes.to_numpy())), "boolean")
    return lambda c: found(h(c))
