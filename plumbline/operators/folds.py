"""Row partitioning for validation: hash folds, exact folds, splits and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import ordering
from plumbline.functions.keys import hash_fold, seeded_digest, seeded_int, seeded_uniform
from plumbline.functions.ordering import ordered_counts
from plumbline.session import cut_lineage


def with_folds(df: DataFrame, key: str, k: int, seed: int = 42, column: str = "outer_fold") -> DataFrame:
    """Fold 0..k-1 from the row key alone: no shuffle, and stable when rows are added."""
    return df.withColumn(column, hash_fold(key, seed, k))


def with_exact_folds(
    df: DataFrame, key: str, k: int, seed: int = 42, column: str = "outer_fold"
) -> DataFrame:
    """Shuffled folds whose sizes differ by at most one; ``key`` must be unique.

    The global position comes from independently sorted ranges, not from one big sort. Rows are spread by the
    digest once; what is written is the key and its place in its range.
    """
    # Bytes of a digest order as its hex text does. Without a key, rows count as the smallest.
    digest = F.when(F.col(key).isNotNull(), F.unhex(seeded_digest(key, seed)))
    keyed = df.select(digest.alias("__h"), F.col(key).alias("__k"))
    text = F.col("__k").cast("string")
    parts = max(1, -(-df.count() // ordering.TARGET_ROWS))
    in_order = keyed.repartitionByRange(parts, F.col("__h"), text).sortWithinPartitions(F.col("__h"), text)
    # Written: the bounds come from a sample, and a row's place is counted in the order of its range.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = cut_lineage(in_order.select("__k", F.spark_partition_id().alias("__part"), place.alias("__place")))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    offsets = cut_lineage(sizes.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset")))
    before = F.min(F.col("__offset") + F.col("__place"))  # rows that share a key share their first position
    position = ranged.join(offsets, "__part").groupBy("__k").agg((before % k).cast("int").alias(column))
    return df.join(position, df[key] == position["__k"]).drop("__k")


def inner_seed(seed: int, outer_fold: int) -> int:
    """Seed of an outer fold's inner split; never the outer seed, or the two would coincide."""
    return seed + outer_fold + 1


def with_inner_folds(
    df: DataFrame, key: str, outer_fold: int, k: int, seed: int = 42, column: str = "inner_fold"
) -> DataFrame:
    """Inner folds of one outer-train set; held-out rows get null."""
    fold = hash_fold(key, inner_seed(seed, outer_fold), k)
    return df.withColumn(column, F.when(F.col("outer_fold") != outer_fold, fold))


def nested_folds(df: DataFrame, key: str, outer: int, inner: int, seed: int = 42) -> DataFrame:
    """Every (outer, inner) assignment as an array column: inner fold per outer split."""
    base = with_folds(df, key, outer, seed)
    inner_cols = [
        F.when(F.col("outer_fold") != o, hash_fold(key, inner_seed(seed, o), inner)) for o in range(outer)
    ]
    return base.withColumn("inner_folds", F.array(*inner_cols))


def with_holdout(df: DataFrame, key: str, fraction: float = 0.25, seed: int = 42) -> DataFrame:
    """Boolean column ``is_valid``, true for about ``fraction`` of the rows."""
    return df.withColumn("is_valid", seeded_uniform(key, seed) < fraction)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement (TakeOrdered: each task keeps n candidates)."""
    return df.orderBy(seeded_int(key, seed), F.col(key)).limit(n)


def sample_per_group(df: DataFrame, groups: Sequence[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows per group; the rank filter is pushed before the shuffle as a group limit."""
    order = W.partitionBy(*groups).orderBy(seeded_int(key, seed), F.col(key))
    return (
        df.withColumn("sample_rank", F.row_number().over(order)).filter(F.col("sample_rank") <= n)
    )


def evenly_spaced(sample: DataFrame, order_by: Sequence[str], m: int, groups: Sequence[str] = ()) -> DataFrame:
    """m rows at floor(linspace(0, n-1, m)) of each group (or of all rows), with their position.

    Keys are ranked by counts in ranges, so no task orders a whole group. Rows with equal keys share
    their first position.
    """
    by = list(groups) or ["__all"]
    rows = sample if groups else sample.withColumn("__all", F.lit(0))
    key = F.struct(*order_by) if len(order_by) > 1 else F.col(order_by[0])
    rows = rows.withColumn("__order", key)
    placed = ordered_counts(rows.select(*by, "__order"), by, "__order")
    size = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    picks = F.least(F.lit(m).cast("bigint"), F.col("__n"))
    wanted = F.transform(
        F.sequence(F.lit(0).cast("bigint"), picks - 1),
        lambda i: F.floor(i * (F.col("__n") - 1).cast("double") / F.greatest(picks - 1, F.lit(1))),
    )
    slots = cut_lineage(size.select(*by, F.explode(wanted).alias("__slot")))  # written: its small size is known
    found = slots.join(placed, by).filter((F.col("__slot") >= F.col("before")) & (F.col("__slot") < F.col("before") + F.col("cnt")))
    found = cut_lineage(found.select(*by, "__order", F.col("__slot").cast("int").alias("instance_index")))
    return rows.join(found, [*by, "__order"]).drop("__order", "__all")
