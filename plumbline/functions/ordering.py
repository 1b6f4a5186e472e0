"""Exact order statistics for groups of any size.

A plain window sorts a whole group in one task and the built-in exact percentile holds all
distinct values of a group in one buffer. Both break when one group holds a third of the table.
The functions here count equal values first (map-side combine), keep only a narrow bracket around the
wanted quantile (percentiles), and order what is left by a sample sort with carried totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.session import cut_lineage


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; keeps the left side's key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


#: Counted rows that one task orders.
TARGET_ROWS = 250_000


def ordered_counts(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: Column | None = None,
    extra: dict[str, Column] | None = None,
    neighbours: bool = False,
    target: int | None = None,
) -> DataFrame:
    """One row per (keys, value): ``cnt`` rows with it, ``before`` rows with a smaller value.

    Equal values are counted first, then ``placed`` orders the counts.
    """
    keys = list(keys)
    weight = F.lit(1) if weight is None else weight
    extra = extra or {}
    counts = df.groupBy(*keys, value).agg(F.sum(weight).cast("bigint").alias("cnt"), *[c.alias(n) for n, c in extra.items()])
    return placed(counts, keys, value, neighbours, target)


def placed(counts: DataFrame, keys: Sequence[str], value: str, neighbours: bool = False, target: int | None = None) -> DataFrame:
    """Adds ``before``, the sum of ``cnt`` over smaller values, to rows that are unique in (keys, value).

    A sample sort: all rows are spread by range of (keys, value), about ``target`` to a partition;
    each partition adds up its own stretch of a group, and the totals of a group's earlier partitions are
    carried over. No task orders more than a partition, however large a group is, and the way is
    the same at every size. Rows of weight 0 are placed but not counted. ``neighbours`` adds ``below``, the
    largest smaller counted value, and ``at_least``, the smallest counted value that is not smaller.
    """
    keys = list(keys)
    counts = cut_lineage(counts)
    parts = max(1, -(-counts.count() // (target or TARGET_ROWS)))
    # Written: the bounds come from a sample, so that another evaluation could cut elsewhere.
    ranged = cut_lineage(counts.repartitionByRange(parts, *keys, value).withColumn("__part", F.spark_partition_id()))
    counted = F.when(F.col("cnt") > 0, F.col(value))
    in_order = W.partitionBy(*keys).orderBy("__part")
    earlier = in_order.rowsBetween(W.unboundedPreceding, -1)
    later = in_order.rowsBetween(1, W.unboundedFollowing)
    inside = W.partitionBy(*keys, "__part").orderBy(value)
    inside_before = inside.rowsBetween(W.unboundedPreceding, -1)
    inside_from = inside.rowsBetween(0, W.unboundedFollowing)
    totals = ranged.groupBy(*keys, "__part").agg(
        F.sum("cnt").alias("__n"), F.max(counted).alias("__hi"), F.min(counted).alias("__lo")
    )
    # One row for each group and partition that meet: at most groups + partitions.
    offsets = totals.select(
        *keys,
        "__part",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"),
        *(
            [F.max("__hi").over(earlier).alias("__left"), F.min("__lo").over(later).alias("__right")]
            if neighbours
            else []
        ),
    )
    before = F.col("__offset") + F.coalesce(F.sum("cnt").over(inside_before), F.lit(0))
    out = join_on(ranged, cut_lineage(offsets), [*keys, "__part"]).withColumn("before", before.cast("bigint"))
    if neighbours:
        out = out.withColumns(
            {
                "below": F.coalesce(F.max(counted).over(inside_before), F.col("__left")),
                "at_least": F.coalesce(F.min(counted).over(inside_from), F.col("__right")),
            }
        )
    return out.drop("__part", "__offset", "__left", "__right")


def average_rank(cnt: str = "cnt", before: str = "before") -> Column:
    """Mean of the 1-based ranks that equal values share."""
    return F.col(before) + (F.col(cnt) + 1) / F.lit(2.0)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    accuracy: int = 10_000,
    target: int | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per group; one row per group, one column per entry of ``probs``.

    A sketch brackets each quantile. Smaller values collapse into one counter, larger ones are
    dropped and the roughly ``6/accuracy`` of the group inside the bracket is counted by value and
    ordered exactly, ``target`` values to a task. Nulls and NaNs are ignored. At least one key is needed.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).filter(
        F.col("__v").isNotNull() & ~F.isnan("__v")
    )
    names = list(probs)
    # the sketch may be off by one part in ``accuracy``; the rest covers interpolation neighbours
    margin = 3.0 / accuracy
    ends = []
    for n in names:
        ends += [max(0.0, probs[n] - margin), min(1.0, probs[n] + margin)]
    bounds = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min("__v").alias("__min"),
        F.max("__v").alias("__max"),
        F.percentile_approx("__v", ends, accuracy).alias("__b"),
    )
    # groups this small are kept whole: a margin of a few ranks would miss their neighbours
    whole = F.col("__n") <= accuracy
    specs = F.array(
        *[
            F.struct(
                F.lit(n).alias("name"),
                (F.lit(float(probs[n])) * (F.col("__n") - 1)).alias("pos"),
                F.when(whole | F.lit(ends[2 * i] == 0.0), F.col("__min"))
                .otherwise(F.element_at("__b", 2 * i + 1))
                .alias("lo"),
                F.when(whole | F.lit(ends[2 * i + 1] == 1.0), F.col("__max"))
                .otherwise(F.element_at("__b", 2 * i + 2))
                .alias("hi"),
            )
            for i, n in enumerate(names)
        ]
    )
    # written first: with a measured size the planner broadcasts it when it is small, instead of
    # shuffling all rows by a possibly hot key
    bounds = cut_lineage(bounds.select(*keys, specs.alias("__specs")))
    bracketed = (
        join_on(rows, bounds, keys)
        .select(*keys, "__v", F.explode(F.filter("__specs", lambda x: F.col("__v") <= x["hi"])).alias("s"))
        .groupBy(
            *keys,
            F.col("s.name").alias("__name"),
            F.col("s.pos").alias("__pos"),
            F.when(F.col("__v") < F.col("s.lo"), F.lit(None)).otherwise(F.col("__v")).alias("__v"),
        )
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    ranked = placed(bracketed, [*keys, "__name"], "__v", target=target).select(
        *keys, "__name", "__pos", "__v", F.col("before").alias("__start"), (F.col("before") + F.col("cnt")).alias("__end")
    )
    low, high = F.floor("__pos"), F.ceil("__pos")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("__start") <= rank) & (rank < F.col("__end")), F.col("__v")))

    picked = ranked.groupBy(*keys, "__name").agg(
        at(low).alias("__lv"), at(high).alias("__hv"), F.max(F.col("__pos") - low).alias("__frac")
    )
    picked = picked.withColumn(
        "__q", F.col("__lv") + (F.col("__hv") - F.col("__lv")) * F.col("__frac")
    )
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("__name") == n, F.col("__q"))).alias(n) for n in names]
    )
