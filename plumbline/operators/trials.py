"""Analytics over a tuning log: sensitivity, coverage, pruning, stopping, aggregation."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.ordering import average_rank, exact_quantiles, join_on, ordered_counts
from plumbline.operators.schema import is_finite
from plumbline.session import cut_lineage

PARAM_PREFIX = "param__"
GROUP = ["model", "base_model", "residual_kind", "metric", "direction"]


def completed(trials: DataFrame) -> DataFrame:
    """Completed trials with a finite value; without a state column every trial counts."""
    if "state" in trials.columns:
        trials = trials.filter(F.col("state") == "COMPLETE")
    value = F.col("value").try_cast("double")
    return trials.withColumn("value", value).filter(is_finite(F.col("value")))


def parameter_cells(trials: DataFrame, min_trials: int = 3) -> DataFrame:
    """(group, parameter, level, score, cnt): trials counted per distinct (level, score).

    Everything below works on these counts, so repeated settings shrink before any shuffle.
    Parameters with fewer than ``min_trials`` trials or one single value are left out.
    """
    df = completed(trials)
    cols = [c for c in df.columns if c.startswith(PARAM_PREFIX)]
    long = (
        df.select(*GROUP, F.col("value").alias("score"), *[F.col(c).cast("string").alias(c) for c in cols])
        .unpivot([*GROUP, "score"], cols, "parameter", "level")
        .filter("level is not null")
        .withColumn("parameter", F.expr(f"substring(parameter, {len(PARAM_PREFIX) + 1})"))
    )
    keys = [*GROUP, "parameter"]
    # written: the levels and every measure read the counts, not the log again
    cells = cut_lineage(long.groupBy(*keys, "level", "score").agg(F.count(F.lit(1)).alias("cnt")))
    levels = cells.groupBy(*keys, "level").agg(F.sum("cnt").alias("__c"))
    numeric = F.col("level").try_cast("double")
    usable = (
        levels.groupBy(*keys)
        .agg(
            F.sum("__c").alias("n_trials"),
            F.count(F.lit(1)).alias("n_unique"),
            F.bool_and(numeric.isNotNull()).alias("__numeric"),
        )
        .filter((F.col("n_trials") >= min_trials) & (F.col("n_unique") >= 2))
        .withColumn("parameter_type", F.when(F.col("__numeric"), "numeric").otherwise("categorical"))
        .drop("__numeric")
    )
    return join_on(cells, cut_lineage(usable), keys)


def spearman(cells: DataFrame, keys: Sequence[str], x: Column, y: str = "score", cnt: str = "cnt") -> DataFrame:
    """Spearman correlation per group from counted (x, y) pairs, ranks averaged over ties."""
    keys = list(keys)
    base = cells.groupBy(*keys, x.alias("__x"), F.col(y).alias("__y")).agg(F.sum(cnt).alias("__w"))
    rx = ordered_counts(base, keys, "__x", weight=F.col("__w")).select(*keys, "__x", average_rank().alias("__rx"))
    ry = ordered_counts(base, keys, "__y", weight=F.col("__w")).select(*keys, "__y", average_rank().alias("__ry"))
    ranked = join_on(join_on(base, rx, [*keys, "__x"]), ry, [*keys, "__y"])
    w, a, b = F.col("__w"), F.col("__rx"), F.col("__ry")
    sums = ranked.groupBy(*keys).agg(
        F.sum(w).cast("double").alias("n"),
        F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"),
        F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"), F.sum(w * a * b).alias("sab"),
    )
    cov = F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")
    va = F.col("n") * F.col("saa") - F.col("sa") * F.col("sa")
    vb = F.col("n") * F.col("sbb") - F.col("sb") * F.col("sb")
    return sums.select(
        *keys, F.when((va > 0) & (vb > 0), cov / (F.sqrt(va) * F.sqrt(vb))).alias("spearman_corr")
    )


def level_statistics(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, sum and mean score per (group, level); numeric levels that are equal numbers merge."""
    numeric = F.col("parameter_type") == "numeric"
    level = F.when(numeric, F.col("level").try_cast("double").cast("string")).otherwise(F.col("level"))
    order = F.when(numeric, F.col("level").try_cast("double"))
    return cells.groupBy(*keys, "parameter_type", level.alias("level")).agg(
        F.sum("cnt").alias("n"),
        (F.sum(F.col("cnt") * F.col("score")) / F.sum("cnt")).alias("mean"),
        F.first(order).alias("__order"),
    )


def eta_squared(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of the score's variance explained by the level means; 0 without variance.

    Two passes: the overall mean first, then squared deviations about it, which keeps the
    digits that sums of squares would lose.
    """
    keys = list(keys)
    overall = cells.groupBy(*keys).agg(
        (F.sum(F.col("cnt") * F.col("score")) / F.sum("cnt")).alias("__overall")
    )
    dev = F.col("score") - F.col("__overall")
    joined = join_on(cells, cut_lineage(overall), keys)
    levels = joined.groupBy(*keys, "level").agg(
        F.sum("cnt").alias("n"),
        (F.sum(F.col("cnt") * dev) / F.sum("cnt")).alias("__shift"),
        F.sum(F.col("cnt") * dev * dev).alias("__total"),
    )
    parts = levels.groupBy(*keys).agg(
        F.sum(F.col("n") * F.col("__shift") * F.col("__shift")).alias("__between"),
        F.sum("__total").alias("__total"),
    )
    return parts.select(
        *keys,
        F.when(F.col("__total") > 0, F.col("__between") / F.col("__total")).otherwise(0.0).alias("eta_squared"),
    )


def best_worst_levels(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Level with the best and the worst mean score; the lower level wins ties."""
    levels = level_statistics(cells, keys)
    tie = F.struct("__order", "level")
    up = F.col("direction") == "maximize"
    low = F.min(F.struct(F.col("mean"), tie.alias("t"), F.col("level").alias("level")))
    high = F.min(F.struct((-F.col("mean")).alias("mean"), tie.alias("t"), F.col("level").alias("level")))
    return levels.groupBy(*keys).agg(low.alias("__low"), high.alias("__high")).select(
        *keys,
        F.when(up, F.col("__high.level")).otherwise(F.col("__low.level")).alias("best_value"),
        F.when(up, F.col("__low.level")).otherwise(F.col("__high.level")).alias("worst_value"),
    )


def sensitivity_summary(trials: DataFrame, min_trials: int = 3) -> DataFrame:
    """One row per (model group, parameter): how strongly the score follows the parameter.

    Every measure reads the counted cells, so those are written once instead of being derived
    from the log again for each of them.
    """
    cells = cut_lineage(parameter_cells(trials, min_trials))
    keys = [*GROUP, "parameter"]
    numeric = cells.filter("parameter_type = 'numeric'")
    rho = spearman(numeric, keys, F.col("level").try_cast("double"))
    eta = eta_squared(cells.filter("parameter_type = 'categorical'"), keys)
    mean = F.sum(F.col("cnt") * F.col("score")) / F.sum("cnt")
    basics = cut_lineage(cells.groupBy(*keys, "parameter_type", "n_trials", "n_unique").agg(mean.alias("score_mean")))
    dev = F.col("score") - F.col("score_mean")
    spread = (
        join_on(cells.select(*keys, "score", "cnt"), basics.select(*keys, "score_mean"), keys)
        .groupBy(*keys)
        .agg((F.sum(F.col("cnt") * dev * dev) / (F.sum("cnt") - 1)).alias("__var"))
    )
    out = join_on(join_on(basics, spread, keys), best_worst_levels(cells, keys), keys)
    out = join_on(join_on(out, rho, keys, "left"), eta, keys, "left")
    strength = F.when(
        F.col("parameter_type") == "numeric", F.coalesce(F.abs("spearman_corr"), F.lit(0.0))
    ).otherwise(F.col("eta_squared"))
    return out.select(
        *keys,
        "parameter_type",
        "n_trials",
        "n_unique",
        strength.alias("sensitivity"),
        "spearman_corr",
        "best_value",
        "worst_value",
        "score_mean",
        F.sqrt("__var").alias("score_std"),
    ).orderBy("model", F.desc("sensitivity"), "parameter")


def top_sensitivity(summary: DataFrame, model: str | None = None, n: int = 20) -> DataFrame:
    """The n most sensitive parameters, of one model or base model when named."""
    if model is not None:
        summary = summary.filter((F.col("model") == model) | (F.col("base_model") == model))
    return summary.orderBy(F.desc("sensitivity"), "model", "parameter").limit(n)


def best_trials(trials: DataFrame, study: Sequence[str] = ("study_name",)) -> DataFrame:
    """Best completed trial per study; a study without one raises at run time."""
    ok = F.col("value").isNotNull() & ~F.isnan("value")
    if "state" in trials.columns:
        ok = ok & (F.col("state") == "COMPLETE")
    signed = F.when(F.col("direction") == "maximize", -F.col("value")).otherwise(F.col("value"))
    rest = [c for c in trials.columns if c not in study]
    best = trials.groupBy(*study).agg(
        F.min_by(F.struct(*rest), F.when(ok, F.struct(signed, "trial_number"))).alias("__best")
    )
    message = F.concat(F.lit("no completed trials in study "), F.concat_ws(" / ", *study))
    checked = F.when(F.col("__best").isNull(), F.raise_error(message)).otherwise(F.col("__best"))
    return best.withColumn("__best", checked).select(*study, "__best.*")


# ---- coverage and stopping -------------------------------------------------------------


def coverage_table(trials: DataFrame, required: DataFrame, study: Sequence[str] = ("study_name",)) -> DataFrame:
    """Per study and parameter: levels required, levels seen, and whether all were seen.

    ``required`` is (parameter, level). Parameters are read from ``param__*`` columns.
    """
    study = list(study)
    cols = [c for c in trials.columns if c.startswith(PARAM_PREFIX)]
    # Nulls stay: a study that has seen no level of a parameter gets a row all the same.
    levels = (
        trials.select(*study, *[F.col(c).cast("string").alias(c) for c in cols])
        .unpivot(study, cols, "parameter", "level")
        .withColumn("parameter", F.expr(f"substring(parameter, {len(PARAM_PREFIX) + 1})"))
        .distinct()
    )
    needed = required.groupBy("parameter").agg(F.count_distinct("level").alias("required"))
    wanted = required.select("parameter", "level").distinct().withColumn("__hit", F.lit(1))
    return (
        levels.join(wanted, ["parameter", "level"], "left")
        .groupBy(*study, "parameter").agg(F.count("__hit").alias("seen"))
        .join(needed, "parameter")
        .select(*study, "parameter", "required", "seen", (F.col("seen") >= F.col("required")).alias("covered"))
    )


BLOCK = 4096


def running(
    df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, tuple[str, Column]], inclusive: bool = True
) -> DataFrame:
    """Running min, max or sum along an integer order, for groups of any length.

    A group is cut into blocks of the order column. Blocks are scanned independently and the
    totals of earlier blocks are added, so no task sees a whole group.
    ``columns`` maps a new name to (kind, expression).
    """
    keys = list(keys)
    merge = {
        "min": (F.min, lambda a, b: F.least(a, b)),
        "max": (F.max, lambda a, b: F.greatest(a, b)),
        "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    }
    blocked = df.withColumn("__block", F.floor(F.col(order) / BLOCK))
    for name, (_, expr) in columns.items():
        blocked = blocked.withColumn(f"__e_{name}", expr)
    totals = blocked.groupBy(*keys, "__block").agg(
        *[merge[kind][0](f"__e_{name}").alias(f"__t_{name}") for name, (kind, _) in columns.items()]
    )
    earlier = W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        "__block",
        *[merge[kind][0](f"__t_{name}").over(earlier).alias(f"__p_{name}") for name, (kind, _) in columns.items()],
    )
    inside = W.partitionBy(*keys, "__block").orderBy(order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    joined = join_on(blocked, carried, [*keys, "__block"])
    out = joined.withColumns(
        {
            name: merge[kind][1](merge[kind][0](f"__e_{name}").over(inside), F.col(f"__p_{name}"))
            for name, (kind, _) in columns.items()
        }
    )
    return out.select(*df.columns, *columns)


def stopping_points(
    trials: DataFrame,
    required: DataFrame,
    patience: int = 5,
    study: Sequence[str] = ("study_name",),
) -> DataFrame:
    """First trial per study at which (no improvement + pruned) >= patience and coverage holds.

    Columns: stop_trial (null when the study never stops) and trials_run.
    """
    study = list(study)
    up = F.col("direction") == "maximize"
    done = F.col("state") == "COMPLETE"
    loss = F.when(done, F.when(up, -F.col("value")).otherwise(F.col("value")))
    t = trials.select(*trials.columns, loss.alias("__loss"))
    t = running(t, study, "trial_number", {"__best": ("min", F.col("__loss"))}, inclusive=False)
    better = F.col("__loss").isNotNull() & (F.col("__best").isNull() | (F.col("__loss") < F.col("__best")))
    t = t.withColumn("__better", better)
    # counters restart at every improvement: difference of running counts to the last one
    failures = F.when(F.col("__better"), 0).when(F.col("__loss").isNotNull() | (F.col("state") == "PRUNED"), 1).otherwise(0)
    t = running(t, study, "trial_number", {"__fails": ("sum", failures.cast("bigint"))})
    t = running(t, study, "trial_number", {"__mark": ("max", F.when(F.col("__better"), F.col("__fails")))})
    # coverage is complete once the last required level has shown up for the first time
    cols = [c for c in trials.columns if c.startswith(PARAM_PREFIX)]
    first_seen = (
        trials.select(*study, "trial_number", *[F.col(c).cast("string").alias(c) for c in cols])
        .unpivot([*study, "trial_number"], cols, "parameter", "level")
        .withColumn("parameter", F.expr(f"substring(parameter, {len(PARAM_PREFIX) + 1})"))
        .join(required.distinct(), ["parameter", "level"])
        .groupBy(*study, "parameter", "level")
        .agg(F.min("trial_number").alias("__first"))
    )
    everything = required.distinct().agg(F.count(F.lit(1)).alias("__need"))
    covered = first_seen.groupBy(*study).agg(
        F.max("__first").alias("__from"), F.count(F.lit(1)).alias("__got")
    )
    need = everything.first()["__need"]  # size of the search space's level list
    t = join_on(t, cut_lineage(covered), study, "left")
    ready = F.lit(True) if need == 0 else (F.col("__got") >= need) & (F.col("trial_number") >= F.col("__from"))
    tired = F.col("__fails") - F.coalesce(F.col("__mark"), F.lit(0)) >= patience
    stop = F.min(F.when(tired & F.coalesce(ready, F.lit(False)), F.col("trial_number")))
    return t.groupBy(*study).agg(stop.alias("stop_trial"), F.count(F.lit(1)).alias("trials_run"))


# ---- the log as a table ----------------------------------------------------------------


def append_trials(log: DataFrame, path: str, run: str) -> None:
    """Adds a run's trials to the log; a run that is there already is replaced, so a repeated write changes nothing.

    Parameters are kept as text: runs may search over different ones, and one parameter may be a
    number in one run and a name in the other.
    """
    text = {c: F.col(c).cast("string") for c in log.columns if c.startswith(PARAM_PREFIX)}
    out = log.withColumns(text).withColumn("run", F.lit(run))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """All runs, with the parameters of all of them; what a run did not search over is null."""
    return spark.read.option("mergeSchema", "true").parquet(path)


# ---- median pruning --------------------------------------------------------------------

#: Blocks of a group at most; longer groups get longer blocks.
MAX_BLOCKS = 256


def median_pruning(
    steps: DataFrame,
    startup: int = 10,
    warmup: int = 1,
    interval: int = 1,
    study: Sequence[str] = ("study_name",),
    complete: str | None = None,
    block: int = 16_384,
) -> DataFrame:
    """Which (trial, step) reports a median pruner would stop.

    ``steps`` is (study, trial_number, step, loss): intermediate losses, smaller is better. A
    report is compared with the median of the losses that earlier trials gave at the same step;
    the trial's own best so far is what is compared. Only trials for which the boolean column
    ``complete`` holds count as earlier ones (all, if no column is named).

    An expanding median over a group of any size needs, per report, the rank of a value among
    earlier ones. Reports are cut into blocks of ``block`` trials in a row. While a block lasts, the
    median moves by half a block of ranks at most, so a block needs only that stretch of the earlier
    losses and the number of smaller ones. Losses are counted by block and by range of value, as many
    ranges as blocks; running sums over that grid tell which ranges hold a block's stretch.
    Every block fetches three blocks of losses at most, and equal ones are counted before.
    """
    study = list(study)
    keys = [*study, "step"]
    done = F.bool_or(complete) if complete else F.lit(True)
    best = steps.groupBy(*study, "trial_number", "step").agg(F.min("loss").alias("loss"), done.alias("__done"))
    own = W.partitionBy(*study, "trial_number").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    # a trial has one row per inner fold, so this window is short
    best = best.withColumn("best", F.min("loss").over(own))
    carried = {c: F.first(c) for c in ("loss", "best", "__done")}  # the trial is unique in its group
    rows = ordered_counts(best, keys, "trial_number", extra=carried).withColumn("__done", F.coalesce("__done", F.lit(False)))
    rows = cut_lineage(rows.select(*keys, "trial_number", "loss", "best", "__done", F.col("before").alias("__at")))
    last = rows.agg(F.max("__at")).first()[0] or 0
    block = max(block, -(-(last + 1) // MAX_BLOCKS))
    rows = rows.withColumn("__blk", F.floor(F.col("__at") / block))
    earlier = W.partitionBy(*keys).orderBy("__blk").rowsBetween(W.unboundedPreceding, -1)  # a row for each block
    blocks = rows.groupBy(*keys, "__blk").agg(F.count_if("__done").alias("__n"))
    blocks = cut_lineage(blocks.select(*keys, "__blk", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n0")))
    told = join_on(rows, blocks, [*keys, "__blk"]).withColumns({"__cnt": F.lit(None).cast("bigint")})
    if last >= block:
        fetched = _stretches(rows, blocks, keys, last // block + 1, block)
        told = told.unionByName(fetched, allowMissingColumns=True)
    plain = rows.select(*keys, "trial_number", "loss", "best").schema
    schema = T.StructType([*plain, T.StructField("earlier_trials", T.LongType()), T.StructField("__above", T.BooleanType())])
    out = told.groupBy(*keys, "__blk").applyInArrow(_median_rule(plain.names, block), schema)
    eligible = (F.col("earlier_trials") >= startup) & (F.col("step") > warmup) & ((F.col("step") - warmup) % interval == 0)
    return out.select(
        *study, "trial_number", "step", "loss", "best", "earlier_trials",
        F.coalesce(eligible & F.col("__above"), F.lit(False)).alias("prune"),
    )


def _stretch(earlier: Any, block: int) -> tuple[Any, Any]:
    """First and last rank, among so many earlier losses, that the median may take while a block lasts."""
    middle = earlier // 2 if isinstance(earlier, int) else F.floor(earlier / 2)
    return middle - block // 2 - 3, middle + block // 2 + 3


def _stretches(rows: DataFrame, blocks: DataFrame, keys: list[str], ranges: int, block: int) -> DataFrame:
    """Counted earlier losses around the median of what precedes each block."""
    value = F.col("loss").cast("double")
    losses = rows.filter("__done")
    edges = losses.groupBy(*keys).agg(
        F.percentile_approx(F.when(~F.isnan(value), value), [i / ranges for i in range(1, ranges)], 10_000).alias("__edges")
    )
    place = F.coalesce(F.size(F.filter("__edges", lambda e: e < value)), F.lit(0))  # nulls come first, NaN last
    counted = join_on(losses, cut_lineage(edges), keys).groupBy(*keys, "__blk", F.greatest(place, F.lit(0)).alias("__rng"), "loss")
    counted = cut_lineage(counted.agg(F.count(F.lit(1)).alias("__cnt")))
    cells = counted.groupBy(*keys, "__blk", "__rng").agg(F.sum("__cnt").alias("__c"))
    grid = blocks.withColumn("__rng", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))))
    grid = join_on(grid, cells, [*keys, "__blk", "__rng"], "left")
    before = (W.unboundedPreceding, -1)
    in_time = W.partitionBy(*keys, "__rng").orderBy("__blk").rowsBetween(*before)
    in_value = W.partitionBy(*keys, "__blk").orderBy("__rng").rowsBetween(*before)
    grid = grid.withColumn("__had", F.coalesce(F.sum("__c").over(in_time), F.lit(0)))
    grid = grid.withColumn("__base", F.coalesce(F.sum("__had").over(in_value), F.lit(0)))
    low, high = _stretch(F.col("__n0"), block)
    meets = (F.col("__had") > 0) & (F.col("__base") <= high) & (F.col("__base") + F.col("__had") > low)
    needed = cut_lineage(grid.filter(meets).select(*keys, "__rng", F.col("__blk").alias("__to"), "__base"))
    found = join_on(counted, needed, [*keys, "__rng"]).filter(F.col("__blk") < F.col("__to"))
    return found.select(*keys, F.col("__to").alias("__blk"), "loss", "__cnt", "__base")


def _median_rule(kept: list[str], block: int):
    """Each report of a block against the median of earlier losses, kept in order as they come."""

    def decide(t: pa.Table) -> pa.Table:
        own = t.filter(pc.is_null(t["__cnt"])).sort_by("__at")
        old = t.filter(pc.is_valid(t["__cnt"]))
        parts = [c.cast(pa.float64()).combine_chunks() for c in (old["loss"], own["loss"], own["best"])]
        missing = np.concatenate([c.is_null().to_numpy(zero_copy_only=False) for c in parts])
        values = np.concatenate([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in parts])
        kind = np.where(missing, 0, np.where(np.isnan(values), 2, 1))  # nulls are smallest, NaN is largest
        plain = np.where(kind == 1, values, 0.0)
        order = np.lexsort((plain, kind))
        steps = (np.diff(plain[order], prepend=plain[order][:1]) != 0) | (np.diff(kind[order], prepend=kind[order][:1]) != 0)
        code = np.empty(len(order), dtype=np.int64)
        code[order] = np.cumsum(steps)
        number: dict[int, float] = dict(zip(code.tolist(), np.where(kind == 0, np.nan, values).tolist()))
        n = own["__n0"][0].as_py()
        low, high = _stretch(n, block)
        low = max(low, 0)
        by_value = np.argsort(code[: len(old)], kind="stable")
        counts = old["__cnt"].to_numpy()[by_value]
        ends = np.cumsum(counts) + (old["__base"].to_numpy().min() if len(old) else 0)
        held = np.clip(np.minimum(ends, high + 1) - np.maximum(ends - counts, low), 0, None)
        inside = np.repeat(code[: len(old)][by_value], held).tolist()
        losses, bests = code[len(old) : len(old) + len(own)].tolist(), code[len(old) + len(own) :].tolist()
        seen, above = [], []
        for loss, best, done in zip(losses, bests, own["__done"].to_pylist()):
            i, half = bisect_left(inside, best), n // 2
            if n == 0 or n % 2 == 1 or low + i != half:
                above.append(low + i > half)
            else:
                above.append(number[best] > (number[inside[i - 1]] + number[inside[i]]) / 2)
            seen.append(n)
            if done:
                insort(inside, loss)
                n += 1
        out = own.select(kept)
        return out.append_column("earlier_trials", pa.array(seen, pa.int64())).append_column("__above", pa.array(above, pa.bool_()))

    return decide


# ---- aggregation of best parameters ----------------------------------------------------


def common_parameters(params: DataFrame, owner: str = "model", fold: str = "outer_fold") -> DataFrame:
    """Rows of the parameters that every fold of the owner has. Long table (owner, fold, param, ...)."""
    folds = params.groupBy(owner, fold).agg(F.lit(1).alias("__1")).groupBy(owner).agg(F.count(F.lit(1)).alias("__folds"))
    per_param = (
        params.groupBy(owner, "param", fold).agg(F.lit(1).alias("__1"))
        .groupBy(owner, "param").agg(F.count(F.lit(1)).alias("__have"))
    )
    keep = per_param.join(folds, owner).filter(F.col("__have") == F.col("__folds")).select(owner, "param")
    return params.join(cut_lineage(keep), [owner, "param"], "left_semi")


def mode_by(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Most frequent value per group; the one seen first wins ties. Counted first, no window."""
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"), F.min(order).alias("__first"))
    best = F.max_by(F.struct(value), F.struct(F.col("__c"), -F.col("__first")))
    return counts.groupBy(*keys).agg(best.alias("__m")).select(*keys, F.col(f"__m.{value}").alias(value))


def aggregate_parameters(params: DataFrame, owner: str = "model", fold: str = "outer_fold") -> DataFrame:
    """One value per (owner, parameter): booleans and text by mode, numbers by median.

    Long input (owner, fold, param, kind, value) with kind in int, float, bool, other and the
    value as text (lists as JSON text). Integers round half to even.
    """
    keys = [owner, "param"]
    # a parameter is numeric only if every fold agrees on that
    kinds = params.groupBy(*keys).agg(
        F.bool_and(F.col("kind").isin("int", "float")).alias("__num"),
        F.bool_and(F.col("kind") == "int").alias("__int"),
        F.bool_and(F.col("kind") == "bool").alias("__bool"),
    )
    kinds = cut_lineage(kinds)
    typed = join_on(params, kinds, keys)
    numbers = typed.filter("__num").withColumn("__x", F.col("value").try_cast("double"))
    medians = exact_quantiles(numbers, keys, "__x", {"__median": 0.5})
    modes = mode_by(typed.filter(~F.col("__num")), keys, "value", fold).withColumnRenamed("value", "__mode")
    out = join_on(join_on(kinds, medians, keys, "left"), modes, keys, "left")
    kind = (
        F.when(F.col("__int"), "int").when(F.col("__num"), "float").when(F.col("__bool"), "bool").otherwise("other")
    )
    value = (
        F.when(F.col("__int"), F.bround("__median", 0).cast("bigint").cast("string"))
        .when(F.col("__num"), F.col("__median").cast("string"))
        .otherwise(F.col("__mode"))
    )
    return out.select(*keys, kind.alias("kind"), value.alias("value"))


def aggregate_residual_configs(records: DataFrame, owner: str = "model", fold: str = "outer_fold") -> DataFrame:
    """Most frequent residual configuration per owner, compared as canonical JSON text.

    The column ``residual_cfg`` may be null, which counts as a configuration of its own.
    """
    return mode_by(records, [owner], "residual_cfg", fold)


def canonical_json(entries: Column) -> Column:
    """JSON text of a map column with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))
