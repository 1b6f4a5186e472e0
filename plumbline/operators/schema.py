"""Column names, column roles and type clean-up."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import cut_lineage


@dataclass(frozen=True)
class Roles:
    """Which columns are the target, numeric features and categorical features."""

    target: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    renamed: dict[str, str] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def plus(self, numeric: Iterable[str] = (), categorical: Iterable[str] = ()) -> "Roles":
        return Roles(
            self.target, (*self.numeric, *numeric), (*self.categorical, *categorical), self.renamed
        )


def safe_names(names: Sequence[str]) -> dict[str, str]:
    """Map each name to letters, digits and single underscores; clashes get a numeric suffix."""
    out: dict[str, str] = {}
    taken: set[str] = set()
    for raw in names:
        stem = re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9_]+", "_", str(raw))).strip("_") or "f"
        if stem[0].isdigit():
            stem = "f_" + stem
        name, n = stem, 0
        while name in taken:
            n += 1
            name = f"{stem}_{n}"
        taken.add(name)
        out[raw] = name
    return out


def sanitize_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    mapping = safe_names(df.columns)
    return df.toDF(*[mapping[c] for c in df.columns]), mapping


def _is_integer(t: T.DataType) -> bool:
    return isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _is_numeric(t: T.DataType) -> bool:
    # booleans count as numeric but not as integers
    return isinstance(t, (T.NumericType, T.BooleanType))


def infer_roles(df: DataFrame, target: str, max_levels: int = 20) -> Roles:
    """Integers with few distinct values and all non-numeric columns are categorical.

    A sketch settles every column whose distinct count is far from the threshold; only the
    rest is counted exactly, which then means few distinct values and a cheap shuffle.
    """
    integers = [f.name for f in df.schema if f.name != target and _is_integer(f.dataType)]
    low: set[str] = set()
    if integers:
        rough = df.agg(*[F.approx_count_distinct(c, 0.05).alias(c) for c in integers]).first()
        close = [c for c in integers if rough[c] <= 2 * max_levels]
        if close:
            exact = df.agg(*[F.count_distinct(c).alias(c) for c in close]).first()
            low = {c for c in close if exact[c] <= max_levels}
    numeric, categorical = [], []
    for f in df.schema:
        if f.name == target:
            continue
        is_num = _is_numeric(f.dataType) and f.name not in low
        (numeric if is_num else categorical).append(f.name)
    return Roles(target, tuple(numeric), tuple(categorical))


def roles_table(df: DataFrame, roles: Roles) -> DataFrame:
    """(column, role, non_null) as a table, from one pass."""
    cols = [c for c in df.columns if c != roles.target]
    role = F.create_map(
        *[x for c in cols for x in (F.lit(c), F.lit("numeric" if c in roles.numeric else "categorical"))]
    )
    return (
        df.agg(*[F.count(c).alias(c) for c in cols])
        .unpivot([], cols, "column", "non_null")
        .select("column", role[F.col("column")].alias("role"), "non_null")
    )


def bind_roles(df: DataFrame, target: str, max_levels: int = 20) -> tuple[DataFrame, Roles]:
    """Sanitise the frame and infer the roles on the renamed frame."""
    clean, mapping = sanitize_columns(df)
    roles = infer_roles(clean, mapping[target], max_levels)
    return clean, Roles(roles.target, roles.numeric, roles.categorical, mapping)


def coerce_types(
    df: DataFrame,
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
    errors: str = "coerce",
) -> DataFrame:
    """Numeric columns to double (bad values to null, or an error), categorical ones to text."""
    if errors not in {"coerce", "raise"}:
        raise ValueError("errors must be 'coerce' or 'raise'")
    changed = {}
    for c in numeric:
        if c in df.columns:
            text = F.col(c)
            parsed = text.try_cast("double")
            if errors == "raise":
                bad = text.isNotNull() & parsed.isNull()
                message = F.concat(F.lit(f"column {c} holds a non-numeric value: "), text.cast("string"))
                parsed = F.when(bad, F.raise_error(message)).otherwise(parsed)
            changed[c] = parsed
    for c in categorical:
        if c in df.columns:
            changed[c] = F.col(c).cast("string")
    return df.withColumns(changed) if changed else df


def drop_missing_target(df: DataFrame, target: str, enabled: bool = True) -> DataFrame:
    return df.dropna(subset=[target]) if enabled and target in df.columns else df


def is_finite(c: Column) -> Column:
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def finite_pairs(df: DataFrame, *cols: str) -> DataFrame:
    """Rows in which every named column is a finite number."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & is_finite(F.col(c))
    return df.filter(cond)


def log_target(y: Column) -> Column:
    """ln(max(y, 1)); null stays null."""
    y = y.cast("double")
    return F.when(y.isNotNull(), F.log(F.greatest(y, F.lit(1.0))))


def project_features(df: DataFrame, roles: Roles) -> DataFrame:
    return df.select(*roles.features)


# Encoder prefixes and suffixes that feature labels carry, applied in this order.
_LABEL_STEPS = (
    ("  ", " "),
    ("_ ", "_"),
    (" _", "_"),
    (" ", "_"),
    ("__+", "_"),
    ("^(cat_te_|cat__|cat_|num_)", ""),
    ("(^|_)te_", "$1"),
    ("(_te|_tr|_test|_train)$", ""),
    ("^_+|_+$", ""),
)


def clean_label(name: Column) -> Column:
    """Readable feature label without encoder prefixes and suffixes."""
    for pattern, replacement in _LABEL_STEPS:
        name = F.regexp_replace(name, pattern, replacement)
    return name


def model_label(base: Column, kind: Column) -> Column:
    """``base`` or ``base+kind``; a null kind, 'none' and 'base' mean no residual stage."""
    real = F.when(~F.lower(kind).isin("none", "base"), kind)
    return F.concat_ws("+", base, real)


def matches_name(model: Column, name: str) -> Column:
    return (model == name) | model.startswith(name + "+")


def match_one(results: DataFrame, name: str, column: str = "model") -> str | None:
    """The exact name, else the only ``name+...``; several such names are an error."""
    found = [
        r[0]
        for r in results.filter(matches_name(F.col(column), name))
        .select(column)
        .distinct()
        # the exact name sorts first, so two rows settle the question
        .orderBy(F.length(column), column)
        .limit(2)
        .collect()
    ]
    if name in found:
        return name
    if len(found) > 1:
        raise ValueError(f"ambiguous model name {name!r}: {found}")
    return found[0] if found else None


def match_many(results: DataFrame, names: Sequence[str], column: str = "model") -> DataFrame:
    """Rows of the models that match any name, exact names hiding their prefixed variants."""
    present = results.select(F.col(column).alias("__m")).distinct()
    wanted = present.select(
        "__m",
        F.explode(F.array(*[F.lit(n) for n in names])).alias("__n"),
    ).filter((F.col("__m") == F.col("__n")) | F.col("__m").startswith(F.concat("__n", F.lit("+"))))
    exact = wanted.groupBy("__n").agg(F.max(F.col("__m") == F.col("__n")).alias("__exact"))
    keep = (
        wanted.join(exact, "__n")
        .filter(~F.col("__exact") | (F.col("__m") == F.col("__n")))
        .select(F.col("__m").alias(column))
        .distinct()
    )
    return results.join(cut_lineage(keep), column, "left_semi")
