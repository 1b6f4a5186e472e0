"""Policy-driven feature pipeline: one PipelineModel from raw columns to a feature vector."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import Imputer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from plumbline.functions.keys import hash_fold, seeded_uniform
from plumbline.operators import numeric as num
from plumbline.operators import select as sel
from plumbline.operators.encode import TargetEncoder, one_hot_stages
from plumbline.operators.features import add_interactions
from plumbline.operators.schema import Roles

CAT_ENCODINGS = {"onehot", "target", "raw"}
SELECTIONS = {None, "lasso", "genetic", "ga"}
NUMERIC_TRANSFORMS = {"power", "quantile", "scale", "none"}


@dataclass(frozen=True)
class Policy:
    """How a model wants its features."""

    cat_encoding: str = "onehot"
    selection: str | None = None
    numeric: str = "power"
    interactions: str = "none"
    nulls: str = "error"
    smoothing: float = 10.0
    min_leaf: int = 1
    explain: str = "kernel"

    def validate(self) -> "Policy":
        if self.cat_encoding not in CAT_ENCODINGS:
            raise ValueError(f"unknown cat_encoding: {self.cat_encoding}")
        if self.selection not in SELECTIONS:
            raise ValueError(f"unknown selection: {self.selection}")
        if self.numeric not in NUMERIC_TRANSFORMS:
            raise ValueError(f"unknown numeric transform: {self.numeric}")
        if self.nulls not in {"error", "mean"}:
            raise ValueError(f"unknown null handling: {self.nulls}")
        return self


# Default policy per model family.
POLICIES: dict[str, Policy] = {
    "LinearRegression": Policy("onehot", "genetic", "power", "interactions", explain="linear"),
    "RandomForest": Policy("target", None, "power", "none", explain="tree"),
    "DecisionTree": Policy("target", None, "power", "none", explain="tree"),
    "BoostedTrees": Policy("target", None, "power", "none", explain="tree"),
    "Bagging": Policy("onehot", "genetic", "power", "interactions", explain="kernel"),
}


def policy_for(model: str, **changes) -> Policy:
    return replace(POLICIES.get(model, Policy()), **changes).validate()


class InteractionFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the interaction columns as a pipeline stage."""

    policy = Param(Params._dummy(), "policy", "interaction policy", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, policy="interactions"):
        super().__init__()
        self._setDefault(policy="interactions")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return add_interactions(dataset, self.getOrDefault(self.policy))[0]


class NormalScores(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Quantile-to-normal scores with fitted landmarks as a pipeline stage."""

    fitted = Param(Params._dummy(), "fitted", "landmarks as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, fitted="{}"):
        super().__init__()
        self._set(**self._input_kwargs)

    @classmethod
    def of(cls, fit: num.QuantileFit) -> "NormalScores":
        return cls(fitted=json.dumps([fit.landmarks, fit.low, fit.high]))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fit = num.QuantileFit(*json.loads(self.getOrDefault(self.fitted)))
        for c in fit.landmarks:
            dataset = num.quantile_normal(dataset, c, fit, f"num__{c}")
        return dataset


@dataclass(frozen=True)
class FittedFeatures:
    """The pipeline with what it learnt."""

    pipeline: PipelineModel
    feature_names: list[str]
    selection: sel.Selection | None = None
    dropped: dict[str, str] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(df)


def _numeric_stages(train: DataFrame, cols: list[str], kind: str) -> tuple[list, list[str], dict[str, str]]:
    if kind == "none":
        exprs = ", ".join(f"CAST(`{c}` AS DOUBLE) AS `num__{c}`" for c in cols)
        return [SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__")], cols, {}
    if kind == "quantile":
        return [NormalScores.of(num.fit_quantiles(train, cols))], cols, {}
    if kind == "scale":
        fit = num.standard_scale_fit(train, cols)
        exprs = ", ".join(f"{num.standard_scale_sql(c, fit[c])} AS `num__{c}`" for c in cols)
        return [SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__")], cols, {}
    power = num.fit_power(train, cols)
    kept = list(power.lambdas)
    exprs = ", ".join(f"{power.sql(c)} AS `num__{c}`" for c in kept)
    return [SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__")], kept, power.dropped


def fit_features(
    train: DataFrame, roles: Roles, policy: Policy, y: str, key: str, seed: int = 42
) -> FittedFeatures:
    """Fit every step on ``train`` and assemble ``features``.

    ``train`` is read a handful of times (power grid, selection sums, encodings), so callers
    that fit several models on it should persist it.
    """
    policy.validate()
    stages: list = []
    frame = train

    def add(stage) -> None:
        nonlocal frame
        fitted = stage.fit(frame) if hasattr(stage, "fit") else stage
        stages.append(fitted)
        frame = fitted.transform(frame)

    if policy.interactions != "none":
        _, more_num, more_cat = add_interactions(frame, policy.interactions)
        add(InteractionFeatures(policy=policy.interactions))
        roles = roles.plus(more_num, more_cat)
    numeric, categorical = list(roles.numeric), list(roles.categorical)
    if policy.nulls == "mean" and numeric:
        exprs = ", ".join(f"CAST(`{c}` AS DOUBLE) AS `__d_{c}`" for c in numeric)
        add(SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__"))
        add(Imputer(inputCols=[f"__d_{c}" for c in numeric], outputCols=[f"{c}__filled" for c in numeric]))
        numeric = [f"{c}__filled" for c in numeric]
    dropped: dict[str, str] = {}
    selection = None
    inputs: list[str] = []
    names: list[str] = []
    if numeric:
        kind = "none" if policy.cat_encoding == "raw" else policy.numeric
        made, kept, dropped = _numeric_stages(frame, numeric, kind)
        for s in made:
            add(s)
        inputs = [f"num__{c}" for c in kept]
        if policy.selection == "lasso":
            folds = frame.withColumn("__cv", hash_fold(key, seed, 10))
            selection = sel.select_lasso(folds, inputs, y, "__cv")
        elif policy.selection in {"genetic", "ga"}:
            split = frame.withColumn("__valid", seeded_uniform(key, seed) < 0.25)
            selection = sel.select_genetic(split, inputs, y, "__valid", seed=seed)
        if selection is not None:
            inputs = selection.kept
        names = list(inputs)
    if categorical and policy.cat_encoding == "onehot":
        hot, outs = one_hot_stages(categorical)
        for s in hot:
            add(s)
        labels = next(s for s in stages if hasattr(s, "labelsArray")).labelsArray
        names += [f"cat__{c}_{lv}" for c, ls in zip(categorical, labels) for lv in ls]
        inputs += outs
    elif categorical and policy.cat_encoding == "target":
        add(TargetEncoder(inputCols=categorical, labelCol=y, smoothing=policy.smoothing, minLeaf=policy.min_leaf))
        inputs += [f"{c}__te" for c in categorical]
        names += [f"cat__{c}__te" for c in categorical]
    elif categorical:
        codes = [f"{c}__code" for c in categorical]
        filled = ", ".join(f"CAST(`{c}` AS STRING) AS `__t_{c}`" for c in categorical)
        add(SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"))
        add(StringIndexer(inputCols=[f"__t_{c}" for c in categorical], outputCols=codes, handleInvalid="keep", stringOrderType="alphabetAsc"))
        # plain numbers: nominal metadata would force a bin per level on every tree
        exprs = ", ".join(f"`{c}` + 0D AS `{c}_n`" for c in codes)
        add(SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__"))
        inputs += [f"{c}_n" for c in codes]
        names += categorical
    add(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error"))
    return FittedFeatures(PipelineModel(stages), names, selection, dropped)
