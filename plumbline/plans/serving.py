"""Scoring with saved artefacts, for batch and streaming frames alike."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.models import Fitted, load_fitted
from plumbline.sources.sinks import read_merged_json


@dataclass(frozen=True)
class Predictor:
    """Features, model and the inverse of the target transform."""

    features: PipelineModel
    model: Fitted
    log_target: bool = True

    def __call__(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        before = df.columns
        scored = self.model.predict(self.features.transform(df), "__p")
        value = F.exp("__p") if self.log_target else F.col("__p")
        return scored.select(*before, value.alias(out))


def best_model_name(spark: SparkSession, path: str) -> str:
    row = read_merged_json(spark, f"{path}/best_model").first()
    if row is None or not row["best_model"]:
        raise ValueError("no best model recorded")
    return row["best_model"]


def make_predictor(spark: SparkSession, path: str, name: str | None = None) -> Predictor:
    """Predictor of a saved model, the recorded best one unless named."""
    name = name or best_model_name(spark, path)
    found = read_merged_json(spark, f"{path}/index").filter(F.col("model") == name).first()
    if found is None:
        raise ValueError(f"model {name!r} not saved under {path}")
    features = PipelineModel.load(f"{path}/{found['base_model']}/features")
    return Predictor(features, load_fitted(spark, found["path"]), bool(found["log_target"]))


Scorer = Callable[[DataFrame], DataFrame]
