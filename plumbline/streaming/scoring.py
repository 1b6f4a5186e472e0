"""Streaming input and scoring: the batch predictor applied to an unbounded table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from plumbline.plans.serving import Predictor
from plumbline.session import scratch_path


def stream_csv_folder(
    spark: SparkSession, path: str, schema: T.StructType | str, pattern: str = "*.csv", files_per_trigger: int = 1000
) -> DataFrame:
    """New CSV files of a folder as a stream with their source path."""
    return (
        spark.readStream.schema(schema)
        .option("header", "true")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_trigger)
        .csv(path)
        .withColumn("_source_file", F.col("_metadata.file_path"))
    )


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def score_stream(stream: DataFrame, predictor: Predictor, out: str, checkpoint: str | None = None) -> StreamingQuery:
    """Append predictions to a Parquet folder; stops once the present input is processed."""
    spark = stream.sparkSession
    return (
        predictor(stream)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-checkpoint"))
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )
