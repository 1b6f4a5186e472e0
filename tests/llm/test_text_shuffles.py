"""Texts that no comparison needs are not shuffled, and shuffle files go with their query."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from plumbline.llm.common import maybe_among
from plumbline.session import cut_lineage


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_shuffle_files_go_when_a_table_is_written(spark):
    before = shuffle_files(spark)
    out = cut_lineage(spark.range(2000).groupBy((F.col("id") * 7919 % 1999).alias("k")).agg(F.count("*").alias("n")))
    assert out.count() == 1999
    assert not shuffle_files(spark) - before


def test_bits_find_all_ids_and_few_others(spark):
    ids = spark.createDataFrame([(i * 3,) for i in range(500)], "id long")
    rows = spark.range(3000).withColumn("small", F.col("id").cast("int"))
    among = maybe_among(ids)
    assert rows.filter(among(F.col("id")) & (F.col("id") % 3 == 0)).count() >= 500
    assert rows.filter(among(F.col("small")) & (F.col("id") < 1500) & (F.col("id") % 3 == 0)).count() == 500
    assert rows.filter(among(F.col("id"))).count() < 600
    assert rows.filter(maybe_among(ids.limit(0))(F.col("id"))).count() == 0


def test_rows_that_the_ids_tell_are_not_shuffled(spark, tmp_path):
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    some, twice = [text() for _ in range(300)], text()
    rows = [(i, t) for i, t in enumerate(some)] + [(1000, some[0]), (2000, twice), (2000, twice), (None, some[1]), (None, some[1])]
    spark.createDataFrame(rows, "doc_id int, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    got = sorted(str(r["doc_id"]) for r in out.collect())
    assert got == sorted([*map(str, range(300)), "2000", "None", "None"])
    # Below every exchange of texts there is the test of the bits.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join LeftSemi") :]
    assert "ArrowEvalPython" in joined[: joined.index("Relation")]
