"""Stages one by one against brute force, and the registered queries against their SQL."""

import os
import random

import pytest
from test_near_dup import brute
from test_pii import plain

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from oracle import compare, connect
from plumbline.llm import decontaminate

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables absent")


def test_stages_on_a_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [(r["item_id"], decontaminate.normalise(r["text"])) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, SMALL)
        after = out.collect()
        if name != "byte_bpe":
            assert out.columns == docs.columns
        ids = [r["doc_id"] for r in after]
        if name == "near_duplicates":
            want = brute([(r["doc_id"], r["text"]) for r in before], corpus_pipeline.THRESHOLD)
            assert sorted(ids) == sorted(i for i, c in want.items() if i == c)
        elif name == "decontamination":
            hit = lambda t: any(x in decontaminate.normalise(t) for _, x in items)
            assert not any(hit(r["text"]) for r in after)
            assert len(after) >= 0.9 * len(before)
        elif name == "personal_data":
            assert len(after) == len(before) and not any(plain(r["text"]) for r in after)
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        elif name == "quality_rules":
            assert 0.6 * len(before) < len(after) < len(before)
        else:
            assert len(after) == len(before)
        docs = spark.createDataFrame(after, out.schema)


def test_odd_rows_pass_all_stages(spark):
    rng = random.Random(1)
    text = ". ".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(9)) for _ in range(12))
    rows = [(1, text, "h"), (1, text, "h"), (None, text, "h"), (2, None, "h"), (3, "", "h"), (4, text + " mail a@b.org", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string")
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SMALL)
        assert sorted(str(r["doc_id"]) for r in now.collect()) == ([] if empty else ["1", "None"])


def test_names_that_the_stage_uses_and_rows_of_one_id(spark):
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a, 1, 1, "x"), (1, b, 2, 2, "x"), (1, a, 1, 1, "x"), (2, b, 3, 3, "x"), (3, c, 4, 4, "x"), (4, a, 5, 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long, place int, place_ string")
    out = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == sorted(rows[i] for i in (0, 1, 4))


@pytest.mark.parametrize("name", ["op6_quality_rules", "op7_warc", "op11_collocations", "op12_merkle_manifest"])
def test_query_equals_its_sql(spark, name):
    assert compare(queries()[name](spark, SMALL), connect(SMALL), oracle_sql()[name]) is None


@pytest.mark.parametrize("name", [f"op{n}_" for n in (*range(1, 11), 12, 13)])
def test_query_returns_every_row(spark, name):
    full = next(q for q in queries() if q.startswith(name))
    table = {"op5_": "conversations", "op7_": "pages"}.get(name, "documents")
    assert queries()[full](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()
