"""Predictions for documents that training may not see, against their labels."""

import os

import pytest
from pyspark.sql import functions as F

from fieldglass.llm.registry import QUERIES

DATA = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def test_language(spark):
    out = QUERIES["op2_language"](spark, DATA).join(table(spark, "documents").select("doc_id", "lang", "text"), "doc_id")
    held = out.filter(F.col("held_out") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    n, right = held.agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    print("language", right, n)
    assert n > 1000 and right / n > 0.98


def test_quality(spark):
    out = QUERIES["op4_quality"](spark, DATA).join(table(spark, "labels").select("doc_id", "quality"), "doc_id")
    n, right = out.filter(F.col("held_out") & F.col("quality").isNotNull()).agg(F.count(F.lit(1)), F.count_if(F.col("quality") == F.col("predicted"))).first()
    print("quality", right, n)
    assert n > 500 and right / n > 0.95


def test_toxicity(spark):
    out = QUERIES["op7_toxicity"](spark, DATA).join(table(spark, "labels").select("doc_id", "toxic"), "doc_id").filter("held_out and toxic is not null")
    toxic, caught, clean, left = out.agg(F.count_if(F.expr("toxic = 1")), F.count_if(F.expr("toxic = 1 and predicted = 1")), F.count_if(F.expr("toxic = 0")), F.count_if(F.expr("toxic = 0 and predicted = 0"))).first()
    print("toxicity", caught, toxic, left, clean)
    assert toxic > 50 and caught / toxic >= 0.9 and left / clean >= 0.97
