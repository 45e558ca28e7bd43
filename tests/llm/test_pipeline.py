import random

import pyarrow as pa
import pytest

import corpus_pipeline
from fieldglass.llm.common import SMALL_BATCHES
from fieldglass.llm.registry import ORACLES, QUERIES

WORDS = "ba ke lo mi nu pa re si to vu".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(WORDS) for _ in range(rng.randint(2, 4)))
    prose = lambda n: " ".join((word() + ("." if rng.random() < 0.1 else "")) for _ in range(n))
    passage, item = prose(80) + ".", prose(40)
    rows = [(i, prose(rng.randint(80, 160))) for i in range(60)]
    rows += [(100, "start. \n" + passage + "\n" + prose(70)), (101, prose(60) + ".\n" + passage), (102, prose(50) + " " + item + " " + prose(50))]
    near = prose(120).replace(".", "").split()
    rows += [(200, " ".join(near)), (201, " ".join([*near[:60], "changed", *near[61:]]))]
    rows += [(300 + i, " ".join(["SPAM!!!"] * 90)) for i in range(30)]
    labels = [(i, 1, 0) for i in range(60)] + [(300 + i, 0, 0) for i in range(30)]
    where = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string").write.parquet(f"{where}/pages.parquet")
    return str(where), dict(rows), passage


def test_stages(spark, folder):
    where, rows, passage = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, where), name)
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "pieces":
            assert docs.columns == columns
    clean = set(range(60))
    assert not any(i >= 300 for i in seen["quality"]) and clean <= set(seen["quality"])
    assert passage in seen["lines"][100]["text"] and passage not in seen["lines"][101]["text"]
    assert all(seen["lines"][i]["text"] == rows[i] for i in clean)
    assert all(r["n_chars"] == len(r["text"]) for r in seen["lines"].values())
    assert 200 in seen["near_duplicates"] and clean <= set(seen["near_duplicates"])
    assert set(seen["decontaminate"]) == set(seen["near_duplicates"]) - {102}
    assert set(seen["pieces"]) == set(seen["decontaminate"]) and all(r["round_trip"] for r in seen["pieces"].values())
    assert corpus_pipeline.run(spark, where).count() == len(seen["pieces"])


def test_near_duplicates_stage_keeps_one_of_each_group(spark, folder):
    where, rows, _ = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs.union(docs.filter("doc_id = 5")), where).collect()}
    assert kept == set(rows) - {201} - set(range(301, 330))


def test_clashing_and_missing_columns(spark, folder, tmp_path):
    from pyspark.sql import functions as F

    where, rows, _ = folder
    names = ("__runs", "__doc", "__nth", "stat_log_words", "_stat_x", "score", "runs", "doc", "component_id", "n", "t", "k", "piece_ids")
    docs = spark.read.parquet(f"{where}/documents.parquet").drop("n_chars").withColumns({c: F.lit(c) for c in names})
    docs = docs.union(docs.filter("doc_id = 7").withColumn("text", F.lit("A different and second text of one id."))).union(docs.filter("doc_id = 7").withColumn("doc_id", F.lit(None)).withColumn("text", F.lit(None).cast("string")))
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.columns, corpus_pipeline.written(stage(spark, docs, where), name)
        if name != "pieces":
            assert docs.columns == before
            assert docs.filter(" or ".join(f"`{c}` <> '{c}'" for c in names)).isEmpty()
    assert docs.filter("doc_id = 7").count() == 1 and {r["doc_id"] for r in docs.select("doc_id").collect()} >= set(range(60))


def test_empty_tables(spark, folder, tmp_path):
    where, _, _ = folder
    for name in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{where}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, f in QUERIES.items():
        assert f(spark, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert set(ORACLES) <= set(QUERIES)


def test_stages_send_small_batches_of_long_texts(spark, folder, tmp_path):
    def largest(df):
        sizes = df.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["b"]) for b in batches), "b long")
        return max(r["b"] for r in sizes.collect())

    where, _, _ = folder
    keys = list(SMALL_BATCHES)
    spark.range(600).selectExpr("repeat('some words ', 2000) AS text").coalesce(1).write.parquet(f"{tmp_path}/long")
    long, docs = spark.read.parquet(f"{tmp_path}/long"), spark.read.parquet(f"{where}/documents.parquet")
    try:
        for name, stage in corpus_pipeline.STAGES:
            for key in keys:
                spark.conf.unset(key)
            stage(spark, docs, where)
            assert largest(long) < 5_000_000, name
        spark.conf.set(keys[1], "2000000b")  # a session's own setting wins
        corpus_pipeline.pieces(spark, docs, where)
        assert largest(long) < 2_100_000
    finally:
        for key in keys:
            spark.conf.unset(key)
