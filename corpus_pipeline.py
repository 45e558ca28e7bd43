"""A corpus pipeline: each stage works on all that the one before it kept, and its result is written and read again.

quality: documents that the rule ensemble scores under 0.5 go. lines: repeated runs of lines go from later texts; a
text may become empty. near_duplicates: of each component of near copies the document with the smallest id stays.
decontaminate: documents with a copy of a benchmark item, within its budget of edits, go. pieces: the rest is encoded.

Rows with null ids or texts pass each stage unless its rule names them. Repeated rows count as one document from the
third stage on, the first by text and hash. Empty tables give empty results, without labels every text passes, ties are
the operators' own. Texts are read whole, however long. Further columns pass, whatever their names; n_chars, where there
is one, follows the text. Executors keep what earlier stages have taken, so every stage reads and sends small batches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldglass.llm.common import crc_mod, drop_written, fresh, sent, small_batches, table, written
from fieldglass.llm.decontaminate import drop_leaks
from fieldglass.llm.line_dedup import dedupe_lines
from fieldglass.llm.ngram_join import jaccard_components
from fieldglass.llm.pieces import piece_rows
from fieldglass.llm.quality import drop_low_quality, train_quality


def lean(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage in small batches, also where it runs by itself."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@lean
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train_quality(docs, table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 3) != 1))
    return drop_low_quality(docs, model)


@lean
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = dedupe_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


@lean
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = written(jaccard_components(docs), "components")
    copies = sent(written(found.filter("doc_id <> component_id").select("doc_id").distinct(), "copies"))
    kept = docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    # rows that share an id are one document: its first text by order stays, and of equal texts the row with the first hash
    repeated = sent(written(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated"))
    nth = fresh("__nth", docs.columns)
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), F.xxhash64(*docs.columns))
    first = kept.join(repeated, "doc_id", "left_semi").withColumn(nth, F.row_number().over(order)).filter(F.col(nth) == 1)
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(first.select(*docs.columns))


@lean
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


@lean
def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_rows(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pieces", pieces)]

#: Learned scores, edit distances and lattice searches are beyond SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
