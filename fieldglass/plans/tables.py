"""The driver tables in the shape of play tables, and a registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import right_open
from ..session import share_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
CUES = ["flag", "status", "qty_band", "disc_band", "ptype", "size_band"]


def query(sql: str | None = None):
    """Registers a function under its name, with DuckDB SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    share_path(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Doubles to 6 places: sums differ in their last bits by order."""
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names or [c for c, t in df.dtypes if t == "double"]})


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def week_of(day: Column) -> Column:
    return (F.year(day) - 1995) * 4 + F.quarter(day)


def cue_table(spark: SparkSession, d: str) -> DataFrame:
    """One row per line item: team, outcome, opponent, week, six cues and measures."""
    t = lambda name: table(spark, d, name)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("n_name").alias("team"), F.col("o_orderpriority").alias("outcome"), F.col("c_mktsegment").alias("opponent"), week_of(F.col("o_orderdate")).alias("week"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), right_open(F.col("l_quantity"), [10, 25, 40], ["low", "mid", "high", "bulk"]).alias("qty_band"),
        right_open(F.col("l_discount"), [0.03, 0.07], ["small", "medium", "large"]).alias("disc_band"), F.col("p_type").alias("ptype"), right_open(F.col("p_size"), [15, 35], ["small", "medium", "large"]).alias("size_band"),
        "l_quantity", "l_extendedprice", "l_discount",
    )


#: The same table for DuckDB, as a common table expression.
LC = """lc AS (SELECT n_name AS team, o_orderpriority AS outcome, c_mktsegment AS opponent, (year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) AS week,
  l_returnflag AS flag, l_linestatus AS status, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 25 THEN 'mid' WHEN l_quantity < 40 THEN 'high' ELSE 'bulk' END AS qty_band,
  CASE WHEN l_discount < 0.03 THEN 'small' WHEN l_discount < 0.07 THEN 'medium' ELSE 'large' END AS disc_band, p_type AS ptype, CASE WHEN p_size < 15 THEN 'small' WHEN p_size < 35 THEN 'medium' ELSE 'large' END AS size_band,
  l_quantity, l_extendedprice, l_discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey)"""

#: One row per line item and cue.
CUE_LONG = "long AS (" + " UNION ALL ".join(f"SELECT team, outcome, week, '{c}' AS cue_key, {c} AS cue_value FROM lc" for c in CUES) + ")"
DIMS = "dims AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}')" for p in PRIORITIES) + ") t(outcome))"
