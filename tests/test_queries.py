import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from fieldglass.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        return plain(v.item())
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(f"{v:.9g}")
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else v


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_mining_report_of_teams_without_tells(spark, tmp_path):
    from fieldglass.operators import mining
    from fieldglass.plans.rate_queries import SHOWN
    from fieldglass.plans.tables import CUES, PRIORITIES, cue_table

    con = duckdb.connect()
    for name in ("nation", "customer", "supplier", "part", "orders", "lineitem"):
        # one outcome throughout, so nothing shifts it
        one = "REPLACE ('2-HIGH' AS o_orderpriority)" if name == "orders" else ""
        con.sql(f"CREATE TABLE {name} AS SELECT * {one} FROM '{DATA}/{name}.parquet'")
        con.sql(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    got, want = QUERIES["mining_report"](spark, str(tmp_path)).toPandas(), con.sql(ORACLES["mining_report"]).df()
    assert (want["n_tells"] == 0).any()
    assert rows(got) == rows(want)
    said = mining.mining_summary(cue_table(spark, str(tmp_path)), "team", "outcome", CUES, PRIORITIES, "week", SHOWN).filter("n_tells = 0").toPandas()
    assert len(said) and said["note"].notna().all()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_names_need_no_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 40)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True).stdout.strip() == "True"
