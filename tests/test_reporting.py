"""Reporting queries at values that the sample tables rarely hold."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from worklake.plans.dashboards import percent
from worklake.registered import all_queries, all_sql
from worklake.session import materialize

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def by_sql(name):
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(all_sql()[name])
    return [c[0] for c in cur.description], cur.fetchall()


def same_as_sql(spark, name):
    columns, theirs = by_sql(name)
    ours = all_queries()[name](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, ours), key=repr) == sorted(theirs, key=repr) and ours


def test_percent_rounds_as_sql_does(spark):
    """Every share of four decimals: 0.0055 is 0.5 %, 0.0045 is 0.5 % too."""
    theirs = duckdb.sql("SELECT round(100 * (i / CAST(10000 AS DOUBLE)), 1) FROM range(10001) t(i) ORDER BY i").fetchall()
    ours = spark.range(10001).orderBy("id").select(percent(F.col("id") / F.lit(10000.0)).alias("p")).collect()
    assert [r.p for r in ours] == [r[0] for r in theirs]


@needs_tables
def test_tile_counts_the_final_run_of_a_date(spark):
    """Every date has two runs; the tile agrees with a recount of the items."""
    same_as_sql(spark, "bi_tile_verify")


@needs_tables
def test_the_summary_stores_what_it_reads(spark, monkeypatch):
    """One row per item of the columns that are summed up or grouped by, all items; the summary agrees with its SQL."""
    all_queries()
    from worklake.registered import reporting

    stored = []
    monkeypatch.setattr(reporting, "materialize", lambda df, name="step": stored.append(materialize(df, name)) or stored[-1])
    same_as_sql(spark, "daily_summary")
    assert len(stored) == 1 and stored[0].count() == spark.read.parquet(f"{SF}/events.parquet").count()
    assert not {"item_id", "arrival", "file_name", "person_id", "report_ts", "probability", "fifo_seq", "triage_seq"} & set(stored[0].columns)
