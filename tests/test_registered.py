"""The registry: complete, valid SQL, and a sample of queries compared with it (the rest is compared by the driver)."""

import os

import duckdb
import pytest

from worklake.registered import all_queries, all_sql

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["contract_reasons", "read_psv_trailer", "recon_replace_stage", "scd1_current", "shadow_arbitrate", "daily_summary",
          "v_triage_outcome", "balanced_sample", "psi", "stage_state", "trailer_check", "quarantine_summary", "bi_detail_table", "read_csv_header", "train_head", "c_sweep", "c_sweep_bands"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())


def test_sql_is_valid(duck):
    for name, text in all_sql().items():
        duck.execute(f"EXPLAIN {text}")


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, duck, name):
    df = all_queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(repr, (r[c] for c in columns))) for r in df.collect())
    cur = duck.execute(all_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(map(repr, (r[names.index(c)] for c in columns))) for r in cur.fetchall())
    assert ours == theirs and ours


def test_whole_tables_in_small_pieces(spark, duck):
    """Cut into pieces of a few rows, the queue and the summaries come out the same."""
    spark.conf.set("spark.worklake.pieceRows", "100")
    try:
        test_same_rows(spark, duck, "daily_summary")
    finally:
        spark.conf.unset("spark.worklake.pieceRows")
