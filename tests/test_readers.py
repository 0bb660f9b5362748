"""Who takes an item, against the source's rule worked through item by item."""

import os
from datetime import datetime, timedelta

import duckdb
import pytest

from test_queues import frame, random_day
from worklake.operators.queues import Shift, readers
from worklake.registered import all_queries, all_sql

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def taken_by(items, servers, opening, service):
    """items: (arrival, item). A reader who gets free with nobody waiting looks again when the next item comes; the first of equals goes."""
    free, out, pending = [opening] * servers, {}, sorted(items)
    while pending:
        r = min(range(servers), key=lambda k: free[k])
        if pending[0][0] > free[r]:
            free[r] = pending[0][0]
            continue
        out[pending.pop(0)[1]] = r
        free[r] += service
    return out


@pytest.mark.parametrize("servers", [1, 2])
def test_first_free_reader(spark, small_pieces, servers):
    rows = [r for seed in range(1, 5) for r in random_day(seed, 60, 3 + 2 * seed)]
    got = readers(frame(spark, rows), ["day"], "day", "arrival", "item", Shift(servers=servers, minutes=6)).collect()
    for day in {r[0] for r in rows}:
        opening = datetime.combine(day, datetime.min.time()) + timedelta(hours=8)
        expected = taken_by([(r[2], r[1]) for r in rows if r[0] == day], servers, opening, timedelta(minutes=6))
        assert {r["item"]: r["reader"] for r in got if r["day"] == day} == expected
    with pytest.raises(ValueError):
        readers(frame(spark, rows), ["day"], "day", "arrival", "item", Shift(servers=3))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_has_both_readers(spark):
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    theirs = con.execute(f"SELECT business_date, item_id, reader FROM ({all_sql()['slot_reader_id']})").fetchall()
    ours = all_queries()["slot_reader_id"](spark, SF).select("business_date", "item_id", "reader")
    assert sorted(map(tuple, ours.collect())) == sorted(theirs)
    assert {r.reader for r in ours.select("reader").distinct().collect()} == {"RAD01", "RAD02"}
