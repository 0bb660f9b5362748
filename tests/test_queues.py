import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from worklake.operators.queues import Shift, busy_periods, fifo_slots, replay


def check_schedule(jobs, servers, service):
    """jobs: (ready, start, rank). Nobody starts early, servers are neither overbooked nor idle while somebody waits, the best goes first."""
    for ready, start, rank in jobs:
        assert start >= ready
        assert sum(begun <= start < begun + service for _, begun, _ in jobs) <= servers
        freed = [begun + service for _, begun, _ in jobs if ready <= begun + service < start]
        for moment in [ready, *freed] if ready < start else []:
            assert sum(begun <= moment < begun + service for _, begun, _ in jobs) == servers
        assert all(rank <= other for came, begun, other in jobs if came <= start < begun)


def random_day(seed, n, minutes_apart):
    rng = random.Random(seed)
    t, rows = datetime(2024, 3, 1 + seed % 20, 7, 30), []
    for i in range(n):
        t += timedelta(seconds=rng.choice([0, 0, 30, 60, 300, int(60 * minutes_apart * rng.random() * 2)]))
        rows.append((t.date(), i + 1000 * seed, t, rng.choice([0, 0, 1, 2]), rng.choice([.2, .5, .5, .9])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "day date, item bigint, arrival timestamp_ntz, band int, prob double")


@pytest.mark.parametrize("servers", [1, 2, 3])
def test_replay_is_a_proper_schedule(spark, small_pieces, servers):
    rows = [r for seed in range(1, 3) for r in random_day(seed, 45, 4 + 3 * (seed % 3))]
    shift = Shift(servers=servers, minutes=6)
    ranks = {"triage": [F.col("band"), -F.col("prob")]}
    got = {r["item"]: r for r in replay(frame(spark, rows), ["day"], "day", "arrival", "item", shift, ranks).collect()}
    assert len(got) == len(rows)
    for day in {r[0] for r in rows}:
        items = [dict(zip(("day", "item", "arrival", "band", "prob"), r)) for r in rows if r[0] == day]
        opening = datetime.combine(day, datetime.min.time()) + timedelta(hours=8)
        for column, rank in (("start_us", lambda i: (i["arrival"], i["item"])),
                             ("triage_start_us", lambda i: (i["band"], -i["prob"], i["arrival"], i["item"]))):
            jobs = [(max(0, (i["arrival"] - opening) // timedelta(microseconds=1)), got[i["item"]][column], rank(i)) for i in items]
            check_schedule(jobs, servers, shift.service_us)


def test_known_order(spark):
    d = date(2024, 3, 1)
    at = datetime(2024, 3, 1, 8)
    rows = [(d, 0, at, 2, .1), (d, 1, at, 0, .99), (d, 2, at, 1, .6), (d, 3, at, 3, None)]
    got = replay(frame(spark, rows), ["day"], "day", "arrival", "item", Shift(minutes=10),
                 {"triage": [F.col("band"), -F.coalesce("prob", F.lit(0.0))]}).collect()
    assert [r["item"] for r in sorted(got, key=lambda r: r["start_us"])] == [0, 1, 2, 3]
    by_triage = sorted(got, key=lambda r: r["triage_start_us"])
    assert [r["item"] for r in by_triage] == [1, 2, 0, 3]
    assert by_triage[0]["triage_start_us"] == 0


def test_periods_begin_when_all_servers_are_idle(spark, small_pieces):
    rows = random_day(3, 40, 9)
    shift = Shift(minutes=6)
    got = sorted(busy_periods(frame(spark, rows), ["day"], "day", "arrival", "item", shift).collect(),
                 key=lambda r: r["pos"])
    period, end = 0, None
    for r in got:
        if end is None or max(r["arrival_us"], 0) > end:
            period += 1
        assert r["period"] == period
        end = r["start_us"] + shift.service_us


def test_slots_do_not_depend_on_the_pieces(spark):
    df = frame(spark, random_day(5, 60, 5))
    found = []
    for rows in ("1000000", "7"):
        spark.conf.set("spark.worklake.pieceRows", rows)
        slots = fifo_slots(df, ["day"], "day", "arrival", "item", Shift(servers=2))
        found.append(sorted(slots.select("item", "pos", "start_us", "server").collect()))
    spark.conf.unset("spark.worklake.pieceRows")
    assert found[0] == found[1]
