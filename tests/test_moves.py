"""How often the ordered scans and the queue move their rows."""

import os
import re

import pytest
from pyspark.sql import functions as F
from test_queues import frame, random_day

from worklake.operators import ordered, outcomes, quantiles, queues
from worklake.operators.joins import moved_by
from worklake.operators.ordered import numbered
from worklake.operators.queues import Shift, by_start, replay
from worklake.plans.views import v_triage_outcome
from worklake.registered import all_queries, frames
from worklake.session import materialize

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_a_scan_moves_its_rows_once(spark, small_pieces):
    """One exchange of the rows for the scan, the others carry a row per piece; nothing is sorted for a join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(100).select((F.col("id") % 3).alias("k"), (F.col("id") * 37 % 101).alias("v"))
        placed = numbered(df, ["k"], [F.col("v")], "n")
        plan = placed._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "rangepartitioning" not in plan
        rows = sorted(map(tuple, placed.select("k", "v", "n").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [n for _, _, n in rows] == [*range(1, 35), *range(1, 34), *range(1, 34)]


def test_places_by_start_without_a_scan(spark, small_pieces):
    rows = [r for seed in range(1, 3) for r in random_day(seed, 40, 5)]
    got = by_start(replay(frame(spark, rows), ["day"], "day", "arrival", "item", Shift(servers=3, minutes=6),
                          {"triage": [F.col("band"), -F.col("prob")]}, slots=True), ["day"], "triage", "item", "seq").collect()
    for day in {r[0] for r in rows}:
        ordered = sorted((r for r in got if r["day"] == day), key=lambda r: (r["triage_start_us"], r["item"]))
        assert [r["seq"] for r in ordered] == list(range(1, len(ordered) + 1))


def test_a_long_stretch_is_cut_once_whatever_its_length(spark, monkeypatch):
    """The steps that store rows are as many for eight classes of ranks as for two, and the schedule is that of one class."""
    rows = random_day(4, 64, 1)
    stored, found = [], []
    for limit in ("1000000", "32", "8"):
        spark.conf.set("spark.worklake.pieceRows", limit)
        names = []
        for module in (queues, ordered):
            monkeypatch.setattr(module, "materialize", lambda df, name="step": names.append(name) or materialize(df, name))
        got = replay(frame(spark, rows), ["day"], "day", "arrival", "item", Shift(servers=2, minutes=6),
                     {"triage": [F.col("band"), -F.col("prob")]}, slots=True)
        stored.append(len(names))
        found.append(sorted(map(tuple, got.select("item", "pos", "triage_start_us", "triage_slot").collect())))
    spark.conf.unset("spark.worklake.pieceRows")
    assert stored[1] == stored[2]
    assert found[0] == found[1] == found[2]


def test_places_do_not_depend_on_the_classes(spark):
    rows, found = random_day(6, 64, 1), []
    for limit in ("1000000", "8"):
        spark.conf.set("spark.worklake.pieceRows", limit)
        got = queues.served(frame(spark, rows), ["day"], "day", "arrival", "item", Shift(servers=3, minutes=6),
                            {"triage": [F.col("band"), -F.col("prob")], "other": [F.col("prob")]}, places=["triage", "other"]).collect()
        for arm in ("triage", "other"):
            for day in {r[0] for r in rows}:
                placed = sorted((r for r in got if r["day"] == day), key=lambda r: (r[f"{arm}_start_us"], r["item"]))
                assert [r[f"{arm}_seq"] for r in placed] == list(range(1, len(placed) + 1))
        found.append(sorted(map(tuple, got)))
    spark.conf.unset("spark.worklake.pieceRows")
    assert found[0] == found[1]


def test_outcomes_do_not_move_to_the_persons(spark):
    """Only the narrow facts are shuffled by person."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        outcomes = spark.createDataFrame([], "business_date date, item int, arrival timestamp, unit string, age_years int, fifo_seq int, "
                                         "triage_seq int, probability double, population string, triage_model string, quality_check string, "
                                         "shadow_priority string, shadow_model string, priority string, model_version string, truth_known "
                                         "boolean, finding string, outcome string, fifo_wait_min double, triage_wait_min double, "
                                         "shadow_wait_min double, wait_saved_min double, truth int, truth_second int")
        facts = spark.range(3).select(F.current_date().alias("business_date"), F.col("id").cast("int").alias("item"), F.col("id").alias("person"))
        persons = spark.range(3).select(F.col("id").alias("person"), F.lit("x").alias("segment"))
        view = v_triage_outcome(outcomes.repartition(2), facts.repartition(2), persons, "item", "person", [], ["segment"])
        lines = view._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sides = {}
    for at, line in enumerate(lines):
        if "Exchange hashpartitioning(person" in line:
            depth = line.index("Exchange")
            below = lines[at + 1:]
            end = next((i for i, x in enumerate(below) if len(x) - len(x.lstrip(" :+-*()0123456789")) < depth), len(below))
            sides[at] = "\n".join(below[:end])
    assert len(sides) == 2 and not any("wait_saved_min" in s for s in sides.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_outcomes_and_their_view_move_by_item_alone(spark):
    """Queue, reports and items meet by item; a second key would move the queue's rows once more, and the view's wide rows too."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (
            frames.outcomes(spark, SF), all_queries()["v_triage_outcome"](spark, SF))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for plan in plans:
        assert "hashpartitioning(item_id" in plan and "hashpartitioning(business_date" in plan
        assert not re.search(r"hashpartitioning\(business_date#\d+, item_id#", plan)
    assert len(re.findall(r"Exchange hashpartitioning\(item_id#", plans[0])) == 3


def test_moved_by_compares_both_columns(spark):
    """An item of two dates meets its own date only; nulls meet nothing."""
    left = spark.createDataFrame([("a", 1, 10), ("b", 1, 11), (None, 1, 12), ("a", None, 13)], "day string, item int, x int")
    right = spark.createDataFrame([("a", 1, 20), ("b", 1, 21), ("c", 1, 22), (None, 1, 23), ("a", None, 24)], "day string, item int, y int")
    got = moved_by(left, right, "item", "day").select("day", "item", "x", "y").collect()
    plain = left.join(right, ["day", "item"]).select("day", "item", "x", "y").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain)) == [("a", 1, 10, 20), ("b", 1, 11, 21)]


def test_waits_move_without_text(spark, monkeypatch):
    """Dates, numbers of series, waits and counts: nothing of a row that moves for the quantiles is a string."""
    moved = []
    monkeypatch.setattr(quantiles, "chunk", lambda df, *a: moved.append(dict(df.dtypes)) or ordered.chunk(df, *a))
    rows = spark.createDataFrame([(1, "x", 0.5, 2.0), (1, "x", 1.0, 3.0), (1, "y", 7.0, 9.5), (2, "x", 4.0, 5.0)], "day int, kind string, a double, b double")
    got = outcomes.group_waits(rows, ["day"], {"x": F.col("kind") == "x", "y": F.col("kind") == "y"}, {"one": "a", "two": "b"})
    found = {r["day"]: r.asDict() for r in got.collect()}
    assert [set(m.values()) for m in moved] == [{"int", "double", "bigint"}]
    assert found[1] == {"day": 1, "x_one_median_min": 0.8, "x_one_p90_min": 1.0, "x_two_median_min": 2.5, "x_two_p90_min": 3.0,
                        "y_one_median_min": 7.0, "y_one_p90_min": 7.0, "y_two_median_min": 9.5, "y_two_p90_min": 9.5}
    assert found[2]["x_two_p90_min"] == 5.0 and found[2]["y_one_median_min"] is None
