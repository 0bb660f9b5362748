import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from worklake.functions.contracts import Contract, Field
from worklake.functions.scalars import hash_unit
from worklake.operators.queues import Shift
from worklake.operators.recon import StageFailed
from worklake.operators.scoring import CHAMPION, TRIAL, Head
from worklake.plans import daily
from worklake.session import scratch_path
from worklake.sources import readers

D1, D2 = date(2026, 10, 1), date(2026, 10, 2)
HEADS = (Head("alpha", CHAMPION, "pediatric", 0.5, 0.9, "alpha-fv1", "ALPHA"), Head("beta", TRIAL, "adult", 0.5, 0.9, "beta-fv1", "BETA"),
         Head("check", CHAMPION, "all", 0.99, 1.01, "check-fv1", checks_quality=True))


SOURCES = (
    daily.Source("requests", Contract("request", "request_no", (Field("request_no", required=True), Field("person_no", required=True), Field("requested_at", "timestamp", True),
                                                               Field("unit", values=("ED", "WARD")), Field("urgency"), Field("note"))), readers.read_psv, True),
    daily.Source("records", Contract("record", "record_id", (Field("record_id", required=True), Field("request_no", required=True), Field("person_no"), Field("taken_day", "date8", True),
                                                            Field("taken_time", "time6", True), Field("file_name"), Field("height", "int"), Field("width", "int"))), readers.read_jsonl),
    daily.Source("reports", Contract("report", "request_no", (Field("request_no", required=True), Field("reported_at", "timestamp"), Field("reader"), Field("finding"), Field("text"))),
                 readers.read_jsonl),
    daily.Source("persons", Contract("person", "person_no", (Field("person_no", required=True), Field("given_name"), Field("family_name"), Field("birth_date", "date"), Field("sex"))),
                 readers.read_csv))


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def land(root, day, n, faults=False):
    at = datetime.combine(day, datetime.min.time()) + timedelta(hours=7)
    key = lambda i: f"{day:%d}-{i:03d}"
    requests = [[key(i), f"P{i}", str(at + timedelta(minutes=4 * i)), "ED", "STAT", ""] for i in range(n)]
    records = [{"record_id": f"R{key(i)}", "request_no": key(i), "person_no": f"P{i}", "taken_day": f"{day:%Y%m%d}",
                "taken_time": f"{at + timedelta(minutes=4 * i):%H%M%S}", "file_name": f"f{key(i)}.png", "height": 10} for i in range(n)]
    if faults:
        requests[3][2] = f"{day} 25:61:00"
        records += [dict(records[5]), dict(records[6])]
        records[7]["request_no"] = ""
    psv = ["|".join(SOURCES[0].contract.names)] + ["|".join(r) for r in requests] + [f"T|{n}"]
    put(root / "requests" / str(day), "requests.psv", "\n".join(psv) + "\n")
    put(root / "records" / str(day), "records.jsonl", "".join(json.dumps(r) + "\n" for r in records))
    lost = [{"request_no": "nobody", "reported_at": str(at), "reader": "RAD01", "finding": "NORMAL"}] if faults else []
    reports = lost + [{"request_no": key(i), "reported_at": str(at + timedelta(hours=3)), "reader": "RAD01",
                "finding": ("ALPHA", "NORMAL", "BETA")[i % 3]} for i in range(0, n, 2)]
    put(root / "reports" / str(day), "reports.jsonl", "".join(json.dumps(r) + "\n" for r in reports))
    people = "".join(f"P{i},G{i},F{i},{2022 - 3 * i}-05-01,F\n" for i in range(n))
    put(root / "persons" / str(day), "persons.csv", "person_no,given_name,family_name,birth_date,sex\n" + people)
    put(root / "manifest" / "records" / str(day), "manifest.json",
        json.dumps({"source": "records", "business_date": str(day), "records": len(records)}))


def run(lake, day, first=D1):
    daily.bronze(lake, day)
    daily.silver(lake, day)
    daily.gold(lake, day)
    files = lake.read("gold.fact_item", daily.on(day)).select("file_name").withColumn("light", hash_unit(F.lit("light"), F.col("file_name")))
    daily.score(lake, day, lambda h: hash_unit(F.lit(h.name), F.lit(h.stage), F.col("file_name")), files)
    daily.outcomes(lake, day, first)


def test_two_days_with_faults_and_a_rerun(spark, tmp_path):
    land(tmp_path, D1, 20, faults=True)
    land(tmp_path, D2, 12)
    lake = daily.Lake(spark, scratch_path(spark, "lake"), str(tmp_path), SOURCES, HEADS, (("alpha", "ALPHA"), ("beta", "BETA")), shift=Shift(minutes=10), quality=("light",), drift_limits=(0.1, 0.25, 5))
    run(lake, D1)
    assert lake.read("ref.scoring_run").first()["drift_level"] == "UNAVAILABLE"
    daily.store_reference(lake, spark.range(500).select(hash_unit(F.lit("r"), F.col("id").cast("string")).alias("light")))
    assert {r["reasons"] for r in lake.read("bronze.quarantine").collect()} == {
        f"requested_at: not a timestamp ('{D1} 25:61:00')", "request_no: missing"}
    checks = {(r["stage"], r["entity"], r["check_name"]): r for r in lake.read("ref.recon_results").collect()}
    assert checks["silver", "record", "duplicates dropped"]["actual"] == 2
    assert checks["bronze", "record", "manifest records = records in file"]["status"] == "MATCHED"
    assert checks["bronze", "request", "trailer count = data lines"]["status"] == "MATCHED"
    assert checks["gold", "fact_item", "items without a valid request"]["actual"] == 1
    assert checks["gold", "fact_report", "reports without an item"]["actual"] == 1
    assert lake.read("gold.fact_item").count() == 19
    audit = {(r["stage"], r["entity"]): (r["rows_in"], r["rows_out"], r["rows_rejected"]) for r in lake.read("ref.load_audit").collect()}
    assert audit["bronze", "request"] == (20, 19, 1) and audit["bronze", "record"] == (22, 21, 1) and audit["bronze", "*"] == (73, 71, 2)
    assert audit["silver", "record"] == (21, 19, 2) and audit["gold", "fact_item"] == (19, 19, 0) and audit["outcomes", "fact_outcome"] == (19, 19, 0)
    before = sorted(r.asDict().items() for r in lake.read("gold.daily_summary").collect())

    run(lake, D1)  # again: nothing changes
    assert sorted(r.asDict().items() for r in lake.read("gold.daily_summary").collect()) == before
    run(lake, D2)
    outcome = lake.read("gold.fact_outcome")
    assert {r[daily.DAY]: r["count"] for r in outcome.groupBy(daily.DAY).count().collect()} == {D1: 19, D2: 12}
    # total service is the same in every order, so the waits only change hands
    sums = outcome.groupBy(daily.DAY).agg(F.round(F.sum("fifo_wait_min"), 1).alias("f"), F.round(F.sum("triage_wait_min"), 1).alias("t")).collect()
    assert all(r["f"] == pytest.approx(r["t"], abs=1.0) for r in sums)
    views = daily.create_views(lake, D2)
    assert {"v_daily_kpi", "v_triage_outcome", "v_quarantine", "v_stage_status"} <= set(views)
    assert daily.consistency(lake).count() == 0
    assert {r["status"] for r in spark.table("v_stage_status").collect()} == {"COMPLETED"}
    runs = spark.table("v_scoring_run").where("is_final = 1").collect()
    assert len(runs) == 2 and {r["drift_level"] for r in runs} <= {"OK", "WARN", "ALERT", "TOO_FEW"} and all(r["message"] == "" for r in runs)
    assert {r["rows_out"] for r in spark.table("v_stage_status").where(f"stage = 'gold' and business_date = date'{D2}'").collect()} == {12 + 6}


def test_a_rerun_without_rows_leaves_none(spark, tmp_path):
    land(tmp_path, D1, 6)
    lake = daily.Lake(spark, scratch_path(spark, "lake"), str(tmp_path), SOURCES, HEADS)
    run(lake, D1)
    put(tmp_path / "records" / str(D1), "records.jsonl", "")
    put(tmp_path / "reports" / str(D1), "reports.jsonl", "")
    put(tmp_path / "manifest" / "records" / str(D1), "manifest.json", json.dumps({"source": "records", "business_date": str(D1), "records": 0}))
    run(lake, D1)
    for table in ("bronze.record", "silver.record", "gold.fact_item", "gold.fact_report", "gold.fact_outcome", "gold.daily_summary", "gold.daily_model_summary"):
        assert lake.read(table).count() == 0, table
    last = lake.read("ref.scoring_run").orderBy(F.desc("ended_at")).first()
    assert (last["status"], last["message"]) == ("FAILED", "no items for the date")


def test_a_contract_needs_what_the_stages_read():
    with pytest.raises(ValueError, match="reader"):
        daily.Source("reports", Contract("report", "request_no", (Field("request_no"), Field("reported_at"), Field("finding"), Field("text"))), readers.read_jsonl)


def test_missing_file_fails_the_stage(spark, tmp_path):
    land(tmp_path, D1, 5)
    (tmp_path / "reports" / str(D1) / "reports.jsonl").unlink()
    (tmp_path / "reports" / str(D1)).rmdir()
    lake = daily.Lake(spark, scratch_path(spark, "lake"), str(tmp_path), SOURCES, HEADS)
    with pytest.raises(StageFailed):
        daily.bronze(lake, D1)
    assert lake.read("ref.load_audit").where("entity = '*'").first()["status"] == "FAILED"
    assert lake.read("ref.load_audit").where("entity = 'report'").first()["status"] == "MISSING"
