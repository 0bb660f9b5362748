"""Daily and per-model summaries, views, dashboard shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from worklake.functions import contracts as C
from worklake.operators import outcomes as O
from worklake.operators import recon
from worklake.operators.joins import orphans
from worklake.operators.latest import latest_per_key
from worklake.plans import dashboards as D
from worklake.plans import views as V
from worklake.registered.base import cte, query, table
from worklake.registered.frames import (EVENT_RECORD, FINDING_OF, events, heads_judged, items, outcomes, raw_records, reports,
                                        scored_items)
from worklake.registered.ingest import audit, bronze_checks
from worklake.registered.scoring import run_summaries
from worklake.session import materialize, scratch_path
from worklake.sources import tables

ARMS = {a: f"{a}_wait_min" for a in ("fifo", "triage", "shadow")}
_WHERE = {"alpha": "truth = 1", "beta": "truth_second = 1", "normal": "finding = 'NORMAL'"}


def _classes():
    return {"alpha": F.col("truth") == 1, "beta": F.col("truth_second") == 1, "normal": F.col("finding") == "NORMAL"}


_waits = ", ".join(
    f"round(quantile_cont(round({col} * 10), 0.5) FILTER ({cond})) / 10 AS {g}_{a}_median_min, "
    f"round(list_sort(list({col}) FILTER ({cond}))[least(count(*) FILTER ({cond}), "
    f"CAST(floor(CAST(0.9 AS DOUBLE) * count(*) FILTER ({cond})) AS BIGINT) + 1)], 1) AS {g}_{a}_p90_min"
    for g, cond in _WHERE.items() for a, col in ARMS.items())
cte("waits", f"SELECT business_date, {_waits} FROM {{outcomes}} GROUP BY business_date")
_ratios = """round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 4) AS sensitivity, round(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 4) AS specificity,
  round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 4) AS ppv"""
cte("daily", f"""SELECT c.*, {_ratios}, round(CAST(reported AS DOUBLE) / studies, 4) AS truth_completeness, w.* EXCLUDE (business_date)
  FROM (SELECT business_date, count(*) AS studies, count(*) FILTER (scored) AS scored, count(*) FILTER (truth_known) AS reported,
  count(*) FILTER (truth = 1) AS alpha, count(*) FILTER (truth_second = 1) AS beta, count(*) FILTER (priority = 'P1') AS p1,
  count(*) FILTER (priority = 'P2') AS p2, count(*) FILTER (priority = 'P3') AS p3, count(*) FILTER (NOT scored) AS unscored,
  count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FN') AS fn, count(*) FILTER (outcome = 'FP') AS fp,
  count(*) FILTER (outcome = 'TN') AS tn, round(coalesce(sum(wait_saved_min) FILTER (truth = 1), 0), 1) AS alpha_minutes_saved,
  string_agg(DISTINCT model_version, ',' ORDER BY model_version) AS model_version,
  count(*) FILTER (population = 'adult') AS adults, count(*) FILTER (priority = 'NA') AS not_triaged,
  count(*) FILTER (quality_check = 'UNSUITABLE') AS unsuitable FROM {{outcomes}} GROUP BY business_date) c
  JOIN {{waits}} w ON w.business_date = c.business_date""")


def waits(spark, sf, rows=None):
    return O.group_waits(outcomes(spark, sf) if rows is None else rows, ["business_date"], _classes(), ARMS)


def daily(spark, sf, rows=None):
    if rows is None:  # replayed once, stored with the columns that the summary and its waits read
        rows = materialize(outcomes(spark, sf).select("business_date", *O.SUMMARISED, "finding", *ARMS.values()), "outcomes")
    return O.daily_summary(rows, waits(spark, sf, rows), "business_date", "alpha", "beta")


@query("daily_summary", "SELECT * FROM {daily}")
def daily_summary(spark, sf):
    return daily(spark, sf)


@query("median_wait", "SELECT business_date, " + ", ".join(f"{g}_{a}_median_min" for g in _WHERE for a in ARMS) + " FROM {waits}")
def median_wait(spark, sf):
    return waits(spark, sf).select("business_date", *[f"{g}_{a}_median_min" for g in _WHERE for a in ARMS])


@query("p90_nearest", "SELECT business_date, " + ", ".join(f"{g}_{a}_p90_min" for g in _WHERE for a in ARMS) + " FROM {waits}")
def p90_nearest(spark, sf):
    return waits(spark, sf).select("business_date", *[f"{g}_{a}_p90_min" for g in _WHERE for a in ARMS])


@query("distinct_versions", """SELECT business_date, unit, string_agg(DISTINCT model_version, ',' ORDER BY model_version) AS model_version
  FROM {scored_items} GROUP BY ALL""")
def distinct_versions(spark, sf):
    return scored_items(spark, sf).groupBy("business_date", "unit").agg(
        O.distinct_versions(F.col("model_version")).alias("model_version"))


cte("model_daily", f"""SELECT *, {_ratios} FROM (SELECT business_date, model, stage, model_version, count(*) AS scored,
  count(*) FILTER (in_scope) AS in_scope, count(truth) FILTER (in_scope) AS reported, coalesce(sum(truth) FILTER (in_scope), 0) AS positives,
  count(*) FILTER (in_scope AND truth = 1 AND positive) AS tp, count(*) FILTER (in_scope AND truth = 1 AND NOT positive) AS fn,
  count(*) FILTER (in_scope AND truth = 0 AND positive) AS fp, count(*) FILTER (in_scope AND truth = 0 AND NOT positive) AS tn
  FROM {{heads_judged}} GROUP BY ALL)""")


def model_daily(spark, sf):
    return O.daily_model_summary(heads_judged(spark, sf), ["business_date", "model", "stage", "model_version"])


@query("daily_model_summary", "SELECT * FROM {model_daily}")
def daily_model_summary(spark, sf):
    return model_daily(spark, sf)


cte("evidence", f"""SELECT * EXCLUDE (ppv) FROM (SELECT *, tp + fn AS positives, tn + fp AS negatives, {_ratios} FROM (
  SELECT model, model_version, count(DISTINCT business_date) AS days, sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp, sum(tn) AS tn
  FROM {{model_daily}} WHERE stage = 'silent_trial' GROUP BY ALL))""")


@query("trial_evidence", "SELECT * FROM {evidence}")
def trial_evidence(spark, sf):
    return O.trial_evidence(model_daily(spark, sf), ["model", "model_version"])


_ARRIVED = "2024-01-13"  # the date whose reports arrive after the outcomes were built
cte("touched_dates", f"""SELECT DISTINCT i.business_date FROM {{signed_reports}} r JOIN {{items}} i ON i.item_id = r.item_id WHERE r.report_date = DATE '{_ARRIVED}'""")
cte("known_reports", f"""SELECT item_id, finding, report_date FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY report_ts DESC, version DESC) AS rn
  FROM {{signed_reports}} WHERE report_date <= DATE '{_ARRIVED}') WHERE rn = 1""")


@query("late_truth_refresh", """SELECT s.business_date, s.item_id, s.priority, r.finding, CASE WHEN s.priority IS NULL THEN 'UNSCORED' WHEN r.finding IS NULL THEN 'PENDING'
    WHEN s.triage_model IS NULL THEN 'NOT_TRIAGED' WHEN r.finding = upper(s.triage_model) THEN CASE WHEN s.priority IN ('P1', 'P2') THEN 'TP' ELSE 'FN' END
    WHEN s.priority IN ('P1', 'P2') THEN 'FP' ELSE 'TN' END AS outcome, t.business_date IS NOT NULL AS refreshed
  FROM {scored_items} s LEFT JOIN {known_reports} r ON r.item_id = s.item_id LEFT JOIN {touched_dates} t ON t.business_date = s.business_date""")
def late_truth_refresh(spark, sf):
    """Outcomes stand as of the day before; the reports of one date arrive. Only the dates of their items are read, judged again and
    overwritten; all others keep the rows they had."""
    from worklake.registered.frames import signed_reports

    root = scratch_path(spark, "late")
    keep = ["business_date", "item_id", "file_name", "priority", "triage_model"]
    tables.write_table(scored_items(spark, sf).select(*keep), f"{root}/items")
    signed, arrived = signed_reports(spark, sf), F.lit(_ARRIVED).cast("date")
    before = signed.where(F.col("report_date") < arrived)
    tables.write_table(late_outcomes(tables.read_table(spark, f"{root}/items"), before, False), f"{root}/outcomes")
    touched = O.touched_dates(signed.where(F.col("report_date") == arrived), tables.read_table(spark, f"{root}/items"), "item_id", "business_date")
    again = tables.read_table(spark, f"{root}/items", F.col("business_date").isin(touched))  # prunes the folders of all other dates
    tables.replace_partitions(late_outcomes(again, signed.where(F.col("report_date") <= arrived), True), f"{root}/outcomes")
    return tables.read_table(spark, f"{root}/outcomes").select("business_date", "item_id", "priority", "finding", "outcome", "refreshed")


def late_outcomes(rows, reports_known, refreshed):
    newest = latest_per_key(reports_known, ["item_id"], [F.col("report_ts").desc(), F.col("version").desc()])
    joined = rows.join(newest.select("item_id", "finding"), "item_id", "left")
    truth = O.model_truth(F.col("triage_model"), F.col("finding"), F.startswith("file_name", F.lit("QC-")), FINDING_OF, "check")
    outcome = O.outcome_class(F.col("priority"), F.col("finding").isNotNull(), F.col("triage_model"), truth, F.col("priority").isin("P1", "P2"))
    return joined.select("business_date", "item_id", "priority", "finding", outcome.alias("outcome"), F.lit(refreshed).alias("refreshed"))


# ---- views

cte("v_outcome", """SELECT o.business_date, o.item_id, o.arrival, o.unit, o.age_years, i.value, c.c_mktsegment, o.fifo_seq, o.triage_seq, o.probability,
  CASE WHEN o.age_years IS NULL THEN 'UNKNOWN' WHEN o.age_years < 1 THEN '<1' WHEN o.age_years < 3 THEN '1-2'
  WHEN o.age_years < 18 THEN '3-17' WHEN o.age_years < 40 THEN '18-39' WHEN o.age_years < 65 THEN '40-64' ELSE '65+' END AS age_band,
  o.population, o.triage_model, o.quality_check, o.shadow_priority, o.shadow_model, coalesce(o.priority, 'UNSCORED') AS priority,
  o.model_version, o.truth_known, o.finding, o.outcome, o.fifo_wait_min, o.triage_wait_min, o.shadow_wait_min, o.wait_saved_min,
  CASE WHEN o.truth = 1 THEN 1 ELSE 0 END AS is_positive, CASE WHEN o.truth_second = 1 THEN 1 ELSE 0 END AS is_second,
  CASE WHEN o.priority = 'P1' THEN 1 ELSE 0 END AS is_p1,
  CASE WHEN o.business_date = max(o.business_date) OVER () THEN 1 ELSE 0 END AS is_latest
  FROM {outcomes} o JOIN {items} i ON i.business_date = o.business_date AND i.item_id = o.item_id
  LEFT JOIN customer c ON c.c_custkey = i.person_id""")


def view_outcome(spark, sf, rows=None):
    persons = table(spark, sf, "customer").select(F.col("c_custkey").alias("person_id"), "c_mktsegment")
    return V.v_triage_outcome((rows or outcomes(spark, sf)).drop("person_id"), items(spark, sf), persons, "item_id", "person_id", ["value"],
                              ["c_mktsegment"])


query("v_triage_outcome", "SELECT * FROM {v_outcome}")(view_outcome)

cte("v_kpi", """SELECT *, alpha_fifo_median_min - alpha_triage_median_min AS alpha_median_minutes_saved,
  CASE WHEN alpha_fifo_median_min > 0 THEN 1 - alpha_triage_median_min / alpha_fifo_median_min END AS alpha_wait_reduction,
  normal_triage_median_min - normal_fifo_median_min AS normal_median_minutes_added,
  beta_triage_median_min - beta_shadow_median_min AS beta_minutes_go_live_saves,
  CASE WHEN business_date = max(business_date) OVER () THEN 1 ELSE 0 END AS is_latest FROM {daily}""")


def view_kpi(spark, sf):
    return V.v_daily_kpi(daily(spark, sf), "alpha", "beta", events(spark, sf))


query("v_daily_kpi", "SELECT * FROM {v_kpi}")(view_kpi)


def _rounded(df, *columns, digits=9):
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


@query("v_band_daily", """SELECT business_date, coalesce(priority, 'UNSCORED') AS priority, count(*) AS films, count(*) FILTER (truth_known) AS reported,
  count(*) FILTER (truth = 1) AS positives, round(CAST(count(*) FILTER (truth = 1) AS DOUBLE) / nullif(count(*) FILTER (truth_known), 0), 9) AS positive_rate,
  round(avg(probability), 9) AS avg_probability, round(avg(triage_wait_min), 9) AS avg_triage_wait_min,
  round(avg(fifo_wait_min), 9) AS avg_fifo_wait_min, CASE WHEN business_date = max(business_date) OVER () THEN 1 ELSE 0 END AS is_latest
  FROM {outcomes} GROUP BY business_date, coalesce(priority, 'UNSCORED')""")
def v_band_daily(spark, sf):
    return _rounded(V.v_band_daily(outcomes(spark, sf), events(spark, sf)), "positive_rate", "avg_probability", "avg_triage_wait_min",
                    "avg_fifo_wait_min")


@query("v_unit_daily", """SELECT business_date, unit, count(*) AS films, count(*) FILTER (priority = 'P1') AS p1_films,
  count(*) FILTER (truth = 1) AS positives, round(avg(fifo_wait_min), 9) AS avg_fifo_wait_min, round(avg(triage_wait_min), 9) AS avg_triage_wait_min,
  round(avg(fifo_wait_min) FILTER (truth = 1), 9) AS positive_avg_fifo_wait_min,
  round(avg(triage_wait_min) FILTER (truth = 1), 9) AS positive_avg_triage_wait_min,
  CASE WHEN business_date = max(business_date) OVER () THEN 1 ELSE 0 END AS is_latest FROM {outcomes} GROUP BY business_date, unit""")
def v_unit_daily(spark, sf):
    return _rounded(V.v_unit_daily(outcomes(spark, sf), events(spark, sf)), "avg_fifo_wait_min", "avg_triage_wait_min",
                    "positive_avg_fifo_wait_min", "positive_avg_triage_wait_min")


cte("model_events", """SELECT e.event_id, nullif(c.c_mktsegment, 'FURNITURE') AS model, CASE e.event_type WHEN 'signup' THEN 'GATE_PASSED'
  WHEN 'error' THEN 'ROLLED_BACK' WHEN 'click' THEN 'SILENT_TRIAL' WHEN 'view' THEN 'DEPLOYED' ELSE 'PROMOTED' END AS event,
  e.ts AS recorded_at, 'fv' || e.k AS model_version FROM {ev} e LEFT JOIN customer c ON c.c_custkey = e.user_id""")


def model_events(spark, sf):
    name = F.when(F.col("event_type") == "signup", "GATE_PASSED").when(F.col("event_type") == "error", "ROLLED_BACK") \
        .when(F.col("event_type") == "click", "SILENT_TRIAL").when(F.col("event_type") == "view", "DEPLOYED").otherwise("PROMOTED")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return events(spark, sf).join(c, F.col("c_custkey") == F.col("user_id"), "left").select(
        "event_id", F.nullif("c_mktsegment", F.lit("FURNITURE")).alias("model"), name.alias("event"),
        F.col("ts").alias("recorded_at"), F.concat(F.lit("fv"), F.col("k").cast("string")).alias("model_version"))


@query("v_model_event", """SELECT event_id, coalesce(model, 'default') AS model, event AS model_event, recorded_at, model_version,
  CAST(recorded_at AS DATE) AS event_date, CASE WHEN row_number() OVER (PARTITION BY coalesce(model, 'default'), event
  ORDER BY recorded_at DESC, event_id DESC) = 1 THEN 1 ELSE 0 END AS is_latest FROM {model_events}""")
def v_model_event(spark, sf):
    return V.v_model_event(model_events(spark, sf), "default", "event_id")


# A date's run is repeated once; the first ended an hour before.
cte("runs", """SELECT r.*, 'score-' || business_date || '-' || attempt AS run_id, CAST(business_date AS TIMESTAMP) + to_hours(20 + attempt) AS ended_at,
  CASE attempt WHEN 0 THEN 'schedule' ELSE 'user' END AS triggered_by FROM {run_summary} r, (SELECT unnest([0, 1]) AS attempt)""")


def runs(spark, sf):
    attempt = F.explode(F.array(F.lit(0), F.lit(1))).alias("attempt")
    per_run = run_summaries(spark, sf).select("*", attempt).select(
        "*", F.concat_ws("-", F.lit("score"), F.col("business_date").cast("string"), "attempt").alias("run_id"),
        F.timestamp_add("HOUR", F.col("attempt") + 20, F.col("business_date").cast("timestamp_ntz")).alias("ended_at"),
        F.when(F.col("attempt") == 0, "schedule").otherwise("user").alias("triggered_by")).drop("attempt")
    return materialize(per_run, "runs")  # a log table: written by the runs, read by the view


cte("v_runs", """SELECT *, CASE WHEN row_number() OVER (PARTITION BY business_date ORDER BY ended_at DESC, run_id DESC) = 1 THEN 1 ELSE 0 END
  AS is_final, CASE WHEN business_date = max(business_date) OVER () THEN 1 ELSE 0 END AS is_latest FROM {runs}""")


@query("v_scoring_run", "SELECT * FROM {v_runs}")
def v_scoring_run(spark, sf):
    return V.v_scoring_run(runs(spark, sf))


cte("labelled", "SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
cte("training_set", """SELECT lang AS data_split, count(*) AS films, sum(quality) AS positives, CAST(NULL AS BIGINT) AS persons
  FROM {labelled} GROUP BY lang UNION ALL SELECT 'all', count(*), sum(quality), count(DISTINCT source) FROM {labelled}""")


def labelled(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


def training_set(spark, sf):
    return O.training_set_counts(labelled(spark, sf), "lang", "quality", "source")


@query("training_set_counts", "SELECT * FROM {training_set}")
def training_set_counts(spark, sf):
    return training_set(spark, sf)


@query("v_training_set", """SELECT *, coalesce(CAST(NULL AS VARCHAR), 'default') AS model, round(CAST(positives AS DOUBLE) / nullif(films, 0), 6) AS prevalence
  FROM {training_set}""")
def v_training_set(spark, sf):
    view = V.v_training_set(training_set(spark, sf).withColumn("model", F.lit(None).cast("string")), "default")
    return _rounded(view, "prevalence", digits=6)


cte("v_models", "SELECT *, CASE WHEN business_date = max(business_date) OVER () THEN 1 ELSE 0 END AS is_latest FROM {model_daily}")


def view_models(spark, sf):
    return V.v_model_daily(model_daily(spark, sf), events(spark, sf))


query("v_model_daily", "SELECT * FROM {v_models}")(view_models)

cte("v_trial", """SELECT *, tp + fn AS positives, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS sensitivity,
  round(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 6) AS specificity FROM (SELECT model, model_version, count(DISTINCT business_date) AS trial_days,
  min(business_date) AS first_day, max(business_date) AS last_day, sum(in_scope) AS in_scope, sum(reported) AS reported, sum(tp) AS tp,
  sum(fn) AS fn, sum(fp) AS fp, sum(tn) AS tn FROM {model_daily} WHERE stage = 'silent_trial' GROUP BY ALL)""")


@query("v_silent_trial", "SELECT * FROM {v_trial}")
def v_silent_trial(spark, sf):
    return _rounded(V.v_silent_trial(model_daily(spark, sf)), "sensitivity", "specificity", digits=6)


cte("v_quality", """SELECT *, actual - expected AS difference, CASE WHEN status = 'MISMATCH' THEN 1 ELSE 0 END AS is_mismatch,
  CASE WHEN status = 'EXPLAINED' THEN 1 ELSE 0 END AS is_explained, CASE WHEN status = 'MATCHED' THEN 1 ELSE 0 END AS is_matched,
  CASE WHEN business_date = max(business_date) OVER () THEN 1 ELSE 0 END AS is_latest FROM {bronze_checks}""")


@query("v_data_quality", "SELECT * FROM {v_quality}")
def v_data_quality(spark, sf):
    return V.v_data_quality(bronze_checks(spark, sf), events(spark, sf))


# The stage ran twice a date; the first run saw nothing but rejected rows.
@query("v_stage_status", """SELECT business_date, stage, entity, rows_in, rows_out, rows_rejected, status, matched, explained, mismatched,
  'run-1' AS run_id, CAST(business_date AS TIMESTAMP) + INTERVAL 21 HOUR AS ended_at FROM {audit} WHERE entity = '*'""")
def v_stage_status(spark, sf):
    runs = F.explode(F.array(F.lit(0), F.lit(1))).alias("run")
    log = audit(spark, sf).select("*", runs)
    first = F.col("run") == 0
    log = log.withColumn("rows_out", F.when(~first, F.col("rows_out")).otherwise(0)).withColumn("rows_rejected", F.when(~first, F.col("rows_rejected")).otherwise(F.col("rows_in")))
    log = log.select("*", F.concat(F.lit("run-"), "run").alias("run_id"),
                     F.timestamp_add("HOUR", F.col("run") + 20, F.col("business_date").cast("timestamp_ntz")).alias("ended_at")).drop("run")
    return V.v_stage_status(log, "run_id")


@query("v_quarantine", """SELECT business_date, 'events' AS source_system, 'event_record' AS entity, 'events.psv' AS file_name,
  CAST(event_id AS BIGINT) AS line_no, reasons, '{{' || concat_ws(',', '"event_id":"' || event_id || '"', '"ts":"' || ts || '"', '"user_id":"' || user_id || '"',
  '"event_type":"' || event_type || '"', '"note":"' || note || '"') || '}}' AS source_record FROM {reasoned} WHERE reasons IS NOT NULL""")
def v_quarantine(spark, sf):
    found = C.annotated(raw_records(spark, sf), EVENT_RECORD)
    bad = C.quarantined_rows(found, EVENT_RECORD, ["business_date", F.lit("events").alias("source"), F.lit("events.psv").alias("_source_file"),
                                                   F.col("event_id").cast("bigint").alias("_line")])
    return V.v_quarantine(bad)


# ---- view against view

COUNTERS = ["studies", "p1", "alpha", "tp", "fn", "fp", "tn"]


@query("cross_view_consistency", """SELECT count(*) AS dates, 0 AS differences FROM (SELECT DISTINCT business_date FROM {ev})""")
def cross_view_consistency(spark, sf):
    """Seven counters of the daily view against the same counted from the detail view: no difference is right."""
    rows = materialize(outcomes(spark, sf), "outcomes")
    kpi, detail = daily(spark, sf, rows), view_outcome(spark, sf, rows)
    recount = detail.groupBy("business_date").agg(
        F.count(F.lit(1)).alias("studies"), F.sum("is_p1").alias("p1"), F.sum("is_positive").alias("alpha"),
        *[F.count_if(F.col("outcome") == c.upper()).alias(c) for c in ("tp", "fn", "fp", "tn")])
    diff = recon.differences(kpi, recount, "business_date", COUNTERS)
    dates = events(spark, sf).select(F.count_distinct("business_date")).scalar()
    return diff.agg(F.count(F.lit(1)).alias("differences")).select(dates.alias("dates"), "differences")


@query("cross_view_differences", """SELECT business_date, counter, left_value, right_value FROM (
  SELECT business_date, 'records' AS counter, count(*) AS left_value, count(*) FILTER (reasons IS NULL) AS right_value FROM {reasoned} GROUP BY ALL
  UNION ALL SELECT business_date, 'persons', count(DISTINCT user_id), count(DISTINCT user_id) FILTER (reasons IS NULL) FROM {reasoned} GROUP BY ALL)
  WHERE left_value <> right_value""")
def cross_view_differences(spark, sf):
    """The same comparison where the sides do differ: everything received against what passed the contract."""
    found = materialize(C.annotated(raw_records(spark, sf), EVENT_RECORD), "annotated")
    count = lambda df: df.groupBy("business_date").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("user_id").alias("persons"))
    return recon.differences(count(found), count(found.where("reasons is null")), "business_date", ["records", "persons"])


@query("recon_outcomes", """SELECT business_date, count(*) AS studies, count(priority) AS scored, count(*) FILTER (finding IS NULL) AS pending,
  count(*) FILTER (quality_check = 'UNSUITABLE') AS unfit, CASE WHEN count(*) = count(priority) THEN 'MATCHED' ELSE 'EXPLAINED' END AS scored_status
  FROM {scored_items} i LEFT JOIN {reports} r ON r.item_id = i.item_id GROUP BY business_date""")
def recon_outcomes(spark, sf):
    rows = scored_items(spark, sf).join(reports(spark, sf), "item_id", "left")
    counts = rows.groupBy("business_date").agg(
        F.count(F.lit(1)).alias("studies"), F.count("priority").alias("scored"), F.count_if(F.col("finding").isNull()).alias("pending"),
        F.count_if(F.col("quality_check") == "UNSUITABLE").alias("unfit"))
    return counts.withColumn("scored_status", recon.recon_status(F.col("studies"), F.col("scored"), 0.0, True))


# Reports of 2024-01-12 on items that were never received: their keys lie behind all others.
cte("all_reports", """SELECT item_id, report_date FROM {signed_reports} UNION ALL SELECT item_id + 1000000000, report_date FROM {signed_reports} WHERE report_date = DATE '2024-01-12'""")


@query("recon_gold", """SELECT g.*, coalesce(o.n, 0) AS without_item, CASE WHEN o.n > 0 THEN 'EXPLAINED' ELSE 'MATCHED' END AS report_status FROM (
  SELECT business_date, count(*) AS silver, count(*) AS gold, count(*) FILTER (r.o_custkey IS NULL) AS without_order,
  count(*) FILTER (age_years IS NULL) AS without_age, 'MATCHED' AS status FROM {items} i LEFT JOIN {open_requests} r ON r.o_custkey = i.person_id
  GROUP BY business_date) g LEFT JOIN (SELECT report_date, count(*) AS n FROM {all_reports} a WHERE NOT EXISTS (SELECT 1 FROM {items} i WHERE i.item_id = a.item_id)
  GROUP BY report_date) o ON o.report_date = g.business_date""")
def recon_gold(spark, sf):
    """Silver rows = gold rows per date, items without an order or an age, and reports of the date that no item belongs to. All are counted;
    listing them is a query of its own (orphans), because nothing bounds their number."""
    from worklake.registered.frames import signed_reports
    from worklake.registered.shaping import open_requests

    side = open_requests(spark, sf).select(F.col("o_custkey").alias("person_id"), "o_orderkey")
    facts = items(spark, sf)
    gold = facts.join(side, "person_id", "left").groupBy("business_date").agg(
        F.count(F.lit(1)).alias("gold"), F.count_if(F.col("o_orderkey").isNull()).alias("without_order"),
        F.count_if(F.col("age_years").isNull()).alias("without_age"))
    silver = events(spark, sf).groupBy("business_date").agg(F.count(F.lit(1)).alias("silver"))
    signed = signed_reports(spark, sf).select("item_id", "report_date")
    signed = signed.unionByName(signed.where("report_date = date'2024-01-12'").withColumn("item_id", F.col("item_id") + 1000000000))
    lost = orphans(signed, facts, ["item_id"]).groupBy(F.col("report_date").alias("business_date")).agg(F.count(F.lit(1)).alias("without_item"))
    both = silver.join(gold, "business_date", "left").join(lost, "business_date", "left").fillna(0, ["without_item"])
    return both.withColumn("status", recon.recon_status(F.col("silver"), F.col("gold"))).withColumn(
        "report_status", recon.recon_status(F.lit(0), F.col("without_item"), 0.0, True))


# ---- dashboard shapes


@query("bi_kpi_tile", "SELECT sum(studies) AS films, sum(scored) AS scored FROM {v_runs} WHERE is_latest = 1 AND is_final = 1")
def bi_kpi_tile(spark, sf):
    return D.visual(V.v_scoring_run(runs(spark, sf)), [], {"films": F.sum("studies"), "scored": F.sum("scored")}, [D.LATEST, "is_final = 1"])


@query("bi_bars_by_dim", """SELECT priority, count(*) AS films, sum(is_positive) AS positives FROM {v_outcome} WHERE is_latest = 1
  GROUP BY priority ORDER BY priority""")
def bi_bars_by_dim(spark, sf):
    return D.visual(view_outcome(spark, sf), ["priority"], {"films": F.count(F.lit(1)), "positives": F.sum("is_positive")},
                    [D.LATEST], [F.col("priority")])


@query("bi_series_by_date", """SELECT business_date, max(alpha_fifo_median_min) AS fifo, max(alpha_triage_median_min) AS triage,
  max(alpha_shadow_median_min) AS if_live FROM {v_kpi} GROUP BY business_date""")
def bi_series_by_date(spark, sf):
    return D.visual(view_kpi(spark, sf), ["business_date"], {
        "fifo": F.max("alpha_fifo_median_min"), "triage": F.max("alpha_triage_median_min"), "if_live": F.max("alpha_shadow_median_min")})


@query("bi_color_split", "SELECT business_date, model, sum(in_scope) AS in_scope FROM {v_models} GROUP BY business_date, model")
def bi_color_split(spark, sf):
    return D.visual(view_models(spark, sf), ["business_date", "model"], {"in_scope": F.sum("in_scope")})


@query("bi_detail_table", """SELECT triage_seq, fifo_seq, item_id, priority, outcome, finding, max(probability) AS probability,
  max(triage_wait_min) AS triage_wait, max(fifo_wait_min) AS fifo_wait FROM {v_outcome} WHERE is_latest = 1
  GROUP BY ALL ORDER BY triage_seq, item_id""")
def bi_detail_table(spark, sf):
    """The worklist of the latest day in triage order, all of it; a page is the caller's limit."""
    return D.visual(view_outcome(spark, sf), ["triage_seq", "fifo_seq", "item_id", "priority", "outcome", "finding"], {
        "probability": F.max("probability"), "triage_wait": F.max("triage_wait_min"), "fifo_wait": F.max("fifo_wait_min")},
        [D.LATEST], [F.col("triage_seq"), F.col("item_id")])


@query("bi_pct_measure", """SELECT business_date, model, round(100 * max(sensitivity), 1) AS sens_pct, round(100 * max(specificity), 1) AS spec_pct
  FROM {v_models} WHERE stage = 'silent_trial' GROUP BY business_date, model""")
def bi_pct_measure(spark, sf):
    return D.visual(view_models(spark, sf), ["business_date", "model"], {
        "sens_pct": D.percent(F.max("sensitivity")), "spec_pct": D.percent(F.max("specificity"))}, ["stage = 'silent_trial'"])


@query("bi_status_filter", """SELECT business_date, stage, entity, check_name, status, sum(expected) AS expected, sum(actual) AS actual
  FROM {v_quality} WHERE status <> 'MATCHED' GROUP BY ALL""")
def bi_status_filter(spark, sf):
    return D.visual(V.v_data_quality(bronze_checks(spark, sf), events(spark, sf)), ["business_date", "stage", "entity", "check_name", "status"],
                    {"expected": F.sum("expected"), "actual": F.sum("actual")}, ["status <> 'MATCHED'"])


@query("bi_column_check", """SELECT unit, count(*) AS missing FROM {items} JOIN (VALUES ('no_such_column')) v(c) ON true GROUP BY unit""")
def bi_column_check(spark, sf):
    """Items per unit for every column the visual names and the view lacks."""
    view = items(spark, sf)
    lacking = D.missing_columns(view, ["unit", "age_years", "no_such_column"])
    return view.select("unit", F.explode(F.array(*[F.lit(c) for c in lacking])).alias("c")).groupBy("unit").agg(
        F.count("c").alias("missing"))


@query("adhoc_sql", """SELECT unit, population, count(*) AS n, round(avg(value), 6) AS avg_value FROM (SELECT *, CASE WHEN age_years >= 18 THEN 'adult'
  WHEN age_years IS NOT NULL THEN 'pediatric' END AS population FROM {items}) GROUP BY ALL""")
def adhoc_sql(spark, sf):
    return D.ask(spark, """SELECT unit, CASE WHEN age_years >= 18 THEN 'adult' WHEN age_years IS NOT NULL THEN 'pediatric' END AS population,
      count(*) AS n, round(avg(value), 6) AS avg_value FROM {items} GROUP BY ALL""", items=items(spark, sf))


@query("bi_tile_verify", """SELECT CAST(count(*) AS DOUBLE) AS tile, CAST(count(*) AS DOUBLE) AS recomputed, true AS agrees FROM {scored_items}
  WHERE priority = 'P1'""")
def bi_tile_verify(spark, sf):
    tile = D.visual(V.v_scoring_run(runs(spark, sf)), [], {"p1": F.sum("p1")}, ["is_final = 1"])  # a repeated run counts once
    recomputed = scored_items(spark, sf).agg(F.count_if(F.col("priority") == "P1").alias("p1"))
    return D.tile_agrees(tile, recomputed, "p1")
