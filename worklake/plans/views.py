"""The semantic views as functions of the tables they read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklake.functions.scalars import age_band, ratio
from worklake.operators.joins import moved_by
from worklake.operators.latest import flag_latest, flag_latest_date, latest_per_key

DAY = "business_date"


def _is(column: str, value) -> Column:
    return F.when(F.col(column) == value, 1).otherwise(0)


def v_triage_outcome(outcomes: DataFrame, facts: DataFrame, persons: DataFrame, item: str, person: str,
                     fact_columns: list[str], person_columns: list[str]) -> DataFrame:
    """One row per item: what was decided, what was true, and the three waits. The age band of an unknown age
    is UNKNOWN and its population stays NULL."""
    f = facts.select(DAY, item, person, *fact_columns)
    p = persons.select(person, *person_columns)
    joined = moved_by(outcomes, f.join(p, person, "left"), item, DAY)  # the wide rows move once, by the key that outcomes were joined by
    shaped = joined.select(
        DAY, item, "arrival", "unit", "age_years", *fact_columns, *person_columns, "fifo_seq", "triage_seq", "probability",
        age_band(F.col("age_years")).alias("age_band"), "population", "triage_model", "quality_check", "shadow_priority",
        "shadow_model", F.coalesce("priority", F.lit("UNSCORED")).alias("priority"), "model_version", "truth_known",
        "finding", "outcome", "fifo_wait_min", "triage_wait_min", "shadow_wait_min", "wait_saved_min",
        _is("truth", 1).alias("is_positive"), _is("truth_second", 1).alias("is_second"), _is("priority", "P1").alias("is_p1"))
    return flag_latest_date(shaped, DAY, dates=facts)


def v_daily_kpi(summary: DataFrame, positive: str, second: str, dates: DataFrame | None = None) -> DataFrame:
    """The daily summary with what follows from it: minutes saved, relative reduction, cost for normal items."""
    def c(name: str) -> Column:
        return F.col(name)

    fifo, triage = c(f"{positive}_fifo_median_min"), c(f"{positive}_triage_median_min")
    derived = summary.select(
        "*", (fifo - triage).alias(f"{positive}_median_minutes_saved"),
        F.when(fifo > 0, 1 - triage / fifo).alias(f"{positive}_wait_reduction"),
        (c("normal_triage_median_min") - c("normal_fifo_median_min")).alias("normal_median_minutes_added"),
        (c(f"{second}_triage_median_min") - c(f"{second}_shadow_median_min")).alias(f"{second}_minutes_go_live_saves"))
    return flag_latest_date(derived, DAY, dates=dates)


def v_band_daily(outcomes: DataFrame, dates: DataFrame) -> DataFrame:
    """Per date and band; items without a band are the band UNSCORED. `dates` holds the dates of the table."""
    reported, positives = F.count_if("truth_known"), F.count_if(F.col("truth") == 1)
    grouped = outcomes.groupBy(DAY, F.coalesce("priority", F.lit("UNSCORED")).alias("priority")).agg(
        F.count(F.lit(1)).alias("films"), reported.alias("reported"), positives.alias("positives"),
        ratio(positives, reported, None).alias("positive_rate"), F.avg("probability").alias("avg_probability"),
        F.avg("triage_wait_min").alias("avg_triage_wait_min"), F.avg("fifo_wait_min").alias("avg_fifo_wait_min"))
    return flag_latest_date(grouped, DAY, dates=dates)


def v_unit_daily(outcomes: DataFrame, dates: DataFrame) -> DataFrame:
    positive = F.col("truth") == 1
    grouped = outcomes.groupBy(DAY, "unit").agg(
        F.count(F.lit(1)).alias("films"), F.count_if(F.col("priority") == "P1").alias("p1_films"),
        F.count_if(positive).alias("positives"), F.avg("fifo_wait_min").alias("avg_fifo_wait_min"),
        F.avg("triage_wait_min").alias("avg_triage_wait_min"),
        F.avg(F.when(positive, F.col("fifo_wait_min"))).alias("positive_avg_fifo_wait_min"),
        F.avg(F.when(positive, F.col("triage_wait_min"))).alias("positive_avg_triage_wait_min"))
    return flag_latest_date(grouped, DAY, dates=dates)


def v_model_event(events: DataFrame, default_model: str, tie: str) -> DataFrame:
    named = events.withColumn("model", F.coalesce("model", F.lit(default_model))).withColumnRenamed("event", "model_event")
    flagged = flag_latest(named, ["model", "model_event"], ["recorded_at"], [tie], "is_latest")
    return flagged.withColumn("event_date", F.to_date("recorded_at"))


def v_scoring_run(runs: DataFrame) -> DataFrame:
    """Every scoring run; is_final marks the last one of its date."""
    return flag_latest_date(flag_latest(runs, [DAY], ["ended_at"], ["run_id"], "is_final"), DAY)


def v_training_set(counts: DataFrame, default_model: str) -> DataFrame:
    return counts.withColumn("model", F.coalesce("model", F.lit(default_model))) \
        .withColumn("prevalence", ratio(F.col("positives"), F.col("films"), None))


def v_model_daily(model_summary: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    return flag_latest_date(model_summary, DAY, dates=dates)


def v_silent_trial(model_summary: DataFrame) -> DataFrame:
    """Evidence so far per model version in trial, ratios unrounded."""
    total = lambda c: F.sum(c).alias(c)
    out = model_summary.where("stage = 'silent_trial'").groupBy("model", "model_version").agg(
        F.count_distinct(DAY).alias("trial_days"), F.min(DAY).alias("first_day"), F.max(DAY).alias("last_day"),
        total("in_scope"), total("reported"), total("tp"), total("fn"), total("fp"), total("tn"))
    pos, neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    return out.withColumn("positives", pos).withColumn("sensitivity", ratio(F.col("tp"), pos, None)) \
              .withColumn("specificity", ratio(F.col("tn"), neg, None))


def v_data_quality(checks: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    shaped = checks.select("*", (F.col("actual") - F.col("expected")).alias("difference"),
                           _is("status", "MISMATCH").alias("is_mismatch"), _is("status", "EXPLAINED").alias("is_explained"),
                           _is("status", "MATCHED").alias("is_matched"))
    return flag_latest_date(shaped, DAY, dates=dates)


def v_stage_status(audit: DataFrame, tie: str) -> DataFrame:
    """Last stage-level row (entity '*') per date and stage."""
    return latest_per_key(audit.where("entity = '*'"), [DAY, "stage"], [F.col("ended_at").desc(), F.col(tie).desc()])


def v_quarantine(quarantine: DataFrame) -> DataFrame:
    return quarantine.select(DAY, F.col("source").alias("source_system"), "entity", F.col("_source_file").alias("file_name"),
                             F.col("_line").alias("line_no"), "reasons", F.col("record").alias("source_record"))
