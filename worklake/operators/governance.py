"""Rules over metrics, and the log of model events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklake.operators.latest import latest_per_key


@dataclass(frozen=True)
class Rule:
    name: str
    metric: str
    at_least: float | None = None
    at_most: float | None = None


def apply_rules(metrics: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """One row per candidate and rule: value, rule text, passed. A missing value fails."""
    def row(r: Rule) -> Column:
        v = F.col(r.metric).cast("double")
        ok = v >= r.at_least if r.at_least is not None else v <= r.at_most
        text = f">= {r.at_least}" if r.at_least is not None else f"<= {r.at_most}"
        return F.struct(F.lit(r.name).alias("check_name"), v.alias("value"), F.lit(text).alias("rule"),
                        F.coalesce(ok, F.lit(False)).alias("passed"))

    return metrics.select(*keys, F.inline(F.array(*[row(r) for r in rules])))


def gate(metrics: DataFrame, keys: list[str], rules: list[Rule], expected_hash: str, max_regression: float) -> DataFrame:
    """The absolute rules plus: built on the whole table, built by the current definition, no worse than the
    incumbent (champion_auroc, else trial_auroc; the first model passes).

    metrics needs auroc, built_limit, feature_hash, champion_auroc, trial_auroc.
    """
    incumbent = F.coalesce("champion_auroc", "trial_auroc")
    floor = incumbent - max_regression
    extra = F.array(
        F.struct(F.lit("trained on the whole table").alias("check_name"), F.col("built_limit").cast("double").alias("value"),
                 F.lit("no limit").alias("rule"), (F.coalesce("built_limit", F.lit(0)) == 0).alias("passed")),
        F.struct(F.lit("feature hash matches").alias("check_name"), F.lit(None).cast("double").alias("value"),
                 F.lit(f"== {expected_hash}").alias("rule"),
                 F.coalesce(F.col("feature_hash") == expected_hash, F.lit(False)).alias("passed")),
        F.struct(F.lit("no regression against the incumbent").alias("check_name"),
                 F.when(incumbent.isNotNull(), F.col("auroc").cast("double")).alias("value"),
                 F.when(incumbent.isNull(), "no incumbent yet").otherwise(
                     F.concat(F.lit(">= "), F.format_string("%.4f", floor))).alias("rule"),
                 F.coalesce(F.col("auroc") >= floor, F.lit(True)).alias("passed")))
    return apply_rules(metrics, keys, rules).unionByName(metrics.select(*keys, F.inline(extra)))


def verdict(check_rows: DataFrame, keys: list[str]) -> DataFrame:
    return check_rows.groupBy(*keys).agg(F.bool_and("passed").alias("passed"),
                                         F.count_if(~F.col("passed")).alias("failed_checks"))


def stage_state(events: DataFrame, time: str, tie: str) -> DataFrame:
    """Who serves and who is on trial, per model, from the event log: the last event that set the stage.

    A rollback is an event that names the earlier version again.
    """
    setting = F.col("event").isin("DEPLOYED", "PROMOTED", "ROLLED_BACK", "SILENT_TRIAL")
    stage = F.when(F.col("event") == "SILENT_TRIAL", "silent_trial").otherwise("champion")
    last = latest_per_key(events.where(setting).withColumn("stage", stage), ["model", "stage"],
                          [F.col(time).desc(), F.col(tie).desc()])
    # a trial ends when a later promotion makes its version the champion
    champion = last.where("stage = 'champion' and event = 'PROMOTED'").select(
        F.col("model").alias("_m"), F.col("model_version").alias("_v"), F.col(time).alias("_t"))
    ended = (F.col("model") == F.col("_m")) & (F.col("model_version") == F.col("_v")) & (F.col(time) <= F.col("_t")) \
        & (F.col("stage") == "silent_trial")
    return last.join(champion, ended, "left_anti").select("model", "stage", "model_version", "event", time)


def build_decision(wanted_hash: str) -> Column:
    """What to do with an existing build: columns feature_hash (NULL when there is none) and built_limit."""
    return (F.when(F.col("feature_hash").isNull(), "BUILD").when(F.coalesce("built_limit", F.lit(0)) > 0, "REBUILD")
             .when(F.col("feature_hash") == wanted_hash, "SKIP").otherwise("FAIL"))
