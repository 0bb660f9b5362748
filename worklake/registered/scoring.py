"""Heads, bands and arbitration."""

from __future__ import annotations

from pyspark.sql import functions as F

from worklake.functions import scalars as S
from worklake.functions.scalars import in_scope as in_scope_of
from worklake.operators import drift, scoring
from worklake.operators.ordered import numbered
from worklake.operators.outcomes import confusion_counts, with_ratios
from worklake.operators.quantiles import exact_quantiles
from worklake.registered.base import cte, query, table
from worklake.registered.drifting import REPORT as _REPORT
from worklake.registered.drifting import psi_sql
from worklake.registered.frames import decided, events, head_scores, heads_judged, scored_items, sql_hash
from worklake.session import materialize

# Weight vectors of two heads over 64 inputs, by rule.
DIMENSION = 64
WEIGHTS = {"left": [((i * 7) % 11 - 5) / 4 for i in range(DIMENSION)],
           "right": [((i * 5) % 13 - 6) / 5 for i in range(DIMENSION)]}
CENTRE = [((i * 3) % 7 - 3) / 100 for i in range(DIMENSION)]
SPREAD = [0.1 + (i % 5) / 50 for i in range(DIMENSION)]


def _dot_sql(weights):
    terms = " + ".join(f"(CAST(embedding[{i + 1}] AS DOUBLE) - ({CENTRE[i]!r})) / {SPREAD[i]!r} * ({w!r})" for i, w in enumerate(weights))
    return f"round(1 / (1 + exp(-({terms} + 0.25))), 6)"


@query("score_heads", "SELECT vec_id, '" + "' AS model, {} AS probability FROM embeddings UNION ALL SELECT vec_id, '".join(
    ["left", "right"]).replace("{}", _dot_sql(WEIGHTS["left"])) + f"' AS model, {_dot_sql(WEIGHTS['right'])} AS probability FROM embeddings")
def score_heads(spark, sf):
    """Both heads over the same vector: standardise, dot product, sigmoid."""
    heads = [scoring.Head(n, scoring.CHAMPION, "all", 0.5, 0.9, "fv1", weights=tuple(w), mean=tuple(CENTRE), std=tuple(SPREAD),
                          intercept=0.25) for n, w in WEIGHTS.items()]
    rows = F.array(*[F.struct(F.lit(h.name).alias("model"),
                              F.round(scoring.linear_probability(F.col("embedding"), h), 6).alias("probability")) for h in heads])
    return table(spark, sf, "embeddings").select("vec_id", F.inline(rows))


@query("priority_band", f"""SELECT event_id, CASE WHEN p >= greatest(0.9, t) THEN 'P1' WHEN p >= t THEN 'P2' ELSE 'P3' END AS band FROM (
  SELECT event_id, {sql_hash("'band:' || event_id")} AS p, CAST(CASE WHEN event_type = 'error' THEN 0.95 ELSE 0.6 END AS DOUBLE) AS t FROM events)""")
def priority_band(spark, sf):
    """One kind of event has its threshold above the P1 cut: P1 then starts at the threshold."""
    p = S.hash_unit(F.lit("band"), F.col("event_id").cast("string"))
    t = F.when(F.col("event_type") == "error", 0.95).otherwise(0.6)
    return table(spark, sf, "events").select("event_id", S.priority_band(p, t, F.lit(0.9)).alias("band"))


@query("triage_arbitrate", "SELECT item_id, priority, probability, triage_model, quality_check FROM {decided}")
def triage_arbitrate(spark, sf):
    return decided(spark, sf).select("item_id", "priority", "probability", "triage_model", "quality_check")


@query("shadow_arbitrate", "SELECT item_id, priority, shadow_priority, shadow_probability, shadow_model FROM {decided}")
def shadow_arbitrate(spark, sf):
    return decided(spark, sf).select("item_id", "priority", "shadow_priority", "shadow_probability", "shadow_model")


@query("heads_long", """SELECT item_id, model, stage, model_version, in_scope, probability, threshold, positive, priority FROM {head_scores}""")
def heads_long(spark, sf):
    return head_scores(spark, sf).drop("business_date", "age_years", "file_name")


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("quality_reference", " UNION ALL ".join(f"""SELECT '{f}' AS feature, round(quantile_cont({f}, 0.01), 6) AS p01,
  round(quantile_cont({f}, 0.99), 6) AS p99, round(avg({f}), 6) AS mean, round(stddev_samp({f}), 6) AS std FROM lineitem
  WHERE l_shipdate < TIMESTAMP '1998-01-01'""" for f in FEATURES))
def quality_reference(spark, sf):
    ref = table(spark, sf, "lineitem").where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")).select(*FEATURES)
    long = ref.unpivot([], FEATURES, "feature", "value")
    q = exact_quantiles(long, ["feature"], "value", {"p01": 0.01, "p99": 0.99})
    moments = long.groupBy("feature").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"))
    return q.join(moments, "feature").select("feature", F.round("p01", 6).alias("p01"), F.round("p99", 6).alias("p99"), "mean", "std")


@query("quality_flags", """SELECT event_id, concat_ws(',', CASE WHEN value < 1 THEN 'value_LOW' WHEN value > 100 THEN 'value_HIGH' END,
  CASE WHEN k < 5 THEN 'k_LOW' WHEN k > 90 THEN 'k_HIGH' END) AS quality_flags FROM {ev}""")
def quality_flags(spark, sf):
    return events(spark, sf).select("event_id", scoring.quality_flags({"value": (1.0, 100.0), "k": (5, 90)}).alias("quality_flags"))


# A run is a business date; the day after the last has no items. Drift is judged on items in scope of the main head, against earlier ones.
QUALITY = ["value", "k"]
_REFERENCE_END, _MIN_ROWS = "2024-01-05", 57
cte("drift_items", f"""SELECT business_date, value, k, business_date < DATE '{_REFERENCE_END}' AS is_ref FROM {{scored_items}}
  WHERE priority IS NOT NULL AND (age_years IS NULL OR age_years < 18)""")
cte("run_psi", psi_sql("(SELECT *, false AS copy FROM {drift_items} WHERE is_ref UNION ALL SELECT business_date, value, k, false, true FROM {drift_items})", QUALITY, "is_ref", "business_date"))
cte("run_drift", f"""SELECT business_date, n AS drift_rows, psi_max, coalesce(psi_json, '{{{{}}}}') AS psi_json, CASE WHEN psi_max IS NULL OR n < {_MIN_ROWS} THEN 'TOO_FEW'
  WHEN psi_max >= 0.25 THEN 'ALERT' WHEN psi_max >= 0.10 THEN 'WARN' ELSE 'OK' END AS drift_level FROM (SELECT business_date, count(*) AS n FROM {{drift_items}} GROUP BY business_date)
  LEFT JOIN (SELECT key AS business_date, {_REPORT} FROM {{run_psi}} GROUP BY key) USING (business_date)""")
cte("run_summary", """SELECT d.business_date, coalesce(studies, 0) AS studies, coalesce(scored, 0) AS scored, coalesce(missing, 0) AS missing, coalesce(p1, 0) AS p1,
  coalesce(p2, 0) AS p2, coalesce(p3, 0) AS p3, coalesce(not_triaged, 0) AS not_triaged, coalesce(unsuitable, 0) AS unsuitable,
  CASE WHEN studies IS NULL THEN 'FAILED' WHEN missing > 0 THEN 'PARTIAL' ELSE 'SUCCEEDED' END AS status,
  CASE WHEN studies IS NULL THEN 'no items for the date' WHEN missing > 0 THEN 'files not found: ' || missing ELSE '' END AS message, heads_json,
  coalesce(drift_rows, 0) AS drift_rows, psi_max, coalesce(psi_json, '{{}}') AS psi_json, coalesce(drift_level, 'TOO_FEW') AS drift_level
  FROM (SELECT DISTINCT business_date FROM {ev} UNION ALL SELECT CAST(max(business_date) + INTERVAL 1 DAY AS DATE) FROM {ev}) d
  LEFT JOIN (SELECT business_date, count(*) AS studies, count(priority) AS scored, count(*) - count(priority) AS missing, count(*) FILTER (priority = 'P1') AS p1,
    count(*) FILTER (priority = 'P2') AS p2, count(*) FILTER (priority = 'P3') AS p3, count(*) FILTER (priority = 'NA') AS not_triaged,
    count(*) FILTER (quality_check = 'UNSUITABLE') AS unsuitable FROM {scored_items} GROUP BY business_date) r USING (business_date)
  LEFT JOIN (SELECT business_date, '{{' || string_agg('"' || model || '/' || stage || '":"' || v || '"', ',' ORDER BY model || '/' || stage) || '}}' AS heads_json
    FROM (SELECT business_date, model, stage, max(model_version) AS v FROM {head_scores} GROUP BY ALL) GROUP BY business_date) v USING (business_date)
  LEFT JOIN {run_drift} USING (business_date)""")


def run_summaries(spark, sf):
    """One row per run: volumes, status with its message, versions, drift against the bins that were stored of the reference."""
    rows = scored_items(spark, sf)
    in_scope = rows.where(F.col("priority").isNotNull() & in_scope_of(F.lit("pediatric"), F.col("age_years")))
    early = F.col("business_date") < F.lit(_REFERENCE_END).cast("date")
    reference = materialize(drift.reference_bins(in_scope.where(early), QUALITY), "bins")
    dates = events(spark, sf).select("business_date")
    runs = dates.distinct().unionByName(dates.agg(F.date_add(F.max("business_date"), 1).alias("business_date")))
    wanted = runs.join(rows.withColumn("wanted", F.lit(True)).withColumn("scored", F.col("priority").isNotNull()), "business_date", "left")
    counts = drift.value_counts(in_scope, QUALITY, "business_date")
    sizes = runs.join(in_scope.groupBy("business_date").agg(F.count(F.lit(1)).alias("n")), "business_date", "left").select(
        "business_date", F.coalesce("n", F.lit(0)).alias("rows"))
    report = drift.drift_report(drift.psi_of_counts(reference, counts, "business_date"), sizes, ["business_date"], 0.10, 0.25, _MIN_ROWS)
    versions = scoring.versions_json(head_scores(spark, sf), ["business_date"])
    return scoring.run_summary(wanted, ["business_date"]).join(versions, "business_date", "left").join(
        report.withColumnRenamed("rows", "drift_rows"), "business_date", "left")


@query("scoring_run_summary", "SELECT * FROM {run_summary}")
def scoring_run_summary(spark, sf):
    return run_summaries(spark, sf)


@query("batch_worklist", """SELECT item_id, priority, probability, row_number() OVER (ORDER BY probability DESC, item_id) AS place
  FROM {decided} WHERE probability IS NOT NULL""")
def batch_worklist(spark, sf):
    """The whole ranking, numbered over pieces of the order."""
    rows = decided(spark, sf).where("probability is not null").select("item_id", "priority", "probability").withColumn("_all", F.lit(0))
    placed = numbered(rows, ["_all"], [F.col("probability").desc(), F.col("item_id")], "place")
    return placed.select("item_id", "priority", "probability", F.col("place").cast("int").alias("place"))


@query("batch_band_counts", "SELECT priority, count(*) AS items FROM {decided} GROUP BY priority")
def batch_band_counts(spark, sf):
    return decided(spark, sf).groupBy("priority").agg(F.count(F.lit(1)).alias("items"))


@query("truth_for_model", "SELECT item_id, model, stage, truth FROM {heads_judged}")
def truth_for_model(spark, sf):
    return heads_judged(spark, sf).select("item_id", "model", "stage", "truth")


@query("confusion_metrics", """SELECT *, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 4) AS sensitivity, round(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 4) AS specificity,
  round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 4) AS ppv FROM (SELECT model, stage, count(*) FILTER (truth = 1 AND positive) AS tp,
  count(*) FILTER (truth = 1 AND NOT positive) AS fn, count(*) FILTER (truth = 0 AND positive) AS fp,
  count(*) FILTER (truth = 0 AND NOT positive) AS tn FROM {heads_judged} GROUP BY model, stage)""")
def confusion_metrics(spark, sf):
    counts = heads_judged(spark, sf).groupBy("model", "stage").agg(
        *[c.alias(n) for n, c in confusion_counts(F.col("truth"), F.col("positive")).items()])
    return with_ratios(counts)


