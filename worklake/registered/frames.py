"""The stand-in frames that play the pipeline's tables, in Spark and in SQL.

events play items, their records and their reports; customer the persons; orders the requests; lineitem
re-sent records; documents and labels the feature rows; embeddings the vectors. Faults, missing files and
missing reports follow from values in the rows (k of props, value), never from leaving rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklake.functions.contracts import Contract, Field
from worklake.functions.scalars import age_years, hash_unit, population_of, truth_flag, worklist_rank
from worklake.operators.joins import moved_by
from worklake.operators.latest import latest_per_key
from worklake.operators.outcomes import model_truth, outcome_class
from worklake.operators.queues import Shift, served
from worklake.operators.scoring import CHAMPION, TRIAL, Head, decide, heads_long, with_probabilities
from worklake.registered.base import cte, table

# Fixed values of the stand-ins.
SHIFT = Shift(servers=2, start_hour=8, minutes=5)
HEADS = [
    Head("alpha", CHAMPION, "pediatric", 0.60, 0.90, "alpha-fv1-0a1b2c3", "ALPHA"),
    Head("gamma", CHAMPION, "pediatric", 0.75, 0.95, "gamma-fv1-1b2c3d4", "GAMMA"),
    Head("check", CHAMPION, "all", 0.97, 1.01, "check-fv1-2c3d4e5", checks_quality=True),
    Head("alpha", TRIAL, "pediatric", 0.55, 0.85, "alpha-fv2-3d4e5f6", "ALPHA"),
    Head("beta", TRIAL, "adult", 0.50, 0.80, "beta-fv1-4e5f6a7", "BETA"),
]
FINDING_OF = {"alpha": "ALPHA", "beta": "BETA", "gamma": "GAMMA"}
UNITS = ("signup", "error", "click", "view", "purchase")
EVENT_RECORD = Contract("event_record", "event_id", (
    Field("event_id", "int", True), Field("ts", "timestamp", True), Field("user_id", "int", True),
    Field("event_type", "string", True, UNITS), Field("note")))


def sql_hash(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS UBIGINT) / CAST(4294967296 AS DOUBLE))"


cte("ev", "SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, CAST(ts AS DATE) AS business_date FROM events")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("business_date", F.to_date("ts"))


# ---- records as a source sends them: strings, with faults on some values of k

cte("raw", """SELECT business_date, CAST(event_id AS VARCHAR) AS event_id,
  CASE WHEN k IN (61, 97) THEN '2024-01-01 25:61:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts,
  CASE WHEN k = 89 THEN '' ELSE CAST(user_id AS VARCHAR) END AS user_id,
  CASE WHEN k IN (61, 83) THEN 'zzz' ELSE event_type END AS event_type,
  CASE WHEN k < 50 THEN ' note ' || CAST(k AS VARCHAR) ELSE ' ' END AS note FROM {ev}""")


def raw_records(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    return events(spark, sf).select(
        "business_date", F.col("event_id").cast("string").alias("event_id"),
        F.when(k.isin(61, 97), "2024-01-01 25:61:00").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ts"),
        F.when(k == 89, "").otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when(k.isin(61, 83), "zzz").otherwise(F.col("event_type")).alias("event_type"),
        F.when(k < 50, F.concat(F.lit(" note "), k.cast("string"))).otherwise(" ").alias("note"))


cte("reasoned", """SELECT *, nullif(concat_ws('; ', r_ts, r_user, r_type), '') AS reasons FROM (SELECT *,
  CASE WHEN try_strptime(ts, '%Y-%m-%d %H:%M:%S') IS NULL THEN 'ts: not a timestamp (''' || trim(ts) || ''')' END AS r_ts,
  CASE WHEN trim(user_id) = '' THEN 'user_id: missing' END AS r_user,
  CASE WHEN event_type NOT IN ('signup', 'error', 'click', 'view', 'purchase') THEN 'event_type: ''' || event_type
    || ''' not in [''signup'', ''error'', ''click'', ''view'', ''purchase'']' END AS r_type FROM {raw})""")


# ---- items to rank

cte("items", f"""SELECT e.business_date, e.event_id AS item_id, e.ts AS arrival, e.user_id AS person_id,
  e.event_type AS unit, e.value, e.k,
  CAST(date_sub('year', DATE '1950-01-01' + CAST(floor({sql_hash("'birth:' || c.c_custkey")} * 25000) AS INTEGER),
    e.business_date) AS INTEGER) AS age_years,
  CASE WHEN e.k < 3 THEN 'QC-BLUR-' ELSE '' END || 'img' || e.event_id || '.png' AS file_name
  FROM {{ev}} e LEFT JOIN customer c ON c.c_custkey = e.user_id""")


def birth_date(person: Column) -> Column:
    return F.date_add(F.lit("1950-01-01").cast("date"), F.floor(hash_unit(F.lit("birth"), person.cast("string")) * 25000).cast("int"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    persons = table(spark, sf, "customer").select("c_custkey", birth_date(F.col("c_custkey")).alias("birth"))
    e = events(spark, sf)
    return e.join(persons, F.col("user_id") == F.col("c_custkey"), "left").select(
        "business_date", F.col("event_id").alias("item_id"), F.col("ts").alias("arrival"),
        F.col("user_id").alias("person_id"), F.col("event_type").alias("unit"), "value", "k",
        age_years(F.col("business_date"), F.col("birth")).alias("age_years"),
        F.concat(F.when(F.col("k") < 3, "QC-BLUR-").otherwise(""), F.lit("img"), F.col("event_id").cast("string"),
                 F.lit(".png")).alias("file_name"))


# ---- scores: the file of items with k = 50 was never found

_values = ", ".join(
    f"('{h.name}', '{h.stage}', '{h.population}', {h.threshold}, {h.p1}, '{h.version}', {h.checks_quality})" for h in HEADS)
cte("head_scores", f"""SELECT business_date, item_id, age_years, file_name, model, stage, model_version,
  is_check OR age_years IS NULL OR population = 'all' OR (population = 'adult' AND age_years >= 18)
    OR (population = 'pediatric' AND age_years < 18) AS in_scope,
  round(p, 4) AS probability, threshold, p >= threshold AS positive,
  CASE WHEN is_check THEN NULL WHEN p >= greatest(p1, threshold) THEN 'P1' WHEN p >= threshold THEN 'P2' ELSE 'P3' END
    AS priority
  FROM (SELECT i.business_date, i.item_id, i.age_years, i.file_name, h.model, h.stage, h.population,
    CAST(h.threshold AS DOUBLE) AS threshold, CAST(h.p1 AS DOUBLE) AS p1, h.model_version, h.is_check,
    {sql_hash("h.model || ':' || h.stage || ':' || i.item_id")} AS p
    FROM {{items}} i CROSS JOIN (VALUES {_values}) h(model, stage, population, threshold, p1, model_version, is_check)
    WHERE i.k <> 50)""")


def head_probability(h: Head):
    return hash_unit(F.lit(h.name), F.lit(h.stage), F.col("item_id").cast("string"))


def headed(spark: SparkSession, sf: str) -> DataFrame:
    return with_probabilities(items(spark, sf).where("k <> 50"), HEADS, head_probability)


def head_scores(spark: SparkSession, sf: str) -> DataFrame:
    return heads_long(headed(spark, sf), ["business_date", "item_id", "age_years", "file_name"], "age_years", HEADS)


cte("decided", """SELECT s.business_date, s.item_id, CASE WHEN c.unfit OR l.item_id IS NULL THEN 'NA' ELSE l.priority END AS priority,
  CASE WHEN NOT c.unfit THEN l.probability END AS probability, CASE WHEN NOT c.unfit THEN l.threshold END AS threshold,
  CASE WHEN NOT c.unfit THEN l.model END AS triage_model, CASE WHEN NOT c.unfit THEN l.model_version END AS model_version,
  CASE WHEN c.unfit THEN 'UNSUITABLE' ELSE 'OK' END AS quality_check,
  CASE WHEN c.unfit OR t.item_id IS NULL THEN 'NA' ELSE t.priority END AS shadow_priority,
  CASE WHEN NOT c.unfit THEN t.probability END AS shadow_probability,
  CASE WHEN NOT c.unfit THEN t.model END AS shadow_model
  FROM (SELECT DISTINCT business_date, item_id FROM {head_scores}) s
  JOIN (SELECT item_id, positive AS unfit FROM {head_scores} WHERE model = 'check') c ON c.item_id = s.item_id
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY priority, -probability, model) AS rn
    FROM {head_scores} WHERE stage = 'champion' AND in_scope AND model <> 'check') l ON l.item_id = s.item_id AND l.rn = 1
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY priority, -probability, model) AS rn
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id, model ORDER BY stage DESC) AS newest FROM {head_scores}
      WHERE model <> 'check') WHERE newest = 1 AND in_scope) t ON t.item_id = s.item_id AND t.rn = 1""")


DECISION = ["priority", "probability", "threshold", "triage_model", "model_version", "quality_check", "shadow_priority",
            "shadow_probability", "shadow_model"]


def decided(spark: SparkSession, sf: str) -> DataFrame:
    return decide(headed(spark, sf), "age_years", HEADS).select("business_date", "item_id", *DECISION)


# ---- reports: amended ones exist twice, items of low value have none yet

cte("signed_reports", """SELECT item_id, report_date, report_ts, finding, version FROM (
  SELECT event_id AS item_id, CAST(t AS DATE) AS report_date, t AS report_ts, finding, 2 AS version FROM (
    SELECT event_id, ts + to_minutes(30 + k) AS t, CASE WHEN k < 25 THEN 'ALPHA' WHEN k < 40 THEN 'BETA' WHEN k < 48 THEN 'GAMMA'
      WHEN k < 85 THEN 'NORMAL' ELSE 'OTHER' END AS finding, value FROM {ev}) WHERE value >= 3
  UNION ALL
  SELECT event_id, CAST(ts + to_minutes(25 + k) AS DATE), ts + to_minutes(25 + k), 'OTHER', 1 FROM {ev}
    WHERE value >= 3 AND k BETWEEN 10 AND 15)""")


def signed_reports(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    finding = (F.when(k < 25, "ALPHA").when(k < 40, "BETA").when(k < 48, "GAMMA").when(k < 85, "NORMAL").otherwise("OTHER"))
    after = lambda m: F.timestamp_add("MINUTE", k + m, F.col("ts"))
    versions = F.array(F.struct(after(30).alias("report_ts"), finding.alias("finding"), F.lit(2).alias("version")),
                       F.struct(after(25).alias("report_ts"), F.lit("OTHER").alias("finding"), F.lit(1).alias("version")))
    all_versions = events(spark, sf).where("value >= 3").select(F.col("event_id").alias("item_id"), "k", F.inline(versions))
    return all_versions.where("version = 2 or k between 10 and 15").select(
        "item_id", F.to_date("report_ts").alias("report_date"), "report_ts", "finding", "version")


cte("reports", """SELECT item_id, report_date, report_ts, finding FROM (SELECT *,
  row_number() OVER (PARTITION BY item_id ORDER BY report_ts DESC, version DESC) AS rn FROM {signed_reports}) WHERE rn = 1""")


def reports(spark: SparkSession, sf: str) -> DataFrame:
    return latest_per_key(signed_reports(spark, sf), ["item_id"], [F.col("report_ts").desc(), F.col("version").desc()]) \
        .drop("version")


# ---- the queue in three orders

_M = SHIFT.service_us
cte("scored_items", """SELECT i.*, d.priority, d.probability, d.threshold, d.triage_model, d.model_version, d.quality_check,
  d.shadow_priority, d.shadow_probability, d.shadow_model,
  date_diff('microsecond', CAST(i.business_date AS TIMESTAMP) + INTERVAL 8 HOUR, i.arrival) AS a
  FROM {items} i LEFT JOIN {decided} d ON d.item_id = i.item_id""")
cte("q_pos", """SELECT *, row_number() OVER (PARTITION BY business_date ORDER BY a, item_id) - 1 AS pos FROM {scored_items}""")
cte("q_fifo", f"""SELECT *, (pos // 2) * {_M} + max(greatest(a, 0) - (pos // 2) * {_M}) OVER (PARTITION BY business_date, pos % 2
  ORDER BY pos) AS start_us FROM {{q_pos}}""")
cte("q_reach", """SELECT f.*, coalesce(c.n, 0) AS reach FROM {q_fifo} f LEFT JOIN (
  SELECT i.item_id, count(*) AS n FROM {q_fifo} i JOIN {q_fifo} s ON s.business_date = i.business_date AND s.start_us < i.a
  GROUP BY i.item_id) c ON c.item_id = f.item_id""")
for _arm, _band, _prob in (("triage", "priority", "probability"),
                           ("shadow", "CASE WHEN shadow_priority IS NOT NULL THEN shadow_priority ELSE priority END",
                            "CASE WHEN shadow_priority IS NOT NULL THEN shadow_probability ELSE probability END")):
    cte(f"q_{_arm}_rank", f"""SELECT *, row_number() OVER (PARTITION BY business_date ORDER BY
  CASE band WHEN 'P1' THEN 0 WHEN 'P2' THEN 1 WHEN 'P3' THEN 2 WHEN 'NA' THEN 2 ELSE 3 END,
  CASE WHEN band IN ('P1', 'P2') THEN -coalesce(prob, 0.0) ELSE 0.0 END, a, item_id) AS r
  FROM (SELECT *, {_band} AS band, {_prob} AS prob FROM {{q_reach}})""")
    # The slot of the item ranked r is what the r best items take together less what the r - 1 best take.
    cte(f"q_{_arm}", f"""SELECT t.item_id, f.start_us AS {_arm}_start_us FROM (
  SELECT business_date, item_id, taken - coalesce(lag(taken) OVER (PARTITION BY business_date ORDER BY r), 0) AS slot FROM (
    SELECT business_date, item_id, r, sum(j + late) AS taken FROM (
      SELECT business_date, item_id, r, j, max(reach - j) OVER (PARTITION BY item_id ORDER BY j) AS late FROM (
        SELECT hi.business_date, hi.item_id, hi.r, lo.reach,
          row_number() OVER (PARTITION BY hi.item_id ORDER BY lo.reach, lo.item_id) - 1 AS j
        FROM {{q_{_arm}_rank}} hi JOIN {{q_{_arm}_rank}} lo ON lo.business_date = hi.business_date AND lo.r <= hi.r))
    GROUP BY business_date, item_id, r)) t
  JOIN {{q_fifo}} f ON f.business_date = t.business_date AND f.pos = t.slot""")
cte("queued", f"""SELECT f.*, t.triage_start_us, s.shadow_start_us,
  round((f.start_us + {_M} - f.a) / 60000000.0, 1) AS fifo_wait_min,
  round((t.triage_start_us + {_M} - f.a) / 60000000.0, 1) AS triage_wait_min,
  round((s.shadow_start_us + {_M} - f.a) / 60000000.0, 1) AS shadow_wait_min
  FROM {{q_fifo}} f JOIN {{q_triage}} t ON t.item_id = f.item_id JOIN {{q_shadow}} s ON s.item_id = f.item_id""")


def scored_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items with the decision of their row; NULL where the file was never found and nothing was scored."""
    return with_decision(items(spark, sf))


def with_decision(all_items: DataFrame) -> DataFrame:
    """Expressions over the item's own row, so joins can move the items without it."""
    kept = all_items.columns
    judged = decide(with_probabilities(all_items, HEADS, head_probability), "age_years", HEADS)
    found = F.col("k") != 50
    return judged.select(*kept, *[F.when(found, F.col(c)).alias(c) for c in DECISION])


def queue(spark: SparkSession, sf: str) -> DataFrame:
    """Places, slots and waits of every item, without its other columns."""
    has_shadow = F.col("shadow_priority").isNotNull()
    band = F.when(has_shadow, F.col("shadow_priority")).otherwise(F.col("priority"))
    prob = F.when(has_shadow, F.col("shadow_probability")).otherwise(F.col("probability"))
    out = served(scored_items(spark, sf), ["business_date"], "business_date", "arrival", "item_id", SHIFT,
                 {"triage": worklist_rank(F.col("priority"), F.col("probability")),
                  "shadow": worklist_rank(band, prob)}, places=["triage"])
    for arm, start in (("fifo", "start_us"), ("triage", "triage_start_us"), ("shadow", "shadow_start_us")):
        out = out.withColumn(f"{arm}_wait_min", F.round((F.col(start) + _M - F.col("arrival_us")) / F.lit(60000000.0), 1))
    return out


def queued(spark: SparkSession, sf: str) -> DataFrame:
    return with_decision(items(spark, sf).join(queue(spark, sf), ["business_date", "item_id"]))


# ---- outcomes

cte("outcomes", """SELECT business_date, item_id, arrival, unit, age_years, file_name, person_id, pos + 1 AS fifo_seq,
  row_number() OVER (PARTITION BY business_date ORDER BY triage_start_us, item_id) AS triage_seq,
  probability, priority, model_version, priority IS NOT NULL AS scored,
  CASE WHEN finding IS NULL THEN NULL WHEN finding = 'ALPHA' THEN 1 ELSE 0 END AS truth,
  CASE WHEN finding IS NULL THEN NULL WHEN finding = 'BETA' THEN 1 ELSE 0 END AS truth_second,
  finding, report_ts, finding IS NOT NULL AS truth_known, priority IN ('P1', 'P2') AS flagged,
  CASE WHEN priority IS NULL THEN 'UNSCORED' WHEN finding IS NULL THEN 'PENDING' WHEN triage_model IS NULL THEN 'NOT_TRIAGED'
    WHEN finding = upper(triage_model) THEN CASE WHEN priority IN ('P1', 'P2') THEN 'TP' ELSE 'FN' END
    WHEN priority IN ('P1', 'P2') THEN 'FP' ELSE 'TN' END AS outcome,
  fifo_wait_min, triage_wait_min, shadow_wait_min, round(fifo_wait_min - triage_wait_min, 1) AS wait_saved_min,
  CASE WHEN age_years >= 18 THEN 'adult' WHEN age_years IS NOT NULL THEN 'pediatric' END AS population,
  triage_model, quality_check, shadow_priority, shadow_model
  FROM (SELECT q.*, r.finding, r.report_ts FROM {queued} q LEFT JOIN {reports} r ON r.item_id = q.item_id)""")


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    # the narrow sides first: queue, reports and items move once, by item, and are judged where they arrive
    known_by_item = queue(spark, sf).join(reports(spark, sf), "item_id", "left")
    joined = with_decision(moved_by(items(spark, sf), known_by_item, "item_id", "business_date"))
    known = F.col("finding").isNotNull()
    flagged = F.col("priority").isin("P1", "P2")
    truth = model_truth(F.col("triage_model"), F.col("finding"), F.startswith("file_name", F.lit("QC-")), FINDING_OF, "check")
    return joined.select(
        "business_date", "item_id", "arrival", "unit", "age_years", "file_name", "person_id", (F.col("pos") + 1).alias("fifo_seq"),
        "triage_seq", "probability", "priority", "model_version", F.col("priority").isNotNull().alias("scored"),
        F.when(known, truth_flag(F.col("finding"), "ALPHA")).alias("truth"),
        F.when(known, truth_flag(F.col("finding"), "BETA")).alias("truth_second"),
        "finding", "report_ts", known.alias("truth_known"), flagged.alias("flagged"),
        outcome_class(F.col("priority"), known, F.col("triage_model"), truth, flagged).alias("outcome"),
        "fifo_wait_min", "triage_wait_min", "shadow_wait_min",
        F.round(F.col("fifo_wait_min") - F.col("triage_wait_min"), 1).alias("wait_saved_min"),
        population_of(F.col("age_years")).alias("population"), "triage_model", "quality_check", "shadow_priority",
        "shadow_model")


cte("heads_judged", """SELECT h.*, CASE WHEN h.model = 'check' THEN CASE WHEN h.file_name LIKE 'QC-%' THEN 1 ELSE 0 END
  WHEN r.finding IS NULL THEN NULL WHEN r.finding = upper(h.model) THEN 1 ELSE 0 END AS truth
  FROM {head_scores} h LEFT JOIN {reports} r ON r.item_id = h.item_id""")


def heads_judged(spark: SparkSession, sf: str) -> DataFrame:
    truth = model_truth(F.col("model"), F.col("finding"), F.startswith("file_name", F.lit("QC-")), FINDING_OF, "check")
    judged = headed(spark, sf).join(reports(spark, sf), "item_id", "left")  # before the heads multiply the rows
    keep = ["business_date", "item_id", "file_name", "finding"]
    return heads_long(judged, keep, "age_years", HEADS).withColumn("truth", truth)

