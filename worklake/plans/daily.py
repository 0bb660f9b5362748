"""The daily run: bronze, silver, gold, scores, outcomes and views of one business date.

Every stage reads tables, writes its own partitions of the date, reconciles its counts and stops on an
unexplained mismatch; running a date again gives the same tables.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import date as Date
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklake.functions import contracts as C
from worklake.functions import scalars as S
from worklake.operators import drift, joins, latest, recon, scoring
from worklake.operators import outcomes as O
from worklake.operators.ordered import numbered
from worklake.operators.queues import Shift, at_time, replay
from worklake.plans import views as V
from worklake.session import materialize
from worklake.sources import landing, readers, tables

DAY = "business_date"

# What the stages need of each source's contract; everything else about it (values, types, names of further fields) is the caller's.
NEEDED = {
    "request": ("request_no", "person_no", "requested_at", "unit", "urgency", "note"),
    "record": ("record_id", "request_no", "person_no", "taken_day", "taken_time", "file_name", "height", "width"),
    "report": ("request_no", "reported_at", "reader", "finding", "text"),
    "person": ("person_no", "given_name", "family_name", "birth_date", "sex"),
}


@dataclass(frozen=True)
class Source:
    """One landed extract: its folder's name, its contract (named as in NEEDED), how it is read."""
    name: str
    contract: C.Contract
    reader: object
    has_trailer: bool = False

    def __post_init__(self):
        missing = set(NEEDED[self.contract.entity]) - set(self.contract.names)
        if missing:
            raise ValueError(f"{self.name}: the contract lacks {sorted(missing)}")


@dataclass(frozen=True)
class Lake:
    """Where the tables and the landed extracts are, and the parameters of the run."""
    spark: SparkSession
    root: str
    landing: str
    sources: tuple[Source, ...] = ()
    heads: tuple[scoring.Head, ...] = ()
    finding_of: tuple[tuple[str, str], ...] = ()
    quality_head: str = "check"
    main_finding: str = "ALPHA"
    second_finding: str = "BETA"
    normal_finding: str = "NORMAL"
    shift: Shift = Shift()
    salt: str = "worklake:"
    quality: tuple[str, ...] = ()  # numeric columns of the available files that drift is judged on
    drift_limits: tuple[float, float, int] = (0.10, 0.25, 30)  # warn, alert, least rows

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str, dates: Column | None = None) -> DataFrame:
        return tables.read_table(self.spark, self.path(table), dates)

    def has(self, table: str) -> bool:
        return tables.exists(self.spark, self.path(table))

    def contract(self, entity: str) -> C.Contract:
        return next(s.contract for s in self.sources if s.contract.entity == entity)

    def extract(self, source: str, date: Date) -> str:
        return f"{self.landing}/{source}/{date.isoformat()}"


def on(date: Date) -> Column:
    return F.col(DAY) == F.lit(date)


def _one(lake: Lake, **values) -> DataFrame:
    """One row of counts, the input of checks that do not come from an aggregate."""
    return lake.spark.range(1).select(*[F.lit(v).alias(n) for n, v in values.items()])


Volumes = dict[str, tuple[int | None, int | None, int | None]]  # entity -> rows in, out, rejected


def _finish(lake: Lake, stage: str, date: Date, parts: list[DataFrame], volumes: Volumes) -> DataFrame:
    """Store the stage's checks, its status and its volumes per entity; stop on a mismatch."""
    rows = materialize(recon.checks(*parts).withColumn(DAY, F.lit(date)), "checks")
    tables.replace_partitions(rows, lake.path("ref.recon_results"), [DAY, "stage"])
    counted = lake.spark.createDataFrame([(date, stage, entity, *v) for entity, v in volumes.items()],
                                         f"{DAY} date, stage string, entity string, rows_in bigint, rows_out bigint, rows_rejected bigint")
    audit = recon.audit_rows(rows, counted, [DAY, "stage"]).withColumn("run_id", F.lit(uuid.uuid4().hex[:12])).withColumn("ended_at", F.current_timestamp())
    tables.append_log(audit, lake.path("ref.load_audit"))
    recon.require_completed(rows)
    return rows


# ---- bronze


def _received(lake: Lake, source: Source, date: Date) -> DataFrame | None:
    try:
        return source.reader(lake.spark, lake.extract(source.name, date), source.contract)
    except AnalysisException:
        return None


def bronze(lake: Lake, date: Date) -> DataFrame:
    parts, quarantines, volumes = [], [], {}
    for source in lake.sources:
        check = lambda df, name, e, a, **kw: recon.check(df, [], "bronze", source.contract.entity, name, e, a, **kw)  # noqa: E731, B023
        rows = _received(lake, source, date)
        if rows is None:  # the old partition stays; the check fails the stage
            parts.append(check(_one(lake, e=1, a=0), "file received", F.col("e"), F.col("a")))
            volumes[source.contract.entity] = (None, None, None)
            continue
        found = materialize(C.annotated(rows, source.contract, "parse_error"), source.name)
        n = found.agg(F.count(F.lit(1)).alias("received"), F.count_if(F.col("reasons").isNotNull()).alias("rejected")).first()
        keep = [F.lit(date).alias(DAY), "_source_file", "_line", F.current_timestamp().alias("_ingested_at")]
        written = tables.replace_date(C.valid_rows(found, source.contract, keep), lake.path(f"bronze.{source.contract.entity}"), date.isoformat(),
                                      rows=F.count(F.lit(1)))["rows"]
        quarantines.append(C.quarantined_rows(found, source.contract, [*keep, F.lit(source.name).alias("source")]))
        volumes[source.contract.entity] = (n["received"], written, n["rejected"])
        counts = _one(lake, received=n["received"], loaded=written, rejected=n["rejected"])
        parts.append(check(counts, "received = loaded + quarantined", F.col("received"), F.col("loaded") + F.col("rejected")))
        if n["rejected"]:
            parts.append(check(counts, "records quarantined", F.lit(0), F.col("rejected"), explained=True))
        manifest = f"{lake.landing}/manifest/{source.name}/{date.isoformat()}"
        try:
            expected = landing.read_manifest(lake.spark, manifest).agg(F.sum("records")).scalar()
            parts.append(check(counts, "manifest records = records in file", expected, F.col("received")))
        except AnalysisException:
            pass  # a source without a manifest has nothing to compare
        if source.has_trailer:
            t = readers.trailer_totals(readers.read_trailers(readers.psv_splits(lake.spark, lake.extract(source.name, date), source.contract)))
            parts.append(check(t, "trailer count = data lines", F.greatest("files", F.lit(1)), F.col("agreeing")))
    if quarantines:
        tables.replace_date(recon.checks(*quarantines), lake.path("bronze.quarantine"), date.isoformat())
    return _finish(lake, "bronze", date, parts, volumes)


# ---- silver


def _typed(entity: str, df: DataFrame) -> DataFrame:
    if entity == "request":
        return df.select(DAY, "request_no", "person_no", F.col("requested_at").cast("timestamp_ntz").alias("requested_at"),
                         "unit", "urgency", "note")
    if entity == "record":
        taken = F.to_timestamp_ntz(F.concat("taken_day", "taken_time"), F.lit("yyyyMMddHHmmss"))
        return df.select(DAY, "record_id", "request_no", "person_no", taken.alias("arrival"), "file_name",
                         F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"))
    return df.select(DAY, "request_no", F.col("reported_at").cast("timestamp_ntz").alias("reported_at"), "reader", "finding",
                     "text", "_line")


def silver(lake: Lake, date: Date) -> DataFrame:
    parts, volumes = [], {}
    newest = [F.col("_ingested_at").desc(), F.col("_line").desc(), F.col("_source_file").desc()]
    for entity in ("request", "record", "report"):
        if not lake.has(f"bronze.{entity}"):
            continue
        key, day = lake.contract(entity).key, lake.read(f"bronze.{entity}", on(date))
        written = tables.replace_date(_typed(entity, latest.latest_per_key(day, [key], newest)), lake.path(f"silver.{entity}"), date.isoformat(),
                                      rows=F.count(F.lit(1)))["rows"]
        per_key = day.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
        counted = per_key.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("bronze"), F.count(F.lit(1)).alias("kept")).first()
        duplicates = counted["bronze"] - counted["kept"]
        counts = _one(lake, bronze=counted["bronze"], written=written, duplicates=duplicates)
        volumes[entity] = (counted["bronze"], written, duplicates)
        parts.append(recon.check(counts, [], "silver", entity, "bronze rows = silver rows + duplicates", F.col("bronze"), F.col("written") + F.col("duplicates")))
        if duplicates:
            parts.append(recon.check(counts, [], "silver", entity, "duplicates dropped", F.lit(0), F.col("duplicates"), explained=True))
    if lake.has("bronze.person"):
        # the present state of every person, from all dates: a re-run of any date ends in the same table
        current = latest.current_per_key(lake.read("bronze.person"), ["person_no"], DAY, [DAY, "_line", "given_name", "family_name", "birth_date", "sex"], "first_seen")
        tables.replace_current(current.select("person_no", "given_name", "family_name", F.col("birth_date").cast("date").alias("birth_date"), "sex", "first_seen"),
                               lake.path("silver.person"))
    return _finish(lake, "silver", date, parts, volumes)


# ---- gold


def gold(lake: Lake, date: Date) -> DataFrame:
    person = lake.read("silver.person")
    tables.replace_current(person.select(S.pseudonym(lake.salt, F.col("person_no")).alias("person_key"), F.year("birth_date").alias("birth_year"), "sex",
                                         "first_seen"), lake.path("gold.dim_person"))
    window = F.col(DAY).between(F.lit(date - timedelta(days=1)), F.lit(date))
    requests = joins.latest_in_window(lake.read("silver.request"), F.col(DAY), window, ["request_no"], [F.col(DAY).desc()])
    records = lake.read("silver.record", on(date))
    joined = joins.left_with_default(records, requests.select("request_no", "requested_at", "unit", "urgency", "note"), ["request_no"],
                                     {"unit": "UNKNOWN", "urgency": "UNKNOWN"}, "has_request")
    aged = joined.join(person.select("person_no", "birth_date"), "person_no", "left").select(
        DAY, F.col("request_no").alias("item_id"), "record_id", S.pseudonym(lake.salt, F.col("person_no")).alias("person_key"),
        "file_name", "arrival", "requested_at", "unit", "urgency", "note", "height", "width",
        S.age_years(F.to_date("arrival"), F.col("birth_date")).alias("age_years"), "has_request")
    facts = numbered(aged, [DAY], [F.col("arrival"), F.col("item_id")], "fifo_seq")
    n = tables.replace_date(facts, lake.path("gold.fact_item"), date.isoformat(), rows=F.count(F.lit(1)), no_request=F.count_if(~F.col("has_request")),
                            no_age=F.count_if(F.col("age_years").isNull()))
    silver_rows = records.count()
    volumes = {"fact_item": (silver_rows, n["rows"], 0)}
    counts = _one(lake, silver=silver_rows, **n)
    check = lambda name, e, a, entity="fact_item", **kw: recon.check(counts, [], "gold", entity, name, e, a, **kw)
    parts = [check("silver rows = gold rows", F.col("silver"), F.col("rows")),
             check("items without demographics", F.lit(0), F.col("no_age"), explained=True)]
    if n["no_request"]:
        parts.append(check("items without a valid request", F.lit(0), F.col("no_request"), explained=True))

    if lake.has("silver.report"):
        # a date holds the reports that arrived on it, whatever the date of their items
        newest = [F.col("reported_at").desc(), F.col("_line").desc()]
        last = latest.latest_per_key(lake.read("silver.report", on(date)), ["request_no"], newest)
        items = lake.read("gold.fact_item", F.col(DAY) <= F.lit(date)).select("item_id", F.col(DAY).alias("item_date"), "arrival")
        reports = last.join(items, F.col("request_no") == F.col("item_id"), "left").select(
            DAY, F.col("request_no").alias("item_id"), "item_date", F.col(DAY).alias("report_date"), "reported_at", "reader",
            "finding", S.truth_flag(F.col("finding"), lake.main_finding).alias("truth"),
            S.truth_flag(F.col("finding"), lake.second_finding).alias("truth_second"), "text",
            S.minutes_between(F.col("arrival"), F.col("reported_at")).alias("report_wait_min"))
        r = tables.replace_date(reports, lake.path("gold.fact_report"), date.isoformat(), rows=F.count(F.lit(1)), lost=F.count_if(F.col("item_date").isNull()))
        volumes["fact_report"] = (r["rows"], r["rows"], 0)
        if r["lost"]:
            parts.append(recon.check(_one(lake, **r), [], "gold", "fact_report", "reports without an item", F.lit(0), F.col("lost"), explained=True))
    return _finish(lake, "gold", date, parts, volumes)


# ---- scores


def score(lake: Lake, date: Date, probability, available: DataFrame) -> DataFrame:
    """Score the date's items. `available` has the file_name of every readable file and what `probability(head)`
    reads; items without a file are counted as missing. Returns the run's summary row."""
    started = datetime.now()
    items = lake.read("gold.fact_item", on(date)).select(DAY, "item_id", "file_name", "age_years")
    heads = list(lake.heads)
    scored = scoring.with_probabilities(joins.found(items, available, ["file_name"]).join(available, "file_name"), heads, probability)
    run_id, now = f"score-{date:%Y%m%d}-{uuid.uuid4().hex[:8]}", F.current_timestamp()
    stamp = lambda df: df.withColumn("run_id", F.lit(run_id)).withColumn("scored_at", now)
    keep = [DAY, "item_id", "file_name"]
    tables.replace_date(stamp(scoring.heads_long(scored, keep, "age_years", heads)), lake.path("gold.head_score"), date.isoformat())
    p = [f"_p{i}" for i in range(len(heads))]
    tables.replace_date(stamp(scoring.decide(scored.select(*keep, "age_years", *p), "age_years", heads)),
                        lake.path("gold.priority_score"), date.isoformat())
    done = lake.read("gold.priority_score", on(date)).select("item_id", "priority", "quality_check")
    run = _one(lake, **{DAY: date})  # a date without items has a run too, which failed
    both = run.join(items.join(done, "item_id", "left").withColumn("wanted", F.lit(True)).withColumn("scored", F.col("priority").isNotNull()), DAY, "left")
    summary = scoring.run_summary(both, [DAY]).join(scoring.versions_json(lake.read("gold.head_score", on(date)), [DAY]), DAY, "left").join(
        _run_drift(lake, run, items, available, heads), DAY)
    rows = materialize(stamp(summary).withColumnRenamed("scored_at", "ended_at").withColumn("started_at", F.lit(started)), "run")
    tables.append_log(rows, lake.path("ref.scoring_run"))
    return rows


def store_reference(lake: Lake, files: DataFrame) -> None:
    """The bins of the quality columns of a model's training files; runs are compared with them without reading the files again."""
    tables.replace_current(drift.reference_bins(files, list(lake.quality)), lake.path("ref.quality_bins"))


def _run_drift(lake: Lake, run: DataFrame, items: DataFrame, available: DataFrame, heads: list[scoring.Head]) -> DataFrame:
    """Drift of the run's files in scope of the main head. Without stored bins it is UNAVAILABLE."""
    if not lake.quality or not lake.has("ref.quality_bins"):
        return run.select(DAY, F.lit(0).cast("bigint").alias("drift_rows"), F.lit(None).cast("double").alias("psi_max"), F.lit("{}").alias("psi_json"),
                          F.lit("UNAVAILABLE").alias("drift_level"))
    main = next(h for h in heads if not h.checks_quality)
    files = items.where(S.in_scope(F.lit(main.population), F.col("age_years"))).join(available.select("file_name", *lake.quality), "file_name")
    sizes = run.select(DAY).join(files.groupBy(DAY).agg(F.count(F.lit(1)).alias("n")), DAY, "left").select(DAY, F.coalesce("n", F.lit(0)).alias("rows"))
    found = drift.psi_of_counts(lake.read("ref.quality_bins"), drift.value_counts(files, list(lake.quality), DAY), DAY)
    return drift.drift_report(found, sizes, [DAY], *lake.drift_limits).withColumnRenamed("rows", "drift_rows")


# ---- outcomes


def outcomes(lake: Lake, date: Date, first: Date, allow_unscored: bool = False) -> DataFrame:
    """Outcomes and summaries of the date and the day before, whose reports may have been signed since."""
    both_days = [d for d in (date - timedelta(days=1), date) if d >= first]
    names, days = [d.isoformat() for d in both_days], F.col(DAY).isin(both_days)
    facts = lake.read("gold.fact_item", days)
    newest = [F.col("scored_at").desc(), F.col("run_id").desc()]
    scores = latest.latest_per_key(lake.read("gold.priority_score", days), ["item_id"], newest) \
        .drop(DAY, "file_name", "age_years", "threshold", "run_id", "scored_at")
    # a report arrives on the date of its item or later, so those of the two dates are enough
    arrived = lake.read("gold.fact_report", F.col(DAY).between(F.lit(both_days[0]), F.lit(date)))
    reports = latest.latest_per_key(arrived, ["item_id"], [F.col("reported_at").desc(), F.col(DAY).desc()]).select(
        "item_id", "finding", "reported_at", "truth", "truth_second")
    ranked = facts.select(DAY, "item_id", "arrival", "unit", "age_years", "file_name", "fifo_seq").join(scores, "item_id", "left")
    has_shadow = F.col("shadow_priority").isNotNull()
    shadow = S.worklist_rank(F.when(has_shadow, F.col("shadow_priority")).otherwise(F.col("priority")),
                             F.when(has_shadow, F.col("shadow_probability")).otherwise(F.col("probability")))
    served = replay(ranked, [DAY], DAY, "arrival", "item_id", lake.shift,
                    {"triage": S.worklist_rank(F.col("priority"), F.col("probability")), "shadow": shadow})
    served = numbered(served, [DAY], [F.col("triage_start_us"), F.col("item_id")], "triage_seq")
    for arm, start in (("fifo", "start_us"), ("triage", "triage_start_us"), ("shadow", "shadow_start_us")):
        served = served.withColumn(f"{arm}_end_us", F.col(start) + lake.shift.service_us).withColumn(
            f"{arm}_wait_min", F.round((F.col(f"{arm}_end_us") - F.col("arrival_us")) / F.lit(60000000.0), 1))
    joined = served.join(reports, "item_id", "left")
    known, flagged = F.col("finding").isNotNull(), F.col("priority").isin("P1", "P2")
    truth = O.model_truth(F.col("triage_model"), F.col("finding"), S.planted_kind(F.col("file_name")).isNotNull(),
                          dict(lake.finding_of), lake.quality_head)
    rows = joined.select(
        DAY, "item_id", "arrival", "unit", "age_years", "file_name", "fifo_seq", "triage_seq", "probability", "priority",
        "model_version", F.col("priority").isNotNull().alias("scored"), "truth", "truth_second", "finding", "reported_at",
        known.alias("truth_known"), flagged.alias("flagged"),
        O.outcome_class(F.col("priority"), known, F.col("triage_model"), truth, flagged).alias("outcome"),
        at_time(DAY, "fifo_end_us", lake.shift).alias("fifo_report_ts"), at_time(DAY, "triage_end_us", lake.shift).alias("triage_report_ts"),
        "fifo_wait_min", "triage_wait_min", "shadow_wait_min",
        F.round(F.col("fifo_wait_min") - F.col("triage_wait_min"), 1).alias("wait_saved_min"),
        S.population_of(F.col("age_years")).alias("population"), "triage_model", "quality_check", "shadow_priority", "shadow_model")
    written = tables.replace_dates(rows, lake.path("gold.fact_outcome"), names, rows=F.count(F.lit(1)))["rows"]

    done = lake.read("gold.fact_outcome", days)
    classes = {"main": F.col("truth") == 1, "second": F.col("truth_second") == 1, "normal": F.col("finding") == lake.normal_finding}
    waits = O.group_waits(done, [DAY], classes, {a: f"{a}_wait_min" for a in ("fifo", "triage", "shadow")})
    tables.replace_dates(O.daily_summary(done, waits, DAY, "main", "second"), lake.path("gold.daily_summary"), names)
    heads = latest.latest_per_key(lake.read("gold.head_score", days), ["item_id", "model", "stage"], newest)
    by_head = O.model_truth(F.col("model"), F.col("finding"), S.planted_kind(F.col("file_name")).isNotNull(),
                            dict(lake.finding_of), lake.quality_head)
    judged = heads.join(reports.select("item_id", "finding"), "item_id", "left").withColumn("truth", by_head)
    tables.replace_dates(O.daily_model_summary(judged, [DAY, "model", "stage", "model_version"]), lake.path("gold.daily_model_summary"), names)

    expected = facts.count()
    counts = materialize(done.agg(F.count(F.lit(1)).alias("n"), F.count_if("scored").alias("scored"), F.count_if(~F.col("truth_known")).alias("pending"),
                                  F.count_if(F.col("quality_check") == "UNSUITABLE").alias("unfit")), "counts")
    check = lambda df, name, e, a, **kw: recon.check(df, [], "outcomes", "fact_outcome", name, e, a, **kw)
    return _finish(lake, "outcomes", date, [
        check(counts, "outcome rows = gold items", F.lit(expected), F.col("n")),
        check(counts, "scored items = gold items", F.col("n"), F.col("scored"), explained=allow_unscored),
        check(counts.where("pending > 0"), "items awaiting a report", F.lit(0), F.col("pending"), explained=True),
        check(counts.where("unfit > 0"), "files unfit for ranking", F.lit(0), F.col("unfit"), explained=True)], {"fact_outcome": (expected, written, 0)})


# ---- views


def create_views(lake: Lake, date: Date) -> list[str]:
    """Register the views over the tables as of the run date; returns their names."""
    done, facts = lake.read("gold.fact_outcome"), lake.read("gold.fact_item")
    persons = lake.read("gold.dim_person")
    models, checks = lake.read("gold.daily_model_summary"), lake.read("ref.recon_results")
    quarantine = lake.read("bronze.quarantine") if lake.has("bronze.quarantine") else None
    found = {
        "v_triage_outcome": V.v_triage_outcome(done, facts.select(DAY, "item_id", "person_key", "urgency", "has_request"), persons, "item_id",
                                               "person_key", ["urgency", "has_request"], ["sex", "birth_year"]),
        "v_daily_kpi": V.v_daily_kpi(lake.read("gold.daily_summary"), "main", "second"),
        "v_band_daily": V.v_band_daily(done, facts), "v_unit_daily": V.v_unit_daily(done, facts),
        "v_scoring_run": V.v_scoring_run(lake.read("ref.scoring_run")), "v_model_daily": V.v_model_daily(models),
        "v_silent_trial": V.v_silent_trial(models), "v_data_quality": V.v_data_quality(checks),
        "v_stage_status": V.v_stage_status(lake.read("ref.load_audit"), "run_id")}
    if quarantine is not None:
        found["v_quarantine"] = V.v_quarantine(quarantine)
    for table, name, build in (("ref.model_event", "v_model_event", lambda df: V.v_model_event(df, "alpha", "event_id")),
                               ("ref.training_set", "v_training_set", lambda df: V.v_training_set(df, "alpha"))):
        if lake.has(table):
            found[name] = build(lake.read(table))
    for name, df in found.items():
        df.createOrReplaceTempView(name)
    return sorted(found)


def consistency(lake: Lake, main: str = "main") -> DataFrame:
    """Counters that differ between v_daily_kpi and the same counted from v_triage_outcome; empty is right."""
    recount = lake.spark.table("v_triage_outcome").groupBy(DAY).agg(
        F.count(F.lit(1)).alias("studies"), F.sum("is_p1").alias("p1"), F.sum("is_positive").alias(main),
        *[F.count_if(F.col("outcome") == c.upper()).alias(c) for c in O.CONFUSION])
    return recon.differences(lake.spark.table("v_daily_kpi"), recount, DAY, ["studies", "p1", main, *O.CONFUSION])
