"""Sources, tables, contracts and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from worklake.functions import contracts as C
from worklake.operators import recon
from worklake.operators.latest import copies_per_key
from worklake.registered.base import cte, query, table
from worklake.registered.frames import EVENT_RECORD, events, raw_records
from worklake.session import materialize, scratch_path
from worklake.sources import landing, readers, tables

COLUMNS = EVENT_RECORD.names


# ---- extracts: written from the whole event table, read back


def _exported(spark, sf, how):
    path = scratch_path(spark, "landing")
    how(raw_records(spark, sf), path, "business_date", "event_id", COLUMNS)
    return path


@query("read_psv_trailer", "SELECT event_id, ts, user_id, event_type, note, CAST(NULL AS VARCHAR) AS parse_error FROM {raw}")
def read_psv_trailer(spark, sf):
    path = _exported(spark, sf, landing.export_psv)
    return readers.read_psv(spark, path, EVENT_RECORD).select(*COLUMNS, "parse_error")


@query("trailer_check", """SELECT CAST(count(*) AS BIGINT) AS expected, CAST(count(*) AS BIGINT) AS actual, CAST(0 AS BIGINT) AS wrong_files,
  'MATCHED' AS status FROM {raw}""")
def trailer_check(spark, sf):
    """Each file's trailer against its own lines: files that are wrong in opposite ways don't make up for each other."""
    totals = readers.trailer_totals(readers.read_trailers(readers.psv_splits(spark, _exported(spark, sf, landing.export_psv), EVENT_RECORD)))
    status = recon.recon_status(F.greatest("files", F.lit(1)), F.col("agreeing"))
    return totals.select(F.col("trailer").alias("expected"), F.col("data_lines").alias("actual"),
                         (F.col("files") - F.col("agreeing")).alias("wrong_files"), status.alias("status"))


@query("read_jsonl_permissive", """SELECT event_id, ts, user_id, event_type, note, CAST(NULL AS VARCHAR) AS parse_error FROM {raw}
  UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'not a JSON object' FROM nation
  UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'invalid JSON' FROM region""")
def read_jsonl_permissive(spark, sf):
    """The records, plus lines that are JSON but no object (one per nation) and lines that are no JSON at all."""
    path = _exported(spark, sf, landing.export_jsonl)
    broken = table(spark, sf, "nation").select(F.concat(F.lit("["), "n_nationkey", F.lit("]")).alias("value")).unionByName(
        table(spark, sf, "region").select(F.concat(F.lit("{\"event_id\": "), "r_name").alias("value")))
    broken.write.mode("append").text(f"{path}/broken")
    return readers.read_jsonl(spark, path, EVENT_RECORD).select(*COLUMNS, "parse_error")


@query("read_csv_header", """SELECT event_id, ts, user_id, event_type, trim(note) AS note, CAST(NULL AS VARCHAR) AS parse_error FROM {raw}
  UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR), 'a "quoted", field', '', NULL FROM supplier
  UNION ALL SELECT NULL, NULL, NULL, NULL, '', '2 fields, header has 5' FROM nation
  UNION ALL SELECT NULL, NULL, NULL, NULL, '', '7 fields, header has 5' FROM region
  UNION ALL SELECT NULL, NULL, NULL, NULL, '', 'no header' FROM region""")
def read_csv_header(spark, sf):
    """The extract, and files whose header has another order, an extra and a missing column; whose lines are too short or too long; and
    whose first line is no header."""
    path = _exported(spark, sf, landing.export_csv)
    other = table(spark, sf, "supplier").select(
        F.lit("x").alias("extra"), F.lit('a "quoted", field').alias("event_type"), F.col("s_nationkey").cast("string").alias("user_id"),
        F.concat(F.lit("S"), "s_suppkey").alias("event_id"), F.col("s_name").alias("ts"))
    other.write.option("header", True).csv(f"{path}/reordered")
    head, line = ",".join(COLUMNS), F.concat(F.col("r_regionkey").cast("string"), F.lit(",a,b,c,d,e,f"))
    short, many = table(spark, sf, "nation").select(F.concat("n_nationkey", F.lit(",a")).alias("value")), table(spark, sf, "region").select(line.alias("value"))
    for name, first, lines in (("short", head, short), ("long", head, many), ("headless", "1,2,3", many)):
        framed = lines.select(F.lit(1).alias("_kind"), "value").unionByName(spark.range(1).select(F.lit(0).alias("_kind"), F.lit(first).alias("value")))
        framed.repartition(1).sortWithinPartitions("_kind").select("value").write.text(f"{path}/{name}")  # 26 lines at most
    return readers.read_csv(spark, path, EVENT_RECORD).select(
        "event_id", "ts", "user_id", "event_type", F.coalesce(F.trim("note"), F.lit("")).alias("note"), "parse_error")


def _landed(spark, sf):
    """The extract and its manifest, the manifest's rows checked against what was written."""
    root = scratch_path(spark, "landed")
    landing.export_with_manifest(landing.export_jsonl, raw_records(spark, sf), f"{root}/events", f"{root}/manifest", "events", "business_date", "event_id", COLUMNS)
    return f"{root}/events", f"{root}/manifest"


@query("export_extract_manifest", """SELECT 'events' AS source, business_date, count(*) AS records, count(*) AS read_back FROM {ev} GROUP BY business_date""")
def export_extract_manifest(spark, sf):
    """The manifest beside the records that are read back from the extract."""
    extract, manifest = _landed(spark, sf)
    back = landing.records_received(spark, extract).withColumnRenamed("received", "read_back")
    return landing.read_manifest(spark, manifest).join(back, "business_date")


_LOST, _SHORT = "2024-01-20", "2024-01-10"


@query("manifest_check", f"""SELECT business_date, expected, actual, CASE WHEN expected = actual THEN 'MATCHED' ELSE 'MISMATCH' END AS status FROM (
  SELECT business_date, count(*) AS expected, CASE business_date WHEN DATE '{_LOST}' THEN 0 WHEN DATE '{_SHORT}' THEN count(*) FILTER (k < 50) ELSE count(*) END AS actual
  FROM {{ev}} GROUP BY business_date)""")
def manifest_check(spark, sf):
    """The extract is written and then damaged: a date's files are lost, another date's are cut short. What is there is read and counted."""
    extract, manifest = _landed(spark, sf)
    short = raw_records(spark, sf).join(events(spark, sf).where(f"business_date = date'{_SHORT}' and k < 50").select(F.col("event_id").cast("string")), "event_id", "left_semi")
    text = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in COLUMNS]))
    nothing = F.col("business_date") == F.lit(_LOST).cast("date")
    lost = raw_records(spark, sf).where(nothing).limit(1).select("business_date", F.lit("").alias("value"))  # overwritten by an empty line
    damaged = short.select("business_date", text.alias("value")).unionByName(lost)
    tables.overwrite_text(damaged, extract)
    return landing.manifest_check(landing.read_manifest(spark, manifest), landing.records_received(spark, extract))


@query("discover_from_path", """SELECT event_type AS label_name, strftime(business_date, 'business_date=%Y-%m-%d') AS source_split,
  '/files/' || strftime(business_date, 'business_date=%Y-%m-%d') || '/label=' || event_type AS folder, CAST(sum(strlen(props) + 1) AS BIGINT) AS bytes FROM {ev} GROUP BY ALL""")
def discover_from_path(spark, sf):
    """Each file's folder, the label and split taken from it, and its bytes; files of another kind beside them are left out."""
    path = f"{scratch_path(spark, 'tree')}/files"
    (events(spark, sf).select("business_date", F.col("event_type").alias("label"), F.col("props").alias("value"))
     .hint("rebalance", "business_date").write.partitionBy("business_date", "label").text(path))
    events(spark, sf).select("business_date", F.col("event_type").alias("label"), "event_id").hint("rebalance", "business_date").write.partitionBy(
        "business_date", "label").mode("append").json(path)
    found = readers.discover(spark, path, [".txt"])
    folder = F.regexp_extract("path", r"(/files/.*)/[^/]+$", 1)
    return found.groupBy(F.regexp_replace("label_name", "^label=", "").alias("label_name"), "source_split", folder.alias("folder")).agg(
        F.sum("length").alias("bytes"))


# ---- tables


def _event_table(spark, sf, name="events"):
    path = scratch_path(spark, name)
    rows = events(spark, sf).select("business_date", "event_id", "event_type", "value")
    tables.write_table(rows, path)
    return path, rows


@query("scan_partitions", """SELECT '= d' AS scan, count(*) AS rows, sum(event_id) AS ids FROM {ev} WHERE business_date = DATE '2024-01-15'
  UNION ALL SELECT 'in (d-1, d)', count(*), sum(event_id) FROM {ev} WHERE business_date IN (DATE '2024-01-14', DATE '2024-01-15')
  UNION ALL SELECT 'between', count(*), sum(event_id) FROM {ev} WHERE business_date BETWEEN DATE '2024-01-14' AND DATE '2024-01-15'
  UNION ALL SELECT '<= d', count(*), sum(event_id) FROM {ev} WHERE business_date <= DATE '2024-01-15'""")
def scan_partitions(spark, sf):
    """The four date predicates of the daily run; each prunes the table's directories."""
    path, _ = _event_table(spark, sf)
    d, before = F.lit("2024-01-15").cast("date"), F.lit("2024-01-14").cast("date")
    day = F.col("business_date")
    scans = {"= d": day == d, "in (d-1, d)": day.isin(before, d), "between": day.between(before, d), "<= d": day <= d}
    parts = [tables.read_table(spark, path, cond).agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids"))
             .select(F.lit(name).alias("scan"), "rows", "ids") for name, cond in scans.items()]
    return recon.checks(*parts)


@query("replace_partitions", """SELECT business_date, event_id, event_type,
  CASE WHEN business_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' THEN value * 2 ELSE value END AS value FROM {ev}""")
def replace_partitions(spark, sf):
    path, rows = _event_table(spark, sf)
    rerun = rows.where("business_date between date'2024-01-10' and date'2024-01-12'").withColumn("value", F.col("value") * 2)
    tables.replace_partitions(rerun, path)
    return tables.read_table(spark, path).select("business_date", "event_id", "event_type", "value")


@query("delete_partition_if_empty", "SELECT business_date, event_id, event_type, value FROM {ev} WHERE business_date <> DATE '2024-01-15'")
def delete_partition_if_empty(spark, sf):
    path, rows = _event_table(spark, sf)
    nothing = rows.where("business_date = date'2024-01-15' and value < 0")
    tables.replace_date(nothing, path, "2024-01-15")
    return tables.read_table(spark, path).select("business_date", "event_id", "event_type", "value")


@query("replace_table", "SELECT event_type, count(*) AS events, max(business_date) AS last_date FROM {ev} GROUP BY event_type")
def replace_table(spark, sf):
    root = scratch_path(spark, "rebuilt")
    summary = lambda df: df.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.max("business_date").alias("last_date"))
    tables.replace_table(summary(events(spark, sf).where("business_date < date'2024-01-15'")), root)
    return spark.read.parquet(tables.replace_table(summary(events(spark, sf)), root))


@query("replace_by_key", """SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
  o_totalprice FROM orders""")
def replace_by_key(spark, sf):
    old = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    new = old.where("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("F"))
    return tables.replace_by_key(old, new, ["o_orderkey"])


@query("append_log", """SELECT event_type, business_date, count(*) AS events FROM {ev} WHERE event_type IS NOT NULL GROUP BY ALL""")
def append_log(spark, sf):
    path = scratch_path(spark, "log")
    early = F.col("event_type").isin("error", "purchase")
    for part in (early, ~early):  # two appends
        tables.append_log(events(spark, sf).where(part).groupBy("event_type", "business_date").agg(
            F.count(F.lit(1)).alias("events")), path)
    return spark.read.parquet(path)


@query("align_schema", """SELECT o_orderkey AS id, CAST(NULL AS VARCHAR) AS note, o_totalprice AS amount, o_orderstatus FROM orders
  UNION ALL SELECT event_id, props, value, NULL FROM events""")
def align_schema(spark, sf):
    target = spark.createDataFrame([], "id bigint, note string, amount double").schema
    orders = table(spark, sf, "orders").select(F.col("o_totalprice").alias("amount"), F.col("o_orderkey").alias("ID"), "o_orderstatus")
    ev = table(spark, sf, "events").select(F.col("value").alias("amount"), F.col("props").alias("note"), F.col("event_id").alias("id"))
    return tables.align_schema(orders, target).unionByName(tables.align_schema(ev, target), allowMissingColumns=True)


@query("rename_column", "SELECT event_id, value, event_type AS kind FROM events")
def rename_column(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value", "event_type")
    once = tables.rename_column(df, "event_type", "kind")
    return tables.rename_column(once, "event_type", "kind")


def _versions(spark, sf):
    path = scratch_path(spark, "versions")
    rows = events(spark, sf).select("event_id", "event_type", "value")
    tables.append_version(rows, path, 1)
    tables.append_version(rows.where("event_type = 'error'").withColumn("value", F.lit(0.0)), path, 2)
    tables.append_version(rows.where("event_type = 'click'").withColumn("value", F.lit(-1.0)), path, 3)
    return path


@query("read_pinned_version", """SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS value FROM {ev}""")
def read_pinned_version(spark, sf):
    return tables.read_pinned(spark, _versions(spark, sf), 2, ["event_id"]).select("event_id", "event_type", "value")


@query("table_history", """SELECT 'events' AS table_name, version, rows_added, sum(rows_added) OVER (ORDER BY version) AS total_rows FROM (
  SELECT 1 AS version, count(*) AS rows_added FROM events UNION ALL SELECT 2, count(*) FROM events WHERE event_type = 'error'
  UNION ALL SELECT 3, count(*) FROM events WHERE event_type = 'click')""")
def table_history(spark, sf):
    return tables.table_history(spark, _versions(spark, sf), "events")


# ---- contracts

_FIELD = {f.name: f for f in EVENT_RECORD.fields}


@query("contract_required", "SELECT event_id, r_user AS reason FROM {reasoned} WHERE r_user IS NOT NULL")
def contract_required(spark, sf):
    reason = C.missing_reason(_FIELD["user_id"], F.col("user_id"))
    return raw_records(spark, sf).select("event_id", reason.alias("reason")).where("reason is not null")


@query("contract_type", "SELECT event_id, r_ts AS reason FROM {reasoned} WHERE r_ts IS NOT NULL")
def contract_type(spark, sf):
    reason = C.type_reason(_FIELD["ts"], F.col("ts"))
    return raw_records(spark, sf).select("event_id", reason.alias("reason")).where("reason is not null")


@query("contract_values", "SELECT event_id, r_type AS reason FROM {reasoned} WHERE r_type IS NOT NULL")
def contract_values(spark, sf):
    reason = C.values_reason(_FIELD["event_type"], F.col("event_type"))
    return raw_records(spark, sf).select("event_id", reason.alias("reason")).where("reason is not null")


@query("contract_reasons", "SELECT event_id, reasons FROM {reasoned}")
def contract_reasons(spark, sf):
    return C.annotated(raw_records(spark, sf), EVENT_RECORD).select("event_id", "reasons")


@query("split_valid_quarantine", """SELECT business_date, event_id, trim(ts) AS ts, trim(user_id) AS user_id, event_type,
  nullif(trim(note), '') AS note, 'valid' AS side, CAST(NULL AS VARCHAR) AS reasons FROM {reasoned} WHERE reasons IS NULL
  UNION ALL SELECT business_date, event_id, ts, user_id, event_type, note, 'quarantine', reasons
  FROM {reasoned} WHERE reasons IS NOT NULL""")
def split_valid_quarantine(spark, sf):
    """Both sides of the split in one frame; the quarantined record is read back from its JSON."""
    found = materialize(C.annotated(raw_records(spark, sf), EVENT_RECORD), "annotated")
    valid = C.valid_rows(found, EVENT_RECORD, ["business_date"]).withColumn("side", F.lit("valid")) \
        .withColumn("reasons", F.lit(None).cast("string"))
    back = F.from_json("record", ", ".join(f"{n} string" for n in COLUMNS)).alias("r")
    bad = C.quarantined_rows(found, EVENT_RECORD, ["business_date"]).select("business_date", "reasons", back).select(
        "business_date", "r.*", F.lit("quarantine").alias("side"), "reasons")
    return valid.unionByName(bad)


@query("quarantine_summary", """SELECT business_date, 'event_record' AS entity, reasons, count(*) AS records FROM {reasoned}
  WHERE reasons IS NOT NULL GROUP BY ALL""")
def quarantine_summary(spark, sf):
    found = C.annotated(raw_records(spark, sf), EVENT_RECORD)
    return C.quarantine_summary(C.quarantined_rows(found, EVENT_RECORD, ["business_date"]), ["business_date", "entity"])


# ---- reconciliation

cte("per_day", """SELECT business_date, CAST(count(*) AS DOUBLE) AS received, CAST(count(*) FILTER (reasons IS NULL) AS DOUBLE) AS loaded,
  CAST(count(*) FILTER (reasons IS NOT NULL) AS DOUBLE) AS rejected FROM {reasoned} GROUP BY business_date""")


def received_per_day(spark, sf):
    found = C.annotated(raw_records(spark, sf), EVENT_RECORD)
    return found.groupBy("business_date").agg(
        F.count(F.lit(1)).alias("received"), F.count_if(F.col("reasons").isNull()).alias("loaded"),
        F.count_if(F.col("reasons").isNotNull()).alias("rejected"))


@query("recon_check", """SELECT business_date, event_type, CAST(n AS DOUBLE) AS expected, CAST(m AS DOUBLE) AS actual,
  CASE WHEN m IS NOT NULL AND abs(m - n) <= 2 THEN 'MATCHED' WHEN event_type = 'error' THEN 'EXPLAINED' ELSE 'MISMATCH' END AS status FROM (
  SELECT business_date, event_type, count(*) AS n, nullif(count(*) FILTER (k < 97), 0) AS m FROM {ev} GROUP BY ALL)""")
def recon_check(spark, sf):
    counts = events(spark, sf).groupBy("business_date", "event_type").agg(
        F.count(F.lit(1)).cast("double").alias("expected"),
        F.nullif(F.count_if(F.col("k") < 97), F.lit(0)).cast("double").alias("actual"))
    return counts.withColumn("status", recon.recon_status(F.col("expected"), F.col("actual"), 2.0, F.col("event_type") == "error"))


cte("bronze_checks", """SELECT business_date, 'bronze' AS stage, 'event_record' AS entity, 'received = loaded + quarantined' AS check_name,
  received AS expected, loaded + rejected AS actual, 'MATCHED' AS status, '' AS detail FROM {per_day}
  UNION ALL SELECT business_date, 'bronze', 'event_record', 'records quarantined', 0.0, rejected, 'EXPLAINED', '' FROM {per_day} WHERE rejected > 0""")


def bronze_checks(spark, sf):
    per_day = received_per_day(spark, sf)
    return recon.checks(
        recon.check(per_day, ["business_date"], "bronze", "event_record", "received = loaded + quarantined",
                    F.col("received"), F.col("loaded") + F.col("rejected")),
        recon.check(per_day.where("rejected > 0"), ["business_date"], "bronze", "event_record", "records quarantined",
                    F.lit(0), F.col("rejected"), explained=True))


@query("recon_received", "SELECT * FROM {bronze_checks}")
def recon_received(spark, sf):
    return bronze_checks(spark, sf)


@query("recon_duplicates", """SELECT l_returnflag AS entity, CAST(count(*) AS DOUBLE) AS expected,
  CAST(count(DISTINCT (l_orderkey, l_linenumber)) AS DOUBLE) AS kept,
  CAST(count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS DOUBLE) AS duplicates,
  CASE WHEN count(*) = count(DISTINCT (l_orderkey, l_linenumber)) THEN 'MATCHED' ELSE 'EXPLAINED' END AS status
  FROM lineitem GROUP BY l_returnflag""")
def recon_duplicates(spark, sf):
    """Per entity: rows = kept + duplicates. Copies of a key collapse to a count before the entity is summed,
    so neither a hot key nor a hot entity meets one task."""
    per_key = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("copies"))
    counts = per_key.groupBy(F.col("l_returnflag").alias("entity")).agg(
        F.sum("copies").cast("double").alias("expected"), F.count(F.lit(1)).cast("double").alias("kept"))
    dup = F.col("expected") - F.col("kept")
    return counts.withColumn("duplicates", dup).withColumn("status", recon.recon_status(F.lit(0.0), dup, 0.0, True))


@query("copies_per_key", """SELECT l_orderkey, l_linenumber, max(l_shipdate) AS l_shipdate, count(*) AS copies FROM lineitem GROUP BY ALL""")
def copies_of_key(spark, sf):
    return copies_per_key(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"])


@query("recon_replace_stage", """SELECT * FROM {bronze_checks} WHERE NOT (business_date >= DATE '2024-01-20')
  UNION ALL SELECT business_date, 'bronze', 'event_record', 'received = loaded + quarantined', received, loaded, 
    CASE WHEN received = loaded THEN 'MATCHED' ELSE 'MISMATCH' END, '' FROM {per_day} WHERE business_date >= DATE '2024-01-20'""")
def recon_replace_stage(spark, sf):
    """A re-run of the last dates writes other checks; those of earlier dates stay."""
    rerun = received_per_day(spark, sf).where("business_date >= date'2024-01-20'")
    new = recon.check(rerun, ["business_date"], "bronze", "event_record", "received = loaded + quarantined",
                      F.col("received"), F.col("loaded"))
    return recon.replace_stage(bronze_checks(spark, sf), new, "bronze", F.col("business_date") >= F.lit("2024-01-20").cast("date"))


cte("volumes", """SELECT business_date, 'bronze' AS stage, 'event_record' AS entity, count(*) AS rows_in, count(*) FILTER (reasons IS NULL) AS rows_out,
  count(*) FILTER (reasons IS NOT NULL) AS rows_rejected FROM {reasoned} GROUP BY business_date
  UNION ALL SELECT DISTINCT business_date, 'bronze', 'lost_record', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM {ev} WHERE k = 7""")
cte("audit", """SELECT s.business_date, s.stage, '*' AS entity, v.rows_in, v.rows_out, v.rows_rejected, CASE WHEN mismatched > 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
  matched, explained, mismatched FROM (SELECT business_date, stage, count(*) FILTER (status = 'MATCHED') AS matched,
  count(*) FILTER (status = 'EXPLAINED') AS explained, count(*) FILTER (status = 'MISMATCH') AS mismatched FROM {bronze_checks} GROUP BY ALL) s
  JOIN (SELECT business_date, stage, CAST(sum(rows_in) AS BIGINT) AS rows_in, CAST(sum(rows_out) AS BIGINT) AS rows_out, CAST(sum(rows_rejected) AS BIGINT) AS rows_rejected
    FROM {volumes} GROUP BY ALL) v ON v.business_date = s.business_date AND v.stage = s.stage
  UNION ALL SELECT business_date, stage, entity, rows_in, rows_out, rows_rejected, CASE WHEN rows_in IS NULL THEN 'MISSING' ELSE 'COMMITTED' END, NULL, NULL, NULL FROM {volumes}""")


def audit(spark, sf):
    """Status and volumes per date, of each entity and of the stage. On some dates a second extract is missing."""
    per_day = received_per_day(spark, sf)
    volumes = per_day.select("business_date", F.lit("bronze").alias("stage"), F.lit("event_record").alias("entity"), F.col("received").alias("rows_in"),
                             F.col("loaded").alias("rows_out"), F.col("rejected").alias("rows_rejected"))
    lost = events(spark, sf).where("k = 7").select("business_date").distinct().select(
        "business_date", F.lit("bronze").alias("stage"), F.lit("lost_record").alias("entity"), *[F.lit(None).cast("bigint").alias(c) for c in volumes.columns[3:]])
    return recon.audit_rows(bronze_checks(spark, sf), volumes.unionByName(lost), ["business_date", "stage"])


@query("stage_status", "SELECT * FROM {audit}")
def stage_status(spark, sf):
    return audit(spark, sf)
