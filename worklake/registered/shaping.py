"""Typed projections, de-identification, joins, latest rows and flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from worklake.functions import contracts as C
from worklake.functions import scalars as S
from worklake.operators import joins, latest
from worklake.operators.ordered import numbered
from worklake.operators.sampling import overlap_pairs
from worklake.registered.base import cte, query, table
from worklake.registered.frames import (EVENT_RECORD, birth_date, decided, events, items, queued, raw_records,
                                        reports, scored_items, signed_reports, sql_hash)


@query("silver_typed", """SELECT CAST(event_id AS BIGINT) AS item_id, CAST(user_id AS BIGINT) AS person_id,
  strptime(ts, '%Y-%m-%d %H:%M:%S') AS sent_at, strptime(strftime(strptime(ts, '%Y-%m-%d %H:%M:%S'), '%Y%m%d%H%M%S'), '%Y%m%d%H%M%S') AS joined_at,
  event_type AS unit, nullif(trim(note), '') AS note FROM {reasoned} WHERE reasons IS NULL""")
def silver_typed(spark, sf):
    """Strings to types; the second timestamp is put together from a date8 and a time6 column."""
    valid = C.valid_rows(C.annotated(raw_records(spark, sf), EVENT_RECORD), EVENT_RECORD)
    ts = F.col("ts").cast("timestamp_ntz")
    date8, time6 = F.date_format(ts, "yyyyMMdd"), F.date_format(ts, "HHmmss")
    return valid.select(F.col("event_id").cast("bigint").alias("item_id"), F.col("user_id").cast("bigint").alias("person_id"),
                        ts.alias("sent_at"), F.to_timestamp_ntz(F.concat(date8, time6), F.lit("yyyyMMddHHmmss")).alias("joined_at"),
                        F.col("event_type").alias("unit"), "note")


_BIRTH = f"DATE '1950-01-01' + CAST(floor({sql_hash(chr(39) + 'birth:' + chr(39) + ' || c_custkey')} * 25000) AS INTEGER)"


@query("pseudonymise", f"""SELECT substr(sha256('worklake:' || c_custkey), 1, 16) AS person_key, year({_BIRTH}) AS birth_year,
  c_mktsegment AS segment FROM customer""")
def pseudonymise(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(S.pseudonym("worklake:", F.col("c_custkey")).alias("person_key"),
                    F.year(birth_date(F.col("c_custkey"))).alias("birth_year"), F.col("c_mktsegment").alias("segment"))


@query("age_years", "SELECT item_id, age_years FROM {items}")
def age_years(spark, sf):
    return items(spark, sf).select("item_id", "age_years")


@query("age_band", """SELECT item_id, CASE WHEN age_years IS NULL THEN 'UNKNOWN' WHEN age_years < 1 THEN '<1' WHEN age_years < 3 THEN '1-2'
  WHEN age_years < 18 THEN '3-17' WHEN age_years < 40 THEN '18-39' WHEN age_years < 65 THEN '40-64' ELSE '65+' END AS age_band FROM {items}""")
def age_band(spark, sf):
    return items(spark, sf).select("item_id", S.age_band(F.col("age_years")).alias("age_band"))


@query("population_of", """SELECT item_id, CASE WHEN age_years >= 18 THEN 'adult' WHEN age_years IS NOT NULL THEN 'pediatric' END AS population
  FROM {items}""")
def population_of(spark, sf):
    return items(spark, sf).select("item_id", S.population_of(F.col("age_years")).alias("population"))


@query("in_scope", """SELECT item_id, age_years IS NULL OR age_years >= 18 AS adult, age_years IS NULL OR age_years < 18 AS pediatric,
  true AS anyone FROM {items}""")
def in_scope(spark, sf):
    scope = lambda p: S.in_scope(F.lit(p), F.col("age_years"))
    return items(spark, sf).select("item_id", scope("adult").alias("adult"), scope("pediatric").alias("pediatric"),
                                   scope("all").alias("anyone"))


@query("truth_flags", """SELECT item_id, CASE WHEN finding = 'ALPHA' THEN 1 ELSE 0 END AS is_alpha,
  CASE WHEN finding = 'BETA' THEN 1 ELSE 0 END AS is_beta FROM {reports}""")
def truth_flags(spark, sf):
    r = reports(spark, sf)
    return r.select("item_id", S.truth_flag(F.col("finding"), "ALPHA").alias("is_alpha"),
                    S.truth_flag(F.col("finding"), "BETA").alias("is_beta"))


cte("fact_report", """SELECT r.item_id, i.business_date AS item_date, r.report_date, r.report_ts, r.finding,
  CASE WHEN r.finding = 'ALPHA' THEN 1 ELSE 0 END AS truth, date_sub('second', i.arrival, r.report_ts) / CAST(60 AS DOUBLE) AS report_wait_min
  FROM {reports} r LEFT JOIN {items} i ON i.item_id = r.item_id""")


def fact_report(spark, sf):
    """Latest report of every item with the item it belongs to, across dates; truth arrives late."""
    i = items(spark, sf).select("item_id", F.col("business_date").alias("item_date"), "arrival")
    return reports(spark, sf).join(i, "item_id", "left").select(
        "item_id", "item_date", "report_date", "report_ts", "finding", S.truth_flag(F.col("finding"), "ALPHA").alias("truth"),
        S.minutes_between(F.col("arrival"), F.col("report_ts")).alias("report_wait_min"))


@query("report_wait_min", """SELECT o_orderkey, l_linenumber, round(date_sub('second', o_orderdate, l_shipdate) / CAST(60 AS DOUBLE), 4) AS wait_min
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def report_wait_min(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "o_orderkey", "l_linenumber", F.round(S.minutes_between(F.col("o_orderdate"), F.col("l_shipdate")), 4).alias("wait_min"))


cte("part_files", """SELECT p_partkey, p_type, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'person' || p_size || '_' || replace(p_name, ' ', '_') || '.jpeg'
  WHEN p_type = 'MEDIUM' THEN 'NORMAL2-IM-' || p_size || '-0001.jpeg' WHEN p_type = 'LARGE' THEN 'IM-' || p_size || '-0001.jpeg'
  ELSE replace(p_name, ' ', '-') || '.png' END AS file_name FROM part""")


def part_files(spark, sf):
    """File names of every shape the keys are hidden in."""
    t, size = F.col("p_type"), F.col("p_size").cast("string")
    name = (F.when(t.isin("ECONOMY", "SMALL"), F.concat(F.lit("person"), size, F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".jpeg")))
             .when(t == "MEDIUM", F.concat(F.lit("NORMAL2-IM-"), size, F.lit("-0001.jpeg")))
             .when(t == "LARGE", F.concat(F.lit("IM-"), size, F.lit("-0001.jpeg")))
             .otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".png"))))
    return table(spark, sf, "part").select("p_partkey", "p_type", name.alias("file_name"))


@query("key_from_name", r"""SELECT p_partkey, p_type || ':' || coalesce(nullif(regexp_extract(file_name, '^(person\d+)_', 1), ''),
  nullif(regexp_extract(file_name, '^((NORMAL2-)?IM-\d+)-', 1), ''), regexp_replace(file_name, '\.[^.]*$', '')) AS person FROM {part_files}""")
def key_from_name(spark, sf):
    return part_files(spark, sf).select("p_partkey", S.person_from_file(F.col("file_name"), F.col("p_type")).alias("person"))


@query("planted_parse", """SELECT item_id, nullif(regexp_extract(file_name, '^QC-([A-Z]+)-(.+)$', 1), '') AS kind,
  nullif(regexp_extract(file_name, '^QC-([A-Z]+)-(.+)$', 2), '') AS original FROM {items}""")
def planted_parse(spark, sf):
    name = F.col("file_name")
    return items(spark, sf).select("item_id", S.planted_kind(name).alias("kind"), S.planted_original(name).alias("original"))


@query("label_flag_from_array", """SELECT p_partkey, CASE WHEN p_name LIKE '%widget%' THEN 1 ELSE 0 END AS is_widget,
  CASE WHEN p_size < 5 THEN 'none' ELSE replace(p_name, ' ', '|') END AS labels FROM part""")
def label_flag_from_array(spark, sf):
    words = F.split("p_name", " ")
    found = F.when(F.col("p_size") < 5, F.array().cast("array<string>")).otherwise(words)
    return table(spark, sf, "part").select("p_partkey", S.label_flag(words, "widget").alias("is_widget"),
                                           S.label_text(found, "none").alias("labels"))


@query("version_string", """SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN '' ELSE p_type || '-' END || 'fv' || p_size || '-'
  || substr(sha256(p_name), 1, 7) AS version FROM part""")
def version_string(spark, sf):
    v = S.version_string(F.col("p_type"), F.col("p_size").cast("string"), F.sha2("p_name", 256), "ECONOMY")
    return table(spark, sf, "part").select("p_partkey", v.alias("version"))


@query("config_hash", """SELECT p_partkey, substr(sha256('{{"backbone":"' || p_brand || '","image_size":' || p_size || ',"pooling":"'
  || p_type || '"}}'), 1, 16) AS config_hash FROM part""")
def config_hash(spark, sf):
    h = S.config_hash(F.col("p_brand").alias("backbone"), F.col("p_size").alias("image_size"), F.col("p_type").alias("pooling"))
    return table(spark, sf, "part").select("p_partkey", h.alias("config_hash"))


@query("content_hash", "SELECT doc_id, sha1(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha1(F.encode("text", "UTF-8")).alias("content_hash"))


# ---- joins: items against the requests of the same person on the two days before


cte("open_requests", """SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2000-06-30')
  WHERE rn = 1""")


def open_requests(spark, sf):
    o = table(spark, sf, "orders")
    window = F.col("o_orderdate").between(F.lit("2000-01-01").cast("timestamp_ntz"), F.lit("2000-06-30").cast("timestamp_ntz"))
    return joins.latest_in_window(o, F.col("o_orderdate"), window, ["o_custkey"],
                                  [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])


@query("join_left_order", """SELECT i.item_id, i.person_id, r.o_orderkey, coalesce(r.o_orderpriority, 'UNKNOWN') AS o_orderpriority,
  r.o_orderkey IS NOT NULL AS has_order FROM {items} i LEFT JOIN {open_requests} r ON r.o_custkey = i.person_id""")
def join_left_order(spark, sf):
    """A person's requests are cut to the latest of the window first, so no item is multiplied."""
    side = open_requests(spark, sf).select(F.col("o_custkey").alias("person_id"), "o_orderkey", "o_orderpriority")
    out = joins.left_with_default(items(spark, sf), side, ["person_id"], {"o_orderpriority": "UNKNOWN"}, "has_order")
    return out.select("item_id", "person_id", "o_orderkey", "o_orderpriority", "has_order")


@query("join_left_dim", """SELECT o_orderkey, n_name, r_name, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def join_left_dim(spark, sf):
    """The order keys travel with the small dimensions; customers go by size."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    c = table(spark, sf, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    o = table(spark, sf, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"), "left")
    return o.select("o_orderkey", "n_name", "r_name", "c_mktsegment")


@query("join_inner_composite", """SELECT q.business_date, q.item_id, q.fifo_wait_min, i.unit, i.age_years FROM {queued} q
  JOIN {items} i ON i.business_date = q.business_date AND i.item_id = q.item_id""")
def join_inner_composite(spark, sf):
    left = queued(spark, sf).select("business_date", "item_id", "fifo_wait_min")
    right = items(spark, sf).select("business_date", "item_id", "unit", "age_years")
    return left.join(right, ["business_date", "item_id"])


@query("join_report_study", "SELECT item_id, item_date, report_date, report_ts, finding, truth, round(report_wait_min, 4) AS report_wait_min FROM {fact_report}")
def join_report_study(spark, sf):
    return fact_report(spark, sf).withColumn("report_wait_min", F.round("report_wait_min", 4))


@query("orphans", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphans(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.orphans(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), lines, ["o_orderkey"])


@query("semi_found", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_found(spark, sf):
    return joins.found(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), ["doc_id"])


@query("join_three_way_outcome", """SELECT i.item_id, i.priority, i.probability, r.finding, r.report_ts FROM {scored_items} i
  LEFT JOIN {reports} r ON r.item_id = i.item_id""")
def join_three_way_outcome(spark, sf):
    """Items, their score and their latest report, which come from three tables."""
    facts = items(spark, sf).select("item_id")
    scores = decided(spark, sf).select("item_id", "priority", "probability")
    return facts.join(scores, "item_id", "left").join(reports(spark, sf), "item_id", "left").select(
        "item_id", "priority", "probability", "finding", "report_ts")


@query("key_set_overlap", """SELECT a.lang AS split_a, b.lang AS split_b, count(*) AS shared_keys FROM
  (SELECT DISTINCT lang, source FROM documents) a JOIN (SELECT DISTINCT lang, source FROM documents) b
  ON a.source = b.source AND a.lang < b.lang GROUP BY ALL""")
def key_set_overlap(spark, sf):
    return overlap_pairs(table(spark, sf, "documents"), "lang", "source")


# ---- latest rows and flags


@query("latest_per_key", """SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (
  PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS rn
  FROM lineitem) WHERE rn = 1""")
def latest_per_key(spark, sf):
    order = [F.col(c).desc() for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")]
    return latest.latest_per_key(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], order).select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity")


@query("scd1_current", """SELECT o_custkey, o_orderdate, o_orderkey, o_orderpriority, first_seen FROM (SELECT *, min(o_orderdate) OVER
  (PARTITION BY o_custkey) AS first_seen, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders WHERE o_orderdate <= TIMESTAMP '2000-12-31') WHERE rn = 1""")
def scd1_current(spark, sf):
    upto = table(spark, sf, "orders").where(F.col("o_orderdate") <= F.lit("2000-12-31").cast("timestamp_ntz"))
    return latest.current_per_key(upto, ["o_custkey"], "o_orderdate", ["o_orderdate", "o_orderkey", "o_orderpriority"], "first_seen")


@query("latest_report", "SELECT item_id, report_date, report_ts, finding FROM {reports}")
def latest_report(spark, sf):
    return latest.latest_per_key(signed_reports(spark, sf), ["item_id"], [F.col("report_ts").desc(), F.col("version").desc()]) \
        .select("item_id", "report_date", "report_ts", "finding")


@query("latest_score", """SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)
  AS rn FROM events) WHERE rn = 1""")
def latest_score(spark, sf):
    return latest.latest_per_key(table(spark, sf, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select(
        "user_id", "event_id", "ts", "value")


@query("latest_event", """SELECT user_id, event_type, event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type
  ORDER BY ts DESC, event_id DESC) = 1 THEN 1 ELSE 0 END AS is_latest FROM events""")
def latest_event(spark, sf):
    flagged = latest.flag_latest(table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"),
                                 ["user_id", "event_type"], ["ts"], ["event_id"], "is_latest")
    return flagged.drop("ts")


@query("latest_run", """SELECT business_date, event_id, CASE WHEN row_number() OVER (PARTITION BY business_date ORDER BY ts DESC, event_id DESC) = 1
  THEN 1 ELSE 0 END AS is_final FROM {ev}""")
def latest_run(spark, sf):
    flagged = latest.flag_latest(events(spark, sf).select("business_date", "event_id", "ts"), ["business_date"], ["ts"],
                                 ["event_id"], "is_final")
    return flagged.drop("ts")


@query("latest_stage_status", """SELECT business_date, event_type AS stage, event_id, value FROM (SELECT *, row_number() OVER
  (PARTITION BY business_date, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM {ev}) WHERE rn = 1""")
def latest_stage_status(spark, sf):
    rows = latest.latest_per_key(events(spark, sf), ["business_date", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()])
    return rows.select("business_date", F.col("event_type").alias("stage"), "event_id", "value")


@query("fifo_seq", """SELECT business_date, item_id, row_number() OVER (PARTITION BY business_date ORDER BY arrival, item_id) AS fifo_seq FROM {items}""")
def fifo_seq(spark, sf):
    return numbered(items(spark, sf).select("business_date", "item_id", "arrival"), ["business_date"],
                    [F.col("arrival"), F.col("item_id")], "fifo_seq").drop("arrival")


@query("is_latest_global", """SELECT business_date, event_id, CASE WHEN business_date = (SELECT max(business_date) FROM {ev}) THEN 1 ELSE 0 END
  AS is_latest FROM {ev}""")
def is_latest_global(spark, sf):
    return latest.flag_latest_date(events(spark, sf).select("business_date", "event_id"), "business_date")


@query("is_latest_after_group", """SELECT business_date, event_type, count(*) AS events, CASE WHEN business_date = max(business_date) OVER () THEN 1
  ELSE 0 END AS is_latest FROM {ev} GROUP BY business_date, event_type""")
def is_latest_after_group(spark, sf):
    grouped = events(spark, sf).groupBy("business_date", "event_type").agg(F.count(F.lit(1)).alias("events"))
    newest = events(spark, sf).select(F.max("business_date")).scalar()
    return grouped.withColumn("is_latest", F.when(F.col("business_date") == newest, 1).otherwise(0))


@query("worklist_order", """SELECT business_date, item_id, priority, row_number() OVER (PARTITION BY business_date ORDER BY
  CASE priority WHEN 'P1' THEN 0 WHEN 'P2' THEN 1 WHEN 'P3' THEN 2 WHEN 'NA' THEN 2 ELSE 3 END,
  CASE WHEN priority IN ('P1', 'P2') THEN -probability ELSE 0.0 END, arrival, item_id) AS place FROM {scored_items}""")
def worklist_order(spark, sf):
    rows = scored_items(spark, sf)
    order = [*S.worklist_rank(F.col("priority"), F.col("probability")), F.col("arrival"), F.col("item_id")]
    return numbered(rows, ["business_date"], order, "place").select("business_date", "item_id", "priority", "place")


