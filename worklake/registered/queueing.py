"""The work queue in arrival order, live priority and trial priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from worklake.operators.queues import at_time, busy_periods, fifo_slots, readers
from worklake.registered.base import query
from worklake.registered.frames import _M, SHIFT, items, outcomes, queue, queued

_AT = "CAST(business_date AS TIMESTAMP) + INTERVAL 8 HOUR + to_microseconds(CAST({} AS BIGINT))"


@query("queue_fifo", f"""SELECT business_date, item_id, pos, {_AT.replace('{}', 'start_us')} AS starts,
  {_AT.replace('{}', f'start_us + {_M}')} AS ends, round((start_us + {_M} - a) / 60000000.0, 1) AS wait_min FROM {{q_fifo}}""")
def queue_fifo(spark, sf):
    """Arrival order in closed form: two windows, no row leaves the JVM."""
    slots = fifo_slots(items(spark, sf).select("business_date", "item_id", "arrival"), ["business_date"], "business_date",
                       "arrival", "item_id", SHIFT)
    ended = slots.withColumn("end_us", F.col("start_us") + _M)
    return ended.select("business_date", "item_id", "pos", at_time("business_date", "start_us", SHIFT).alias("starts"),
                        at_time("business_date", "end_us", SHIFT).alias("ends"),
                        F.round((F.col("end_us") - F.col("arrival_us")) / F.lit(60000000.0), 1).alias("wait_min"))


@query("queue_busy_periods", f"""SELECT business_date, item_id, sum(is_new) OVER (PARTITION BY business_date ORDER BY pos) AS period FROM (
  SELECT *, CASE WHEN pos = 0 OR greatest(a, 0) > lag(start_us) OVER (PARTITION BY business_date ORDER BY pos) + {_M} THEN 1 ELSE 0 END AS is_new
  FROM {{q_fifo}})""")
def queue_busy_periods(spark, sf):
    return busy_periods(items(spark, sf).select("business_date", "item_id", "arrival"), ["business_date"], "business_date",
                        "arrival", "item_id", SHIFT).select("business_date", "item_id", "period")


@query("queue_triage", f"""SELECT business_date, item_id, {_AT.replace('{}', 'triage_start_us')} AS starts, triage_wait_min FROM {{queued}}""")
def queue_triage(spark, sf):
    return queued(spark, sf).select("business_date", "item_id", at_time("business_date", "triage_start_us", SHIFT).alias("starts"),
                                    "triage_wait_min")


@query("queue_shadow", f"""SELECT business_date, item_id, {_AT.replace('{}', 'shadow_start_us')} AS starts, shadow_wait_min FROM {{queued}}""")
def queue_shadow(spark, sf):
    return queued(spark, sf).select("business_date", "item_id", at_time("business_date", "shadow_start_us", SHIFT).alias("starts"),
                                    "shadow_wait_min")


@query("wait_compare", """SELECT item_id, fifo_wait_min, triage_wait_min, shadow_wait_min, round(fifo_wait_min - triage_wait_min, 1) AS wait_saved_min
  FROM {queued}""")
def wait_compare(spark, sf):
    saved = F.round(F.col("fifo_wait_min") - F.col("triage_wait_min"), 1)
    return queued(spark, sf).select("item_id", "fifo_wait_min", "triage_wait_min", "shadow_wait_min", saved.alias("wait_saved_min"))


@query("slot_reader_id", f"""SELECT business_date, item_id, 'RAD' || lpad(CAST((pos - max(both_free) OVER (PARTITION BY business_date ORDER BY pos)) % 2 + 1 AS VARCHAR), 2, '0') AS reader
  FROM (SELECT *, CASE WHEN pos = 0 OR start_us >= lag(start_us) OVER (PARTITION BY business_date ORDER BY pos) + {_M} THEN pos END AS both_free FROM {{q_fifo}})""")
def slot_reader_id(spark, sf):
    """The first of the shift's readers who is free."""
    slots = readers(items(spark, sf).select("business_date", "item_id", "arrival"), ["business_date"], "business_date",
                    "arrival", "item_id", SHIFT)
    return slots.select("business_date", "item_id",
                        F.concat(F.lit("RAD"), F.lpad((F.col("reader") + 1).cast("string"), 2, "0")).alias("reader"))


@query("triage_seq", """SELECT business_date, item_id, row_number() OVER (PARTITION BY business_date ORDER BY triage_start_us, item_id) AS triage_seq
  FROM {queued}""")
def triage_seq(spark, sf):
    return queue(spark, sf).select("business_date", "item_id", "triage_seq")


@query("outcome_class", "SELECT item_id, priority, finding, outcome FROM {outcomes}")
def outcome_class(spark, sf):
    return outcomes(spark, sf).select("item_id", "priority", "finding", "outcome")
