"""Incremental bronze: every landed file is picked up once, whenever it arrives, by the same contract.

The daily run reads a date's folder; this reads what is new since the last trigger. Each micro-batch is
written under its own number and a repeated batch overwrites itself, so a restart neither loses nor doubles
records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from worklake.functions.contracts import Contract, annotated, quarantined_rows, valid_rows
from worklake.session import materialize
from worklake.sources import readers


def _write_batch(rows: DataFrame, path: str, batch: int) -> None:
    rows.withColumn("_batch", F.lit(batch)).write.partitionBy("_batch").mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").parquet(path)


def ingest_new_files(spark: SparkSession, landing: str, contract: Contract, bronze: str, quarantine: str,
                     checkpoint: str) -> StreamingQuery:
    """Start a run over all JSON-lines files that are new under landing; it ends when they are done."""
    lines = spark.readStream.option("recursiveFileLookup", True).text(landing).select("value", "_metadata")

    def batch(df: DataFrame, number: int) -> None:
        placed = readers.placed_lines(df)
        numbered = readers.numbered_lines(placed, readers.split_table(placed))
        found = annotated(readers.parse_json_lines(numbered, contract), contract, "parse_error")
        found = materialize(found, "annotated")
        keep = ["_source_file", "_line"]
        _write_batch(valid_rows(found, contract, keep), bronze, number)
        _write_batch(quarantined_rows(found, contract, keep), quarantine, number)

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
