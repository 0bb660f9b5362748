"""Session-level settings: where shared intermediate tables go, and how many rows a piece of an ordered scan takes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows that one task of an ordered scan, or of a grouped match, is to take.
PIECE_ROWS = "spark.worklake.pieceRows"
DEFAULT_PIECE_ROWS = 1_000_000

_local_scratch: str | None = None


def piece_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(PIECE_ROWS, str(DEFAULT_PIECE_ROWS)))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temp folder only in local mode."""
    global _local_scratch
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_scratch


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/worklake/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_rows(df: DataFrame, name: str = "step") -> tuple[DataFrame, int]:
    """materialize, and the number of rows, which the files' footers tell."""
    stored = materialize(df, name)
    return stored, stored.count()
