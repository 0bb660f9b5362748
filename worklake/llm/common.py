"""Registry of the queries, and helpers for batches of whole texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from worklake.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20,
           "spark.sql.parquet.columnarReaderBatchSize": 128}
ROW_GROUP, PAGE = 8 << 20, 256 << 10
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]  # of documents


def query(name: str, sql: str | None = None):
    """Register a query, with SQL for the same rows where SQL can express them."""
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once to the cluster's shared folder and read again: cuts lineage, survives lost executors.

    Whole texts are wide, so while it is written fewer rows make a batch, of the scan (4,096 by default) and for Python (10,000 or 64 MB), and
    row groups are small: each is held at once, some several times over.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = {k: spark.conf.get(k) for k in BATCHES}
    for k, most in BATCHES.items():
        now = before[k].removesuffix("b")  # the default in bytes; one that the caller set in other units stays
        if now.lstrip("-").isdigit():
            spark.conf.set(k, str(min(most, int(now)) if int(now) > 0 else most))
    try:
        df.write.option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE).parquet(path)
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """What this worker has freed goes back to the system. Workers outlive their tasks, and both Arrow and the C library keep freed
    memory, which counts until the worker ends."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def pieces(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` characters each, one text at least. Bounds a step's arrays; no text is cut."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield start, i
            start = i
            held = 0
        held += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of Arrow batches of about `limit` bytes of column text, one row at least; only a part's rows become Python values."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy()
        number = (np.cumsum(sizes + 1) - sizes - 1) // limit if len(sizes) else sizes
        cuts = np.flatnonzero(np.diff(number, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def map_texts(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str,
              limit: int = 4_000_000) -> DataFrame:
    """df through a function from columns (as lists) to columns, over parts of about `limit` bytes of column text.

    make() runs once a task and returns the function; a null text reaches it as "" (and as None in column raw).
    """
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for part in slices(batches, limit):
            fn = fn or make()
            cols = part.to_pydict()
            cols["raw"] = cols["text"]
            cols["text"] = [t or "" for t in cols["raw"]]
            got = fn(cols)
            made = pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)
            del cols, got
            yield made
            del made, part
            give_back()

    return df.mapInArrow(run, schema)
