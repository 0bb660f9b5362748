"""What a task's Python worker holds, and what it gives back."""

import subprocess
import sys

import pyarrow as pa
from pyspark.sql import functions as F

from worklake.llm.common import kept


def test_batches_of_long_texts_are_small(spark):
    """300 texts of 100,000 characters are 30 MB: one batch by rows, several by bytes. The caller's settings come back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["bytes"])
    docs = spark.range(300, numPartitions=1).select(F.repeat(F.lit("a"), 100_000).alias("text"))
    got = [r["bytes"] for r in kept(docs.mapInArrow(sizes, "bytes long"), "sizes").collect()]
    assert sum(got) > 30_000_000 and max(got) < 6_000_000
    assert spark.conf.get(name) == before


def test_freed_memory_goes_back():
    code = """
import re, numpy as np
from worklake.llm.common import give_back
held = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1])
many = [np.ones(12_000) for _ in range(3000)]  # of 96 KB, on the heap
last = many[-1]  # the top stays in use
del many
before = held()
give_back()
print(before - held())
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert int(out.stdout) > 150_000  # KB
