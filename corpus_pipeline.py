"""The corpus pipeline: documents in a known language, without near copies, without personal data, mixed by source, as tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from worklake.llm import bpe, jaccard, langid, mixture, pii
from worklake.llm.common import kept, table

STAGES = [("language", langid.stage), ("near_copies", jaccard.stage), ("personal_data", pii.stage), ("mixture", mixture.stage), ("tokens", bpe.stage)]

ORACLE_SQL = None  # profiles, EM and tokenizers have no SQL; tests/llm compares with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
