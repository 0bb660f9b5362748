"""Writing a date's extract with its manifest, and checking what arrived against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from worklake.operators.recon import recon_status
from worklake.session import materialize

# Records per extract file, so that no file (and no task) takes more than its share of a large date.
RECORDS_PER_FILE = 500_000


def _spread(df: DataFrame, date: str, key: str, per_file: int) -> DataFrame:
    """_part: number of the file of its date a record goes to. Dates with more records get more files."""
    sizes = df.groupBy(date).agg(F.ceil(F.count(F.lit(1)) / per_file).alias("_files")).withColumnRenamed(date, "_date")
    return df.join(sizes, F.col(date) == F.col("_date")).withColumn(
        "_part", F.pmod(F.xxhash64(key), F.col("_files")).cast("int")).drop("_date", "_files")


def export_psv(df: DataFrame, path: str, date: str, key: str, columns: list[str],
               per_file: int = RECORDS_PER_FILE) -> None:
    """<path>/<date>/<part>: header, records, trailer T|n. Every file stands for itself."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows = _spread(df, date, key, per_file).select(date, "_part", F.lit(1).alias("_kind"), text.alias("value"))
    frame = rows.groupBy(date, "_part").agg(F.count(F.lit(1)).alias("n")).select(date, "_part", F.inline(F.array(
        F.struct(F.lit(0).alias("_kind"), F.lit("|".join(columns)).alias("value")),
        F.struct(F.lit(2).alias("_kind"), F.concat(F.lit("T|"), F.col("n").cast("string")).alias("value")))))
    (rows.unionByName(frame).repartition(F.col(date), F.col("_part"))
         .sortWithinPartitions(date, "_part", "_kind").drop("_kind")
         .write.partitionBy(date, "_part").mode("overwrite").text(path))


def export_jsonl(df: DataFrame, path: str, date: str, key: str, columns: list[str],
                 per_file: int = RECORDS_PER_FILE) -> None:
    text = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]))
    (_spread(df, date, key, per_file).select(date, "_part", text.alias("value"))
     .repartition(F.col(date), F.col("_part")).write.partitionBy(date, "_part").mode("overwrite").text(path))


def export_csv(df: DataFrame, path: str, date: str, key: str, columns: list[str],
               per_file: int = RECORDS_PER_FILE) -> None:
    (_spread(df, date, key, per_file).select(date, "_part", *[F.col(c).cast("string").alias(c) for c in columns])
     .repartition(F.col(date), F.col("_part")).write.partitionBy(date, "_part").mode("overwrite")
     .option("header", True).csv(path))


def write_manifest(df: DataFrame, path: str, source: str, date: str) -> None:
    """One manifest record per date: the source's own count."""
    (df.groupBy(date).agg(F.count(F.lit(1)).alias("records"))
       .select(F.lit(source).alias("source"), F.col(date).cast("string").alias("business_date"), "records")
       .write.mode("overwrite").json(path))


def export_with_manifest(export, df: DataFrame, path: str, manifest: str, source: str, date: str, key: str, columns: list[str]) -> int:
    """Writes the extract by `export`, then the manifest. The rows are observed while the extract is written; a manifest that counts
    others is not written."""
    seen = Observation()
    export(df.observe(seen, F.count(F.lit(1)).alias("rows")), path, date, key, columns)
    per_date = materialize(df.groupBy(date).agg(F.count(F.lit(1)).alias("records")), "manifest")
    counted = per_date.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    written = seen.get["rows"] if counted else 0  # nothing is observed where there are no rows
    if counted != written:
        raise RuntimeError(f"{source}: {written} records written, {counted} in the manifest")
    per_date.select(F.lit(source).alias("source"), F.col(date).cast("string").alias("business_date"), "records").write.mode("overwrite").json(manifest)
    return written


def records_received(spark: SparkSession, path: str) -> DataFrame:
    """business_date, received: the records that lie under path/business_date=.../, one a line, blank lines aside."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("path"))
    day = F.regexp_extract("path", r"/business_date=([^/]+)/", 1).cast("date")
    return lines.where("value <> ''").groupBy(day.alias("business_date")).agg(F.count(F.lit(1)).alias("received"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("source string, business_date date, records bigint").json(path)


def manifest_check(manifest: DataFrame, received: DataFrame, explained: Column | bool = False) -> DataFrame:
    """Per date: the manifest's count against the records read; a date without a file has 0 received."""
    both = manifest.join(received, "business_date", "left")
    actual = F.coalesce("received", F.lit(0))
    return both.select("business_date", F.col("records").alias("expected"), actual.alias("actual"),
                       recon_status(F.col("records"), actual, 0.0, explained).alias("status"))
