"""Tables partitioned by business date: replace dates, replace keys, append, evolve, pin a version.

Plain Parquet paths. With an Iceberg catalog configured, overwritePartitions and VERSION AS OF do the same
behind these names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from worklake.operators.latest import latest_per_key
from worklake.session import materialize

DAY = "business_date"


def _columns(by: str | list[str]) -> list[str]:
    return [by] if isinstance(by, str) else by


def _schema_path(path: str) -> str:
    return f"{path.rstrip('/')}.schema"


def table_schema(spark: SparkSession, path: str) -> StructType | None:
    """The schema noted beside the table; None when there is no table. Merging the footers of all files
    instead would read every one of them."""
    try:
        return StructType.fromJson(json.loads(spark.read.text(_schema_path(path), wholetext=True).first()[0]))
    except AnalysisException:
        return None


def _note_schema(spark: SparkSession, path: str, schema: StructType) -> None:
    spark.createDataFrame([(schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(_schema_path(path))


def write_table(df: DataFrame, path: str, by: str | list[str] = DAY) -> None:
    """Write by date. REBALANCE lets AQE split a date that is too big for a task and join small ones."""
    df.hint("rebalance", *_columns(by)).write.partitionBy(*_columns(by)).mode("overwrite").parquet(path)
    _note_schema(df.sparkSession, path, df.schema)


def read_table(spark: SparkSession, path: str, dates: Column | None = None) -> DataFrame:
    """The table, or the dates that match; a condition on the partition column prunes directories. Files
    written before a column was added read it as NULL."""
    schema = table_schema(spark, path)
    df = spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    return df if dates is None else df.where(dates)


def align_schema(df: DataFrame, target) -> DataFrame:
    """df in the target's column order: missing columns as typed NULL, columns new to the target last."""
    have = {c.lower(): c for c in df.columns}
    wanted = {f.name.lower() for f in target.fields}
    return df.select(
        *[F.col(have[f.name.lower()]).alias(f.name) if f.name.lower() in have
          else F.lit(None).cast(f.dataType).alias(f.name) for f in target.fields],
        *[c for c in df.columns if c.lower() not in wanted])


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename a legacy column, only where the new name is not there yet."""
    return df.withColumnRenamed(old, new) if old in df.columns and new not in df.columns else df


def exists(spark: SparkSession, path: str) -> bool:
    if table_schema(spark, path) is not None:
        return True
    try:
        spark.read.parquet(path)  # a log, written by append only
        return True
    except AnalysisException:
        return False


def replace_partitions(df: DataFrame, path: str, by: str | list[str] = DAY) -> None:
    """Replace exactly the dates present in df, the others stay; columns new in df are added to the table. The
    first write creates it."""
    target = table_schema(df.sparkSession, path)
    if target is None:
        return write_table(df, path, by)
    aligned = align_schema(df, target)
    if len(aligned.columns) > len(target):
        _note_schema(df.sparkSession, path, aligned.schema)
    (aligned.hint("rebalance", *_columns(by)).write.partitionBy(*_columns(by)).mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").parquet(path))


def clear_partition(spark: SparkSession, path: str, schema, value: str, by: str = DAY) -> None:
    """A re-run without rows removes the date's old rows: overwrite of one named partition with nothing."""
    name = f"worklake_{uuid.uuid4().hex[:12]}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY ({by}) LOCATION '{path}'")
    try:
        empty = spark.createDataFrame([], schema)
        view = f"{name}_none"
        empty.drop(by).createOrReplaceTempView(view)
        spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION ({by} = DATE '{value}') SELECT * FROM {view}")
        spark.catalog.dropTempView(view)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def replace_dates(df: DataFrame, path: str, dates: list[str], by: str = DAY, **counted: Column) -> dict[str, int]:
    """A re-run of dates: their rows are replaced, or removed where there are none any more. Returns the aggregates `counted` (name=Column)
    of what was written. The written dates are read back for both, by the columns asked for; df is computed once."""
    spark = df.sparkSession
    new = materialize(df, "new-rows")
    rows = [F.count_if(F.col(by).cast("date") == F.lit(d).cast("date")).alias(f"_{i}") for i, d in enumerate(dates)]
    got = new.agg(*rows, *[c.alias(n) for n, c in counted.items()]).first()
    was_there = exists(spark, path)
    if any(got[f"_{i}"] for i in range(len(dates))) or not was_there:
        replace_partitions(new, path, by)
    for i, d in enumerate(dates):
        if was_there and not got[f"_{i}"]:
            clear_partition(spark, path, table_schema(spark, path), d, by)
    return {n: got[n] for n in counted}


def replace_date(df: DataFrame, path: str, date: str, by: str = DAY, **counted: Column) -> dict[str, int]:
    return replace_dates(df, path, [date], by, **counted)


def overwrite_text(df: DataFrame, path: str, by: str = DAY, part: str = "_part") -> None:
    """The text extract's folders of the dates in df written anew, as one part each; all other folders stay."""
    df.withColumn(part, F.lit(0)).hint("rebalance", by).write.partitionBy(by, part).mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").text(path)


def replace_current(df: DataFrame, path: str) -> None:
    """A table of the present state, without a history by date, written anew from other tables."""
    df.write.mode("overwrite").parquet(path)
    _note_schema(df.sparkSession, path, df.schema)


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table after every key in new has replaced its old rows. To be written to a new path: reading and
    overwriting one path loses data."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_table(df: DataFrame, root: str) -> str:
    """Rebuild a whole table in a fresh directory under root and return it; readers of the old one are not
    disturbed."""
    path = f"{root}/v-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return path


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_version(df: DataFrame, path: str, version: int) -> None:
    df.withColumn("_version", F.lit(version)).write.partitionBy("_version").mode("append").parquet(path)


def read_pinned(spark: SparkSession, path: str, version: int, keys: list[str]) -> DataFrame:
    """The table as a run saw it: the newest row per key among versions up to the one it recorded. Later
    versions are pruned as directories."""
    rows = spark.read.parquet(path).where(F.col("_version") <= version)
    return latest_per_key(rows, keys, [F.col("_version").desc()])


def table_history(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Per commit: rows added and the running total. One row per commit takes part in the window."""
    commits = spark.read.parquet(path).groupBy("_version").agg(F.count(F.lit(1)).alias("rows_added")) \
        .withColumn("table_name", F.lit(table))
    upto = Window.partitionBy("table_name").orderBy("_version").rowsBetween(Window.unboundedPreceding, 0)
    return commits.select("table_name", F.col("_version").cast("int").alias("version"), "rows_added",
                          F.sum("rows_added").over(upto).alias("total_rows"))
