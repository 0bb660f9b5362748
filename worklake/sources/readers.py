"""Readers of source extracts that keep file name and line number and never drop a bad line.

All return _path, _source_file, _line, parse_error and the contract's fields as strings. An extract is scanned for a small table of its
splits (lines, first line, trailer, header), which is kept, and parsed in one more scan that takes the line's place from that table; no
line is written or moved. A line whose place doesn't fit its split (Spark cut the files otherwise the second time) fails the job.
Pipe-separated and comma-separated files are parsed by position and mapped to the contract's names through each file's own header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklake.functions.contracts import Contract
from worklake.session import materialize

TRAILER = "T|"
# One field of a comma-separated line, its comma before it: quoted (a quote inside is doubled or has a backslash), or bare.
_FIELD = r',(?:"(?:[^"\\]++|\\.|"")*+"(?=,|$)|[^,]*)'


def placed_lines(lines: DataFrame) -> DataFrame:
    """value with its file, split and order, of a text source (batch or stream)."""
    return lines.select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("_source_file"),
                        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_seq"))


def _text(spark: SparkSession, path: str) -> DataFrame:
    return placed_lines(spark.read.option("recursiveFileLookup", True).text(path))


def psv_fields(value: Column) -> Column:
    return F.split(value, r"\|")


def csv_fields(value: Column) -> Column:
    """Fields of a comma-separated line; a bare empty field is NULL, a quoted one is empty."""
    found = F.regexp_extract_all(F.concat(F.lit(","), value), F.lit(_FIELD), F.lit(0))

    def plain(f: Column) -> Column:
        f = F.substr(f, F.lit(2))
        inner = F.regexp_replace(F.substr(f, F.lit(2), F.length(f) - 2), r'\\(.)|"(")', "$1$2")
        quoted = F.startswith(f, F.lit('"')) & F.endswith(f, F.lit('"')) & (F.length(f) > 1)
        return F.when(quoted, inner).when(f != "", f)
    return F.transform(found, plain)


def split_table(placed: DataFrame, fields=None, contract: Contract | None = None) -> DataFrame:
    """A row for each split, stored: _n lines, _first place, _offset lines of the file before it; trailer and data_lines of the split.

    With fields and contract also the file's _header: its first line, if that names a field of the contract; else NULL.
    """
    is_trailer = F.startswith("value", F.lit(TRAILER))
    bare = (F.col("value") == "") | is_trailer
    count = F.get(psv_fields(F.col("value")), F.lit(1)).try_cast("bigint")
    aggs = [F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"), F.max(F.when(is_trailer, count)).alias("trailer"),
            F.count_if(~bare).alias("data_lines"), F.min(F.when(~bare, F.col("_seq"))).alias("_first_data")]
    if contract is not None:
        # few lines name a field; only those at the head of a file are looked at further
        names = fields(F.col("value"))
        is_header = (F.col("_block") == 0) & F.arrays_overlap(names, F.array(*[F.lit(n) for n in contract.names]))
        aggs.append(F.array_min(F.collect_list(F.when(is_header, F.struct("_seq", "value")))).alias("_head"))
    found = placed.groupBy("_path", "_source_file", "_block").agg(*aggs)
    of_file = Window.partitionBy("_path")  # a row for each split of the file
    before = of_file.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    out = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")]
    if contract is not None:
        first = F.min(F.struct("_block", "_first")).over(of_file)
        head = F.max(F.when((F.col("_block") == first["_block"]) & (F.col("_head._seq") == first["_first"]), F.col("_head.value"))).over(of_file)
        out.append(fields(head).alias("_header"))
    return materialize(found.select("_path", "_source_file", "_block", "_n", "_first", "_first_data", "trailer", "data_lines", *out), "splits")


def numbered_lines(placed: DataFrame, splits: DataFrame, *more: str) -> DataFrame:
    """placed with _line, and the columns `more` of its split."""
    at = splits.select("_path", "_block", "_n", "_first", "_offset", *more)
    place = F.col("_seq") - F.col("_first")
    right = (place >= 0) & (place < F.col("_n"))
    line = F.when(right, F.col("_offset") + place + 1).otherwise(
        F.raise_error(F.concat(F.lit("lines counted otherwise before: "), "_path")).cast("bigint"))
    return placed.join(at, ["_path", "_block"], "left").withColumn("_line", line).drop("_block", "_seq", "_n", "_first", "_offset")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, _path, _source_file, _line of every line, blank ones included."""
    return numbered_lines(_text(spark, path), split_table(_text(spark, path)))


def read_jsonl(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """One object per line; a line that is no JSON, or JSON but no object, becomes an error row."""
    return parse_json_lines(read_lines(spark, path), contract)


def parse_json_lines(lines: DataFrame, contract: Contract) -> DataFrame:
    parsed = F.try_parse_json("value")
    error = (F.when(parsed.isNull(), "invalid JSON")
              .when(~F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), "not a JSON object"))
    record = F.from_json("value", "map<string,string>")
    known = lines.where(F.trim("value") != "").select("_path", "_source_file", "_line", error.alias("parse_error"), record.alias("_r"))
    return known.select("_path", "_source_file", "_line", "parse_error",
                        *[F.when(F.col("parse_error").isNull(), F.col("_r")[n]).alias(n) for n in contract.names])


def _by_header(lines: DataFrame, fields, contract: Contract) -> DataFrame:
    """The contract's fields of each line by its file's own header. A line with another number of fields than the header, or below a first
    line that names none of them, becomes an error row; a field the header lacks is NULL, one the contract lacks is left out."""
    rows = lines.withColumn("_parts", fields(F.col("value")))
    fits = F.size("_parts") == F.size("_header")
    error = (F.when(F.col("_header").isNull(), "no header").when(~fits, F.concat(
        F.size("_parts").cast("string"), F.lit(" fields, header has "), F.size("_header").cast("string"))))
    at = lambda n: F.get("_parts", F.array_position("_header", n).cast("int") - 1)
    return rows.select("_path", "_source_file", "_line", error.alias("parse_error"),
                       *[F.when(fits & F.array_contains("_header", n), at(n)).alias(n) for n in contract.names])


def psv_splits(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    return split_table(_text(spark, path), psv_fields, contract)


def read_psv(spark: SparkSession, path: str, contract: Contract, splits: DataFrame | None = None) -> DataFrame:
    """Header line, fields separated by '|', a trailer T|n. splits: what psv_splits gave, to be shared with read_trailers."""
    splits = psv_splits(spark, path, contract) if splits is None else splits
    lines = numbered_lines(_text(spark, path), splits, "_header")
    return _by_header(lines.where((F.col("_line") > 1) & (F.col("value") != "") & ~F.startswith("value", F.lit(TRAILER))), psv_fields, contract)


def read_trailers(splits: DataFrame) -> DataFrame:
    """Per file, from its splits: trailer (its count) and data_lines (what is there, the header line aside)."""
    heads = F.count_if((F.col("_offset") == 0) & (F.col("_first_data") == F.col("_first")) & (F.col("_n") > 0))
    return splits.groupBy("_path", "_source_file").agg(F.max("trailer").alias("trailer"), (F.sum("data_lines") - heads).alias("data_lines"))


def trailer_totals(trailers: DataFrame) -> DataFrame:
    """One row: files, those whose own trailer says what is in them (agreeing), and both sums. A file without a trailer doesn't agree."""
    agrees = F.coalesce(F.col("trailer") == F.col("data_lines"), F.lit(False))
    return trailers.agg(F.count(F.lit(1)).alias("files"), F.count_if(agrees).alias("agreeing"), F.sum("trailer").alias("trailer"),
                        F.sum("data_lines").alias("data_lines"))


def read_csv(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """CSV with a header line, a record per line; the first record is on line 2."""
    lines = numbered_lines(_text(spark, path), split_table(_text(spark, path), csv_fields, contract), "_header")
    return _by_header(lines.where((F.col("_line") > 1) & (F.col("value") != "")), csv_fields, contract)


def discover(spark: SparkSession, path: str, suffixes: list[str], with_content: bool = False) -> DataFrame:
    """Files under path by suffix: name, label and split taken from the directory names, length, content hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    keep = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*suffixes)
    out = files.where(keep).select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"),
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("label_name"),
        F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1).alias("source_split"), "length",
        *([F.sha1("content").alias("content_hash")] if with_content else []))
    return out
