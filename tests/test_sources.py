from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from worklake.functions.contracts import Contract, Field, annotated, quarantined_rows, reasons, valid_rows
from worklake.session import scratch_path
from worklake.sources import landing, readers, tables

ORDERS = Contract("orders", "a", (Field("a", required=True), Field("b")))


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_psv_with_trailer_and_short_row(spark, tmp_path):
    path = write(tmp_path, "orders.psv", "a|b\n1|2\n\n3\n4|\nT|2\n")
    rows = {r["_line"]: r for r in readers.read_psv(spark, path, ORDERS).collect()}
    assert set(rows) == {2, 4, 5}
    assert (rows[2]["a"], rows[2]["b"], rows[2]["parse_error"]) == ("1", "2", None)
    assert rows[4]["parse_error"] == "1 fields, header has 2" and rows[4]["a"] is None
    t = readers.read_trailers(readers.psv_splits(spark, path, ORDERS)).first()
    assert (t["trailer"], t["data_lines"]) == (2, 3)


def test_jsonl_keeps_bad_lines(spark, tmp_path):
    path = write(tmp_path, "x.jsonl", '{"a": 1, "b": "x"}\n\n[1]\n{bad\n{"a": " "}\n')
    rows = {r["_line"]: r for r in readers.read_jsonl(spark, path, ORDERS).collect()}
    assert {k: r["parse_error"] for k, r in rows.items()} == {
        1: None, 3: "not a JSON object", 4: "invalid JSON", 5: None}
    assert rows[1]["a"] == "1"
    found = annotated(readers.read_jsonl(spark, path, ORDERS), ORDERS, "parse_error")
    assert [r["a"] for r in valid_rows(found, ORDERS).collect()] == ["1"]
    assert sorted(r["reasons"] for r in quarantined_rows(found, ORDERS).collect()) == [
        "a: missing", "invalid JSON", "not a JSON object"]


def test_csv_lines_start_at_two(spark, tmp_path):
    path = write(tmp_path, "p.csv", "a,b\nx,1\ny,2\n")
    assert {(r["_line"], r["a"]) for r in readers.read_csv(spark, path, ORDERS).collect()} == {(2, "x"), (3, "y")}


def test_csv_by_each_files_own_header(spark, tmp_path):
    write(tmp_path, "1.csv", 'b,x,a\n"1, ""one""",2,3\n,,\n"",5,"back\\"slash"\n1,2\n1,2,3,4\n"open,2,3\n')
    write(tmp_path, "2.csv", "a,x\nq,w\n")
    write(tmp_path, "3.csv", "c,d\n1,2\n")
    path = write(tmp_path, "4.csv", "")
    rows = {(r["_source_file"], r["_line"]): (r["a"], r["b"], r["parse_error"]) for r in readers.read_csv(spark, path, ORDERS).collect()}
    assert rows == {
        ("1.csv", 2): ("3", '1, "one"', None), ("1.csv", 3): (None, None, None), ("1.csv", 4): ('back"slash', "", None),
        ("1.csv", 5): (None, None, "2 fields, header has 3"), ("1.csv", 6): (None, None, "4 fields, header has 3"), ("1.csv", 7): ("3", '"open', None),
        ("2.csv", 2): ("q", None, None), ("3.csv", 2): (None, None, "no header")}


def test_headers_and_trailers_across_splits(spark, tmp_path):
    for name, n in (("a.psv", 3000), ("b.psv", 10)):
        path = write(tmp_path, name, "b|a\n" + "".join(f"{i}|row {i}\n" for i in range(2, n + 2)) + f"T|{n}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        splits = readers.psv_splits(spark, path, ORDERS)
        got = readers.read_psv(spark, path, ORDERS, splits)
        assert splits.count() > 5 and got.count() == 3010
        assert got.where("a <> concat('row ', _line) OR b <> _line OR parse_error IS NOT NULL").count() == 0
        t = readers.trailer_totals(readers.read_trailers(splits)).first()
        assert (t["files"], t["agreeing"], t["trailer"], t["data_lines"]) == (2, 2, 3010, 3010)
        moved = splits.withColumn("_first", F.col("_first") + 1)  # as if the files had been cut otherwise
        with pytest.raises(Exception, match="counted otherwise"):
            readers.read_psv(spark, path, ORDERS, moved).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_are_numbered_across_splits(spark, tmp_path):
    path = write(tmp_path, "long.txt", "".join(f"row {i}\n" for i in range(1, 4001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = readers.read_lines(spark, path)
        assert got.where(F.concat(F.lit("row "), F.col("_line")) != F.col("value")).count() == 0
        assert got.count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("field,value,expected", [
    (Field("order_ts", "timestamp", True), "2026-10-01 25:61:00", "order_ts: not a timestamp ('2026-10-01 25:61:00')"),
    (Field("order_ts", "timestamp", True), "2026-10-01 23:59:59", None),
    (Field("d", "date"), "2026-02-30", "d: not a date ('2026-02-30')"),
    (Field("d", "date8"), "20260230", "d: not a date8 ('20260230')"),
    (Field("t", "time6"), "246060", "t: not a time6 ('246060')"),
    (Field("n", "int"), "12x", "n: not a int ('12x')"),
    (Field("n", "int"), " 12 ", None),
    (Field("s", values=("F", "M")), "X", "s: 'X' not in ['F', 'M']"),
    (Field("s", required=True), "  ", "s: missing"),
    (Field("s"), None, None)])
def test_reasons(spark, field, value, expected):
    df = spark.createDataFrame([(value,)], f"`{field.name}` string")
    assert df.select(reasons(Contract("e", field.name, (field,)))).first()[0] == expected


def frame(spark, *rows):
    return spark.createDataFrame([(date.fromisoformat(d), k, v) for d, k, v in rows], "business_date date, k int, v string")


def test_rerun_of_a_date_is_idempotent_and_leaves_others(spark):
    path = scratch_path(spark, "t")
    tables.write_table(frame(spark, ("2024-01-01", 1, "a"), ("2024-01-02", 2, "b")), path)
    again = frame(spark, ("2024-01-02", 3, "c"))
    for _ in range(2):
        tables.replace_partitions(again, path)
    assert {(r["k"], r["v"]) for r in tables.read_table(spark, path).collect()} == {(1, "a"), (3, "c")}
    tables.replace_date(again.where("false"), path, "2024-01-02")
    assert [r["k"] for r in tables.read_table(spark, path).collect()] == [1]


def test_new_column_is_null_in_old_rows(spark):
    path = scratch_path(spark, "t")
    tables.write_table(frame(spark, ("2024-01-01", 1, "a")), path)
    tables.replace_partitions(frame(spark, ("2024-01-02", 2, "b")).drop("v").withColumn("extra", F.lit(9)), path)
    assert {(r["k"], r["v"], r["extra"]) for r in tables.read_table(spark, path).collect()} == {(1, "a", None), (2, None, 9)}


def test_pinned_version(spark):
    path = scratch_path(spark, "t")
    tables.append_version(frame(spark, ("2024-01-01", 1, "a"), ("2024-01-01", 2, "b")), path, 1)
    tables.append_version(frame(spark, ("2024-01-01", 2, "B")), path, 2)
    assert {r["v"] for r in tables.read_pinned(spark, path, 1, ["k"]).collect()} == {"a", "b"}
    assert {r["v"] for r in tables.read_pinned(spark, path, 2, ["k"]).collect()} == {"a", "B"}
    assert [(r["version"], r["rows_added"], r["total_rows"]) for r in
            tables.table_history(spark, path, "t").orderBy("version").collect()] == [(1, 2, 2), (2, 1, 3)]


def test_export_splits_a_large_date_into_whole_files(spark):
    df = spark.range(0, 1000).select(F.lit(date(2024, 1, 1)).alias("business_date"), F.col("id").cast("string").alias("a"),
                                     F.lit("x").alias("b"))
    path, manifest = scratch_path(spark, "land"), scratch_path(spark, "manifest")
    landing.export_psv(df, path, "business_date", "a", ["a", "b"], per_file=300)
    landing.write_manifest(df, manifest, "s", "business_date")
    got = readers.read_psv(spark, path, ORDERS)
    assert got.where("parse_error is null").select("a").distinct().count() == 1000
    trailers = readers.read_trailers(readers.psv_splits(spark, path, ORDERS)).collect()
    assert len(trailers) == 4 and all(t["trailer"] == t["data_lines"] for t in trailers)
    assert landing.read_manifest(spark, manifest).first()["records"] == 1000


def test_table_without_schema_note_is_read_as_it_is(spark):
    path = scratch_path(spark, "log")
    assert not tables.exists(spark, path)
    tables.append_log(frame(spark, ("2024-01-01", 1, "a")), path)
    assert tables.exists(spark, path) and tables.read_table(spark, path).count() == 1


def test_trailers_of_files_wrong_in_opposite_ways(spark):
    trailers = spark.createDataFrame([("a", 1, 2), ("b", 2, 1), ("c", None, 3), ("d", 4, 4)], "_path string, trailer long, data_lines long")
    t = readers.trailer_totals(trailers).first()
    assert (t["files"], t["agreeing"]) == (4, 1)
