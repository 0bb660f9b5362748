from worklake.functions.contracts import Contract, Field
from worklake.session import scratch_path
from worklake.streaming.landing import ingest_new_files

ENTITY = Contract("e", "a", (Field("a", required=True), Field("b", "int")))


def test_each_file_is_picked_up_once(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    bronze, quarantine, checkpoint = (scratch_path(spark, n) for n in ("bronze", "quarantine", "progress"))

    def run():
        ingest_new_files(spark, str(landing), ENTITY, bronze, quarantine, checkpoint).awaitTermination()
        return spark.read.parquet(bronze)

    (landing / "one.jsonl").write_text('{"a": "x", "b": 1}\n\n{"a": "y", "b": "no"}\nbroken\n')
    assert [(r["a"], r["_line"]) for r in run().collect()] == [("x", 1)]
    assert {(r["_line"], r["reasons"]) for r in spark.read.parquet(quarantine).collect()} == {
        (3, "b: not a int ('no')"), (4, "invalid JSON")}
    (landing / "two.jsonl").write_text('{"a": "z"}\n')
    assert {r["a"] for r in run().collect()} == {"x", "z"}
    assert {r["a"] for r in run().collect()} == {"x", "z"}  # nothing new: nothing changes
