"""Secret scans with an incremental ledger of blobs: every version of a text has its content's address, and only what is new is scanned.

The history (any columns and `text`) gets a column `blob`, the SHA-256 of the text. The ledger is a table of (blob, rule, version,
spans) in a shared folder. Pairs of a blob and a rule's version that the ledger lacks are scanned, each blob's text once however many
paths and versions hold it, and appended; a rule whose version rises is scanned again, the others are not. Findings are joined back to
all rows of the history by the blob.

Texts travel by their address: copies collapse before the shuffle, so a large group of copies is one text a task. The join back is salted.
Null text: empty. Null ids and repeated rows: each row by itself. Very long texts are scanned whole, in linear time. No rows: no rows.
Positions are code points, ends are exclusive; spans of different rules may overlap.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklake.llm.common import kept, map_texts, query, table
from worklake.session import scratch_path

SALTS = 16
LEDGER = "blob binary, rule string, version int, spans array<struct<start:int,stop:int>>"


class Rule(NamedTuple):
    name: str
    version: int  # to be raised with every change of the pattern or the check
    pattern: re.Pattern
    valid: Callable[[re.Match], bool]


def _case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def _any(m: re.Match) -> bool:
    return True


# The base patterns as the contract gives them; runs of hex digits are asked for by their least length at once.
ASSIGN = rf"({_case('password|passwd|secret|token|api_?key')})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = (
    Rule("assign", 1, re.compile(ASSIGN), lambda m: m.end(2) - m.start(2) >= 6),
    Rule("access", 1, re.compile(r"AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= 20),
    Rule("hex", 1, re.compile(r"[0-9a-f]{24,}+"), _any),
)
# Public forms of credentials.
MORE = (
    Rule("prefixed", 1, re.compile(r"(?<![A-Za-z0-9_-])(?:gh[oprsu]_|github_pat_|glpat-|hf_|xox[abprs]-|sk-|AIza|npm_|pypi-)[A-Za-z0-9_-]{16,}+"), _any),
    Rule("jwt", 1, re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"), _any),
    Rule("bearer", 1, re.compile(rf"(?<![A-Za-z]){_case('bearer')} [A-Za-z0-9+/_.=-]{{16,}}+"), _any),
    Rule("pem", 1, re.compile(r"-----BEGIN (?:[A-Z]{2,10} ){0,3}PRIVATE KEY-----"), _any),
)
RULES = BASE + MORE


def spans_of(rule: Rule, text: str) -> list[dict[str, int]]:
    """Leftmost non-overlapping matches; one that isn't valid is left out and not tried again."""
    return [{"start": m.start(), "stop": m.end()} for m in rule.pattern.finditer(text) if rule.valid(m)]


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at path, one row for each blob, rule and version; an empty one is begun where there is none."""
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def addressed(history: DataFrame) -> DataFrame:
    """The history without its texts, but with their addresses."""
    rows = history.withColumn("blob", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    return kept(rows.drop("text"), "secret-paths")


def unseen(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, rules: the names of the rules under whose present version the ledger doesn't hold the blob."""
    every = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules))
    pairs = paths.select("blob").distinct().select("blob", F.explode(every).alias("p")).select("blob", "p.rule", "p.version")
    lacking = pairs.join(ledger.select("blob", "rule", "version"), ["blob", "rule", "version"], "left_anti")
    return lacking.groupBy("blob").agg(F.sort_array(F.collect_list("rule")).alias("rules"))


def scan(history: DataFrame, lacking: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows for the ledger: each lacking blob's text scanned once by its rules."""
    named = {r.name: r for r in rules}
    blob = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob")
    texts = history.select(blob, "text").dropDuplicates(["blob"]).join(lacking, "blob")

    def make():
        def fn(cols):
            out: dict[str, list] = {c: [] for c in ("blob", "rule", "version", "spans")}
            for address, text, names in zip(cols["blob"], cols["text"], cols["rules"]):
                for name in names:
                    out["blob"].append(address)
                    out["rule"].append(name)
                    out["version"].append(named[name].version)
                    out["spans"].append(spans_of(named[name], text))
            return out
        return fn
    return map_texts(texts, make, LEDGER)


def update(history: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Brings the ledger at path up to the history and the rules. Returns the history's rows with blob, without texts."""
    paths = addressed(history)
    lacking = kept(unseen(paths, read_ledger(history.sparkSession, path), rules), "secret-unseen")
    scan(history, lacking, rules).write.mode("append").parquet(path)
    return paths


def findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """paths with found: array of (start, kind, stop, rule) by start and rule, of the blob of each row. kind is the rule's number."""
    present = F.array(*(F.concat_ws(":", F.lit(r.name), F.lit(r.version)) for r in rules))
    number = F.array_position(present, F.concat_ws(":", "rule", "version")).cast("int")
    hits = ledger.where(F.size("spans") > 0).withColumn("kind", number).where("kind > 0")
    hits = hits.groupBy("blob", "kind").agg(F.any_value("spans").alias("spans"), F.any_value("rule").alias("rule"))  # a pair written twice
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("kind"), s["stop"].alias("stop"), F.col("rule")))
    hits = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(spans))).alias("found"))
    hits = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = paths.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    return salted.join(hits, ["blob", "salt"], "left").drop("salt").withColumn("found", F.coalesce("found", F.expr("array()")))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"], s["stop"])), ",")


def detect(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans of every document, through the ledger at path (a new one by default)."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "secret-ledger")
    found = findings(update(docs.select("doc_id", "text"), path), read_ledger(spark, path))

    def base(kind: int) -> Column:
        return F.filter("found", lambda s: s["kind"] == kind + 1)
    counts = [F.size(base(k)).cast("long").alias(f"n_{r.name}") for k, r in enumerate(BASE)]
    strict = F.filter("found", lambda s: s["kind"] <= len(BASE))
    return found.select("doc_id", *counts, F.sha2(_text(strict), 256).alias("base_sha256"), _text(F.col("found")).alias("spans"))


@query("op13_secret_scan")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
