"""Feature rows: splits, samples, data checks, array statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from worklake.functions import arrays as A
from worklake.functions import scalars as S
from worklake.operators import sampling as P
from worklake.operators.latest import top_per_group
from worklake.operators.quantiles import exact_quantiles
from worklake.operators.training import assemble_inputs
from worklake.registered.base import cte, query, table
from worklake.registered.frames import items, sql_hash

# Kinds of degraded copies.
KINDS = ["blur", "underexposed", "overexposed", "noise", "cropped", "rotated", "inverted"]
SPLITS, SEED = ["train", "val", "test"], 42

cte("films", f"""SELECT d.doc_id, d.source, d.lang, d.n_chars, coalesce(l.quality, 0) AS label, l.doc_id IS NOT NULL AS readable,
  sha1(d.text) AS content_hash, CASE WHEN d.lang = 'de' THEN 'test' WHEN {sql_hash("'42:' || d.source")} < 0.15 THEN 'val' ELSE 'train' END AS split
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")


def films(spark, sf):
    """Documents as feature rows: one language is the published hold-out, the rest is split by source."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", F.sha1(F.encode("text", "UTF-8")).alias("content_hash"))
    marks = table(spark, sf, "labels").select("doc_id", "quality", F.lit(True).alias("readable"))
    split = P.group_split(F.col("source"), SEED, 0.15, F.col("lang") == "de")
    return docs.join(marks, "doc_id", "left").select(
        "doc_id", "source", "lang", "n_chars", F.coalesce("quality", F.lit(0)).alias("label"),
        F.coalesce("readable", F.lit(False)).alias("readable"), "content_hash", split.alias("split"))


@query("group_split", "SELECT doc_id, source, split FROM {films}")
def group_split(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", "source", P.group_split(F.col("source"), SEED, 0.15, F.col("lang") == "de").alias("split"))


@query("head_per_group", """SELECT doc_id, source, label FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY label DESC, n_chars, doc_id) AS rn
  FROM {films}) WHERE rn <= 5""")
def head_per_group(spark, sf):
    """At most five rows per source, positives first, then the shortest."""
    return top_per_group(films(spark, sf), ["source"], [F.col("label").desc(), F.col("n_chars"), F.col("doc_id")], 5).select(
        "doc_id", "source", "label")


@query("stratified_sample", """SELECT doc_id, split, lang FROM (SELECT *, row_number() OVER (PARTITION BY split, lang ORDER BY md5('42:' || doc_id), doc_id) AS rn
  FROM {films}) WHERE rn <= CASE split WHEN 'train' THEN 40 WHEN 'val' THEN 10 ELSE 20 END""")
def stratified_sample(spark, sf):
    return P.stratified_sample(films(spark, sf), "split", "lang", "doc_id", {"train": 120, "val": 30, "test": 60}, 3, SEED).select(
        "doc_id", "split", "lang")


cte("bal_pos", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM {films}
  WHERE label = 1) WHERE rn <= 30""")
cte("bal_neg", """SELECT f.*, n.near, sum(CASE WHEN n.near THEN 1 ELSE 0 END) OVER (PARTITION BY f.split) AS n_near,
  3 * (SELECT count(*) FROM {bal_pos} p WHERE p.split = f.split) AS want FROM {films} f JOIN (SELECT x.doc_id, EXISTS (SELECT 1 FROM {bal_pos} p
  WHERE p.split = x.split AND p.source = x.source) AS near FROM {films} x) n ON n.doc_id = f.doc_id WHERE f.label = 0""")


@query("balanced_sample", """SELECT doc_id, split, label FROM {bal_pos} UNION ALL SELECT doc_id, split, label FROM (SELECT *, row_number() OVER (
  PARTITION BY split ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM {bal_neg} WHERE near OR n_near < want) WHERE rn <= want""")
def balanced_sample(spark, sf):
    return P.balanced_sample(films(spark, sf), "split", "label", "source", "doc_id", 30, 3, SEED).select("doc_id", "split", "label")


@query("range_filter_ages", "SELECT item_id, age_years FROM {items} WHERE age_years BETWEEN 18 AND 95")
def range_filter_ages(spark, sf):
    return items(spark, sf).where(F.col("age_years").between(18, 95)).select("item_id", "age_years")


@query("label_recode", """SELECT p_partkey, CASE WHEN p_name LIKE '%widget%' THEN 'WIDGET' WHEN p_size < 5 THEN 'NORMAL' ELSE 'OTHER' END AS recoded FROM part""")
def label_recode(spark, sf):
    words = F.split("p_name", " ")
    labels = S.label_text(F.when(F.col("p_size") < 5, F.array().cast("array<string>")).otherwise(words), "No Finding")
    return table(spark, sf, "part").select("p_partkey", S.label_recode(
        S.label_flag(words, "widget"), labels, "WIDGET", "No Finding").alias("recoded"))


_kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"


@query("augment_union", f"""SELECT doc_id, split, 'none' AS degradation, 0 AS label FROM {{films}} UNION ALL
  SELECT doc_id, split, {_kinds}[CAST(floor({sql_hash("'42:kind:' || doc_id")} * 7) AS INTEGER) + 1], 1 FROM {{films}}""")
def augment_union(spark, sf):
    return P.augment_union(films(spark, sf).select("doc_id", "split"), "doc_id", SEED, KINDS)


@query("check_leakage", """SELECT 'no group in both train and val' AS check_name, 'critical' AS severity, count(*) = 0 AS passed, count(*) AS observed FROM (
  SELECT source FROM {films} WHERE split = 'train' INTERSECT SELECT source FROM {films} WHERE split = 'val')""")
def check_leakage(spark, sf):
    return P.check_row("no group in both train and val", "critical", P.keys_in_both(films(spark, sf), "split", "source", "train", "val"))


@query("check_empty_class", """SELECT 'every split has both classes' AS check_name, 'critical' AS severity, count(*) = 0 AS passed, count(*) AS observed FROM (
  SELECT s.split, c.label, count(f.doc_id) AS n FROM (VALUES ('train'), ('val'), ('test')) s(split) CROSS JOIN (VALUES (0), (1)) c(label)
  LEFT JOIN {films} f ON f.split = s.split AND f.label = c.label GROUP BY ALL) WHERE n = 0""")
def check_empty_class(spark, sf):
    empty = P.empty_classes(films(spark, sf), "split", "label", SPLITS, [0, 1])
    return P.check_row("every split has both classes", "critical", empty.agg(F.count(F.lit(1)).alias("observed")))


@query("check_unreadable", """SELECT 'all files readable' AS check_name, 'warning' AS severity, count(*) = 0 AS passed, count(*) AS observed FROM {films}
  WHERE NOT readable""")
def check_unreadable(spark, sf):
    return P.check_row("all files readable", "warning", films(spark, sf).agg(F.count_if(~F.col("readable")).alias("observed")))


@query("check_dup_content", """SELECT 'no identical content in two splits' AS check_name, 'warning' AS severity, count(*) = 0 AS passed, count(*) AS observed FROM (
  SELECT content_hash FROM {films} GROUP BY content_hash HAVING count(DISTINCT split) > 1)""")
def check_dup_content(spark, sf):
    return P.check_row("no identical content in two splits", "warning", P.keys_in_several(films(spark, sf), "split", "content_hash"))


@query("unique_key_check", """SELECT 'lineitem' AS selection, count(*) AS rows, count(DISTINCT (l_orderkey, l_linenumber)) AS keys,
  count(*) = count(DISTINCT (l_orderkey, l_linenumber)) AS is_unique FROM lineitem
  UNION ALL SELECT 'events', count(*), count(DISTINCT event_id), count(*) = count(DISTINCT event_id) FROM events""")
def unique_key_check(spark, sf):
    """Copies collapse map-side: rows and distinct keys come out of one aggregate over (key, copies)."""
    def check(name, df, keys):
        per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
        return per_key.agg(F.lit(name).alias("selection"), F.sum("c").alias("rows"), F.count(F.lit(1)).alias("keys"),
                           (F.sum("c") == F.count(F.lit(1))).alias("is_unique"))

    return check("lineitem", table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).unionByName(
        check("events", table(spark, sf, "events"), ["event_id"]))


@query("split_label_crosstab", """SELECT split, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es,
  count(*) FILTER (lang = 'fr') AS fr FROM {films} GROUP BY split""")
def split_label_crosstab(spark, sf):
    return P.split_label_crosstab(films(spark, sf), "split", "lang", ["de", "en", "es", "fr"])


@query("split_profile", """SELECT split, count(*) AS films, sum(label) AS positives, count(DISTINCT source) AS groups,
  quantile_cont(n_chars, 0.5) AS median_chars FROM {films} GROUP BY split""")
def split_profile(spark, sf):
    rows = films(spark, sf)
    counts = rows.groupBy("split").agg(F.count(F.lit(1)).alias("films"), F.sum("label").alias("positives"))
    groups = rows.groupBy("split").agg(F.count_distinct("source").alias("groups"))
    median = exact_quantiles(rows, ["split"], "n_chars", {"median_chars": 0.5})
    return counts.join(groups, "split").join(median, "split")


@query("build_manifest", """SELECT (SELECT count(*) FROM {films}) AS rows, (SELECT count(DISTINCT source) FROM {films}) AS groups,
  '{{' || string_agg('"' || split || '":' || n, ',' ORDER BY split) || '}}' AS rows_by_split,
  '{{' || string_agg('"' || split || '":' || pos, ',' ORDER BY split) || '}}' AS positives_by_split
  FROM (SELECT split, count(*) AS n, sum(label) AS pos FROM {films} GROUP BY split)""")
def build_manifest(spark, sf):
    """One row that describes a build: totals and per-split counts as JSON."""
    rows = films(spark, sf)
    per = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    as_json = lambda v: F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", v)))))
    return per.agg(F.sum("n").alias("rows"), as_json("n").alias("rows_by_split"), as_json("pos").alias("positives_by_split")) \
        .withColumn("groups", rows.agg(F.count_distinct("source")).scalar())


@query("array_stats", """SELECT vec_id, round(list_avg(e), 6) AS mean, round(list_stddev_pop(e), 6) AS std, round(p05, 6) AS p05, round(p95, 6) AS p95,
  round(p95 - p05, 6) AS spread, round(list_var_pop(bends), 6) AS roughness, size FROM (SELECT vec_id, e, len(e) AS size,
  list_aggregate(e, 'quantile_cont', 0.05) AS p05, list_aggregate(e, 'quantile_cont', 0.95) AS p95,
  list_transform(range(2, len(e)), lambda i: 2 * e[i] - e[i - 1] - e[i + 1]) AS bends FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))""")
def array_stats(spark, sf):
    stats = A.array_stats(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding")
    return stats.select("vec_id", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p05", "p95", "spread", "roughness")], "size")


@query("assemble_inputs", """SELECT vec_id, unnest(range(len(x))) AS place, round(unnest(x), 6) AS value FROM (
  SELECT vec_id, list_concat(CAST(embedding AS DOUBLE[]), [CAST(label AS DOUBLE), CAST(1 AS DOUBLE)]) AS x FROM embeddings)""")
def assemble(spark, sf):
    """Embedding and two extra numbers in the fixed order, whatever order they are asked for in; compared place by place."""
    e = table(spark, sf, "embeddings")
    parts = {"embedding": F.col("embedding"), "quality": F.array(F.col("label").cast("double"), F.lit(1.0))}
    return e.select("vec_id", F.posexplode(assemble_inputs(parts, ["quality", "embedding"])).alias("place", "value")).select(
        "vec_id", F.col("place").cast("bigint").alias("place"), F.round("value", 6).alias("value"))
