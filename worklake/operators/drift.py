"""Population stability of numeric features against a reference, whose bins can be stored and used again.

Values collapse to counts per feature and distinct value first; edges and bins are taken from these counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklake.operators.quantiles import exact_quantiles
from worklake.session import materialize

# Fixed value: the least share a bin counts for.
SMALLEST_SHARE = 1e-4
BINS = "feature string, edges array<double>, ref array<bigint>"


def value_counts(df: DataFrame, features: list[str], *keys: str) -> DataFrame:
    """feature, value, keys, n: all features in one pass over the rows."""
    long = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(list(keys), features, "feature", "value")
    return long.where("value IS NOT NULL").groupBy("feature", "value", *keys).agg(F.count(F.lit(1)).alias("n"))


def _binned(counts: DataFrame, edges: DataFrame, *keys: str) -> DataFrame:
    """Rows per feature (and keys) as an array over its bins. Values beyond the edges go to the outer bins, the last bin includes its upper edge.

    edges has one row for each feature that the caller names, so its size is fixed; a shuffle by feature would meet hot keys.
    """
    placed = counts.join(F.broadcast(edges), "feature")
    last = F.size("edges") - 1
    bin_no = F.least(F.greatest(F.size(F.filter("edges", lambda e: e <= F.col("value"))), F.lit(1)), last)
    cells = placed.groupBy("feature", *keys, bin_no.alias("bin")).agg(F.sum("n").alias("n"), F.max(last).alias("last"))
    found = cells.groupBy("feature", *keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.max("last").alias("last"))
    per_bin = F.transform(F.filter(F.sequence(F.lit(1), F.greatest("last", F.lit(1))), lambda b: b <= F.col("last")),
                          lambda b: F.coalesce(F.element_at("m", b), F.lit(0).cast("bigint")))
    return found.select("feature", *keys, per_bin.alias("rows"))


def bins_of_counts(counts: DataFrame, bins: int = 10) -> DataFrame:
    """feature, edges, ref: quantile bins of a reference and its rows in each. Equal edges bound no bin of their own."""
    names = [f"e{i}" for i in range(bins + 1)]
    q = exact_quantiles(counts, ["feature"], "value", {n: i / bins for i, n in enumerate(names)}, "n")
    edges = q.select("feature", F.array_sort(F.array_distinct(F.array(*names))).alias("edges"))
    edges = materialize(edges, "edges")
    return edges.join(_binned(counts, edges), "feature").select("feature", "edges", F.col("rows").alias("ref"))


def reference_bins(df: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """What has to be stored of a reference: a run is compared with it without reading the reference again."""
    return bins_of_counts(materialize(value_counts(df, features), "counts"), bins)


def psi_of_counts(reference: DataFrame, counts: DataFrame, *keys: str) -> DataFrame:
    """feature, keys, psi of counted values against stored bins. Fewer than two bins: 0."""
    both = reference.join(_binned(counts, reference.select("feature", "edges"), *keys), "feature")

    def shares(a: str) -> Column:
        total = F.greatest(F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x), F.lit(1))
        return F.transform(a, lambda x: F.greatest(x / total, F.lit(SMALLEST_SHARE)))
    terms = F.zip_with(shares("ref"), shares("rows"), lambda e, a: (a - e) * F.ln(a / e))
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return both.select("feature", *keys, F.when(F.size("edges") < 3, F.lit(0.0)).otherwise(total).alias("psi"))


def psi(df: DataFrame, features: list[str], is_reference: Column, bins: int = 10) -> DataFrame:
    """(feature, psi) of the other rows of df against its reference rows, from one table of counts."""
    counts = materialize(value_counts(df.withColumn("_ref", is_reference), features, "_ref"), "counts")
    reference = bins_of_counts(counts.where("_ref").drop("_ref"), bins)
    found = psi_of_counts(reference, counts.where("NOT _ref").drop("_ref"))
    return reference.select("feature", F.size("edges").alias("_edges")).join(found, "feature", "left").select(
        "feature", F.when(F.col("_edges") < 3, F.lit(0.0)).otherwise(F.col("psi")).alias("psi"))


def drift_level(psi_max: Column, rows: Column, warn: float, alert: float, min_rows: int) -> Column:
    worst = F.coalesce(psi_max, F.lit(0.0))
    return (F.when(rows < min_rows, "TOO_FEW").when(worst >= alert, "ALERT").when(worst >= warn, "WARN").otherwise("OK"))


def drift_report(psi_rows: DataFrame, sizes: DataFrame, keys: list[str], warn: float, alert: float, min_rows: int) -> DataFrame:
    """Per key of sizes (keys, rows): psi of every feature as JSON, the worst, and the level; without a feature NULL, {} and TOO_FEW."""
    entry = F.concat(F.lit('"'), "feature", F.lit('":'), F.format_string("%.4f", F.col("psi")))
    found = psi_rows.select(*keys, "feature", F.round("psi", 4).alias("psi")).groupBy(*keys).agg(
        F.max("psi").alias("psi_max"), F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(entry)), ","), F.lit("}")).alias("psi_json"))
    level = F.when(F.col("psi_max").isNull(), "TOO_FEW").otherwise(drift_level(F.col("psi_max"), F.col("rows"), warn, alert, min_rows))
    return sizes.join(found, keys, "left").select(
        *keys, "rows", "psi_max", F.coalesce("psi_json", F.lit("{}")).alias("psi_json"), level.alias("drift_level"))
