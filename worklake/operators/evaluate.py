"""Operating threshold and ranking metrics of scored, labelled rows, of one model or of many at once. Ties in the score are exact.

Rows first collapse to one row per key (of a model, a split) and distinct score. One prefix scan over these counts gives the rank sums of
all models; every metric after it is an aggregate of the same small table.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklake.functions.scalars import priority_band, ratio_or_zero
from worklake.operators.ordered import CHUNK, SUM, chunk, running
from worklake.operators.quantiles import exact_quantiles


def score_counts(df: DataFrame, label: str, score: str, keys: list[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg"))


def ranked_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The counts with pos_upto and neg_upto (to the score, itself included) and pos_all and neg_all, per key."""
    pieces = chunk(counts, keys, [F.col("score")])
    cum = running(pieces, keys, [F.col("score")], {"pos_upto": (SUM, F.col("pos")), "neg_upto": (SUM, F.col("neg"))}).drop(CHUNK)
    totals = pieces.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.sum("pos").alias("pos_all"), F.sum("neg").alias("neg_all"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return cum.join(totals, same).drop(*[f"_k_{k}" for k in keys])


def _one(df: DataFrame, label: str, score: str) -> DataFrame:
    return ranked_counts(score_counts(df.withColumn("_all", F.lit(0)), label, score, ["_all"]), ["_all"])


def thresholds(ranked: DataFrame, keys: list[str], target_sensitivity: float) -> DataFrame:
    """Per key the highest threshold that keeps the target sensitivity: the positive score at 0-based position
    floor((1 - target) * positives); 0.5 without positives."""
    at = F.floor(F.lit(1 - target_sensitivity) * F.col("pos_all"))
    hit = (F.col("pos") > 0) & (F.col("pos_upto") > at) & (F.col("pos_upto") - F.col("pos") <= at)
    return ranked.groupBy(*keys).agg(F.coalesce(F.max(F.when(hit, F.col("score"))), F.lit(0.5)).alias("threshold"))


def _auroc() -> Column:
    pairs = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg")) + F.col("pos") * F.col("neg") / 2)
    return F.try_divide(pairs, F.max(F.col("pos_all") * F.col("neg_all")).cast("double"))


def _auprc() -> Column:
    tp = F.col("pos_all") - F.col("pos_upto") + F.col("pos")
    seen = tp + F.col("neg_all") - F.col("neg_upto") + F.col("neg")
    return F.try_divide(F.sum(F.col("pos") * tp / seen), F.max("pos_all").cast("double"))


def model_metrics(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, from ranked counts with a column threshold: n, prevalence, the confusion and its ratios, AUROC, average precision, Brier."""
    hit, n = F.col("score") >= F.col("threshold"), F.sum(F.col("pos") + F.col("neg"))
    s = F.col("score")
    out = ranked.groupBy(*keys).agg(
        n.alias("n"), (F.sum("pos") / n).alias("prevalence"), *[F.sum(F.when(c, F.col(col)).otherwise(0)).alias(name) for name, c, col in (
            ("tp", hit, "pos"), ("fp", hit, "neg"), ("tn", ~hit, "neg"), ("fn", ~hit, "pos"))],
        _auroc().alias("auroc"), _auprc().alias("auprc"),
        (F.sum(F.col("pos") * (1 - s) * (1 - s) + F.col("neg") * s * s) / n).alias("brier"))
    return _with_ratios(out)


def model_bands(ranked: DataFrame, keys: list[str], cuts: list[float]) -> DataFrame:
    """Per key and candidate cut above the key's threshold: rows and positives of the three bands, all cuts in one aggregate."""
    s, t, aggs = F.col("score"), F.col("threshold"), []
    for i, c in enumerate(cuts):
        for band, cond in (("p1", s >= c), ("p2", (s >= t) & (s < c)), ("p3", s < t)):
            aggs += [F.sum(F.when(cond, F.col("pos") + F.col("neg")).otherwise(0)).alias(f"{band}_{i}"),
                     F.sum(F.when(cond, F.col("pos")).otherwise(0)).alias(f"{band}_pos_{i}")]
    names = [f"{b}{x}" for b in ("p1", "p2", "p3") for x in ("", "_pos")]
    per_key = ranked.groupBy(*keys, "threshold").agg(*aggs)
    rows = [F.struct(F.lit(c).alias("cut"), *[F.col(f"{n}_{i}").alias(n) for n in names]) for i, c in enumerate(cuts)]
    return per_key.select(*keys, "threshold", F.inline(F.array(*rows))).where("cut > threshold").drop("threshold")


def model_quantiles(ranked: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    return exact_quantiles(ranked.withColumn("_times", F.col("pos") + F.col("neg")), keys, "score", probs, "_times")


def choose_threshold(df: DataFrame, label: str, score: str, target_sensitivity: float) -> DataFrame:
    return thresholds(_one(df, label, score), [], target_sensitivity)


def _with_ratios(df: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = (df.withColumn("sensitivity", ratio_or_zero(tp, tp + fn)).withColumn("specificity", ratio_or_zero(tn, tn + fp))
             .withColumn("precision", ratio_or_zero(tp, tp + fp)))
    p, r = F.col("precision"), F.col("sensitivity")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def classification_metrics(df: DataFrame, label: str, score: str, threshold: Column) -> DataFrame:
    y, hit = F.col(label) == 1, F.col(score) >= threshold
    return _with_ratios(df.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("prevalence"),
        F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"),
        F.count_if(~y & ~hit).alias("tn"), F.count_if(y & ~hit).alias("fn")))


def auroc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Share of positive-negative pairs in the right order, ties counting half."""
    return _one(df, label, score).agg(_auroc().alias("auroc"))


def auprc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Average precision: precision at every score weighted by the gain in recall."""
    return _one(df, label, score).agg(_auprc().alias("auprc"))


def brier(df: DataFrame, label: str, score: str) -> DataFrame:
    e = F.col(score) - F.col(label)
    return df.agg(F.avg(e * e).alias("brier"))


def band_table(df: DataFrame, label: str, score: str, threshold: float, p1: float) -> DataFrame:
    band = priority_band(F.col(score), F.lit(threshold), F.lit(p1))
    return df.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("films"), F.sum(label).alias("positives"))


def p1_cut_sweep(df: DataFrame, label: str, score: str, threshold: float, cuts: list[float]) -> DataFrame:
    """Rows and positives per band for every candidate P1 cut above the threshold, in one pass."""
    s, y = F.col(score), F.col(label) == 1
    used = [c for c in cuts if c > threshold]
    aggs = []
    for i, c in enumerate(used):
        for band, cond in (("p1", s >= c), ("p2", (s >= threshold) & (s < c)), ("p3", s < threshold)):
            aggs += [F.count_if(cond).alias(f"{band}_{i}"), F.count_if(cond & y).alias(f"{band}_pos_{i}")]
    names = [f"{b}{x}" for b in ("p1", "p2", "p3") for x in ("", "_pos")]
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("cut"), *[F.col(f"{n}_{i}").alias(n) for n in names]) for i, c in enumerate(used)])))
