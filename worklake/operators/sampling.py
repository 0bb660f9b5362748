"""Splits, samples and data checks. Every choice is by hash, so a row's fate does not depend on the run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklake.functions.scalars import hash_unit
from worklake.operators.latest import top_per_group
from worklake.session import materialize


def group_split(group: Column, seed: int, val_fraction: float, held_out: Column) -> Column:
    """train / val / test: held-out rows stay test, the rest is split by group, so no group is on both sides."""
    return (F.when(held_out, "test")
             .when(hash_unit(F.lit(str(seed)), group.cast("string")) < val_fraction, "val").otherwise("train"))


def hash_order(seed: int, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def stratified_sample(df: DataFrame, split: str, source: str, key: str, per_split: dict[str, int], sources: int,
                      seed: int) -> DataFrame:
    """per_split rows of every split, an equal share of each source, picked in hash order."""
    share = None
    for name, n in per_split.items():
        c = F.col(split) == name
        share = F.when(c, n // sources) if share is None else share.when(c, n // sources)
    most = max(per_split.values()) // sources
    top = top_per_group(df.where(F.col(split).isin(*per_split)).withColumn("_h", hash_order(seed, F.col(key))),
                        [split, source], [F.col("_h"), F.col(key)], most)
    w = Window.partitionBy(split, source).orderBy("_h", key)
    # at most `most` rows per group are left, the per-split share is cut from those
    return top.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= share).drop("_rn", "_h")


def balanced_sample(df: DataFrame, split: str, positive: str, block: str, key: str, n_pos: int, negatives_per_positive: int,
                    seed: int) -> DataFrame:
    """n_pos positives per split and a multiple of negatives, preferably from storage blocks that the positives
    use (fewer blocks to read); all blocks when those hold too few.

    Two passes over the rows, each cut to its candidates before anything is shuffled; the rest works on at most
    a few times n_pos rows per split.
    """
    most = n_pos * negatives_per_positive
    ordered = df.withColumn("_h", hash_order(seed, F.col(key)))
    in_order = [F.col("_h"), F.col(key)]
    pos = materialize(top_per_group(ordered.where(F.col(positive) == 1), [split], in_order, n_pos), "positives")
    want = pos.groupBy(split).agg((F.count(F.lit(1)) * negatives_per_positive).alias("_want"))
    blocks = pos.select(F.col(split).alias("_s"), F.col(block).alias("_b"), F.lit(1).alias("_near")).distinct()
    # at most n_pos blocks per split
    marked = ordered.where(F.col(positive) == 0).join(
        F.broadcast(blocks), (F.col(split) == F.col("_s")) & (F.col(block) == F.col("_b")), "left") \
        .withColumn("_near", F.coalesce("_near", F.lit(0))).drop("_s", "_b")
    # the best of both kinds; a split that fills `most` near ones has enough of them
    candidates = materialize(top_per_group(marked, [split, "_near"], in_order, most), "negatives")
    known = candidates.groupBy(split).agg(F.sum("_near").alias("_n_near")).join(want, split)
    pool = candidates.join(known, split).where((F.col("_near") == 1) | (F.col("_n_near") < F.col("_want")))
    w = Window.partitionBy(split).orderBy(*in_order)
    picked = pool.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.col("_want"))
    return pos.select(*df.columns).unionByName(picked.select(*df.columns))


def augment_union(df: DataFrame, key: str, seed: int, kinds: list[str]) -> DataFrame:
    """Every row as it is (label 0) and once more as a degraded copy (label 1) of a kind chosen by hash."""
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]),
                        (F.floor(hash_unit(F.lit(f"{seed}:kind"), F.col(key).cast("string")) * len(kinds)) + 1).cast("int"))
    copy = F.array(F.struct(F.lit("none").alias("degradation"), F.lit(0).alias("label")),
                   F.struct(kind.alias("degradation"), F.lit(1).alias("label")))
    return df.select("*", F.inline(copy))


def split_label_crosstab(df: DataFrame, split: str, label: str, labels: list[str]) -> DataFrame:
    """Counts split by label, missing combinations 0."""
    return df.groupBy(split).agg(*[F.count_if(F.col(label) == v).alias(v) for v in labels])


def keys_in_both(df: DataFrame, split: str, key: str, a: str, b: str) -> DataFrame:
    """Number of keys that occur in both splits; one aggregate, no self-join."""
    per_key = df.groupBy(key).agg(F.max((F.col(split) == a).cast("int")).alias("in_a"),
                                  F.max((F.col(split) == b).cast("int")).alias("in_b"))
    return per_key.agg(F.count_if((F.col("in_a") == 1) & (F.col("in_b") == 1)).alias("observed"))


def keys_in_several(df: DataFrame, split: str, key: str) -> DataFrame:
    """Number of keys that occur in more than one split."""
    per_key = df.groupBy(key).agg(F.min(split).alias("lo"), F.max(split).alias("hi"))
    return per_key.agg(F.count_if(F.col("lo") != F.col("hi")).alias("observed"))


def overlap_pairs(df: DataFrame, split: str, key: str) -> DataFrame:
    """Pairs of splits that share keys, with the number of shared keys. The splits of a key are a short array."""
    per_key = df.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).where("size(s) > 1")
    pairs = F.flatten(F.transform("s", lambda a: F.transform(
        F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))
    return per_key.select(F.inline(pairs)).groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("shared_keys"))


def empty_classes(df: DataFrame, split: str, label: str, splits: list[str], labels: list[int]) -> DataFrame:
    """Expected split and class combinations without a single row."""
    cells = df.agg(*[F.count_if((F.col(split) == s) & (F.col(label) == v)).alias(f"{s}/{v}")
                     for s in splits for v in labels])
    return cells.unpivot([], cells.columns, "cell", "rows").where("rows = 0").select("cell")


def check_row(name: str, severity: str, observed: DataFrame) -> DataFrame:
    """observed: one row, one column `observed`; the check passes at 0."""
    return observed.select(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"),
                           (F.col("observed") == 0).alias("passed"), F.col("observed").cast("bigint").alias("observed"))
