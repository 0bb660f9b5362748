"""What became of every ranked item, per item, per day and per model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklake.functions.scalars import ratio
from worklake.operators.quantiles import INDEX, LINEAR, exact_quantiles

CONFUSION = ["tp", "fn", "fp", "tn"]
# what daily_summary reads of the outcomes, beside the date and what the waits are grouped by
SUMMARISED = ["scored", "truth_known", "truth", "truth_second", "priority", "outcome", "wait_saved_min", "model_version", "population", "quality_check"]


def model_truth(model: Column, finding: Column, planted: Column, finding_of: dict[str, str], quality_head: str) -> Column:
    """0/1 against the finding a model looks for; the quality head is judged by planted files. NULL when the
    report is missing or the model unknown."""
    out = F.when(model == quality_head, planted.cast("int"))
    for name, wanted in finding_of.items():
        out = out.when((model == name) & finding.isNotNull(), (finding == wanted).cast("int"))
    return out


def outcome_class(priority: Column, truth_known: Column, decided_by: Column, truth: Column, flagged: Column) -> Column:
    """The order of the tests matters: unscored before pending before not triaged before the confusion cell."""
    return (F.when(priority.isNull(), "UNSCORED").when(~truth_known, "PENDING").when(decided_by.isNull(), "NOT_TRIAGED")
             .when((truth == 1) & flagged, "TP").when(truth == 1, "FN").when(flagged, "FP").otherwise("TN"))


def confusion_counts(truth: Column, flagged: Column) -> dict[str, Column]:
    return {"tp": F.count_if((truth == 1) & flagged), "fn": F.count_if((truth == 1) & ~flagged),
            "fp": F.count_if((truth == 0) & flagged), "tn": F.count_if((truth == 0) & ~flagged)}


def confusion_ratios(digits: int | None = 4) -> dict[str, Column]:
    c = {n: F.col(n) for n in CONFUSION}
    return {"sensitivity": ratio(c["tp"], c["tp"] + c["fn"], digits),
            "specificity": ratio(c["tn"], c["tn"] + c["fp"], digits),
            "ppv": ratio(c["tp"], c["tp"] + c["fp"], digits)}


def with_ratios(df: DataFrame) -> DataFrame:
    for name, c in confusion_ratios().items():
        df = df.withColumn(name, c)
    return df


def distinct_versions(column: Column) -> Column:
    """Sorted distinct versions joined by ',', NULL when there are none. Versions are few by nature."""
    return F.nullif(F.array_join(F.sort_array(F.collect_set(column)), ","), F.lit(""))


def group_waits(outcomes: DataFrame, keys: list[str], groups: dict[str, Column], arms: dict[str, str]) -> DataFrame:
    """Median of every arm and 90th percentile per class of items: <class>_<arm>_median_min / _p90_min.

    One long frame (day, class, arm, wait) feeds a single exact-quantile job, whatever the number of classes.
    Waits have one decimal; they are taken as whole tenths, so that half-way medians round up exactly.
    """
    series = [(g, a) for g in groups for a in arms]  # a row carries its series' number, as every row of the long frame moves
    entries = [F.struct(F.when(groups[g], F.lit(i)).alias("series"), F.round(F.col(arms[a]) * 10).alias("wait"))
               for i, (g, a) in enumerate(series)]
    long = outcomes.select(*keys, F.inline(F.array(*entries))).where("series is not null")
    by = [*keys, "series"]
    both = exact_quantiles(long, by, "wait", {"median": (0.5, LINEAR), "p90": (0.9, INDEX)})
    pick = []
    for i, (g, a) in enumerate(series):
        is_series = F.col("series") == i
        pick += [(F.round(F.max(F.when(is_series, F.col("median")))) / 10).alias(f"{g}_{a}_median_min"),
                 (F.max(F.when(is_series, F.col("p90"))) / 10).alias(f"{g}_{a}_p90_min")]
    return both.groupBy(*keys).agg(*pick)


def daily_summary(outcomes: DataFrame, waits: DataFrame, day: str, positive: str, second: str) -> DataFrame:
    """Per date: volumes, bands, confusion, completeness and the waits of group_waits."""
    is_cell = lambda c: F.col("outcome") == c
    counts = outcomes.groupBy(day).agg(
        F.count(F.lit(1)).alias("studies"), F.count_if("scored").alias("scored"),
        F.count_if("truth_known").alias("reported"),
        F.count_if(F.col("truth") == 1).alias(positive),
        F.count_if(F.col("truth_second") == 1).alias(second),
        *[F.count_if(F.col("priority") == b).alias(b.lower()) for b in ("P1", "P2", "P3")],
        F.count_if(~F.col("scored")).alias("unscored"),
        *[F.count_if(is_cell(c.upper())).alias(c) for c in CONFUSION],
        F.round(F.coalesce(F.sum(F.when(F.col("truth") == 1, F.col("wait_saved_min"))), F.lit(0.0)), 1)
         .alias(f"{positive}_minutes_saved"),
        distinct_versions(F.col("model_version")).alias("model_version"),
        F.count_if(F.col("population") == "adult").alias("adults"),
        F.count_if(F.col("priority") == "NA").alias("not_triaged"),
        F.count_if(F.col("quality_check") == "UNSUITABLE").alias("unsuitable"))
    counts = with_ratios(counts).withColumn("truth_completeness", ratio(F.col("reported"), F.col("studies")))
    return counts.join(waits, day, "left")


def daily_model_summary(heads: DataFrame, by: list[str], truth: str = "truth") -> DataFrame:
    """Per date, model, stage and version: every head at its own threshold against what is known by now."""
    t = F.when(F.col("in_scope"), F.col(truth))
    out = heads.groupBy(*by).agg(
        F.count(F.lit(1)).alias("scored"), F.count_if("in_scope").alias("in_scope"), F.count(t).alias("reported"),
        F.coalesce(F.sum(t), F.lit(0)).alias("positives"),
        *[c.alias(n) for n, c in confusion_counts(t, F.col("positive")).items()])
    return with_ratios(out)


def trial_evidence(daily: DataFrame, by: list[str], date: str = "business_date") -> DataFrame:
    """Sum of the daily confusion over the trial days of a version."""
    out = daily.where("stage = 'silent_trial'").groupBy(*by).agg(
        F.count_distinct(date).alias("days"), *[F.sum(c).alias(c) for c in CONFUSION])
    return with_ratios(out.withColumn("positives", F.col("tp") + F.col("fn"))
                          .withColumn("negatives", F.col("tn") + F.col("fp"))).drop("ppv")


def training_set_counts(films: DataFrame, split: str, positive: str, person: str, by: list[str] = ()) -> DataFrame:
    """Rows and positives per split with an 'all' row, which alone carries the number of distinct persons.

    The distinct count is its own aggregate: inside the rollup it would multiply every row.
    """
    grouped = films.groupBy(*by, split).agg(F.count(F.lit(1)).alias("films"), F.sum(positive).alias("positives"))
    total = grouped.groupBy(*by).agg(F.sum("films").alias("films"), F.sum("positives").alias("positives"))
    persons = films.groupBy(*by).agg(F.count_distinct(person).alias("persons"))
    total = (total.join(persons, by) if by else total.withColumn("persons", persons.scalar()))
    return (grouped.withColumnRenamed(split, "data_split").withColumn("persons", F.lit(None).cast("bigint"))
            .unionByName(total.withColumn("data_split", F.lit("all"))))


def touched_dates(arrived: DataFrame, items: DataFrame, item: str, day: str) -> list:
    """The dates of the items that the arrived reports are on, to prune partitions by: as many values as dates, whatever the rows."""
    found = items.select(item, day).join(arrived.select(item).distinct(), item, "left_semi").select(day).distinct()
    return sorted(r[0] for r in found.collect())
