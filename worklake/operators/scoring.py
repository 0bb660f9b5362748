"""Scoring heads, priority bands and the decision which head sets an item's priority."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklake.functions.arrays import as_doubles, dot
from worklake.functions.scalars import BAND_RANK, in_scope, priority_band

CHAMPION, TRIAL = "champion", "silent_trial"


@dataclass(frozen=True)
class Head:
    """Parameters of one scoring head: a few numbers from its package, carried as literals in the plan."""
    name: str
    stage: str
    population: str
    threshold: float
    p1: float
    version: str
    finding: str | None = None
    checks_quality: bool = False
    weights: tuple[float, ...] = field(default=(), repr=False)
    mean: tuple[float, ...] = field(default=(), repr=False)
    std: tuple[float, ...] = field(default=(), repr=False)
    intercept: float = 0.0


def linear_probability(vector: Column, head: Head) -> Column:
    """Standardise, dot product, sigmoid. The scaler is folded into the weights, so a row costs one pass."""
    scale = head.std or (1.0,) * len(head.weights)
    mean = head.mean or (0.0,) * len(head.weights)
    folded = [w / s for w, s in zip(head.weights, scale)]
    bias = head.intercept - sum(w * m for w, m in zip(folded, mean))
    z = dot(as_doubles(vector), F.array(*[F.lit(w) for w in folded])) + F.lit(bias)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def with_probabilities(df: DataFrame, heads: list[Head], probability) -> DataFrame:
    """Adds a column _p<i> per head; `probability(head)` is the head's score as a Column. Everything that
    follows is an expression over the item's own row."""
    return df.select("*", *[probability(h).alias(f"_p{i}") for i, h in enumerate(heads)])


def _scope(h: Head, age: str) -> Column:
    return F.lit(True) if h.checks_quality else in_scope(F.lit(h.population), F.col(age))


def heads_long(df: DataFrame, keep: list[str], age: str, heads: list[Head]) -> DataFrame:
    """One row per item and head. Probabilities are kept to four digits; the cut-offs apply to the unrounded
    score. The quality head has no band and applies to every item."""
    def row(i: int, h: Head) -> Column:
        p = F.col(f"_p{i}")
        band = F.lit(None).cast("string") if h.checks_quality else priority_band(p, F.lit(h.threshold), F.lit(h.p1))
        return F.struct(
            F.lit(h.name).alias("model"), F.lit(h.stage).alias("stage"), F.lit(h.version).alias("model_version"),
            _scope(h, age).alias("in_scope"), F.round(p, 4).alias("probability"), F.lit(h.threshold).alias("threshold"),
            (p >= h.threshold).alias("positive"), band.alias("priority"))

    return df.select(*keep, F.inline(F.array(*[row(i, h) for i, h in enumerate(heads)])))


def decide(df: DataFrame, age: str, heads: list[Head]) -> DataFrame:
    """The live priority of every item, and the one it would have if every trial head were live.

    Unfit items get NA; otherwise the most urgent in-scope head decides, none left gives NA. The quality head
    never ranks. In the trial arm a trial head stands in for the champion of its name. The heads of an item sit
    in its row, so the decision needs neither an explode nor a shuffle: the least of (rank, -probability, head)
    wins, and what else is known of a head is looked up by its number.
    """
    ordered = sorted(range(len(heads)), key=lambda i: (heads[i].name, heads[i].stage))  # ties go by name
    ranking = [i for i in ordered if not heads[i].checks_quality]
    on_trial = {heads[i].name for i in ranking if heads[i].stage == TRIAL}
    live = [i for i in ranking if heads[i].stage == CHAMPION]
    shadow = [i for i in ranking if heads[i].stage == TRIAL or heads[i].name not in on_trial]
    number = {i: n for n, i in enumerate(ranking, 1)}

    def key(i: int) -> Column:
        h, p = heads[i], F.col(f"_p{i}")
        rank = F.when(p >= max(h.p1, h.threshold), 1).when(p >= h.threshold, 2).otherwise(3)
        return F.when(_scope(h, age), F.struct(rank.alias("rank"), (-F.round(p, 4)).alias("p"), F.lit(number[i]).alias("head")))

    def least(candidates: list[int]) -> Column:
        keys = [key(i) for i in candidates]
        return F.least(*keys) if len(keys) > 1 else keys[0]

    quality = [F.col(f"_p{i}") >= h.threshold for i, h in enumerate(heads) if h.checks_quality]
    unfit = quality[0] if quality else F.lit(None).cast("boolean")
    kept = [c for c in df.columns if c not in {f"_p{i}" for i in range(len(heads))}]
    best = df.select(*kept, least(live).alias("_live"), least(shadow).alias("_shadow"), unfit.alias("_unfit"))
    fit = ~F.coalesce(F.col("_unfit"), F.lit(False))
    bands = F.array(*[F.lit(b) for b in BAND_RANK])

    def decided_by(arm: str) -> Column:
        return fit & F.col(arm).isNotNull()  # a NULL index must not reach the lookup

    def head_value(arm: str, value) -> Column:
        return F.when(decided_by(arm), F.element_at(F.array(*[F.lit(value(heads[i])) for i in ranking]), F.col(f"{arm}.head")))

    def band(arm: str) -> Column:
        return F.when(decided_by(arm), F.element_at(bands, F.col(f"{arm}.rank"))).otherwise("NA")

    return best.select(
        *kept, band("_live").alias("priority"), F.when(fit, -F.col("_live.p")).alias("probability"),
        head_value("_live", lambda h: h.threshold).alias("threshold"),
        head_value("_live", lambda h: h.name).alias("triage_model"),
        head_value("_live", lambda h: h.version).alias("model_version"),
        F.when(F.col("_unfit"), "UNSUITABLE").when(F.col("_unfit").isNotNull(), "OK").alias("quality_check"),
        band("_shadow").alias("shadow_priority"), F.when(fit, -F.col("_shadow.p")).alias("shadow_probability"),
        head_value("_shadow", lambda h: h.name).alias("shadow_model"))


def quality_flags(reference: dict[str, tuple[float, float]]) -> Column:
    """Comma-joined <feature>_LOW / <feature>_HIGH outside the reference range, in feature order."""
    flags = [F.when(F.col(f) < lo, f"{f}_LOW").when(F.col(f) > hi, f"{f}_HIGH") for f, (lo, hi) in reference.items()]
    return F.array_join(F.filter(F.array(*flags), lambda x: x.isNotNull()), ",")


def run_summary(decided: DataFrame, keys: list[str], wanted: str = "wanted", scored: str = "scored") -> DataFrame:
    """Per scoring run: volumes per band and the run's status. `wanted` and `scored` are boolean columns."""
    band = lambda b: F.count_if(F.col(scored) & (F.col("priority") == b))
    out = decided.groupBy(*keys).agg(
        F.count_if(F.col(wanted)).alias("studies"), F.count_if(F.col(scored)).alias("scored"),
        F.count_if(F.col(wanted) & ~F.col(scored)).alias("missing"),
        band("P1").alias("p1"), band("P2").alias("p2"), band("P3").alias("p3"), band("NA").alias("not_triaged"),
        F.count_if(F.col(scored) & (F.col("quality_check") == "UNSUITABLE")).alias("unsuitable"))
    none, some = F.col("studies") == 0, F.col("missing") > 0
    return out.withColumn("status", F.when(none, "FAILED").when(some, "PARTIAL").otherwise("SUCCEEDED")).withColumn(
        "message", F.when(none, "no items for the date").when(some, F.concat(F.lit("files not found: "), F.col("missing"))).otherwise(""))


def versions_json(long: DataFrame, keys: list[str]) -> DataFrame:
    """heads_json per run: the version of every model and stage. Distinct versions are few, whatever the rows."""
    seen = long.groupBy(*keys, "model", "stage").agg(F.max("model_version").alias("model_version"))
    entry = F.concat_ws("/", "model", "stage")
    return seen.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(entry.alias("k"), F.col("model_version").alias("v")))))).alias("heads_json"))
