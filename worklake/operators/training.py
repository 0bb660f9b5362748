"""Training of linear heads with MLlib, the parameters they leave behind, and the proof that they are at the minimum."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklake.functions.arrays import as_doubles, dot


@dataclass(frozen=True)
class Fitted:
    c: float
    mean: tuple[float, ...]
    std: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float
    positive_weight: float = 1.0
    negative_weight: float = 1.0


def assemble_inputs(parts: dict[str, Column], wanted: list[str]) -> Column:
    """The model's input array: the wanted groups in their fixed order."""
    if not [p for p in parts if p in wanted]:
        raise ValueError("model inputs must name at least one group")
    return F.concat(*[as_doubles(parts[p]) for p in parts if p in wanted])


def train_heads(df: DataFrame, vector: str, label: str, strengths: list[float], max_iter: int = 3000,
                balanced: bool = True) -> list[Fitted]:
    """One L2 logistic regression per strength C on standardised inputs.

    Inputs are scaled by the population deviation (a constant position stays at 0). MLlib minimises the mean
    loss, so regParam is 1 / (C * n); balanced classes weigh n / (2 * n_class). Moments and class counts are
    taken in one pass for all strengths.
    """
    y = F.col(label).cast("double")
    data = df.select(array_to_vector(as_doubles(F.col(vector))).alias("x"), y.alias("label"))
    stats = data.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"),
                     Summarizer.metrics("mean", "variance").summary(F.col("x")).alias("s")).first()
    n, pos = stats["n"], stats["pos"]
    mean = [float(v) for v in stats["s"]["mean"]]
    std = [float(v * (n - 1) / n) ** 0.5 or 1.0 for v in stats["s"]["variance"]]
    of_pos, of_neg = (n / (2 * pos), n / (2 * (n - pos))) if balanced else (1.0, 1.0)
    weight = F.when(F.col("label") == 1, of_pos).otherwise(of_neg)
    centred = F.zip_with(as_doubles(F.col(vector)), F.array(*[F.lit(v) for v in mean]), lambda a, m: a - m)
    scaled = F.zip_with(centred, F.array(*[F.lit(v) for v in std]), lambda a, s: a / s)
    ready = df.select(array_to_vector(scaled).alias("features"), y.alias("label")).withColumn("weight", weight).persist()
    try:
        out = []
        for c in strengths:
            model = LogisticRegression(weightCol="weight", regParam=1.0 / (c * n), elasticNetParam=0.0,
                                       standardization=False, maxIter=max_iter, tol=1e-9).fit(ready)
            out.append(Fitted(c, tuple(mean), tuple(std), tuple(float(v) for v in model.coefficients.toArray()),
                              float(model.intercept), of_pos, of_neg))
        return polished(df, vector, label, out)
    finally:
        ready.unpersist()


def probabilities(vector: Column, fits: list[Fitted]) -> Column:
    """Array of the models' probabilities of one row. The scalers are folded into the weights: a model costs one dot product."""
    def one(f: Fitted) -> Column:
        folded = [w / s for w, s in zip(f.weights, f.std)]
        bias = f.intercept - sum(w * m for w, m in zip(folded, f.mean))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(dot(vector, F.array(*[F.lit(w) for w in folded])) + F.lit(bias))))
    return F.array(*[one(f) for f in fits])


def polished(df: DataFrame, vector: str, label: str, fits: list[Fitted], steps: int = 2) -> list[Fitted]:
    """fits moved to the minimum by Newton steps: the optimizer stops where its loss no longer changes, which leaves the last digits of
    the weights open. A task adds up the gradients and second derivatives of all models over its rows; the sums of sums, (inputs + 1) x
    (inputs + 2) numbers a model, come to the driver. The steps are one pass over the rows each."""
    wide = len(fits[0].weights) + 1
    block = wide * (wide + 1)
    mean, std = np.array(fits[0].mean), np.array(fits[0].std)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(fits), block))
        for batch in batches:
            x, y = np.asarray(batch.column(0).flatten()).reshape(-1, wide - 1), np.asarray(batch.column(1))
            z = np.column_stack([(x - mean) / std, np.ones(len(x))])
            for i, f in enumerate(fits):
                p = 1 / (1 + np.exp(-(z @ np.array([*f.weights, f.intercept]))))
                weight = np.where(y == 1, f.positive_weight, f.negative_weight)
                sums[i, :wide] += z.T @ (weight * (p - y))
                sums[i, wide:] += ((z * (weight * p * (1 - p))[:, None]).T @ z).ravel()
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(sums.size)), "v": pa.array(sums.ravel())})

    rows = df.select(as_doubles(F.col(vector)).alias("x"), F.col(label).cast("double").alias("y"))
    for _ in range(steps):
        total = np.zeros(len(fits) * block)
        found = rows.mapInArrow(partial, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        total[np.asarray(found["i"])] = np.asarray(found["v"])
        moved = []
        for f, part in zip(fits, total.reshape(len(fits), block)):
            w, free = np.array([*f.weights, f.intercept]), np.ones(wide)
            free[-1] = 0  # the intercept is not drawn to 0
            step = np.linalg.solve(np.diag(free) + f.c * part[wide:].reshape(wide, wide), free * w + f.c * part[:wide])
            w = w - step
            moved.append(replace(f, weights=tuple(map(float, w[:-1])), intercept=float(w[-1])))
        fits[:] = moved
    return fits


def certificate(df: DataFrame, vector: str, label: str, fits: list[Fitted]) -> DataFrame:
    """c, gradient: the largest component of the gradient of |w|^2 / 2 + C * (weighted log loss) at the fitted parameters.

    The loss is strictly convex, so a gradient of 0 means the minimum, whatever way led there. The sums over the rows are one Spark
    aggregate for all models.
    """
    x, y = as_doubles(F.col(vector)), F.col(label).cast("double")
    first = fits[0]
    scaled = F.zip_with(F.zip_with(x, F.array(*map(F.lit, first.mean)), lambda a, m: a - m), F.array(*map(F.lit, first.std)), lambda a, s: a / s)
    rows = df.select(F.concat(scaled, F.array(F.lit(1.0))).alias("z"), y.alias("y"), probabilities(x, fits).alias("p"))

    def summed(i: int, f: Fitted) -> Column:
        residual = (F.get("p", F.lit(i)) - F.col("y")) * F.when(F.col("y") == 1, f.positive_weight).otherwise(f.negative_weight)
        return Summarizer.metrics("sum").summary(array_to_vector(F.transform("z", lambda v: v * residual))).alias(f"s{i}")

    def largest(i: int, f: Fitted) -> Column:
        pull = F.array(*[F.lit(w) for w in (*f.weights, 0.0)])  # the intercept is free
        parts = F.zip_with(vector_to_array(F.col(f"s{i}.sum")), pull, lambda s, w: F.abs(w + F.lit(f.c) * s))
        return F.struct(F.lit(f.c).alias("c"), F.array_max(parts).alias("gradient"))
    return rows.agg(*[summed(i, f) for i, f in enumerate(fits)]).select(F.inline(F.array(*[largest(i, f) for i, f in enumerate(fits)])))
