"""Combination of forecasts and pooling of models.

Forecasts: keys, model, value (or probabilities). Tables by model have a row a model and are broadcast: at most MOST_MODELS.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_MODELS = 10_000


def model_table(weights: DataFrame) -> DataFrame:
    if weights.limit(MOST_MODELS + 1).count() > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    return F.broadcast(weights)


def uniform(forecasts: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean over models; missing in one, missing in all."""
    whole = F.count(value) == F.count(F.lit(1))
    return forecasts.groupBy(*keys).agg(F.when(whole, F.avg(value)).alias(value))


def skill_weights(scores: DataFrame) -> DataFrame:
    """Negative and missing scores count as 0; equal weights where none is positive. scores: model, score."""
    s = F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0))
    w = Window.partitionBy(F.lit(0))  # a row a model
    total = F.sum(s).over(w)
    return scores.select("model", F.when(total > 0, s / total).otherwise(1 / F.count(F.lit(1)).over(w)).alias("weight"))


def shrink(weights: DataFrame, amount: float) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return weights.select("model", ((1 - amount) * F.col("weight") + amount / n).alias("weight"))


def effective_models(weights: DataFrame) -> DataFrame:
    return weights.agg((1 / F.sum(F.col("weight") * F.col("weight"))).alias("n"))


def weighted(forecasts: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of weight times value, the weights as they are; missing in one, missing in all."""
    j = forecasts.join(model_table(weights), "model")
    whole = F.count("value") == F.count(F.lit(1))
    return j.groupBy(*keys).agg(F.when(whole, F.sum(F.col("weight") * F.col("value"))).alias("value"))


def drop_worst(forecasts: DataFrame, scores: DataFrame, keys: list[str], drop: int = 1) -> DataFrame:
    """Mean without the models of the lowest scores, the first names of ties."""
    ranked = scores.withColumn("_r", F.row_number().over(Window.orderBy("score", "model")))  # a row a model
    if ranked.limit(drop + 1).count() <= drop:
        raise ValueError("no model would be left")
    return uniform(forecasts.join(model_table(ranked.where(F.col("_r") > drop).select("model")), "model"), keys)


def pool(members: DataFrame) -> DataFrame:
    """One super-ensemble: years that all models have, members numbered through. members: model, member, cell, year, value."""
    models = members.select("model").distinct().count()
    shared = members.groupBy("year").agg(F.count_distinct("model").alias("n")).where(F.col("n") == models).select("year")
    ids = members.select("model", "member").distinct()
    ids = ids.select("model", "member", F.row_number().over(Window.orderBy("model", "member")).alias("_i"))  # a row a member
    return members.join(F.broadcast(shared), "year").join(ids, ["model", "member"]).select("cell", "year", F.col("_i").alias("member"), "value")


def contributions(forecasts: DataFrame, combined: DataFrame) -> DataFrame:
    """Correlation over years of each model's mean over cells with the combination's."""
    a = forecasts.groupBy("model", "year").agg(F.avg("value").alias("a"))
    b = combined.groupBy("year").agg(F.avg("value").alias("b"))
    return a.join(b, "year").groupBy("model").agg(F.corr("a", "b").alias("r"))


def bma(forecasts: DataFrame, obs: DataFrame, keys: list[str], rounds: int = 200, tolerance: float = 1e-7, floor: float = 1e-12) -> list[tuple[str, float, float]]:
    """(model, weight, variance) of a mixture of normals by expectation and maximisation.

    Errors of all models stand in one row a sample; each pass gives partial sums, and only sums by model come to the driver. Two steps are followed by
    one along the squared extrapolation of both, taken back where it lowers the likelihood, so that few passes are needed. Samples that miss a model
    are left out.
    """
    models = sorted(r[0] for r in forecasts.select("model").distinct().limit(MOST_MODELS + 1).collect())
    if len(models) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    wide = forecasts.groupBy(*keys).pivot("model", models).agg(F.first("value")).join(obs, keys)
    errors = wide.select(*[(F.col(f"`{m}`") - F.col("obs")).alias(f"e{i}") for i, m in enumerate(models)]).dropna().persist()
    k = len(models)

    def step(w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Weights and variances after one round, and the likelihood's logarithm before it."""
        e2 = [F.col(f"e{i}") * F.col(f"e{i}") for i in range(k)]
        logs = [F.lit(math.log(max(w[i], 1e-300)) - 0.5 * math.log(v[i])) - e2[i] / (2 * float(v[i])) for i in range(k)]
        z = errors.select("*", (F.greatest(*logs) if k > 1 else logs[0]).alias("top"), *[x.alias(f"l{i}") for i, x in enumerate(logs)])
        z = z.select("*", *[F.exp(F.col(f"l{i}") - F.col("top")).alias(f"z{i}") for i in range(k)])
        whole = sum((F.col(f"z{i}") for i in range(1, k)), F.col("z0"))
        s = z.agg(*[F.sum(F.col(f"z{i}") / whole) for i in range(k)], *[F.sum(F.col(f"z{i}") / whole * e2[i]) for i in range(k)], F.sum(F.col("top") + F.log(whole))).first()
        n = np.array(s[:k])
        return n / n.sum(), np.maximum(np.array(s[k : 2 * k]) / np.where(n > 0, n, 1.0), floor), s[2 * k]

    try:
        first = errors.agg(F.count(F.lit(1)), *[F.var_pop(f"e{i}") for i in range(k)]).first()
        if not first[0]:
            raise ValueError("no sample has all models and an observation")
        w, v = np.full(k, 1 / k), np.array([max(x, floor) for x in first[1:]])
        for _ in range(max(1, rounds // 3)):
            w1, v1, _ = step(w, v)
            w2, v2, _ = step(w1, v1)
            if np.abs(w2 - w1).max() < tolerance and np.abs(np.log(v2 / v1)).max() < tolerance:
                w, v = w2, v2
                break
            at = [np.concatenate([a, np.log(b)]) for a, b in ((w, v), (w1, v1), (w2, v2))]
            r, c = at[1] - at[0], at[2] - 2 * at[1] + at[0]
            far = -max(1.0, np.sqrt((r @ r) / max(c @ c, 1e-300)))
            leap = at[0] - 2 * far * r + far * far * c
            wl, vl = np.maximum(leap[:k], 1e-12), np.maximum(np.exp(np.clip(leap[k:], -700, 700)), floor)
            w3, v3, good = step(wl / wl.sum(), vl)
            w4, v4, safe = step(w2, v2)
            w, v = (w3, v3) if np.isfinite(good) and good >= safe else (w4, v4)
        return [(m, float(w[i]), float(v[i])) for i, m in enumerate(models)]
    finally:
        errors.unpersist()
