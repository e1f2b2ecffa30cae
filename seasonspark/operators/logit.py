"""Logistic tercile forecasts of cells from an index, by Newton's method in one group a cell (a record of years)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binomial(x: np.ndarray, y: np.ndarray, at: float, penalty: float = 0.0, least: int = 10) -> tuple[float, float]:
    """(probability at a new x, Wald p value of the slope).

    Missing below `least` whole pairs; the base rate, without p value, where all labels are one. The penalty is half the slope's square times it; a
    penalised fit has no p value. Separated labels end at steep slopes after 100 steps.
    """
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = x[ok], y[ok]
    if len(x) < max(least, 1):
        return math.nan, math.nan
    if y.min() == y.max():
        return float(y.mean()), math.nan
    centre, spread = x.mean(), x.std() or 1.0
    a = np.column_stack([np.ones(len(x)), (x - centre) / spread])
    ridge = np.diag([0.0, penalty / spread**2])
    b = np.zeros(2)

    def loss(v):
        eta = a @ v
        return np.logaddexp(0, eta).sum() - y @ eta + 0.5 * v @ ridge @ v

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -700, 700)))
        grad = a.T @ (p - y) + ridge @ b
        hess = a.T @ (a * (p * (1 - p))[:, None]) + ridge + 1e-12 * np.eye(2)
        step, now, rate = np.linalg.solve(hess, grad), loss(b), 1.0
        while loss(b - rate * step) > now and rate > 1e-6:
            rate /= 2
        b = b - rate * step
        if np.abs(rate * step).max() < 1e-10:
            break
    p = 1 / (1 + np.exp(-np.clip(a @ b, -700, 700)))
    hess = a.T @ (a * (p * (1 - p))[:, None]) + 1e-300 * np.eye(2)
    wald = math.nan
    if penalty == 0 and np.linalg.cond(hess) < 1e14:
        wald = math.erfc(abs(b[1]) / math.sqrt(np.linalg.inv(hess)[1, 1]) / math.sqrt(2))
    eta = b[0] + b[1] * (at - centre) / spread
    return float(1 / (1 + math.exp(-max(min(eta, 700.0), -700.0)))), wald


def multinomial(x: np.ndarray, labels: np.ndarray, at: float, penalty: float = 0.0, least: int = 10) -> np.ndarray:
    """Shares of three categories by one model; a category that is absent has none, a single one all."""
    ok = np.isfinite(x) & (labels >= 0)
    x, labels = x[ok], labels[ok].astype(int)
    out = np.zeros(3)
    if len(x) < max(least, 1):
        return np.full(3, math.nan)
    there = np.unique(labels)
    if len(there) == 1:
        out[there[0]] = 1.0
        return out
    centre, spread = x.mean(), x.std() or 1.0
    a, k = np.column_stack([np.ones(len(x)), (x - centre) / spread]), len(there)
    hot = (labels[:, None] == there[None, :]).astype(float)
    ridge = np.tile([1e-9, penalty / spread**2 + 1e-9], k)
    b = np.zeros((k, 2))

    def shares(v, m):
        eta = m @ v.T
        e = np.exp(eta - eta.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    for _ in range(100):
        p = shares(b, a)
        grad = ((p - hot).T @ a).ravel() + ridge * b.ravel()
        hess = np.diag(ridge)
        for i in range(k):
            for j in range(k):
                hess[2 * i : 2 * i + 2, 2 * j : 2 * j + 2] += a.T @ (a * (p[:, i] * ((i == j) - p[:, j]))[:, None])
        step = np.linalg.solve(hess, grad).reshape(k, 2)
        size = np.abs(step).max()
        b = b - step / max(1.0, size / 5)
        if size < 1e-10:
            break
    out[there] = shares(b, np.array([[1.0, (at - centre) / spread]]))[0]
    return out


def forecast(rows: DataFrame, at: float, model: str = "binomial", penalty: float = 0.0, least: int = 10, significance: float | None = None, settle: str | None = "sum") -> DataFrame:
    """cell, p_below, p_normal, p_above. rows: cell, x (index), value.

    Boundaries are type 7, values on them normal. Three binomial models are divided by their sum (all missing where one is), or under "cap" keep their
    values except that above becomes the rest where they add up to over 1.0001, or stay as they are (None). Cells whose slope for below has a p value
    over `significance` are missing.
    """
    if model not in ("binomial", "multinomial") or settle not in ("sum", "cap", None):
        raise ValueError(f"unknown model {model!r} or rule {settle!r}")
    if significance is not None and penalty:
        raise ValueError("a penalised fit has no p values")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, v = pdf["x"].to_numpy(float), pdf["value"].to_numpy(float)
        whole = np.isfinite(v)
        p, wald = np.full(3, math.nan), math.nan
        if whole.any():
            lo, hi = np.quantile(v[whole], [1 / 3, 2 / 3])
            labels = np.where(~whole, -1, np.where(v < lo, 0, np.where(v > hi, 2, 1)))
            if model == "multinomial":
                p = multinomial(x, labels, at, penalty, least)
            else:
                fits = [binomial(x, np.where(whole, labels == c, math.nan), at, penalty, least) for c in range(3)]
                p, wald = np.array([f[0] for f in fits]), fits[0][1]
                if settle == "sum":
                    p = p / p.sum()
                elif settle == "cap" and p.sum() > 1.0001:
                    p[2] = 1 - p[0] - p[1]
        if significance is not None and wald > significance:
            p = np.full(3, math.nan)
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "p_below": [p[0]], "p_normal": [p[1]], "p_above": [p[2]]})

    def run(batches):
        for pdf in batches:
            yield pd.concat([one(pd.DataFrame({"cell": cell, "x": [r["x"] for r in rs], "value": [r["value"] for r in rs]}, dtype=None)) for cell, rs in zip(pdf["cell"], pdf["_r"], strict=True)], ignore_index=True)

    kind = dict(rows.dtypes)["cell"]
    # A row a cell, many to a batch.
    records = rows.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("value").cast("double").alias("value")))).alias("_r"))
    return records.mapInPandas(run, f"cell {kind}, p_below double, p_normal double, p_above double")
