"""Canonical correlation between two fields through their leading patterns.

fit() works on two matrices of years by cells. The cross-validated forms need the products of years only, which partial sums over cells give, so that
no task holds a field; years and models are few, and bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLAMP, FAINT = 100.0, 1e-10


def latitude_weights(lats: np.ndarray) -> np.ndarray:
    """Square root of the mean cosine of each band, whose edges lie midway to its neighbours."""
    if len(lats) < 3:
        return np.sqrt(np.cos(np.deg2rad(lats))) if len(lats) == 2 else np.ones(len(lats))
    r = np.deg2rad(np.asarray(lats, dtype=float))
    inner = (r[1:] + r[:-1]) / 2
    edges = np.concatenate([[(3 * r[0] - r[1]) / 2], inner, [(3 * r[-1] - r[-2]) / 2]])
    wide = np.diff(edges)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.abs(np.diff(np.sin(edges)) / wide)
    return np.where(np.abs(wide) > 1e-12, np.sqrt(mean), 0.0)


@dataclass
class Side:
    """One field's mean, weights, patterns (cells x modes), scores (modes x years) and singular values."""

    mean: np.ndarray
    scale: np.ndarray
    patterns: np.ndarray
    scores: np.ndarray
    values: np.ndarray


def side(field: np.ndarray, weights: np.ndarray, modes: int, standard: bool) -> Side:
    """field: years x cells, gaps filled with the cell's mean."""
    mean = np.nanmean(field, axis=0)
    centred = np.where(np.isnan(field), mean, field) - mean
    sd = centred.std(axis=0, ddof=1) if standard else np.ones(len(mean))
    scale = weights / np.where(sd < 1e-20, 1.0, sd)
    u, s, vt = np.linalg.svd(centred * scale, full_matrices=False)
    k = min(modes, len(field) - 1, field.shape[1])
    return Side(mean, scale, vt[:k].T, u[:, :k].T, s[:k])


@dataclass
class Fit:
    x: Side
    y: Side
    across: np.ndarray  # modes of x to canonical modes
    back: np.ndarray  # canonical modes to modes of y
    correlations: np.ndarray
    years: int

    def canonical(self, field: np.ndarray) -> np.ndarray:
        """Scores of a predictor field; patterns whose singular value is a rounding error have no part."""
        a = np.where(np.isnan(field), 0.0, (field - self.x.mean) * self.x.scale)
        firm = np.abs(self.x.values) > FAINT * np.abs(self.x.values).max()
        raw = self.x.patterns.T @ a
        return self.across @ np.where(firm, raw / np.where(firm, self.x.values, 1.0), 0.0)

    def predict(self, field: np.ndarray) -> np.ndarray:
        modes = self.back @ (self.canonical(field) * self.correlations) * self.y.values
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.y.patterns @ modes / self.y.scale + self.y.mean

    def leverage(self, field: np.ndarray) -> float:
        """1/n plus the square of the scores' sum, 100 at most."""
        h = 1 / self.years + float(np.sum(self.canonical(field))) ** 2
        return min(h, CLAMP) if np.isfinite(h) else CLAMP


def fit(x: np.ndarray, y: np.ndarray, x_weights: np.ndarray, y_weights: np.ndarray, x_modes: int = 10, y_modes: int = 10, modes: int = 3, standard: bool = False) -> Fit:
    a, b = side(x, x_weights, x_modes, standard), side(y, y_weights, y_modes, standard)
    if not (a.values.size and a.values.max() > 0):
        raise ValueError("the predictor does not vary over years")
    u, s, vt = np.linalg.svd(b.scores @ a.scores.T, full_matrices=False)
    k = min(modes, len(a.values), len(b.values), len(x) - 1)
    return Fit(a, b, vt[:k], u[:, :k], s[:k], len(x))


def north_modes(field: np.ndarray, weights: np.ndarray, ceiling: int = 10, standard: bool = False, share: float = 1.0) -> int:
    """Leading modes by variance: up to the first that falls below share of the mean one, or that does not stand off the next by more than its sampling error.

    The latter still counts; at least one does, and ceiling at most. Cells with a gap are left out.
    """
    whole = np.isfinite(field).all(0)
    a = field[:, whole] - field[:, whole].mean(0)
    if standard and len(a) > 1:
        sd = a.std(axis=0, ddof=1)
        a = a / np.where(sd < 1e-20, 1.0, sd)
    lam = np.linalg.svd(a * weights[whole], compute_uv=False) ** 2
    lam = lam[lam > 0]
    kept = 1
    for i in range(min(len(lam) - 1, ceiling)):
        if lam[i] < share * lam.mean():
            break
        kept = i + 1
        if lam[i] - lam[i + 1] <= lam[i] * np.sqrt(2 / len(field)):
            break
    return max(1, min(kept, ceiling))


def capped_modes(ranges: list[tuple[int, int]], years: int, window: int) -> list[tuple[int, int]]:
    """Ranges of modes within what the years that a fold leaves can carry."""
    most = max(1, years - window - 2)
    return [(min(a, most), min(b, most)) for a, b in ranges]


#: Models and years of a record, at most; the driver holds matrices of years by years for each model and fold.
MOST_MODELS, MOST_YEARS = 200, 200


def records(rows: DataFrame, years: dict, weighted: dict | None = None) -> DataFrame:
    """model, lat, lon and v, the values of the model's years in order (null: a gap); cells without any value are left out."""
    kept = rows.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("model", "lat", "lon", "year").agg(F.avg("value").alias("value"))
    spans = rows.sparkSession.createDataFrame([(m, [int(y) for y in ys]) for m, ys in years.items()], f"model {dict(rows.dtypes)['model']}, ys array<int>")
    cells = kept.groupBy("model", "lat", "lon").agg(F.map_from_entries(F.collect_list(F.struct(F.col("year").cast("int").alias("year"), "value"))).alias("_m"))
    v = F.transform("ys", lambda y: F.try_element_at("_m", y))
    return cells.join(F.broadcast(spans), "model").select("model", "lat", "lon", v.alias("v")).where(F.exists("v", lambda x: x.isNotNull()))


def shared_years(predictor: DataFrame, obs: DataFrame) -> dict:
    """Of each model with five years or more the years that both have."""
    own = [t.where("value IS NOT NULL").select("model", F.col("year").cast("int").alias("year")).distinct() for t in (predictor, obs)]
    rows = own[0].join(own[1], ["model", "year"]).groupBy("model").agg(F.sort_array(F.collect_list("year")).alias("ys")).limit(MOST_MODELS + 1).collect()
    if len(rows) > MOST_MODELS or any(len(r.ys) > MOST_YEARS for r in rows):
        raise ValueError(f"more than {MOST_MODELS} models or {MOST_YEARS} years")
    return {r.model: list(r.ys) for r in rows if len(r.ys) >= 5}


def folds(years: list, half: int) -> list[list[int]]:
    """Of each year the places of those that it is predicted from."""
    return [[j for j in range(len(years)) if abs(years[j] - y) > half] for y in years]


def band_weights(rows: DataFrame) -> dict:
    """Weight of each model's latitudes; an axis each."""
    out: dict = {}
    for r in rows.groupBy("model").agg(F.sort_array(F.collect_set(F.col("lat").cast("double"))).alias("axis")).collect():
        out.update({(r.model, lat): w for lat, w in zip(r.axis, latitude_weights(np.array(r.axis)), strict=True)})
    return out


def centred(v: np.ndarray, train: list[int], standard: bool) -> tuple[np.ndarray, np.ndarray]:
    """(all years' departures from the mean of the training ones, gaps 0; the mean). v: cells x years."""
    with np.errstate(all="ignore"):
        some = np.isfinite(v[:, train])
        mean = np.where(some, v[:, train], 0).sum(1) / some.sum(1)
        a = np.where(np.isfinite(v), v - mean[:, None], 0.0)
        if standard:
            sd = a[:, train].std(axis=1, ddof=1)
            a = a / np.where(sd < 1e-20, 1.0, sd)[:, None]
    return np.where(np.isfinite(mean)[:, None], a, 0.0), mean


def products(rows: DataFrame, years: dict, half: int, standard: bool = False) -> dict:
    """Of each model and fold the products of all years' weighted departures, years by years, summed over cells.

    Partial sums are made in Arrow batches, so that no task holds a field; with -1 for a fold that leaves out none.
    """
    weights = band_weights(rows)
    kind = dict(rows.dtypes)["model"]

    def run(batches):
        held: dict = {}
        for pdf in batches:
            for model, part in pdf.groupby("model"):
                v = np.array([[np.nan if x is None else x for x in r] for r in part["v"]], float)
                w = np.array([weights[model, lat] for lat in part["lat"]])[:, None]
                for fold, train in enumerate([*folds(years[model], half), list(range(v.shape[1]))]):
                    a = centred(v, train, standard)[0] * w
                    held[model, fold] = held.get((model, fold), 0) + a.T @ a
        yield pd.DataFrame([(m, f, i, row.tolist()) for (m, f), g in held.items() for i, row in enumerate(g)], columns=["model", "fold", "i", "g"])

    parts = records(rows, years).mapInPandas(run, f"model {kind}, fold int, i int, g array<double>")
    cells = parts.select("model", "fold", "i", F.posexplode("g").alias("j", "g")).groupBy("model", "fold", "i", "j").agg(F.sum("g").alias("g"))
    out: dict = {}
    for r in cells.groupBy("model", "fold", "i").agg(F.sort_array(F.collect_list(F.struct("j", "g"))).alias("r")).collect():
        n = len(years[r.model])
        fold = r.fold if r.fold < n else -1
        out.setdefault((r.model, fold), np.zeros((n, n)))[r.i] = [x.g for x in r.r]
    return out


@dataclass
class Half:
    """One field's modes from its products over the training years: their values, year by year scores, and the scores of a further year."""

    values: np.ndarray
    scores: np.ndarray  # training years x modes
    further: np.ndarray


def half_of(g: np.ndarray, train: list[int], year: int, modes: int) -> Half:
    lam, u = np.linalg.eigh(g[np.ix_(train, train)])
    k = min(modes, len(train) - 1)
    values, u = np.sqrt(np.maximum(lam[::-1][:k], 0)), u[:, ::-1][:, :k]
    firm = values > FAINT * values.max(initial=0)
    # A value's square is no better than the products' rounding.
    firm &= values**2 > 1e-13 * lam[-1]
    raw = u.T @ g[train, year]
    return Half(values, u, np.where(firm, raw / np.where(firm, values, 1.0) ** 2, 0.0))


def answer(x: Half, y: Half, modes: int, years: int) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights of the training years' departures in the predicted field, leverage, all canonical correlations)."""
    u, s, vt = np.linalg.svd(y.scores.T @ x.scores, full_matrices=False)
    k = min(modes, len(s))
    canonical = vt[:k] @ x.further
    h = 1 / years + float(canonical.sum()) ** 2
    return y.scores @ (u[:, :k] @ (canonical * s[:k])), min(h, CLAMP) if np.isfinite(h) else CLAMP, s


def cross_validated(predictor: DataFrame, obs: DataFrame, x_modes: int = 3, y_modes: int = 3, modes: int = 2, half: int = 0, standard: bool = False) -> DataFrame:
    """model, year, lat, lon, prediction, leverage: each year by a fit on the years more than `half` away from it.

    predictor: model, year, lat, lon, value (members are averaged first); obs: model, year, lat, lon, value. Only years of both take part; models with
    fewer than five of them, or none, give no rows. The fits need products of years only; the predicted field is a sum of the training years' departures,
    so that fields are read cell by cell.
    """
    years = shared_years(predictor, obs)
    kind = dict(predictor.dtypes)["model"]
    gx, gy = (products(t.where(F.col("model").isin(*years)), years, half, standard) if years else {} for t in (predictor, obs))
    plan: dict = {}
    for model, ys in years.items():
        for t, train in enumerate(folds(ys, half)):
            if (model, t) in gx and (model, t) in gy:
                if not np.abs(gx[model, t]).max() > 0:
                    raise ValueError("the predictor does not vary over years")
                x, y = half_of(gx[model, t], train, t, x_modes), half_of(gy[model, t], train, t, y_modes)
                plan.setdefault(model, []).append((t, train, *answer(x, y, modes, len(train))[:2]))

    def run(batches):
        for pdf in batches:
            parts = []
            for model, part in pdf.groupby("model"):
                v = np.array([[np.nan if x is None else x for x in r] for r in part["v"]], float)
                for t, train, alpha, leverage in plan.get(model, []):
                    a, mean = centred(v, train, False)
                    parts.append(pd.DataFrame({"model": model, "year": years[model][t], "lat": part["lat"].to_numpy(float), "lon": part["lon"].to_numpy(float), "prediction": mean + a[:, train] @ alpha, "leverage": leverage}))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    held = records(obs.where(F.col("model").isin(*years)) if years else obs.where("false"), years or {None: []})
    return held.mapInPandas(run, f"model {kind}, year int, lat double, lon double, prediction double, leverage double")


def tau_b(p: np.ndarray, y: np.ndarray, cpt: bool = False) -> np.ndarray:
    """Kendall's tau of each cell's record (cells x years), with ties taken into account or counted as the reference programme does; nan under four pairs."""
    i, j = np.triu_indices(p.shape[1], 1)
    out = np.full(len(p), np.nan)
    for c in range(len(p)):
        ok = np.isfinite(p[c]) & np.isfinite(y[c])
        if ok.sum() < 4:
            continue
        both = ok[i] & ok[j]
        a, b = np.sign(p[c][j] - p[c][i])[both], np.sign(y[c][j] - y[c][i])[both]
        if cpt:
            out[c] = 2 * np.where((a == 0) & (b == 0), 0.5, (a <= 0) == (b <= 0)).mean() - 1
        else:
            n = np.sqrt(float((a != 0).sum()) * float((b != 0).sum()))
            out[c] = (a * b).sum() / n if n else np.nan
    return out


def best_modes(predictor: DataFrame, obs: DataFrame, x_range=(1, 10), y_range=(1, 10), cca_range=(1, 10), window: int = 1, tau: str = "b", overfit: bool = True, standard: bool = False) -> DataFrame:
    """model, x, y, modes and goodness of every combination of numbers of modes, and best: the mean of tau over cells of the cross-validated predictions.

    Pairs of x and y for which a canonical correlation of some fold is one are left out (goodness null). Ranges are cut to what the years carry.
    """
    if tau not in ("b", "cpt"):
        raise ValueError(f"unknown statistic {tau!r}")
    years, half = shared_years(predictor, obs), (window - 1) // 2
    kind = dict(predictor.dtypes)["model"]
    gx, gy = (products(t.where(F.col("model").isin(*years)), years, half, standard) for t in (predictor, obs))
    plans: dict = {}
    for model, ys in years.items():
        xs, y_s, cs = capped_modes([x_range, y_range, cca_range], len(ys), window)
        odd, found = set(), {}
        for t, train in enumerate(folds(ys, half)):
            x, y = half_of(gx[model, t], train, t, xs[1]), half_of(gy[model, t], train, t, y_s[1])
            for a in range(xs[0], xs[1] + 1):
                for b in range(y_s[0], y_s[1] + 1):
                    part = Half(x.values[:a], x.scores[:, :a], x.further[:a]), Half(y.values[:b], y.scores[:, :b], y.further[:b])
                    for c in range(cs[0], min(cs[1], a, b) + 1):
                        alpha, _, s = answer(*part, c, len(train))
                        found.setdefault((a, b, c), []).append((t, train, alpha))
                        if s[0] > 1 - 1.5e-8:
                            odd.add((a, b))
        plans[model] = {k: v for k, v in found.items() if not (overfit and k[:2] in odd)}, [k for k in found if overfit and k[:2] in odd]

    def run(batches):
        sums: dict = {}
        for pdf in batches:
            for model, part in pdf.groupby("model"):
                v = np.array([[np.nan if x is None else x for x in r] for r in part["v"]], float)
                for combo, each in plans[model][0].items():
                    p = np.full(v.shape, np.nan)
                    for t, train, alpha in each:
                        a, mean = centred(v, train, False)
                        p[:, t] = mean + a[:, train] @ alpha
                    g = tau_b(p, v, tau == "cpt")
                    old = sums.get((model, combo), (0.0, 0))
                    sums[model, combo] = old[0] + float(np.nansum(g)), old[1] + int(np.isfinite(g).sum())
        yield pd.DataFrame([(m, *c, s, n) for (m, c), (s, n) in sums.items()], columns=["model", "x", "y", "modes", "s", "n"])

    held = records(obs.where(F.col("model").isin(*years)), years).mapInPandas(run, f"model {kind}, x int, y int, modes int, s double, n long")
    scores = held.groupBy("model", "x", "y", "modes").agg((F.sum("s") / F.sum("n")).alias("goodness"))
    out = [(m, *c) for m, (_, gone) in plans.items() for c in gone]
    if out:
        scores = scores.unionByName(predictor.sparkSession.createDataFrame([(*r, None) for r in out], f"model {kind}, x int, y int, modes int, goodness double"))
    first = F.row_number().over(Window.partitionBy("model").orderBy(F.col("goodness").desc_nulls_last(), "x", "y", "modes"))
    return scores.withColumn("best", (first == 1) & F.col("goodness").isNotNull())
