"""Named methods, metrics, strategies and schemes."""

from __future__ import annotations

from collections.abc import Callable

from seasonspark.operators import ensembles, logit, methods, metrics, validation

KINDS: dict[str, dict[str, Callable]] = {
    "method": {
        "climatology": lambda hindcast, obs, forecast: methods.climatology_forecast(obs, forecast),
        "delta": methods.delta,
        "qm": methods.quantile_map_empirical,
        "qm_parametric": methods.quantile_map_parametric,
        "dqm": methods.quantile_map_detrended,
        "bcsd": methods.bcsd_coarse,
    },
    "calibrator": {"ereg": methods.ereg_forecast, "logit": logit.forecast, "smoothed_regression": methods.smoothed_forecast},
    "metric": {**{k: v[0] for k, v in {**metrics.BY_CELL, **metrics.POOLED}.items()}, "msss": metrics.msss, "crpss": metrics.crpss},
    "strategy": {"uniform": ensembles.uniform, "skill_weighted": ensembles.weighted, "drop_worst": ensembles.drop_worst, "bma": ensembles.bma},
    "scheme": dict(validation.SCHEMES),
}
ALIASES = {"mean_square_skill_score": "msss", "continuous_ranked_probability_skill_score": "crpss", "heidke_skill_score": "heidke", "hss": "heidke"}


def register(kind: str, name: str) -> Callable[[Callable], Callable]:
    def keep(f: Callable) -> Callable:
        KINDS[kind][name] = f
        return f

    return keep


def lookup(kind: str, name: str) -> Callable:
    """KeyError, with the names there are, for an unknown one."""
    found = KINDS[kind].get(ALIASES.get(name, name))
    if found is None:
        raise KeyError(f"unknown {kind} {name!r}; there are {sorted(KINDS[kind])}")
    return found


def downscale(method: str, hindcast, obs, forecast=None):
    """A method by name; without a forecast the hindcast's last year is held out and predicted."""
    if forecast is None:
        last = hindcast.agg({"year": "max"}).first()[0]
        forecast = hindcast.where(hindcast["year"] == last)
        hindcast, obs = hindcast.where(hindcast["year"] < last), obs.where(obs["year"] < last)
    return lookup("method", method)(hindcast, obs, forecast)
