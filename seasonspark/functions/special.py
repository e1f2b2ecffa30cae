"""Distribution functions: as column expressions where a closed form or rational approximation exists, else in Arrow batches.

Each `*_sql` gives the same function as SQL text over an expression.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Hart's rational approximation of the normal distribution, highest power first.
HART_TOP = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_BOTTOM = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
# Wichura's algorithm AS 241 for the normal quantile, lowest power first.
CENTRE_TOP = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
CENTRE_BOTTOM = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
SIDE_TOP = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4)
SIDE_BOTTOM = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
TAIL_TOP = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
TAIL_BOTTOM = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)
ROOT_TAU = math.sqrt(2 * math.pi)


def at_least(x: Column, low: float) -> Column:
    """x, or low if that is greater; unlike greatest, null stays null."""
    return F.when(x < low, F.lit(low)).otherwise(x)


def horner(x: Column, powers: tuple[float, ...]) -> Column:
    """Polynomial of x, highest power first."""
    out = F.lit(powers[0])
    for c in powers[1:]:
        out = out * x + F.lit(c)
    return out


def horner_sql(x: str, powers: tuple[float, ...]) -> str:
    out = f"{powers[0]:.20e}"
    for c in powers[1:]:
        out = f"({out} * {x} + {c:.20e})"
    return out


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / ROOT_TAU


def normal_cdf(x: Column) -> Column:
    """To about 1e-15 (absolute); a continued fraction, right to 1e-8 of its value, beyond 5 sqrt(2)."""
    a = F.abs(x)
    body = F.exp(-a * a / 2) * horner(a, HART_TOP) / horner(a, HART_BOTTOM)
    deep = a + 0.65
    for k in (4, 3, 2, 1):
        deep = a + k / deep
    tail = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, body).otherwise(normal_pdf(a) / deep)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def normal_cdf_np(x: np.ndarray) -> np.ndarray:
    """normal_cdf() of numbers."""
    a = np.abs(x)
    deep = a + 0.65
    for k in (4, 3, 2, 1):
        deep = a + k / deep
    tail = np.exp(-a * a / 2) * np.where(a < 7.07106781186547, np.polyval(HART_TOP, a) / np.polyval(HART_BOTTOM, a), 1 / (ROOT_TAU * deep))
    return np.where(x > 0, 1 - tail, tail)


def normal_cdf_sql(x: str) -> str:
    a = f"abs({x})"
    body = f"exp(-{a} * {a} / 2) * {horner_sql(a, HART_TOP)} / {horner_sql(a, HART_BOTTOM)}"
    deep = f"({a} + 0.65e0)"
    for k in (4, 3, 2, 1):
        deep = f"({a} + {k}e0 / {deep})"
    tail = f"CASE WHEN {a} > 37 THEN 0e0 WHEN {a} < 7.07106781186547e0 THEN {body} ELSE exp(-{a} * {a} / 2) / {ROOT_TAU!r} / {deep} END"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def normal_ppf(p: Column) -> Column:
    """Quantile for 0 < p < 1, to about 1e-15; null outside."""
    q = p - 0.5
    r = F.lit(0.180625) - q * q
    centre = q * horner(r, CENTRE_TOP[::-1]) / horner(r, CENTRE_BOTTOM[::-1])
    s = F.sqrt(-F.log(F.least(p, 1 - p)))
    near = horner(s - 1.6, SIDE_TOP[::-1]) / horner(s - 1.6, SIDE_BOTTOM[::-1])
    far = horner(s - 5.0, TAIL_TOP[::-1]) / horner(s - 5.0, TAIL_BOTTOM[::-1])
    side = F.when(s <= 5, near).otherwise(far)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, centre).otherwise(F.when(q < 0, -side).otherwise(side)))


def normal_ppf_sql(p: str) -> str:
    q, r = f"({p} - 0.5e0)", f"(0.180625e0 - ({p} - 0.5e0) * ({p} - 0.5e0))"
    s = f"sqrt(-ln(least({p}, 1 - {p})))"
    centre = f"{q} * {horner_sql(r, CENTRE_TOP[::-1])} / {horner_sql(r, CENTRE_BOTTOM[::-1])}"
    near = f"{horner_sql(f'({s} - 1.6e0)', SIDE_TOP[::-1])} / {horner_sql(f'({s} - 1.6e0)', SIDE_BOTTOM[::-1])}"
    far = f"{horner_sql(f'({s} - 5e0)', TAIL_TOP[::-1])} / {horner_sql(f'({s} - 5e0)', TAIL_BOTTOM[::-1])}"
    return f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN abs({q}) <= 0.425e0 THEN {centre} ELSE sign({q}) * CASE WHEN {s} <= 5 THEN {near} ELSE {far} END END)"


def t_series(dof: int) -> tuple[float, ...]:
    """Coefficients of the finite series in cos^2 for whole degrees of freedom, highest power first."""
    odd, out = dof % 2, [1.0]
    for k in range(1, (dof - 1) // 2 if odd else dof // 2):
        out.append(out[-1] * (2 * k / (2 * k + 1) if odd else (2 * k - 1) / (2 * k)))
    return tuple(out[::-1])


def t_cdf(t: Column, dof: int) -> Column:
    """Student's t for whole degrees of freedom, by the finite trigonometric series."""
    c2 = F.lit(float(dof)) / (dof + t * t)
    if dof % 2 == 0:
        area = t / F.sqrt(dof + t * t) * horner(c2, t_series(dof))
    else:
        angle = F.atan(t / math.sqrt(dof))
        area = (angle if dof == 1 else angle + t * math.sqrt(dof) / (dof + t * t) * horner(c2, t_series(dof))) * (2 / math.pi)
    return (1 + area) / 2


def t_cdf_sql(t: str, dof: int) -> str:
    c2 = f"({dof}e0 / ({dof} + {t} * {t}))"
    if dof % 2 == 0:
        area = f"{t} / sqrt({dof} + {t} * {t}) * {horner_sql(c2, t_series(dof))}"
    else:
        angle = f"atan({t} / {math.sqrt(dof)!r})"
        area = f"({angle} + {t} * {math.sqrt(dof)!r} / ({dof} + {t} * {t}) * {horner_sql(c2, t_series(dof)) if dof > 1 else '0e0'}) * {2 / math.pi!r}"
    return f"((1 + {area}) / 2)"


def _lgamma(a: np.ndarray) -> np.ndarray:
    """Of each distinct shape once."""
    own, at = np.unique(a, return_inverse=True)
    return np.array([math.lgamma(x) for x in own])[at].reshape(a.shape)


def _series(s: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Sum of z^k / (s (s + 1) ... (s + k)); what has converged leaves the loop."""
    total = 1 / s
    term, live = total.copy(), np.arange(len(s))
    for k in range(1, 100_000):
        term = term * z[live] / (s[live] + k)
        total[live] += term
        on = np.abs(term) > 1e-17 * np.abs(total[live])
        if not on.all():
            term, live = term[on], live[on]
        if not len(live):
            break
    return total


def _fraction(s: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The continued fraction of the upper function, by the modified method of Lentz; what has converged leaves the loop."""
    live = np.arange(len(s))
    b = z + 1 - s
    c, d = np.full(s.shape, 1e300), 1 / b
    h, out = d.copy(), d.copy()
    for k in range(1, 100_000):
        an, b = -k * (k - s[live]), b + 2
        d, c = an * d + b, b + an / c
        d, c = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d), np.where(np.abs(c) < 1e-300, 1e-300, c)
        step = c * d
        h = h * step
        on = np.abs(step - 1) > (1e-16 if k <= 500 else 1e-14)
        if not on.all():
            out[live[~on]] = h[~on]
            live, b, c, d, h = live[on], b[on], c[on], d[on], h[on]
        if not len(live):
            break
    out[live] = h
    return out


def gamma_p(shape, x) -> np.ndarray:
    """Regularised lower incomplete gamma function: a series below shape + 1, else a continued fraction; nan for bad input."""
    a, x = (np.array(v, dtype=float) for v in np.broadcast_arrays(shape, x))
    out = np.full(a.shape, np.nan)
    ok = np.isfinite(a) & (a > 0) & ~np.isnan(x)
    out[ok & (x <= 0)] = 0.0
    out[ok & np.isposinf(x)] = 1.0
    live = ok & (x > 0) & np.isfinite(x)
    low, high = live & (x < a + 1), live & (x >= a + 1)
    for at, f, one in ((low, _series, False), (high, _fraction, True)):
        if at.any():
            s, z = a[at], x[at]
            p = f(s, z) * np.exp(s * np.log(z) - z - _lgamma(s))
            out[at] = 1 - p if one else p
    return out


def gamma_q(shape, p) -> np.ndarray:
    """Inverse of gamma_p: a cube of a normal quantile, or a power for small shapes, made good by steps of the third order inside a bracket."""
    a, p = (np.array(v, dtype=float) for v in np.broadcast_arrays(shape, p))
    out = np.full(a.shape, np.nan)
    ok = np.isfinite(a) & (a > 0) & (p >= 0) & (p <= 1)
    out[ok & (p == 0)], out[ok & (p == 1)] = 0.0, np.inf
    live = ok & (p > 0) & (p < 1)
    if not live.any():
        return out
    s, want, logs = a[live], p[live], _lgamma(a[live])
    t = np.sqrt(-2 * np.log(np.minimum(want, 1 - want)))
    z = np.sign(want - 0.5) * (t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3))
    cube = s * (1 - 1 / (9 * s) + z / (3 * np.sqrt(s))) ** 3
    power = np.exp((np.log(want) + np.log(s) + logs) / s)
    x = np.where((s > 0.5) & (cube > 0.1 * s), cube, np.minimum(power, s + 10 * np.sqrt(s) + 10))
    x = np.maximum(x, 1e-300)
    lo, hi, at = np.zeros(len(s)), np.full(len(s), np.inf), np.arange(len(s))
    for _ in range(200):
        own, here = s[at], x[at]
        gap = gamma_p(own, here) - want[at]
        lo[at], hi[at] = np.where(gap < 0, here, lo[at]), np.where(gap >= 0, here, hi[at])
        with np.errstate(all="ignore"):
            u = gap / np.exp((own - 1) * np.log(here) - here - logs[at])
            new = here - u / (1 - 0.5 * np.clip(u * ((own - 1) / here - 1), -1, 1))
        middle = np.where(np.isinf(hi[at]), 2 * here, np.where(lo[at] > 0, np.sqrt(lo[at]) * np.sqrt(np.where(np.isinf(hi[at]), 1, hi[at])), hi[at] / 2))
        new = np.where((new > lo[at]) & (new < hi[at]), new, middle)
        x[at] = new
        at = at[np.abs(new - here) > 4e-16 * new]
        if not len(at):
            break
    out[live] = x
    return out


@F.pandas_udf(DoubleType())
def gamma_cdf(x: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.Series:
    return pd.Series(gamma_p(shape, x / scale))


@F.pandas_udf(DoubleType())
def gamma_ppf(p: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.Series:
    return pd.Series(gamma_q(shape, p) * scale.to_numpy(dtype=float))
