"""Statistics as column expressions: intervals, shrinkage, exact tests, false discovery, ramps. Nulls in give nulls out."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Two-sided 95 %.
Z95 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """FN-MATH-05: Wilson's interval of k of n, within [0, 1]; (0, 1) without trials."""
    n_ = n.cast("double")
    p = F.try_divide(k, n_)
    spread = 1 + z * z / n_
    centre = (p + z * z / (2 * n_)) / spread
    half = z / spread * F.sqrt(p * (1 - p) / n_ + z * z / (4 * n_ * n_))
    none = n <= 0
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)), F.when(none, 1.0).otherwise(F.least(F.lit(1.0), centre + half))


def posterior(k: Column, n: Column, prior: Column, strength: Column) -> Column:
    """FN-MATH-06: beta-binomial posterior mean."""
    return F.try_divide(k + prior * strength, n + strength)


def transported(rate: Column, own_base: Column, other_base: Column, clip: float = 1e-3) -> Column:
    """FN-MATH-08: a rate moved to another base by its log-odds shift."""
    logit = lambda p: F.ln(bounded(p, clip) / (1 - bounded(p, clip)))
    return 1 / (1 + F.exp(-(logit(other_base) + logit(rate) - logit(own_base))))


def bounded(p: Column, clip: float) -> Column:
    return F.greatest(F.lit(clip), F.least(F.lit(1 - clip), p))


def effective(weight: Column) -> Column:
    """AGG-05: Kish's effective count of weighted rows."""
    return F.try_divide(F.pow(F.sum(weight), 2), F.sum(weight * weight))


def recency(week: Column, reference: Column, half_life: float, usual: Column | None = None) -> Column:
    """WIN-02: weight halves every half_life weeks; weeks after the reference weigh 1. Unknown weeks count as the usual one (the median of the entity's), or weigh 1 without one."""
    known = week if usual is None else F.coalesce(week, usual)
    return F.coalesce(F.pow(F.lit(0.5), F.greatest(reference - known, F.lit(0)) / max(half_life, 1e-6)), F.lit(1.0))


def benjamini_hochberg(p: Column, order: list[Column], by: list[str] = ()) -> Column:
    """WIN-01: q-values; ties in p are ordered by `order`."""
    base = Window.partitionBy(*by)
    rank = F.row_number().over(base.orderBy(p.asc(), *order))
    raw = p * F.count(p).over(base) / rank
    return F.least(F.lit(1.0), F.min(raw).over(base.orderBy(p.desc(), *(o.desc() for o in order)).rowsBetween(Window.unboundedPreceding, 0)))


def _outward(log_mass: float, at: int, step: int, end: int, log_ratio: Callable[[np.ndarray], np.ndarray], size: int = 1024) -> float:
    """The total of a unimodal law's terms from `at` on, away from its mode, until they vanish; log_ratio(i): of term i + 1 to term i."""
    total, here, last = math.exp(log_mass), at, log_mass
    floor = log_mass - 45.0
    while here != end and last > floor:
        n = min(size, abs(end - here))
        i = here + step * np.arange(n, dtype=np.float64)
        with np.errstate(divide="ignore"):
            logs = last + np.cumsum(log_ratio(i) if step > 0 else -log_ratio(i - 1))
        total += float(np.exp(logs).sum())
        here, last, size = here + step * n, float(logs[-1]), size * 2
    return total


def _two_sided(k: int, lo: int, hi: int, mode: int, log_mass: Callable[[int], float], log_ratio: Callable[[np.ndarray], np.ndarray]) -> float:
    """The total of all terms no likelier than k's: one walk outward from k, one from the first such term beyond the mode."""
    own = log_mass(k)
    step = -1 if k <= mode else 1
    total = _outward(own, k, step, lo if step < 0 else hi, log_ratio)
    end = hi if step < 0 else lo
    near = max(mode, k + 1) if step < 0 else min(mode, k - 1)
    if (end - near) * -step < 0 or log_mass(end) > own + 1e-7:
        return min(1.0, total)
    far = end
    while near != far:
        mid = near + ((far - near) // 2 if far > near else -((near - far) // 2))
        near, far = (near, mid) if log_mass(mid) <= own + 1e-7 else (mid - step, far)
    return min(1.0, total + _outward(log_mass(far), far, -step, end, log_ratio))


def binomial_p_value(k: int, n: int, p: float) -> float:
    """Two-sided exact binomial: the total of outcomes no likelier than k. No array grows with n beyond what does not vanish."""
    if n <= 0:
        return 1.0
    if p <= 0 or p >= 1:
        return 1.0 if k == n * (p >= 1) else 0.0
    a, b, whole, odds = math.log(p), math.log1p(-p), math.lgamma(n + 1), math.log(p) - math.log1p(-p)
    mass = lambda i: whole - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * a + (n - i) * b
    return _two_sided(k, 0, n, min(n, int((n + 1) * p)), mass, lambda i: np.log((n - i) / (i + 1)) + odds)


def fisher_p_value(a: int, n: int, c: int, m: int) -> float:
    """Two-sided exact test of a of n against c of m."""
    total, hits = n + m, a + c
    if n <= 0 or m <= 0:
        return 1.0
    g = math.lgamma
    whole = g(n + 1) + g(m + 1) - (g(total + 1) - g(hits + 1) - g(total - hits + 1))
    mass = lambda i: whole - g(i + 1) - g(n - i + 1) - g(hits - i + 1) - g(m - hits + i + 1)
    lo, hi = max(0, hits - m), min(n, hits)
    mode = min(hi, max(lo, (n + 1) * (hits + 1) // (total + 2)))
    return _two_sided(a, lo, hi, mode, mass, lambda i: np.log((n - i) * (hits - i) / ((i + 1) * (m - hits + i + 1))))


def two_proportion_value(k: int, n: int, rate: float, baseline_n: int | None) -> float:
    """k of n against a rate that comes from baseline_n trials: taken as known beyond 20 n of them, else as a sample of its own."""
    if n <= 0:
        return 1.0
    rate = min(1 - 1e-9, max(1e-9, rate))
    if baseline_n is None or baseline_n > 20 * n:
        return binomial_p_value(k, n, rate)
    return fisher_p_value(k, n, round(rate * baseline_n), baseline_n)


@F.pandas_udf(T.DoubleType())
def binomial_p(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """FN-MATH-07, in Arrow batches."""
    return pd.Series([None if x != x or y != y or z != z else binomial_p_value(int(x), int(y), z) for x, y, z in zip(k, n, p, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, n: pd.Series, c: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([None if any(v != v for v in r) else fisher_p_value(*map(int, r)) for r in zip(a, n, c, m, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def two_proportion_p(k: pd.Series, n: pd.Series, rate: pd.Series, baseline_n: pd.Series) -> pd.Series:
    """FN-MATH-07: either test, whichever a cell needs."""
    return pd.Series([None if any(v != v for v in r) else two_proportion_value(int(r[0]), int(r[1]), float(r[2]), int(r[3])) for r in zip(k, n, rate, baseline_n, strict=True)], dtype="float64")


def chi_square_tail(x: float, df: int) -> float:
    """FN-MATH-17: P(chi-square of df > x), by the series or the continued fraction of the incomplete gamma function."""
    if x <= 0 or df <= 0:
        return 1.0
    a, t = df / 2, x / 2
    front = math.exp(-t + a * math.log(t) - math.lgamma(a))
    if t < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= t / n
            total += term
        return max(0.0, 1 - total * front)
    b = t + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(T.DoubleType())
def chi_square_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if v != v or d != d else chi_square_tail(float(v), int(d)) for v, d in zip(x, df, strict=True)], dtype="float64")


def criterion_score(value: Column, good: float, best: float) -> Column:
    """FN-MATH-16: 10 at best, 8 at good, below it in proportion and 1 at least."""
    ramp = 8 + 2 * (value - good) / (best - good)
    return F.when(value >= best, 10.0).when(value >= good, ramp).otherwise(F.greatest(F.lit(1.0), 7 * value / good))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """FN-MATH-18: over an array, at a temperature."""
    scaled = F.transform(logits, lambda x: F.exp((x - F.array_max(logits)) / temperature))
    return F.transform(scaled, lambda x: x / F.aggregate(scaled, F.lit(0.0), lambda a, b: a + b))
