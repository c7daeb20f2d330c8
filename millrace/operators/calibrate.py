"""Calibration and Beta scores: temperature fits, quantiles, ensembles, divergences."""

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def negative_log_likelihood(logits: Column, gold: Column, temperature) -> Column:
    """Of the gold place (from 0) of an array of logits divided by a temperature."""
    z = F.transform(logits, lambda x: x / temperature)
    most = F.array_max(z)
    total = F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - most))
    return F.log(total) + most - F.element_at(z, gold + 1)


def fit_temperature(rows: DataFrame, logits: str, gold: str, low=0.05, high=20.0, tolerance=0.01) -> float:
    """The temperature of least mean loss, by narrowing a bracket of its logarithm (the mean loss has one valley there).

    Every pass is one aggregate over all rows that prices seven trial values at once; only means reach the driver.
    """

    def losses(trials: list[float]) -> list[float]:
        means = [F.avg(negative_log_likelihood(F.col(logits), F.col(gold), F.lit(t))) for t in trials]
        return list(rows.agg(*[m.alias(f"m{k}") for k, m in enumerate(means)]).first())

    a, b = math.log(low), math.log(high)
    while b - a > tolerance:
        trials = [a + (b - a) * k / 8 for k in range(1, 8)]
        found = losses([math.exp(t) for t in trials])
        if found[0] is None:
            return 1.0  # no rows: leave the logits alone
        best = int(np.argmin(found))
        a, b = a + (b - a) * best / 8, a + (b - a) * (best + 2) / 8
    return math.exp((a + b) / 2)


def _by_pandas(f: Callable, kind: str = "double") -> Callable:
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([f(*x) if all(v is not None and v == v for v in x) else None for x in zip(*columns)], dtype="float64")

    return F.pandas_udf(run, kind)


def log_beta_density(x: float, a: float, b: float) -> float:
    return (a - 1) * math.log(x) + (b - 1) * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)


_U = np.linspace(0, 1, 2049)
_SIMPSON = np.where(np.arange(2049) % 2 == 1, 4.0, 2.0)
_SIMPSON[[0, -1]] = 1.0


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in x])


def _lower_share(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # t = x * u ** (3 / a) makes the integral x ** a / a * mean over u of (1 - t) ** (b - 1) * 3 u ** 2
    t = x[:, None] * (_U**3)[None, :] ** (1 / a)[:, None]
    f = (1 - t) ** (b - 1)[:, None] * (3 * _U**2)[None, :]
    log_gammas = _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)
    return np.exp(a * np.log(x) - np.log(a) + log_gammas) * (f @ _SIMPSON) / (3 * (len(_U) - 1))


def beta_shares(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by Simpson's rule on a substitution that removes the end poles."""
    x, a, b = (np.asarray(v, dtype=float) for v in (x, a, b))
    out = (x >= 1).astype(float)
    inside = (x > 0) & (x < 1)
    flip = x > a / (a + b)
    for side, args in ((inside & ~flip, (x, a, b)), (inside & flip, (1 - x, b, a))):
        if side.any():
            share = _lower_share(*(v[side] for v in args))
            out[side] = share if args[0] is x else 1 - share
    return out


def beta_share(x: float, a: float, b: float) -> float:
    return float(beta_shares(np.array([x]), np.array([a]), np.array([b]))[0])


def beta_quantiles(p: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 512) -> np.ndarray:
    """Bisection on whole arrays, a block of rows at a time."""
    out = np.empty(len(p))
    for i in range(0, len(p), block):
        part = slice(i, i + block)
        low, high = np.zeros(len(p[part])), np.ones(len(p[part]))
        for _ in range(60):
            mid = (low + high) / 2
            less = beta_shares(mid, a[part], b[part]) < p[part]
            low, high = np.where(less, mid, low), np.where(less, high, mid)
        out[part] = (low + high) / 2
    return out


def beta_quantile(p: float, a: float, b: float) -> float:
    return float(beta_quantiles(*(np.array([float(v)]) for v in (p, a, b)))[0])


@F.pandas_udf(DoubleType())
def _quantiles(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    columns = [np.asarray(v, dtype=float) for v in (p, a, b)]
    whole = ~np.isnan(np.stack(columns)).any(axis=0) & (columns[1] > 0) & (columns[2] > 0)
    out = np.full(len(p), np.nan)
    out[whole] = beta_quantiles(*(v[whole] for v in columns))
    return pd.Series(out)


def beta_nll(x: Column, mu: Column, kappa: Column) -> Column:
    """Minus the log density at x of the Beta of mean mu and concentration kappa."""
    return -_by_pandas(log_beta_density)(x, mu * kappa, (1 - mu) * kappa)


def beta_interval(mu: Column, kappa: Column, share: float = 0.9) -> tuple[Column, Column]:
    return tuple(_quantiles(F.lit(p), mu * kappa, (1 - mu) * kappa) for p in ((1 - share) / 2, (1 + share) / 2))


def squeeze(unit: Column, n: int = 100) -> Column:
    """A unit value moved inside (0, 1)."""
    return (F.least(F.lit(1.0), F.greatest(F.lit(0.0), unit)) * (n - 1) + 0.5) / n


def to_step(unit: Column, low: float, high: float, step: float) -> Column:
    """A unit value on its scale, at the nearest step from low; halves go to the even step."""
    return low + F.bround(unit * (high - low) / step) * step


def ensemble(systems: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """Means of the columns over systems, for keys that every system has."""
    rows = systems[0].select(key, *columns)
    for s in systems[1:]:
        rows = rows.unionByName(s.select(key, *columns))
    means = rows.groupBy(key).agg(F.count("*").alias("__n"), *[F.avg(c).alias(c) for c in columns])
    return means.where(F.col("__n") == len(systems)).drop("__n")


def symmetric_divergence(p: list[Column], q: list[Column]) -> Column:
    """Sum of (p - q)(log p - log q)."""
    floor = F.lit(1e-12)
    parts = [(a - b) * (F.log(F.greatest(a, floor)) - F.log(F.greatest(b, floor))) for a, b in zip(p, q)]
    return sum(parts[1:], parts[0])


def fill_capped(weights: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Shares of total by weight, none above its cap; what a cap frees goes to the others. For short tables."""
    given, open_, left = {}, dict(weights), float(total)
    while open_:
        scale = left / (sum(open_.values()) or 1.0)
        full = [k for k, w in open_.items() if w * scale >= caps[k]]
        if not full:
            return given | {k: w * scale for k, w in open_.items()}
        for k in full:
            given[k] = float(caps[k])
            left -= caps[k]
            del open_[k]
    return given
