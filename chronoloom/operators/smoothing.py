"""Error, trend and season smoothing of a series, as a batch function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from chronoloom.session import ship

KINDS = (None, "additive", "multiplicative")


def fit(x: np.ndarray, error="additive", trend=None, season=None, period=1, alpha=0.1, beta=0.01, gamma=0.01, phi=0.99):
    """(level, slope, seasonal terms, one-step errors, fits) after the last point; None if the series is too short.

    Starts: level, the mean of the first season; slope, the mean step (or ratio) from the first
    season to the second; seasonal terms, what is left of the first season.
    """
    if error not in KINDS[1:] or trend not in KINDS or season not in KINDS:
        raise ValueError("error, trend and season are additive, multiplicative or (the last two) None")
    m = period if season else 1
    if len(x) < m + (m if trend else 0) or not len(x):
        return None
    first = x[:m]
    level = first.mean()
    if trend == "additive":
        slope = (x[m : 2 * m] - first).mean() / m
    elif trend == "multiplicative":
        slope = float(np.prod(x[m : 2 * m] / first)) ** (1.0 / (m * m))
    else:
        slope = 0.0
    terms = (first - level if season == "additive" else first / level if season else np.zeros(m)).astype(float)
    errors, fits = np.zeros(len(x)), np.zeros(len(x))
    for t in range(m, len(x)):  # the first season is in the start
        move = slope * phi if trend == "additive" else slope**phi if trend else 0.0
        base = level + move if trend != "multiplicative" else level * move
        s = terms[t % m] if season else 0.0
        fits[t] = base + s if season != "multiplicative" else base * s
        e = x[t] - fits[t]
        errors[t] = e if error == "additive" else e / fits[t]
        pull = e if season != "multiplicative" else e / (s or 1.0)
        new = base + alpha * pull
        if trend == "additive":
            slope = move + beta * pull
        elif trend:
            slope = move + beta * pull / level
        if season:
            terms[t % m] = s + gamma * (e if season == "additive" else e / base)
        level = new
    return level, slope, terms, errors, fits


def forecast(state, n, horizon, trend=None, season=None, period=1, phi=0.99) -> np.ndarray:
    """The next ``horizon`` values after ``n`` points."""
    level, slope, terms = state[:3]
    m, out, reach = (period if season else 1), np.zeros(horizon), 0.0
    for h in range(1, horizon + 1):
        reach += phi**h
        base = level + reach * slope if trend == "additive" else level * slope**reach if trend else level
        s = terms[(n + h - 1) % m]
        out[h - 1] = base + s if season != "multiplicative" else base * s
    return out


def likelihood(errors: np.ndarray, fits: np.ndarray, error: str) -> float:
    """Twice the negative log likelihood, less its constants."""
    n = len(errors)
    base = n * np.log(max((errors**2).sum(), 1e-300))
    return float(base if error == "additive" else base + 2 * np.log(np.maximum(np.abs(fits), 1e-300)).sum())


def smooth(x: Column, horizon: int, error="additive", trend=None, season=None, period=1, alpha=0.1, beta=0.01, gamma=0.01, phi=0.99) -> Column:
    """Struct of forecast (array), mse and likelihood of a series."""
    if spark := SparkSession.getActiveSession():
        ship(spark)

    @F.pandas_udf("forecast array<double>, mse double, likelihood double")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for v in s:
            v = np.asarray(v, float)
            state = fit(v, error, trend, season, period, alpha, beta, gamma, phi)
            start = period if season else 1
            rows.append((None, None, None) if state is None else (
                forecast(state, len(v), horizon, trend, season, period, phi), float((((v - state[4])[start:]) ** 2).mean()) if len(v) > start else None, likelihood(state[3][start:], state[4][start:], error),
            ))
        return pd.DataFrame(rows, columns=["forecast", "mse", "likelihood"])

    return run(x)
