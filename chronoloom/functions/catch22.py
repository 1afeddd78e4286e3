"""The 22 canonical features of a series, computed in one Arrow pass.

Features with a plain Column form are in ``arrays``; here all 22 are vector expressions over
one series in memory. A series too short for a feature, or flat where it divides by spread, gives NaN.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from chronoloom.session import ship

#: Short names, in the usual order (fixed values).
NAMES = (
    "mode_5", "mode_10", "acf_timescale", "acf_first_min", "ami2", "trev", "high_fluctuation", "stretch_high", "transition_matrix", "periodicity", "embedding_dist",
    "ami_timescale", "whiten_timescale", "outlier_timing_pos", "outlier_timing_neg", "centroid_freq", "stretch_decreasing", "entropy_pairs", "rs_range", "dfa", "low_freq_power", "forecast_error",
)


def _mode(x, bins):
    counts, edges = np.histogram(x, bins)
    return float(((edges[:-1] + edges[1:]) / 2)[counts == counts.max()].mean()) if x.max() > x.min() else np.nan


def _stretch(flags) -> int:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return int((edge[1::2] - edge[::2]).max()) if len(edge) else 0


def _spectrum(x):
    return np.fft.fft(x - x.mean(), 1 << int(np.ceil(np.log2(len(x)))))


def _acf(x, length: int | None = None):
    """Autocorrelation by the transform of ``length``, by default the next power of two; zeros for a flat series."""
    f = _spectrum(x) if length is None else np.fft.fft(x - x.mean(), length)
    c = np.fft.ifft(f * f.conj()).real
    return c[: len(x)] / c[0] if c[0] else np.zeros(len(x))


def _first(flags, otherwise):
    at = np.flatnonzero(flags)
    return int(at[0]) if len(at) else otherwise


def _valley(a, otherwise):
    return _first((a[1:-1] < a[:-2]) & (a[1:-1] < a[2:]), otherwise - 1) + 1


def _zero(acf):
    return _first(acf[1:] <= 0, len(acf) - 1) + 1


def _crossing(acf):
    """Where the autocorrelation first falls below 1 / e, between two lags by a straight line."""
    k = _first(acf[1:-1] < np.exp(-1), -1)
    return float(k + (np.exp(-1) - acf[k]) / (acf[k + 1] - acf[k])) if k >= 0 else float(len(acf))


def _letters(x, groups):
    """1 .. groups by quantiles that lie half-way between order statistics."""
    cuts = np.quantile(x, np.arange(1, groups) / groups, method="hazen")
    return 1 + (x[:, None] > cuts).sum(axis=1)


def _outliers(x):
    """Median over thresholds, 0.01 apart, of the median place of the values above, from -1 to 1."""
    top, total = x.max(), int((x >= 0).sum())
    if top < 0.01:
        return 0.0
    steps, held, medians = int(top / 0.01) + 1, [], []
    busy, far = 0, int(top / 0.01)
    for v in np.unique(x[x >= 0]).tolist():  # thresholds between two values have the same places above
        k = int(v / 0.01)
        k += (k + 1) * 0.01 <= v
        k -= k * 0.01 > v
        upto = min(k + 1, steps)
        if upto <= (held[-1] if held else 0):
            continue
        at = np.flatnonzero(x >= v) + 1
        medians.append((at[(len(at) - 1) // 2] + at[len(at) // 2]) / 2 / (len(x) / 2) - 1)
        held.append(upto)
        if (len(at) - 1) * 100 / total > 2:
            busy = upto - 1
        if len(at) == 1:
            far = steps - upto
    if held[-1] < steps:  # a threshold above the top by rounding
        held.append(steps)
        medians.append(0.0)
    n = max(busy, far) + 1
    order = np.argsort(medians, kind="stable")
    upto = np.minimum(held, n)
    many = np.cumsum(np.diff(upto, prepend=0)[order])
    low, high = (medians[order[np.searchsorted(many, i, "right")]] for i in ((n - 1) // 2, n // 2))
    return float((low + high) / 2)


def _power(x):
    """Power at frequencies from 0 to half the length of the transform, and the frequencies."""
    f = _spectrum(x)
    n = len(f) // 2 + 1
    p = np.abs(f[:n]) ** 2 / len(x) / (2 * np.pi)
    p[1:-1] *= 2
    return p, np.arange(n) * 2 * np.pi / len(f)


def _centroid(x):
    p, w = _power(x)
    c = np.cumsum(p)
    k = _first(c[1:] > c[-1] / 2, -1)
    return float(w[k + 1]) if k >= 0 else np.nan


def _low_power(x):
    p, w = _power(x)
    return float(p[: len(p) // 5].sum() * (w[1] - w[0]))


def _mutual(x):
    """Mutual information of points two apart, over five equal bins; a point on an edge falls by the SQL's own arithmetic."""
    low, high = x.min() - 0.1, x.max() + 0.1
    y = np.minimum(np.floor((x - low) / ((high - low) / 5)), 4)
    h = np.histogram2d(y[:-2], y[2:], bins=[np.arange(6), np.arange(6)])[0] / (len(x) - 2)
    base = h.sum(axis=1)[:, None] * h.sum(axis=0)[None]
    return float((h[h > 0] * np.log(h[h > 0] / base[h > 0])).sum())


def _mutual_scale(x):
    top = int(min(40, np.ceil(len(x) / 2)))
    with np.errstate(divide="ignore", invalid="ignore"):
        info = np.array([-0.5 * np.log(1 - np.corrcoef(x[:-k], x[k:])[0, 1] ** 2) for k in range(1, top + 1)])
    return _valley(info, top)


def _pairs(x):
    """Entropy of two-letter words of three letters."""
    y = _letters(x, 3)
    p = np.bincount(y[:-1] * 4 + y[1:], minlength=16) / (len(x) - 1)
    return float(-(p[p > 0] * np.log(p[p > 0])).sum())


def _transitions(x, lag):
    y = _letters(x[:: max(lag, 1)], 3) - 1
    if len(y) < 2:
        return np.nan
    t = np.bincount(y[:-1] * 3 + y[1:], minlength=9).reshape(3, 3) / (len(y) - 1)
    return float(t.var(axis=0, ddof=1).sum())


def _embedding(x, lag):
    """Mean gap between the histogram of steps in the plane (x[t], x[t + lag]) and the exponential density of their mean."""
    lag = int(len(x) / 10) if lag > len(x) / 10 else lag
    n = len(x) - lag - 1
    d = np.hypot(np.diff(x)[:n], np.diff(x)[lag : lag + n])
    if n < 2 or d.std() < 0.001:
        return 0.0
    bins = int(np.ceil((d.max() - d.min()) / (3.5 * d.std(ddof=1) / n ** (1 / 3))))
    counts, edges = np.histogram(d, max(bins, 1))
    middle = (edges[:-1] + edges[1:]) / 2
    return float(np.abs(counts / n - np.exp(-middle / d.mean()) / d.mean()).mean())


def _line(x, y):
    """Residuals of a straight line."""
    m = x - x.mean()
    q = (m * m).sum()
    return y - (y.mean(axis=-1, keepdims=True) + ((m * (y - y.mean(axis=-1, keepdims=True))).sum(axis=-1, keepdims=True) / q if q else 0.0) * m)


def _fluctuation(sums, n, detrended):
    """Share of scales below the break of two lines through log scale and log fluctuation."""
    if n < 4:
        return np.nan
    scales = list(dict.fromkeys(np.concatenate([[5], np.round(np.exp(np.linspace(np.log(5), np.log(n / 2), 50)[1:]) + 1e-12)]).astype(int).tolist()))
    if len(scales) < 12:
        return np.nan
    size = []
    for s in scales:
        rows = len(sums) // s
        blocks = sums[: rows * s].reshape(rows, s) if rows else np.concatenate([sums[: s - 1], np.zeros(s - len(sums[: s - 1]))])[None]
        left = _line(np.arange(1.0, s + 1), blocks)
        size.append(np.sqrt((left * left).mean()) if detrended else np.sqrt(((left.max(axis=1) - left.min(axis=1)) ** 2).mean()))
    with np.errstate(divide="ignore"):
        a, f = np.log(scales), np.log(size)
    ends = range(6, len(scales) - 5)
    misfit = [np.linalg.norm(_line(a[:i], f[:i])) + np.linalg.norm(_line(a[i - 1 :], f[i - 1 :])) for i in ends]
    return (int(np.argmin(misfit)) + 6) / len(scales)


def _period(x):
    """First peak of the autocovariance, at least 0.01 over the valley before it, after a cubic spline with one knot is taken off."""
    t = np.arange(len(x), dtype=float)
    basis = np.stack([np.ones_like(t), t, t**2, t**3, np.maximum(t - (len(x) / 2 - 1), 0) ** 3], axis=1)
    scale = np.abs(basis).max(axis=0)
    y = x - (basis / scale) @ np.linalg.lstsq(basis / scale, x, rcond=None)[0]
    c = np.array([(y[:-k] * y[k:]).mean() for k in range(1, int(np.ceil(len(x) / 3)) + 1)])
    into, out = np.diff(c)[:-1], np.diff(c)[1:]
    valleys, peaks = np.flatnonzero((into < 0) & (out > 0)) + 1, np.flatnonzero((into > 0) & (out < 0)) + 1
    for p in peaks.tolist():
        before = valleys[valleys < p]
        if len(before) and c[p] - c[before[-1]] >= 0.01 and c[p] >= 0:
            return p
    return 0


def features(x: np.ndarray, normal_outliers: bool = False, names: tuple = NAMES) -> dict[str, float]:
    """The features of ``names``, by default all 22; ``normal_outliers`` z-norms the series for the two outlier features."""
    x = np.asarray(x, float)
    if len(x) < 6:
        return dict.fromkeys(names, np.nan)
    flat = x.max() == x.min()
    step, acf = np.diff(x), _acf(x)
    zero = _zero(acf)
    spread = (x - x.mean()) / (x.std() or 1.0) if normal_outliers else x
    made = {
        "mode_5": lambda: _mode(x, 5), "mode_10": lambda: _mode(x, 10), "acf_timescale": lambda: _crossing(acf),
        "acf_first_min": lambda: np.nan if flat else _valley(_acf(x, 4 << int(np.ceil(np.log2(len(x))))), len(x)), "ami2": lambda: _mutual(x), "trev": lambda: float((step**3).mean()),
        "high_fluctuation": lambda: float((np.abs(step) * 1000 > 40).mean()), "stretch_high": lambda: _stretch(x > x.mean()), "transition_matrix": lambda: _transitions(x, zero),
        "periodicity": lambda: _period(x), "embedding_dist": lambda: _embedding(x, zero), "ami_timescale": lambda: np.nan if flat else _mutual_scale(x),
        "whiten_timescale": lambda: _zero(_acf(step)) / zero, "outlier_timing_pos": lambda: _outliers(spread), "outlier_timing_neg": lambda: _outliers(-spread), "centroid_freq": lambda: _centroid(x),
        "stretch_decreasing": lambda: _stretch(step < 0), "entropy_pairs": lambda: _pairs(x), "rs_range": lambda: _fluctuation(np.cumsum(x), len(x), False),
        "dfa": lambda: _fluctuation(np.cumsum(x[::2][: len(x) // 2]), len(x), True), "low_freq_power": lambda: _low_power(x),
        "forecast_error": lambda: float((x[3:] - (x[:-3] + x[1:-2] + x[2:-1]) / 3).std(ddof=1)),
    }
    return {n: made[n]() for n in names}


def catch22(x: Column, normal_outliers: bool = False, names: tuple = NAMES) -> Column:
    """Struct of the features of ``names`` of an array<double>, by default all 22; the others are not computed."""
    if spark := SparkSession.getActiveSession():
        ship(spark)

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([features(v, normal_outliers, names) for v in s], columns=list(names), dtype=float)

    return run(x)
