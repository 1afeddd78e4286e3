"""Lock-step and elastic distances of two series, as Column expressions.

Lock-step distances are built-in array functions. An elastic distance is a dynamic programme,
whose cells depend on the one above, the one before and the one on the diagonal. All cells of
an anti-diagonal are independent, so an Arrow batch of pairs is solved with one vector step a
diagonal for all pairs of equal lengths. The work is quadratic in the length, memory linear;
a pair stays in its row, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.arrays import mean
from chronoloom.session import ship

INF = float("inf")


def minkowski(x: Column, y: Column, p: float = 2.0) -> Column:
    parts = F.zip_with(x, y, lambda a, b: F.pow(F.abs(a - b), F.lit(float(p))))
    return F.pow(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v), F.lit(1.0 / p))


def squared(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(squared(x, y))


class Cells:
    """What a cell rule sees of one anti-diagonal, for all pairs: i, j from 1, points a, b and those before them, and the three ways in."""

    def __init__(self, i, j, a, b, a_before, b_before, diagonal, up, left, n, m):
        self.i, self.j, self.a, self.b, self.a_before, self.b_before = i, j, a, b, a_before, b_before
        self.diagonal, self.up, self.left, self.n, self.m = diagonal, up, left, n, m


def programme(x: np.ndarray, y: np.ndarray, rule: Callable[[Cells], np.ndarray], row0: np.ndarray, column0: np.ndarray, allowed=None, abandon: float = INF, table: bool = False):
    """Last cells of the tables of pairs x (pairs, n), y (pairs, m); ``row0`` is (pairs, m + 1), ``column0`` (pairs, n + 1).

    ``allowed(i, j)`` masks cells out. A pair whose last two diagonals exceed ``abandon`` throughout
    gets infinity. With ``table`` the whole tables come back, for paths.
    """
    pairs, n, m = len(x), x.shape[1], y.shape[1]
    before = lambda s: np.concatenate([np.zeros((pairs, 1)), s[:, :-1]], axis=1)
    xb, back, back_before = before(x), y[:, ::-1], before(y)[:, ::-1]
    older, old = np.full((pairs, n + 1), INF), np.full((pairs, n + 1), INF)
    older[:, 0] = row0[:, 0]
    old[:, 0], old[:, 1] = row0[:, 1] if m else INF, column0[:, 1] if n else INF
    spare = np.full((pairs, n + 1), INF)
    lost = np.zeros(pairs, bool)
    full = np.full((pairs, n + 1, m + 1), INF) if table else None
    if table:
        full[:, 0, :], full[:, :, 0] = row0, column0
    for s in range(2, n + m + 1):
        lo, hi = max(1, s - m), min(n, s - 1)
        i = np.arange(lo, hi + 1)
        yy = slice(m - s + lo, m - s + hi + 1)
        now = spare  # its cells are of three diagonals ago
        now[:, : lo + 1] = INF
        now[:, hi + 1 :] = INF
        cells = Cells(i, s - i, x[:, lo - 1 : hi], back[:, yy], xb[:, lo - 1 : hi], back_before[:, yy], older[:, lo - 1 : hi], old[:, lo - 1 : hi], old[:, lo : hi + 1], n, m)
        value = rule(cells)
        if allowed is not None:
            value = np.where(allowed(i, s - i), value, INF)
        now[:, lo : hi + 1] = value
        if s <= m:
            now[:, 0] = row0[:, s]
        if s <= n:
            now[:, s] = column0[:, s]
        if table:
            full[:, i, s - i] = value
        if abandon < INF:
            lost |= np.minimum(now.min(axis=1), old.min(axis=1)) > abandon
        older, old, spare = old, now, older
    out = old[:, n] if n and m else np.full(pairs, INF)
    out = np.where(lost, INF, out)
    return (out, full) if table else out


def _walls(x, y):
    row, column = np.full((len(x), y.shape[1] + 1), INF), np.full((len(x), x.shape[1] + 1), INF)
    row[:, 0] = column[:, 0] = 0.0
    return row, column


def _zeros(x, y):
    return np.zeros((len(x), y.shape[1] + 1)), np.zeros((len(x), x.shape[1] + 1))


def band(window: float, n: int, m: int):
    """Cells whose shares of the two lengths differ by at most ``window``; all at 1."""
    return None if window >= 1 else lambda i, j: np.abs(i / n - j / m) <= window


def parallelogram(slope: float, n: int, m: int):
    """Itakura's parallelogram: slopes between 1 / ``slope`` and ``slope`` from both corners."""

    def inside(i, j):
        u, v, w, z = i / n, j / m, 1 - (i - 1) / n, 1 - (j - 1) / m
        return (v <= slope * u) & (u <= slope * v) & (z <= slope * w) & (w <= slope * z)

    return inside


def _dtw(x, y, window=1.0, p=2.0, penalty=0.0, weight=None, itakura=None, abandon=INF, table=False):
    def rule(c):
        d = c.a - c.b
        cost = d * d if p == 2 else np.abs(d) ** p
        cost = cost if weight is None else cost * weight(np.abs(c.i - c.j), c.n)
        return cost + np.minimum(c.diagonal, np.minimum(c.up, c.left) + penalty)

    allowed = parallelogram(itakura, x.shape[1], y.shape[1]) if itakura else band(window, x.shape[1], y.shape[1])
    return programme(x, y, rule, *_walls(x, y), allowed, abandon, table)


def _slope(x):
    """((x[j] - x[j-1]) + (x[j+1] - x[j-1]) / 2) / 2 of the inner points."""
    return ((x[:, 1:-1] - x[:, :-2]) + (x[:, 2:] - x[:, :-2]) / 2) / 2


def _wdtw(x, y, g=0.05, window=1.0):
    return _dtw(x, y, window, weight=lambda d, n: 1.0 / (1.0 + np.exp(-g * (d - n / 2.0))))


def _erp(x, y, gap=0.05, window=1.0):
    away = lambda v: np.abs(v - gap)
    run = lambda s: np.concatenate([np.zeros((len(s), 1)), np.cumsum(away(s), axis=1)], axis=1)
    rule = lambda c: np.minimum(c.diagonal + np.abs(c.a - c.b), np.minimum(c.up + away(c.a), c.left + away(c.b)))
    return programme(x, y, rule, run(y), run(x), band(window, x.shape[1], y.shape[1]))


def _edr(x, y, epsilon=None, window=1.0):
    """Points match within ``epsilon``, by default a quarter of the larger deviation of the two."""
    e = np.maximum(x.std(axis=1), y.std(axis=1))[:, None] / 4 if epsilon is None else epsilon
    rule = lambda c: np.minimum(c.diagonal + (np.abs(c.a - c.b) > e), np.minimum(c.up, c.left) + 1.0)
    return programme(x, y, rule, *_zeros(x, y), band(window, x.shape[1], y.shape[1])) / max(x.shape[1], y.shape[1])


def _lcss(x, y, epsilon=1.0, window=1.0):
    rule = lambda c: np.where(np.abs(c.a - c.b) <= epsilon, c.diagonal + 1.0, np.maximum(c.up, c.left))
    allowed = band(window, x.shape[1], y.shape[1])
    held = (lambda c: np.where(allowed(c.i, c.j), rule(c), 0.0)) if allowed else rule
    return 1.0 - programme(x, y, held, *_zeros(x, y)) / min(x.shape[1], y.shape[1])


def _msm(x, y, c=1.0, window=1.0):
    """Move-split-merge."""

    def split(v, a, b):
        inside = ((a <= v) & (v <= b)) | ((a >= v) & (v >= b))
        return np.where(inside, c, c + np.minimum(np.abs(v - a), np.abs(v - b)))

    def rule(k):
        up = np.where(k.i == 1, INF, k.up + split(k.a, k.a_before, k.b))
        left = np.where(k.j == 1, INF, k.left + split(k.b, k.a, k.b_before))
        return np.minimum(k.diagonal + np.abs(k.a - k.b), np.minimum(up, left))

    return programme(x, y, rule, *_walls(x, y), band(window, x.shape[1], y.shape[1]))


def _twe(x, y, nu=0.001, lam=1.0, window=1.0):
    """Time warp edit; the points before the series are 0."""

    def rule(c):
        match = c.diagonal + np.abs(c.a - c.b) + np.abs(c.a_before - c.b_before) + 2 * nu * np.abs(c.i - c.j)
        return np.minimum(match, np.minimum(c.up + np.abs(c.a - c.a_before), c.left + np.abs(c.b - c.b_before)) + nu + lam)

    return programme(x, y, rule, *_walls(x, y), band(window, x.shape[1], y.shape[1]))


def _soft_dtw(x, y, gamma=1.0, window=1.0):
    """DTW with the soft minimum -gamma * log(sum(exp(-v / gamma)))."""

    def rule(c):
        ways = np.stack([c.diagonal, c.up, c.left])
        low = ways.min(axis=0)
        low = np.where(np.isinf(low), 0.0, low)
        with np.errstate(divide="ignore"):
            return (c.a - c.b) ** 2 + low - gamma * np.log(np.exp(-(ways - low) / gamma).sum(axis=0))

    return programme(x, y, rule, *_walls(x, y), band(window, x.shape[1], y.shape[1]))


def _shape_dtw(x, y, reach=15, window=1.0):
    """DTW over the stretches of ``reach`` points on either side of each point, the ends repeated."""

    def around(s):
        wide = np.pad(s, ((0, 0), (reach, reach)), mode="edge")
        return np.lib.stride_tricks.sliding_window_view(wide, 2 * reach + 1, axis=1)

    p, q = around(x), around(y)
    place = lambda s: np.broadcast_to(np.arange(s.shape[1], dtype=float), s.shape)
    rows = np.arange(len(x))[:, None]

    def rule(c):
        d = p[rows, c.i - 1] - q[rows, c.j - 1]
        return (d * d).sum(axis=2) + np.minimum(c.diagonal, np.minimum(c.up, c.left))

    return programme(place(x), place(y), rule, *_walls(x, y), band(window, x.shape[1], y.shape[1]))


#: Elastic distances of arrays (pairs, n), (pairs, m).
ELASTIC: dict[str, Callable] = {
    "dtw": _dtw, "ddtw": lambda x, y, **k: _dtw(_slope(x), _slope(y), **k), "wdtw": _wdtw, "wddtw": lambda x, y, **k: _wdtw(_slope(x), _slope(y), **k),
    "adtw": lambda x, y, penalty=1.0, window=1.0: _dtw(x, y, window, penalty=penalty), "erp": _erp, "edr": _edr, "lcss": _lcss, "msm": _msm, "twe": _twe,
    "soft_dtw": _soft_dtw, "shape_dtw": _shape_dtw,
}
LOCK_STEP = {"euclidean": euclidean, "squared": squared, "minkowski": minkowski}
NAMES = [*LOCK_STEP, *ELASTIC]
#: Defaults of a distance asked for by name.
DEFAULTS = {"dtw": {"window": 0.2}, "ddtw": {"window": 0.2}, "lcss": {"epsilon": 1.0}, "erp": {"gap": 0.05}, "msm": {"c": 1.0}, "twe": {"nu": 0.001, "lam": 1.0}, "adtw": {"penalty": 1.0}}


def batch(name: str, xs: list, ys: list, most: int = 1 << 24, **parameters) -> np.ndarray:
    """The distance of each pair of a list; pairs of equal lengths are solved together, ``most`` numbers of a diagonal at a time. An empty series has no distance (NaN)."""
    f, out = ELASTIC[name], np.full(len(xs), np.nan)
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
        if x is not None and y is not None and len(x) and len(y):
            groups.setdefault((len(x), len(y)), []).append(k)
    for (n, _), rows in groups.items():
        step = max(1, most // (64 * n))
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            out[part] = f(np.array([xs[k] for k in part], float), np.array([ys[k] for k in part], float), **parameters)
    return out


def distance(name: str | Callable, x: Column, y: Column, **parameters) -> Column:
    """Distance by name, or by a function of two Columns; an unknown name is an error."""
    if callable(name):
        return name(x, y, **parameters)
    if name not in NAMES:
        raise ValueError(f"unknown distance {name!r}")
    parameters = DEFAULTS.get(name, {}) | parameters
    if name in LOCK_STEP:
        return LOCK_STEP[name](x, y, **parameters)
    if spark := SparkSession.getActiveSession():
        ship(spark)

    @F.pandas_udf("double")
    def elastic(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(batch(name, a.tolist(), b.tolist(), **parameters))

    return elastic(x, y)


def _named(name):
    def f(x: Column, y: Column, **parameters) -> Column:
        return distance(name, x, y, **parameters)

    f.__name__ = name
    return f


dtw, adtw, msm, erp, twe = (_named(n) for n in ("dtw", "adtw", "msm", "erp", "twe"))


def path(x: list[float], y: list[float], **parameters) -> list[tuple[int, int]]:
    """The cheapest DTW alignment of two series as pairs of places from 0; a diagonal step wins a tie."""
    _, full = _dtw(np.array([x], float), np.array([y], float), table=True, **parameters)
    t, i, j, out = full[0], len(x), len(y), []
    while i and j:
        out.append((i - 1, j - 1))
        ways = [(t[i - 1, j - 1], i - 1, j - 1), (t[i - 1, j], i - 1, j), (t[i, j - 1], i, j - 1)]
        _, i, j = min(ways, key=lambda w: w[0])
    return out[::-1]


def paths(pairs, x: str = "x", y: str = "y", **parameters):
    """Add ``path``, the cheapest DTW alignment (array of structs i, j), to rows with two series."""
    ship(pairs.sparkSession)

    @F.pandas_udf("array<struct<i:int,j:int>>")
    def align(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"i": i, "j": j} for i, j in path(u.tolist(), v.tolist(), **parameters)] for u, v in zip(a, b, strict=True)])

    return pairs.withColumn("path", align(F.col(x), F.col(y)))


def warp_penalty(series, key: str, x: str = "x", seed: int = 0):
    """One row: the mean squared distance of random pairs of series, each with the next in hash order, the scale for the penalty off the diagonal.

    Pairs are made within partitions of the hash order, so no task sees all series.
    """
    from pyspark.sql import Window

    dealt = series.select(key, x, F.xxhash64(F.lit(seed), key).alias("h")).withColumn("part", F.shiftright("h", 54))
    other = F.lead(x).over(Window.partitionBy("part").orderBy("h", key))
    return dealt.withColumn("y", other).where("y is not null").agg(F.avg(squared(F.col(x), F.col("y"))).alias("penalty"), F.count("*").alias("pairs"))


def column_deviation(series, x: str = "x"):
    """Sum over time points of the population deviation across series: the scale of ERP's gap."""
    points = series.select(F.posexplode(x).alias("t", "v")).groupBy("t").agg(F.stddev_pop("v").alias("s"))
    return points.agg(F.sum("s").alias("deviation"))


__all__ = [*LOCK_STEP, "NAMES", "adtw", "batch", "distance", "dtw", "erp", "mean", "msm", "path", "paths", "programme", "twe"]
