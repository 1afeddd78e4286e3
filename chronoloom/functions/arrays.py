"""Transforms and features of a series (array<double>) as Column expressions.

Each takes and returns Columns, so plans stay in the JVM; a series is one row's array, as
long as one case, never as long as the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def series(points: DataFrame, by: list[str], t: str = "t", v: str = "v") -> DataFrame:
    """Fold points to one array a series, in order of time."""
    return points.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(t, v))), lambda p: p[v]).alias("x"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once; an expression named inside a lambda is else computed at each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def mean(x: Column) -> Column:
    """Null for an empty series."""
    return total(x) / F.nullif(F.size(x), F.lit(0))


def variance(x: Column) -> Column:
    """Population variance by the two-pass formula."""
    squares = let(mean(x), lambda m: F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)))
    return squares / F.nullif(F.size(x), F.lit(0))


def znorm(x: Column) -> Column:
    """Zero mean and unit population deviation; a constant series becomes zeros."""
    moments = F.struct(mean(x).alias("m"), F.sqrt(variance(x)).alias("s"))
    return let(moments, lambda k: F.transform(x, lambda v: F.when(k["s"] == 0, F.lit(0.0)).otherwise((v - k["m"]) / k["s"])))


def pad(x: Column, length: Column | int, fill: str | float = 0.0) -> Column:
    """Fill up at the end to ``length`` with a number or mean, median, min, max or last; a longer series is an error."""
    length = length if isinstance(length, Column) else F.lit(length)
    values = {
        "mean": lambda: mean(x), "min": lambda: F.array_min(x), "max": lambda: F.array_max(x),
        "last": lambda: F.try_element_at(x, F.lit(-1)), "median": lambda: median(x),
    }
    value = values[fill]() if isinstance(fill, str) else F.lit(float(fill))
    full = F.concat(x, F.array_repeat(value, (length - F.size(x)).cast("int")))
    return F.when(F.size(x) > length, F.raise_error(F.lit("series is longer than the padded length"))).otherwise(full)


def median(x: Column) -> Column:
    s, n = F.array_sort(x), F.size(x)
    lower, upper = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return (lower + upper) / 2


def truncate(x: Column, length: int, end: bool = True) -> Column:
    """Keep ``length`` points: the first, or with ``end`` false the last."""
    return F.slice(x, 1, length) if end else F.slice(x, F.greatest(F.size(x) - length, F.lit(0)) + 1, F.lit(length))


def diff(x: Column) -> Column:
    """x[t+1] - x[t]; empty for fewer than two points."""
    n = F.size(x)
    return F.zip_with(F.slice(x, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(x, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda a, b: a - b)


def derivative(x: Column) -> Column:
    """((x[j] - x[j-1]) + (x[j+1] - x[j-1]) / 2) / 2 inside, for at least three points."""
    n = F.size(x)
    inner = F.when(n > 2, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(inner, lambda j: ((F.get(x, j) - F.get(x, j - 1)) + (F.get(x, j + 1) - F.get(x, j - 1)) / 2) / 2)


def resize(x: Column, length: int) -> Column:
    """Linear interpolation to ``length`` points over the same span."""
    n = F.size(x)

    def at(i):
        p = i * (n - 1) / F.lit(max(length - 1, 1))
        k = F.floor(p).cast("int")
        return F.get(x, k) + (p - k) * (F.coalesce(F.get(x, k + 1), F.get(x, k)) - F.get(x, k))

    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at)


def autocorrelation(x: Column, lag: int) -> Column:
    """Pearson correlation of x[:-lag] and x[lag:]; 1 where both are constant, 0 where one is."""
    n = F.size(x) - lag
    a, b = F.slice(x, F.lit(1), n), F.slice(x, F.lit(lag + 1), n)
    means = F.struct(mean(a).alias("a"), mean(b).alias("b"))
    cov = let(means, lambda m: total(F.zip_with(a, b, lambda u, v: (u - m["a"]) * (v - m["b"])))) / n
    va, vb = variance(a), variance(b)
    return F.when((va == 0) & (vb == 0), 1.0).when((va == 0) | (vb == 0), 0.0).otherwise(cov / F.sqrt(va * vb))


def windows(x: Column, width: int, step: int = 1) -> Column:
    """All runs of ``width`` points, ``step`` apart."""
    last = F.size(x) - width
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(x, i + 1, F.lit(width)))


def longest_run(flags: Column) -> Column:
    """Length of the longest stretch of true in an array<boolean>."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(s, v):
        now = F.when(v, s["now"] + 1).otherwise(F.lit(0))
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

    return F.aggregate(flags, start, step, lambda s: s["best"])


def stretch_high(x: Column) -> Column:
    return longest_run(let(mean(x), lambda m: F.transform(x, lambda v: v > m)))


def stretch_decreasing(x: Column) -> Column:
    return longest_run(F.transform(diff(x), lambda v: v < 0))


def trev(x: Column) -> Column:
    """Mean cubed step."""
    return mean(F.transform(diff(x), lambda v: v * v * v))


def pnn40(x: Column) -> Column:
    """Share of steps whose size times 1000 exceeds 40, of the z-normed series."""
    return let(diff(znorm(x)), lambda d: mean(F.transform(d, lambda v: F.when(F.abs(v) * 1000 > 40, 1.0).otherwise(0.0))))


def histogram_mode(x: Column, bins: int) -> Column:
    """Mean of the centres of the fullest of ``bins`` equal bins between the least and greatest value."""

    def with_bounds(k):
        low, width = k["low"], k["width"]
        binned = F.transform(x, lambda v: F.least(F.floor((v - low) / F.nullif(width, F.lit(0.0))).cast("int"), F.lit(bins - 1)))
        counts = let(binned, lambda b: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.size(F.filter(b, lambda c: c == i))))

        def fullest(n):
            best = F.array_max(n)
            return mean(F.filter(F.transform(n, lambda c, i: F.when(c == best, low + (i + 0.5) * width)), lambda v: v.isNotNull()))

        return F.when(width == 0, low).otherwise(let(counts, fullest))

    return let(F.struct(F.array_min(x).alias("low"), ((F.array_max(x) - F.array_min(x)) / bins).alias("width")), with_bounds)


def slope(x: Column) -> Column:
    """Least-squares slope against 0, 1, 2, ..."""
    n = F.size(x)
    c = (n - 1) / 2.0
    num = let(mean(x), lambda m: total(F.transform(x, lambda v, i: (i - c) * (v - m))))
    return num / F.nullif(n * (n * n - 1) / 12.0, F.lit(0.0))


def rocket(x: Column, weights: list[float], bias: float, dilation: int = 1, padding: int = 0) -> tuple[Column, Column]:
    """Share of positive values, and maximum, of the convolution with one kernel; null if the series is too short.

    A value that lies on 0 falls by the order of its sum: the products from the left, then the bias.
    """
    p = F.concat(F.array_repeat(F.lit(0.0), padding), x, F.array_repeat(F.lit(0.0), padding))
    last = F.size(p) - (len(weights) - 1) * dilation - 1
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def at(i):
        out = F.lit(float(weights[0])) * F.get(p, i)
        for k, w in enumerate(weights[1:], 1):
            out = out + F.lit(float(w)) * F.get(p, i + k * dilation)
        return out + F.lit(float(bias))

    conv = F.transform(places, at)
    return let(conv, lambda c: mean(F.transform(c, lambda v: F.when(v > 0, 1.0).otherwise(0.0)))), F.array_max(conv)


def shapelet_distance(x: Column, shapelet: Column) -> Column:
    """Least mean squared distance between the z-normed shapelet and z-normed runs of its length."""
    n = F.size(shapelet)
    starts = F.sequence(F.lit(0), F.size(x) - n)

    def run(s, i):
        return let(znorm(F.slice(x, i + 1, n)), lambda z: total(F.zip_with(z, s, lambda a, b: (a - b) * (a - b))) / n)

    return let(znorm(shapelet), lambda s: F.array_min(F.transform(starts, lambda i: run(s, i))))


def word(x: Column, segments: int, letters: int) -> Column:
    """Symbolic word: segment means of the z-normed series cut at the normal's quartiles, base ``letters`` (2 or 4)."""
    n = F.size(x)
    cuts = {2: (0.0,), 4: (-0.6744897501960817, 0.0, 0.6744897501960817)}[letters]

    def letter(z, k):
        a, b = F.floor(k * n / segments).cast("int"), F.floor((k + 1) * n / segments).cast("int")
        return let(mean(F.slice(z, a + 1, b - a)), lambda m: sum((F.when(m > c, 1).otherwise(0) for c in cuts), F.lit(0)))

    places = F.sequence(F.lit(0), F.lit(segments - 1))
    return let(znorm(x), lambda z: F.aggregate(places, F.lit(0).cast("long"), lambda w, k: w * letters + letter(z, k)))


def noisy_pad(x: Column, length: Column | int, seed: Column, noise: float = 0.1) -> Column:
    """Pad with zeros and add small numbers, within ``noise`` of 0 and fixed by ``seed`` and place, to the padded points."""
    full = pad(x, length)
    small = lambda i: (F.pmod(F.xxhash64(seed, i), F.lit(2000001)) / 1000000.0 - 1) * noise
    return F.transform(full, lambda v, i: F.when(i < F.size(x), v).otherwise(v + small(i)))


def concat_channels(*channels: Column, length: Column | int | None = None) -> Column:
    """The channels of a case end to end, each filled up to ``length`` with zeros if given."""
    return F.concat(*[c if length is None else pad(c, length) for c in channels])


def unequal(x: Column, seed: Column, share: float = 0.8, least: float = 0.2, how: str = "end") -> Column:
    """Of a ``share`` of cases, fixed by ``seed``, only from ``least`` to all of the length: cut at the ``start`` or ``end``, a ``random`` stretch, or ``resize``d by interpolation."""
    u = lambda k: F.pmod(F.xxhash64(seed, F.lit(k)), F.lit(1000000)) / 1000000.0
    n = F.size(x)
    m = F.greatest(F.ceil(n * (least + (1 - least) * u(1))).cast("int"), F.lit(1))
    starts = {"end": F.lit(1), "start": n - m + 1, "random": 1 + F.floor((n - m + 1) * u(2)).cast("int")}
    if how == "resize":
        at = lambda i: i * (n - 1) / F.greatest(m - 1, F.lit(1))
        point = lambda p, k: F.get(x, k) + (p - k) * (F.coalesce(F.get(x, k + 1), F.get(x, k)) - F.get(x, k))
        short = F.transform(F.sequence(F.lit(0), m - 1), lambda i: point(at(i), F.floor(at(i)).cast("int")))
    elif how in starts:
        short = F.slice(x, starts[how], m)
    else:
        raise ValueError(f"unknown way {how!r}")
    return F.when(u(0) < share, short).otherwise(x)


def chain(*steps):
    """One transform of a Column out of several, applied in order."""

    def run(x: Column) -> Column:
        for step in steps:
            x = step(x)
        return x

    return run


#: Series transforms by name.
TRANSFORMS = {"normaliser": znorm, "derivative": derivative, "difference": diff, "padder": pad, "low-noise-padder": noisy_pad}


def transform(name: str):
    """A series transform by name, without regard to case; an unknown name is an error."""
    found = TRANSFORMS.get(name.lower())
    if found is None:
        raise ValueError(f"unknown transform {name!r}")
    return found


def random_intervals(n_points: int, n: int, least: int = 3, seed: int = 0) -> list[tuple[int, int]]:
    """Up to ``n`` distinct intervals (start, end) of at least ``least`` points, drawn by a seeded generator; repeats are pruned."""
    import numpy as np

    rng = np.random.default_rng(seed)
    out = {}
    for _ in range(n):
        size = int(rng.integers(min(least, n_points), n_points + 1))
        start = int(rng.integers(0, n_points - size + 1))
        out[start, start + size] = None
    return list(out)


def interval_features(x: Column, intervals: list[tuple[int, int]]) -> Column:
    """Array of mean, deviation, slope, median, least and greatest value of each interval, in order."""
    out = []
    for a, b in intervals:
        s = F.slice(x, a + 1, b - a)
        out += [mean(s), F.sqrt(variance(s)), slope(s), median(s), F.array_min(s), F.array_max(s)]
    return F.array(*out)
