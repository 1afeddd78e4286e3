"""Frequencies of series: spectra and symbolic Fourier words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.arrays import diff, windows
from chronoloom.session import ship


def _by_batch(x: Column, f) -> Column:
    """Apply an array function to each series; equal lengths are stacked."""
    if spark := SparkSession.getActiveSession():
        ship(spark)

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        out = [None] * len(s)
        for n, rows in s.groupby(s.map(len)).indices.items():
            made = f(np.array([s.iloc[i] for i in rows], float).reshape(len(rows), n))
            for i, v in zip(rows, made, strict=True):
                out[i] = v.tolist()
        return pd.Series(out, dtype=object)

    return run(x)


def _spectrum(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    return np.abs(np.fft.rfft(x, 1 << max(int(np.ceil(np.log2(n))), 1) if n else 2, axis=1))[:, :-1]


def power_spectrum(x: Column) -> Column:
    """Magnitudes of the transform, padded with zeros to a power of two, without the last frequency."""
    return _by_batch(x, _spectrum)


def periodogram(x: Column) -> Column:
    """The power spectrum without its mean: the series is centred before it is padded."""
    return _by_batch(x, lambda a: _spectrum(a - a.mean(axis=1, keepdims=True)))


def fourier(x: Column, n: int, norm: bool = True) -> Column:
    """The first ``n`` numbers of the transform, real and imaginary parts in turn, over the square root of the length and the deviation; ``norm`` leaves the mean out."""

    def run(a):
        s = a.std(axis=1, keepdims=True)
        f = np.fft.rfft(a, axis=1) / np.sqrt(max(a.shape[1], 1)) / np.where(s > 1e-8, s, 1.0)
        f = f[:, 1:] if norm else f
        both = np.stack([f.real, f.imag], axis=2).reshape(len(a), -1)[:, :n]
        return np.pad(both, ((0, 0), (0, n - both.shape[1])))

    return _by_batch(x, run)


def cuts(coefficients: DataFrame, column: str, n: int, letters: int, binning: str = "equi-depth") -> list[list[float]]:
    """Bounds of the letters for each of ``n`` numbers: equal counts (approximate quantiles, accurate to 1e-4) or equal widths. One small row for the driver."""
    at = [F.get(column, F.lit(i)) for i in range(n)]
    if binning == "equi-depth":
        shares = F.array(*[F.lit(k / letters) for k in range(1, letters)])
        row = coefficients.agg(*[F.percentile_approx(c, shares, F.lit(10000)) for c in at]).first()
        return [list(v) if v else [0.0] * (letters - 1) for v in row]
    if binning == "equi-width":
        row = coefficients.agg(*[f(c) for c in at for f in (F.min, F.max)]).first()
        return [[a + (b - a) * k / letters for k in range(1, letters)] if a is not None else [0.0] * (letters - 1) for a, b in zip(row[::2], row[1::2], strict=True)]
    raise ValueError(f"unknown binning {binning!r}")


def word(coefficients: Column, bounds: list[list[float]], letters: int) -> Column:
    """Letters as one number, base ``letters``, the first coefficient highest."""
    out = F.lit(0).cast("long")
    for i, b in enumerate(bounds):
        c = F.get(coefficients, F.lit(i))
        out = out * letters + sum((F.when(c > v, 1).otherwise(0) for v in b), F.lit(0))
    return out


def sfa(series: DataFrame, key: str, window: int, length: int = 8, letters: int = 4, binning: str = "equi-depth", dilation: int = 1, difference: bool = False, norm: bool = True, numerosity: bool = True, bigrams: bool = False, x: str = "x") -> DataFrame:
    """Bag of symbolic Fourier words: (key, word, n).

    Windows of ``window`` points, ``dilation`` apart, of the series or its first difference.
    ``numerosity`` counts a word once while it repeats in succeeding windows. ``bigrams`` adds
    pairs of words one window length apart, as word * letters ** length + later word + letters ** length.
    Series shorter than a window have no words.
    """
    base = diff(F.col(x)) if difference else F.col(x)
    reach = (window - 1) * dilation + 1
    every = F.transform(windows(F.col("s"), reach), lambda w: F.filter(w, lambda v, i: i % dilation == 0)) if dilation > 1 else windows(F.col("s"), reach)
    w = series.select(key, base.alias("s")).select(key, F.posexplode(every).alias("at", "w"))
    c = w.select(key, "at", fourier(F.col("w"), length, norm).alias("c"))
    bounds = cuts(c, "c", length, letters, binning)
    words = c.select(key, "at", word(F.col("c"), bounds, letters).alias("word"))
    lists = words.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda p: p["word"]).alias("l"))
    first = F.filter("l", lambda v, i: (i == 0) | (v != F.get("l", i - 1))) if numerosity else F.col("l")
    if bigrams:
        size = letters**length
        first = F.concat(first, F.transform(F.slice("l", F.lit(1), F.greatest(F.size("l") - reach, F.lit(0))), lambda v, i: (v + 1) * size + F.get("l", i + reach)))
    return lists.select(key, F.explode(first).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))
