"""Convolution kernels with fixed weights, and clustering on their features."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.session import ship

#: Each kernel has nine weights: 2 at three places and -1 at the others, in every one of the 84 ways.
PLACES = np.array(list(combinations(range(9), 3)))
GOLDEN = (5**0.5 + 1) / 2


def convolve(x: np.ndarray, kernel: int, dilation: int) -> np.ndarray:
    """The kernel over series (cases, n), with zeros beyond the ends, one number a point."""
    pad = 4 * dilation
    wide = np.pad(x, ((0, 0), (pad, pad)))
    part = lambda k: wide[:, k * dilation : k * dilation + x.shape[1]]
    return 3 * sum(part(k) for k in PLACES[kernel]) - sum(part(k) for k in range(9))


def plan(n: int, features: int = 500, most: int = 32) -> tuple[np.ndarray, int]:
    """(dilations, biases a kernel and dilation) for series of ``n`` points and about ``features`` numbers."""
    per = max(1, features // len(PLACES))
    top = np.log2(max((n - 1) / 8, 1))
    dilations = np.unique(np.logspace(0, top, min(per, most), base=2).astype(int))
    return dilations, max(1, per // len(dilations))


def fit(sample: np.ndarray, features: int = 500, seed: int = 0) -> dict:
    """Dilations and biases: quantiles of each kernel's output on a random case of ``sample``, at golden-ratio steps."""
    rng = np.random.default_rng(seed)
    dilations, per = plan(sample.shape[1], features)
    total = len(PLACES) * len(dilations) * per
    shares = rng.permutation(np.arange(1, total + 1) * GOLDEN % 1).reshape(len(dilations), len(PLACES), per)
    biases = np.zeros(shares.shape)
    for i, d in enumerate(dilations):
        for k in range(len(PLACES)):
            case = sample[rng.integers(len(sample))][None]
            biases[i, k] = np.quantile(convolve(case, k, d)[0], shares[i, k])
    return {"dilations": dilations, "biases": biases}


def apply(x: np.ndarray, model: dict) -> np.ndarray:
    """Share of outputs above each bias; every second kernel leaves out the padded ends."""
    out = []
    for i, d in enumerate(model["dilations"]):
        for k in range(len(PLACES)):
            c = convolve(x, k, int(d))
            cut = 4 * int(d)
            if (i + k) % 2 and x.shape[1] > 2 * cut:
                c = c[:, cut:-cut]
            out += [(c > b).mean(axis=1) for b in model["biases"][i, k]]
    return np.stack(out, axis=1)


def kernel_features(series: DataFrame, key: str, x: str = "x", features: int = 500, sample: int = 256, seed: int = 0) -> DataFrame:
    """(key, features): kernel features of series of one length, fitted on ``sample`` cases with the least hash of their key."""
    ship(series.sparkSession)
    chosen = series.select(key, x).orderBy(F.xxhash64(F.lit(seed), key), key).limit(sample).collect()
    if not chosen:
        return series.select(key, F.array().cast("array<double>").alias("features"))
    model = fit(np.array([r[x] for r in chosen], float), features, seed)

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(apply(np.array(s.tolist(), float), model)))

    return series.select(key, run(F.col(x)).alias("features"))


def r_cluster(series: DataFrame, key: str, k: int, x: str = "x", features: int = 500, share: float = 0.01, most: int = 100, seed: int = 0) -> DataFrame:
    """(key, y_pred): k-means on standardised kernel features, reduced to the components before the first that explains under ``share`` of the variance (at most ``most``)."""
    f = kernel_features(series, key, x, features, seed=seed).select(key, array_to_vector("features").alias("v"))
    scaled = StandardScaler(inputCol="v", outputCol="z", withMean=True).fit(f).transform(f)
    wide = scaled.first()["z"].size
    pca = PCA(k=min(most, wide), inputCol="z", outputCol="p").fit(scaled)
    small = np.flatnonzero(pca.explainedVariance.toArray() < share)
    kept = max(1, int(small[0]) if len(small) else min(most, wide))
    from pyspark.ml.feature import VectorSlicer

    cut = VectorSlicer(inputCol="p", outputCol="features", indices=list(range(kept))).transform(pca.transform(scaled))
    return KMeans(k=k, seed=seed, maxIter=50).fit(cut).transform(cut).select(key, F.col("prediction").alias("y_pred"))
