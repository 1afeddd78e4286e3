"""Principal components against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import components


def test_components_to_keep():
    assert components.components_to_keep([0.9, 0.09, 0.009, 0.001]) == 2
    assert components.components_to_keep([0.5, 0.5]) == 2
    assert components.components_to_keep([float("nan"), 0.0]) == 1


def test_reduce_features(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(80, 2)) @ rnd.normal(size=(2, 6)) + 0.01 * rnd.normal(size=(80, 6))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(99, None)], "id int, features array<double>")
    out = {r.id: r.components for r in components.reduce_features(df.withColumn("components", F.lit("clash"))).collect()}
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    values, axes = np.linalg.eigh(np.cov(z.T))
    values, axes = values[::-1], axes[:, ::-1]
    k = components.components_to_keep((values / values.sum()).tolist())
    assert k == 2 and out.pop(99) is None and len(out) == 80
    got = np.array([out[i] for i in range(80)])
    assert np.abs(got) == pytest.approx(np.abs(z @ axes[:, :k]), abs=1e-6)


def test_reduce_features_edges(spark):
    kind = "id int, features array<double>"
    assert components.reduce_features(spark.createDataFrame([], kind)).count() == 0
    assert components.reduce_features(spark.createDataFrame([(1, None)], kind)).first().components is None
    flat = components.reduce_features(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], kind)).collect()
    assert [r.components for r in flat] == [[0.0]] * 3
