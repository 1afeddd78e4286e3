"""Principal components of feature rows, as many as explain a share of the variance each."""

from __future__ import annotations

from pyspark.ml.feature import PCA, PCAModel, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components_to_keep(shares: list[float], least: float = 0.01) -> int:
    """Components before the first whose share of the variance is under ``least``; all if none is, one at least."""
    under = next((i for i, s in enumerate(shares) if not s >= least), len(shares))
    return max(under, 1)


def reduce_features(rows: DataFrame, features: str = "features", made: str = "components", least: float = 0.01) -> DataFrame:
    """Add ``made``: the scores of the kept components of the standardised ``features``, an array of one width.

    Means, deviations and covariances are summed over all rows; the driver gets the covariance
    matrix, whose size depends on the width alone. Rows whose features are null have null. No
    rows, or features that are all constant, give one component of zeros.
    """
    width = rows.where(F.col(features).isNotNull()).select(F.size(features).alias("n")).first()
    if width is None:
        return rows.withColumn(made, F.lit(None).cast("array<double>"))
    vectors = rows.withColumn("__v", F.when(F.col(features).isNotNull(), array_to_vector(F.col(features).cast("array<double>"))))
    whole = vectors.where("__v is not null")
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="__v", outputCol="__s").fit(whole)
    model: PCAModel = PCA(k=width["n"], inputCol="__s", outputCol="__c").fit(scaler.transform(whole))
    shares = model.explainedVariance.toArray().tolist()
    k = components_to_keep(shares, least)
    scored = model.transform(scaler.transform(whole)).withColumn(made, F.slice(vector_to_array("__c"), 1, k))
    empty = vectors.where("__v is null").withColumn(made, F.lit(None).cast("array<double>"))
    columns = [*(c for c in rows.columns if c != made), made]
    return scored.select(columns).unionByName(empty.select(columns))
