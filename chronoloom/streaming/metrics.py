"""Running metrics over a stream of predictions (an extension: the evaluated system has no streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_accuracy(cases: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes", keys: tuple = ("estimator",)) -> DataFrame:
    """Accuracy by tumbling window; the watermark bounds the state, rows later than it are dropped."""
    hit = (F.col("y_true") == F.col("y_pred")).cast("double")
    return cases.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.avg(hit).alias("accuracy"), F.count("*").alias("n"))


def session_error(cases: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes", keys: tuple = ("estimator",)) -> DataFrame:
    """Mean absolute error by session: cases of a key less than ``gap`` apart."""
    e = F.abs(F.col("y_true") - F.col("y_pred"))
    return cases.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.avg(e).alias("mae"), F.count("*").alias("n"))
