"""Evaluation of many estimators: completeness, means, ranks, comparisons, summaries.

``facts`` holds (estimator, dataset, split, resample, value).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_written(facts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows that share their keys, the one with the greatest ``order``."""
    rest = [c for c in facts.columns if c not in keys]
    return facts.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")


def missing(facts: DataFrame) -> DataFrame:
    """(estimator, dataset, resample) that the grid of all three has and ``facts`` lacks."""
    grid = facts.select("estimator").distinct()
    for c in ("dataset", "resample"):
        grid = grid.crossJoin(facts.select(c).distinct())  # three short dimension lists
    return grid.join(facts, ["estimator", "dataset", "resample"], "left_anti")


def complete_datasets(facts: DataFrame) -> DataFrame:
    """Datasets for which every estimator has every resample."""
    size = facts.agg((F.count_distinct("estimator") * F.count_distinct("resample")).alias("want"))
    have = facts.groupBy("dataset").agg(F.count_distinct("estimator", "resample").alias("have"))
    return have.crossJoin(size).where("have = want").select("dataset")


def mean_over_resamples(facts: DataFrame) -> DataFrame:
    return facts.groupBy("dataset", "estimator").agg(F.avg("value").alias("value"))


def rank(value: Column, within: list[str], higher_better: bool = True) -> Column:
    """Rank from 1, the best, with ties sharing their mean rank."""
    order = value.desc() if higher_better else value.asc()
    return F.rank().over(Window.partitionBy(*within).orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*within, value)) - 1) / 2.0


def ranks(means: DataFrame, higher_better: bool = True) -> DataFrame:
    return means.withColumn("rank", rank(F.col("value"), ["dataset"], higher_better))


def summary(means: DataFrame, higher_better: bool = True) -> DataFrame:
    """Mean value and mean rank of each estimator, best first."""
    out = ranks(means, higher_better).groupBy("estimator").agg(F.avg("value").alias("mean_value"), F.avg("rank").alias("avg_rank"))
    value = F.col("mean_value")
    return out.orderBy("avg_rank", value.desc() if higher_better else value, "estimator")


def paired(means: DataFrame) -> DataFrame:
    """(dataset, a, b, value_a, value_b) for every ordered pair of estimators; the values of one dataset are few."""
    a = means.select("dataset", F.col("estimator").alias("a"), F.col("value").alias("value_a"))
    b = means.select("dataset", F.col("estimator").alias("b"), F.col("value").alias("value_b"))
    return a.join(b, "dataset").where("a <> b")


def win_draw_loss(means: DataFrame) -> DataFrame:
    return paired(means).groupBy("a", "b").agg(
        F.count_if(F.col("value_a") > F.col("value_b")).alias("wins"),
        F.count_if(F.col("value_a") == F.col("value_b")).alias("draws"),
        F.count_if(F.col("value_a") < F.col("value_b")).alias("losses"),
    )


def signed_ranks(means: DataFrame) -> DataFrame:
    """Wilcoxon's W+ and W- of each ordered pair; differences of zero are dropped."""
    d = paired(means).withColumn("d", F.col("value_a") - F.col("value_b")).where("d <> 0")
    d = d.withColumn("rank", rank(F.abs("d"), ["a", "b"], higher_better=False))
    return d.groupBy("a", "b").agg(
        F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"),
        F.count("*").alias("n"),
    )


def wilcoxon_p(w_plus: float, ranks_of: np.ndarray) -> float:
    """One-sided p of a W+ at least this large: exact to 25 differences without ties, else normal with tie correction."""
    n = len(ranks_of)
    if not n:
        return 1.0
    if n <= 25 and len(set(ranks_of)) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r].copy()
        return float(ways[int(math.ceil(w_plus)) :].sum() / 2**n)
    _, ties = np.unique(ranks_of, return_counts=True)
    var = n * (n + 1) * (2 * n + 1) / 24 - float((ties**3 - ties).sum()) / 48
    z = (w_plus - n * (n + 1) / 4) / math.sqrt(var)
    return 0.5 * math.erfc(z / math.sqrt(2))


def p_values(means: DataFrame) -> DataFrame:
    """One-sided Wilcoxon p that a is better than b, for every ordered pair."""

    def of_pair(part: pd.DataFrame) -> pd.DataFrame:
        d = (part["value_a"] - part["value_b"]).to_numpy()
        d = d[d != 0]
        r = pd.Series(np.abs(d)).rank().to_numpy()
        return part[["a", "b"]].iloc[:1].assign(p=wilcoxon_p(float(r[d > 0].sum()), r))

    from chronoloom.session import ship

    ship(means.sparkSession)
    return paired(means).groupBy("a", "b").applyInPandas(of_pair, "a string, b string, p double")


def cliques(summary_rows: list[tuple[str, float]], p: dict[tuple[str, str], float], alpha: float = 0.05) -> list[list[str]]:
    """Maximal runs of estimators, in order of mean rank, with no Holm-corrected difference between them.

    Works on one row an estimator, on the driver.
    """
    names = [n for n, _ in sorted(summary_rows, key=lambda x: x[1])]
    pairs = sorted(((min(p[a, b], p[b, a]) * 2, a, b) for i, a in enumerate(names) for b in names[i + 1 :]))
    differ, m = set(), len(pairs)
    for k, (v, a, b) in enumerate(pairs):
        if v > alpha / (m - k):
            break
        differ |= {(a, b), (b, a)}
    out: list[list[str]] = []
    for i in range(len(names)):
        j = i
        while j + 1 < len(names) and not any((names[k], names[j + 1]) in differ for k in range(i, j + 1)):
            j += 1
        if j > i and not any(set(names[i : j + 1]) <= set(c) for c in out):
            out.append(names[i : j + 1])
    return out
