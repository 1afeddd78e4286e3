"""Metrics of predictions by group, as DataFrame aggregations.

Every classification and clustering metric but log loss and AUROC is a function of the
contingency table, which one partially aggregated shuffle makes; it has at most one row a
group and label pair, however many cases there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.session import ship

KEYS = ["estimator", "dataset", "split", "resample"]
EPS = 2.220446049250313e-16


def contingency(cases: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Counts ``n`` of each pair (y_true, y_pred) in each group."""
    return cases.groupBy(*keys, "y_true", "y_pred").agg(F.count("*").alias("n"))


def accuracy(cases: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return cases.groupBy(*keys).agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))


def per_class(table: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """support, predicted and hits of each label that occurs, from a contingency table."""
    pairs = table.select(*keys, F.explode(F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0).cast("long")).alias("hits")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
    )).alias("x"))
    return pairs.groupBy(*keys, "x.label").agg(F.sum("x.support").alias("support"), F.sum("x.predicted").alias("predicted"), F.sum("x.hits").alias("hits"))


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def class_metrics(cases: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """accuracy, balanced_accuracy, sensitivity, specificity and f1 of each group.

    With two labels in y_true: sensitivity and F1 are those of the rarer label (the smaller
    at a tie), specificity the recall of the more frequent one (the larger at a tie). With
    more: means over labels weighted by support. A recall or F1 without cases is 0.
    """
    c = per_class(contingency(cases, keys), keys)
    recall = _ratio(F.col("hits"), F.col("support"))
    f1 = _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted"))
    c = c.withColumn("recall", recall).withColumn("f1", f1)
    real = F.col("support") > 0
    stat = c.groupBy(*keys).agg(
        F.sum("hits").alias("hits"),
        F.sum("support").alias("total"),
        F.count_if(real).alias("labels"),
        F.avg(F.when(real, F.col("recall"))).alias("balanced_accuracy"),
        F.min_by("recall", F.when(real, F.struct("support", "label"))).alias("rare_recall"),
        F.min_by("f1", F.when(real, F.struct("support", "label"))).alias("rare_f1"),
        F.max_by("recall", F.when(real, F.struct("support", "label"))).alias("common_recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    )
    share = F.col("hits") / F.col("total")
    two = F.col("labels") == 2
    return stat.select(
        *keys,
        share.alias("accuracy"),
        "balanced_accuracy",
        F.when(two, F.col("rare_recall")).otherwise(share).alias("sensitivity"),
        F.when(two, F.col("common_recall")).otherwise(share).alias("specificity"),
        F.when(two, F.col("rare_f1")).otherwise(F.col("weighted_f1")).alias("f1"),
    )


def _probability(probs: str | None) -> tuple[Column, Column]:
    """(array of class probabilities, true label as a place in it); without ``probs``, from ``p1`` of two labels, where others than 0 and 1 are an error."""
    if probs:
        return F.col(probs), F.col("y_true").cast("int")
    known = F.col("y_true").isin(0, 1)
    label = F.when(known, F.col("y_true").cast("int")).otherwise(F.raise_error(F.lit("more than two labels: p1 alone does not tell the others apart, give probs")))
    return F.array(1 - F.col("p1"), F.col("p1")), label


def log_loss(cases: DataFrame, keys: list[str] = KEYS, probs: str | None = None) -> DataFrame:
    """Mean negative log probability of the true label, clipped by the machine epsilon.

    ``probs`` names an array with the probability of label 0, 1 and so on; without it ``p1`` is
    that of label 1 of two.
    """
    p, label = _probability(probs)
    true = F.coalesce(F.get(p, label), F.lit(0.0))
    return cases.groupBy(*keys).agg((-F.avg(F.ln(F.greatest(F.least(true, F.lit(1 - EPS)), F.lit(EPS))))).alias("log_loss"))


def auroc(cases: DataFrame, keys: list[str] = KEYS, probs: str | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half; null where no label has both cases and others.

    Two labels: of ``p1`` for label 1. With ``probs`` and more labels: each label against the
    rest, weighted by its share of the cases. Cases fold to one row a distinct score before the window.
    """
    p, label = _probability(probs)
    d = cases.select(*keys, label.alias("y"), F.posexplode(p).alias("label", "score"))
    d = d.where("label = 1") if not probs else d
    scores = d.groupBy(*keys, "label", "score").agg(F.count_if(F.col("y") == F.col("label")).alias("pos"), F.count_if(F.col("y") != F.col("label")).alias("neg"))
    below = F.sum("neg").over(Window.partitionBy(*keys, "label").orderBy("score").rowsBetween(Window.unboundedPreceding, -1))
    u = scores.withColumn("u", F.col("pos") * (F.coalesce(below, F.lit(0)) + F.col("neg") / 2.0))
    each = u.groupBy(*keys, "label").agg((F.sum("u") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("area"), F.sum("pos").alias("n"))
    # Of two labels only the second counts.
    each = each.withColumn("last", F.max("label").over(Window.partitionBy(*keys))).where("last <> 1 or label = 1")
    return each.groupBy(*keys).agg((F.sum(F.col("area") * F.col("n")) / F.sum(F.when(F.col("area").isNotNull(), F.col("n")))).alias("auroc"))


def regression_metrics(cases: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """mse, rmse, mae, r2 (against the mean of the group) and mape, in one pass."""
    e = F.col("y_true") - F.col("y_pred")
    out = cases.groupBy(*keys).agg(
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(F.abs(e) / F.greatest(F.abs("y_true"), F.lit(EPS))).alias("mape"),
        F.var_pop("y_true").alias("var"),
    )
    return out.select(*keys, "mse", F.sqrt("mse").alias("rmse"), "mae", (1 - F.col("mse") / F.nullif(F.col("var"), F.lit(0.0))).alias("r2"), "mape")


def pair_metrics(cases: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """rand, adjusted_rand, mutual_information (nats) and normalised_mi (by the mean entropy) of labels against clusters."""
    t = contingency(cases, keys)
    a = F.sum("n").over(Window.partitionBy(*keys, "y_true"))
    b = F.sum("n").over(Window.partitionBy(*keys, "y_pred"))
    n = F.sum("n").over(Window.partitionBy(*keys))
    t = t.withColumn("a", a).withColumn("b", b).withColumn("total", n)
    two = lambda x: x * (x - 1) / 2.0
    c = lambda name: F.col(name).cast("double")
    g = t.groupBy(*keys).agg(
        F.max("total").cast("double").alias("m"),
        F.sum(two(c("n"))).alias("both"),
        F.sum(c("n") * (c("a") - 1) / 2.0).alias("rows"),
        F.sum(c("n") * (c("b") - 1) / 2.0).alias("columns"),
        F.sum(c("n") / c("total") * F.ln(c("total") * c("n") / (c("a") * c("b")))).alias("mutual_information"),
        (-F.sum(c("n") / c("total") * F.ln(c("a") / c("total")))).alias("ha"),
        (-F.sum(c("n") / c("total") * F.ln(c("b") / c("total")))).alias("hb"),
    )
    pairs = two(F.col("m"))
    expected = F.col("rows") * F.col("columns") / pairs
    return g.select(
        *keys,
        ((pairs + 2 * F.col("both") - F.col("rows") - F.col("columns")) / pairs).alias("rand"),
        ((F.col("both") - expected) / ((F.col("rows") + F.col("columns")) / 2.0 - expected)).alias("adjusted_rand"),
        "mutual_information",
        (F.col("mutual_information") / F.nullif((F.col("ha") + F.col("hb")) / 2.0, F.lit(0.0))).alias("normalised_mi"),
    )


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a least-cost assignment of a square matrix, by shortest augmenting paths."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    owner = np.zeros(n + 1, int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, seen, way = np.full(n + 1, np.inf), np.zeros(n + 1, bool), np.zeros(n + 1, int)
        while owner[j]:
            seen[j] = True
            slack = cost[owner[j] - 1] - u[owner[j]] - v[1:]
            better = ~seen[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j
            nxt = 1 + int(np.argmin(np.where(seen[1:], np.inf, least[1:])))
            step = least[nxt]
            u[owner[seen]] += step
            v[seen] -= step
            least[~seen] -= step
            j = nxt
        while j:
            owner[j], j = owner[way[j]], way[j]
    out = np.zeros(n, int)
    out[owner[1:] - 1] = np.arange(n)
    return out


def expected_mutual_information(a: np.ndarray, b: np.ndarray) -> float:
    """Mean mutual information of tables with these margins under the hypergeometric model; blocks of a million cells at most are held."""
    n = int(a.sum())
    sizes, times = np.unique(np.stack(np.meshgrid(a, b, indexing="ij"), axis=-1).reshape(-1, 2).astype(np.int64), axis=0, return_counts=True)
    log = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])  # log(k!)
    total = 0.0
    for (x, y), often in zip(sizes.tolist(), times.tolist(), strict=True):
        low, high = max(1, x + y - n), min(x, y)
        for at in range(low, high + 1, 1 << 20):
            k = np.arange(at, min(at + (1 << 20), high + 1))
            chance = log[x] + log[y] + log[n - x] + log[n - y] - log[n] - log[k] - log[x - k] - log[y - k] - log[n - x - y + k]
            total += often * float((k / n * np.log(n * k / (x * y)) * np.exp(chance)).sum())
    return total


def matched_metrics(cases: DataFrame, keys: list[str] = KEYS, adjusted: bool = True) -> DataFrame:
    """clustering_accuracy (best one-to-one matching of clusters and labels) and, if ``adjusted``, adjusted_mi (else null).

    Only contingency tables, one small table a group, reach Python.
    """
    ship(cases.sparkSession)
    t = contingency(cases, keys)

    def of_table(part: pd.DataFrame) -> pd.DataFrame:
        rows, columns = part["y_true"].astype("category").cat.codes, part["y_pred"].astype("category").cat.codes
        size = max(rows.max(), columns.max()) + 1
        m = np.zeros((size, size))
        np.add.at(m, (rows, columns), part["n"])
        a, b, n = m.sum(axis=1), m.sum(axis=0), m.sum()
        best = m[np.arange(size), assign(-m)].sum() / n
        a, b = a[a > 0], b[b > 0]
        i, j = np.nonzero(m)
        mi = float((m[i, j] / n * np.log(n * m[i, j] / (m.sum(axis=1)[i] * m.sum(axis=0)[j]))).sum())
        h = -float((a / n * np.log(a / n)).sum() + (b / n * np.log(b / n)).sum()) / 2
        e = expected_mutual_information(a, b) if adjusted else np.nan
        ami = 1.0 if h - e == 0 else (mi - e) / (h - e)
        return part[keys].iloc[:1].assign(clustering_accuracy=best, adjusted_mi=ami)

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.schema.fields if f.name in keys)
    return t.groupBy(*keys).applyInPandas(of_table, f"{kind}, clustering_accuracy double, adjusted_mi double")
