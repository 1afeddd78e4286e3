"""How well a value separates labels: the measures by which splits and shapelets are judged. Each gives one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.order import running, value_bin


def _entropy(a: Column, b: Column) -> Column:
    part = lambda x: F.when(x > 0, -x / (a + b) * F.log2(x / (a + b))).otherwise(0.0)
    return part(a) + part(b)


def _counts(rows: DataFrame, value: str, flag: str) -> DataFrame:
    """(value, ones, zeros, run_ones, run_zeros, all_ones, all_zeros): cases of a flag at each value and up to it."""
    g = rows.groupBy(value).agg(F.count_if(F.col(flag) == 1).alias("ones"), F.count_if(F.col(flag) != 1).alias("zeros")).where(F.col(value).isNotNull())
    every = g.agg(F.sum("ones").cast("double").alias("all_ones"), F.sum("zeros").cast("double").alias("all_zeros"))
    return running(g, ["ones", "zeros"], [value], value_bin(rows, value)).crossJoin(every)  # one row


def information_gain(rows: DataFrame, value: str, flag: str) -> DataFrame:
    """gain: the best information gain of a cut of ``value`` for a flag of 0 and 1."""
    s = _counts(rows, value, flag)
    l1, l0, t1, t0 = (F.col(c) for c in ("run_ones", "run_zeros", "all_ones", "all_zeros"))
    n, left = t1 + t0, l1 + l0
    gain = _entropy(t1, t0) - left / n * _entropy(l1, l0) - (n - left) / n * _entropy(t1 - l1, t0 - l0)
    return s.where(left < n).agg(F.max(gain).alias("gain"))


def gini_gain(rows: DataFrame, leaf: str, label: str) -> DataFrame:
    """gain: the fall of the gini impurity from all cases to the leaves."""
    c = rows.groupBy(leaf, label).agg(F.count("*").cast("double").alias("n"))
    gini = 1 - F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))
    leaves = c.groupBy(leaf).agg(F.sum("n").alias("m"), gini.alias("g")).agg(F.sum(F.col("m") * F.col("g")).alias("inner"), F.sum("m").alias("n"))
    parent = c.groupBy(label).agg(F.sum("n").alias("n")).agg(gini.alias("g"))
    return leaves.crossJoin(parent).select((F.col("g") - F.col("inner") / F.col("n")).alias("gain"))  # one row each


def f_statistic(rows: DataFrame, value: str, label: str) -> DataFrame:
    """f_stat: variance between labels over that within."""
    g = rows.groupBy(label).agg(F.count("*").alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("s"))
    a = rows.agg(F.avg(value).alias("am"), F.count("*").alias("an"))
    between = F.sum(F.col("n") * F.pow(F.col("m") - F.col("am"), 2)) / (F.count("*") - 1)
    return g.crossJoin(a).agg((between / (F.sum("s") / (F.max("an") - F.count("*")))).alias("f_stat"))


def median_test(rows: DataFrame, value: str, label: str) -> DataFrame:
    """chi2: Mood's median test, labels against above or not above the median of all."""
    m = rows.agg(F.median(value).alias("m"))
    t = rows.crossJoin(m).groupBy(label).agg(F.count_if(F.col(value) > F.col("m")).alias("up"), F.count_if(F.col(value) <= F.col("m")).alias("down"))
    every = t.agg(F.sum("up").cast("double").alias("u"), F.sum("down").cast("double").alias("d"))
    n, size = F.col("u") + F.col("d"), F.col("up") + F.col("down")
    part = lambda seen, total: F.pow(seen - size * total / n, 2) / (size * total / n)
    return t.crossJoin(every).agg(F.sum(part(F.col("up"), F.col("u")) + part(F.col("down"), F.col("d"))).alias("chi2"))


def kruskal_wallis(rows: DataFrame, value: str, label: str) -> DataFrame:
    """h: the Kruskal-Wallis statistic with mean ranks for ties and its tie correction. Only counts of equal values are ranked."""
    g = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    r = running(g, ["n"], [value], value_bin(rows, value)).select(value, "n", (F.col("run_n") - (F.col("n") - 1) / 2.0).alias("rank"))
    ties = g.agg(F.sum(F.pow("n", F.lit(3.0)) - F.col("n")).alias("ties"), F.sum("n").cast("double").alias("m"))
    per = rows.join(r.select(value, "rank"), value).groupBy(label).agg(F.sum("rank").alias("s"), F.count("*").alias("k"))
    m = F.max("m")
    h = 12.0 / (m * (m + 1)) * F.sum(F.col("s") * F.col("s") / F.col("k")) - 3 * (m + 1)
    return per.crossJoin(ties).agg((h / (1 - F.max("ties") / (m * m * m - m))).alias("h"))


def two_samples(rows: DataFrame, value: str, flag: str) -> DataFrame:
    """ks (Kolmogorov-Smirnov), empirical (1-Wasserstein of the two samples) and gaussian (2-Wasserstein of normal fits) of the cases with flag 1 against the rest."""
    s = _counts(rows, value, flag).withColumn("gap", F.abs(F.col("run_ones") / F.col("all_ones") - F.col("run_zeros") / F.col("all_zeros")))
    b = value_bin(rows, value)
    # The next value lies in this bin or is the least of the next bin that has any.
    s = s.withColumn("bin", b)
    low = s.groupBy("bin").agg(F.min(value).alias("low"))
    low = low.select("bin", F.lead("low").over(Window.partitionBy().orderBy("bin")).alias("beyond"))  # one row a bin
    s = s.join(low, "bin").withColumn("next", F.coalesce(F.lead(value).over(Window.partitionBy("bin").orderBy(value)), F.col("beyond")))
    main = s.agg(F.max("gap").alias("ks"), F.sum(F.col("gap") * (F.col("next") - F.col(value))).alias("empirical"))
    one, zero = F.when(F.col(flag) == 1, F.col(value)), F.when(F.col(flag) != 1, F.col(value))
    fits = rows.agg(F.sqrt(F.pow(F.avg(one) - F.avg(zero), 2) + F.pow(F.stddev_pop(one) - F.stddev_pop(zero), 2)).alias("gaussian"))
    return main.crossJoin(fits)


def r_squared(rows: DataFrame, value: str, target: str) -> DataFrame:
    """r2: squared correlation of the value with a numeric target."""
    return rows.agg(F.pow(F.corr(value, target), 2).alias("r2"))
