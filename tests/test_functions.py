"""Distances and transforms against plain Python, and metric goldens."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import arrays as A
from chronoloom.functions import distances as D
from chronoloom.operators import evaluate, metrics, resample

INF = float("inf")


def table(x, y, cell, row0, col0):
    n, m = len(x), len(y)
    d = [[0.0] * (m + 1) for _ in range(n + 1)]
    for j in range(m + 1):
        d[0][j] = row0(j)
    for i in range(1, n + 1):
        d[i][0] = col0(i)
        for j in range(1, m + 1):
            d[i][j] = cell(i, j, d)
    return d[n][m]


def wall(k):
    return 0.0 if k == 0 else INF


def plain(name, x, y):
    if name in ("dtw", "adtw"):
        pen = 1.0 if name == "adtw" else 0.0
        return table(x, y, lambda i, j, d: (x[i - 1] - y[j - 1]) ** 2 + min(d[i - 1][j - 1], d[i - 1][j] + pen, d[i][j - 1] + pen), wall, lambda i: INF)
    if name == "erp":
        g = 0.05
        return table(
            x, y, lambda i, j, d: min(d[i - 1][j - 1] + abs(x[i - 1] - y[j - 1]), d[i - 1][j] + abs(x[i - 1] - g), d[i][j - 1] + abs(y[j - 1] - g)),
            lambda j: sum(abs(v - g) for v in y[:j]), lambda i: sum(abs(v - g) for v in x[:i]),
        )
    if name == "edr":
        return table(x, y, lambda i, j, d: min(d[i - 1][j - 1] + (abs(x[i - 1] - y[j - 1]) > 0.3), d[i - 1][j] + 1, d[i][j - 1] + 1), lambda j: 0.0, lambda i: 0.0) / max(len(x), len(y))
    if name == "lcss":
        lcs = table(x, y, lambda i, j, d: d[i - 1][j - 1] + 1 if abs(x[i - 1] - y[j - 1]) <= 0.3 else max(d[i - 1][j], d[i][j - 1]), lambda j: 0.0, lambda i: 0.0)
        return 1 - lcs / min(len(x), len(y))
    if name == "twe":
        nu, lam = 0.001, 1.0
        p = lambda s, i: s[i - 2] if i > 1 else 0.0
        return table(
            x, y,
            lambda i, j, d: min(
                d[i - 1][j - 1] + abs(x[i - 1] - y[j - 1]) + abs(p(x, i) - p(y, j)) + 2 * nu * abs(i - j),
                d[i - 1][j] + abs(x[i - 1] - p(x, i)) + nu + lam,
                d[i][j - 1] + abs(y[j - 1] - p(y, j)) + nu + lam,
            ),
            wall, lambda i: INF,
        )
    c = 1.0

    def split(v, a, b):
        return c if a <= v <= b or a >= v >= b else c + min(abs(v - a), abs(v - b))

    def cell(i, j, d):
        move = d[i - 1][j - 1] + abs(x[i - 1] - y[j - 1])
        up = d[i - 1][j] + split(x[i - 1], x[i - 2], y[j - 1]) if i > 1 else INF
        left = d[i][j - 1] + split(y[j - 1], y[j - 2], x[i - 1]) if j > 1 else INF
        return min(move, up, left)

    return table(x, y, cell, wall, lambda i: INF)


@pytest.mark.parametrize("name,more", [("dtw", {"window": 1.0}), ("adtw", {}), ("erp", {}), ("edr", {"epsilon": 0.3}), ("lcss", {"epsilon": 0.3}), ("twe", {}), ("msm", {})])
def test_elastic(spark, name, more):
    rnd = random.Random(name)
    rows = [([rnd.random() for _ in range(rnd.randint(1, 7))], [rnd.random() for _ in range(rnd.randint(1, 7))]) for _ in range(8)]
    df = spark.createDataFrame(rows, "x array<double>, y array<double>")
    got = [r[0] for r in df.select(D.distance(name, F.col("x"), F.col("y"), **more)).collect()]
    assert got == pytest.approx([plain(name, x, y) for x, y in rows])


def test_unknown_distance():
    with pytest.raises(ValueError):
        D.distance("nothing", F.lit(1), F.lit(1))


def test_transforms(spark):
    x = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame([(x,)], "x array<double>")
    c = F.col("x")
    r = df.select(
        A.znorm(c).alias("z"), A.diff(c).alias("d"), A.median(c).alias("m"), A.autocorrelation(c, 2).alias("a"), A.slope(c).alias("s"),
        A.resize(c, 15).alias("r"), A.windows(c, 3, 2).alias("w"), A.pad(c, 10, "last").alias("p"), A.truncate(c, 3, end=False).alias("t"),
        A.stretch_decreasing(c).alias("sd"), A.shapelet_distance(c, F.slice(c, 3, 3)).alias("sh"), A.word(c, 4, 2).alias("wd"),
    ).first()
    v = np.array(x)
    assert r.z == pytest.approx(list((v - v.mean()) / v.std()))
    assert r.d == pytest.approx(list(np.diff(v)))
    assert r.m == np.median(v)
    assert r.a == pytest.approx(np.corrcoef(v[:-2], v[2:])[0, 1])
    assert r.s == pytest.approx(np.polyfit(range(8), v, 1)[0])
    assert r.r == pytest.approx(list(np.interp(np.linspace(0, 7, 15), range(8), v)))
    assert r.w == [x[0:3], x[2:5], x[4:7]]
    assert r.p == [*x, 6.0, 6.0]
    assert r.t == x[-3:]
    assert (r.sd, r.sh) == (1, pytest.approx(0))
    z = [(v[2 * k : 2 * k + 2].mean() - v.mean()) / v.std() > 0 for k in range(4)]
    assert r.wd == sum(int(b) << (3 - k) for k, b in enumerate(z))


def test_edges(spark):
    df = spark.createDataFrame([([],), ([2.0],), ([2.0, 2.0, 2.0],), (None,)], "x array<double>")
    c = F.col("x")
    rows = df.select(A.mean(c), A.znorm(c), A.diff(c), A.derivative(c), A.windows(c, 2), A.histogram_mode(c, 5)).collect()
    assert rows[0][0] is None and rows[0][1] == [] and rows[0][2] == []
    assert rows[1][1] == [0.0] and rows[1][3] == []
    assert rows[2][1] == [0.0, 0.0, 0.0] and rows[2][5] == 2.0
    assert rows[3][0] is None


def test_rank_ties(spark):
    values = [1.0, 0.9, 0.5, 0.5, 1.0, 0.5, 1.0, 0.9, 0.5, 0.5, 0.5]
    df = spark.createDataFrame([("d", str(i), v) for i, v in enumerate(values)], "dataset string, estimator string, value double")
    got = {int(r.estimator): r["rank"] for r in evaluate.ranks(df, True).collect()}
    order = sorted(values, reverse=True)
    want = [np.mean([k + 1 for k, v in enumerate(order) if v == x]) for x in values]
    assert [got[i] for i in range(len(values))] == want


def test_assignment():
    rnd = np.random.default_rng(0)
    from itertools import permutations

    for n in (1, 2, 4, 5):
        cost = rnd.random((n, n))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(n)))
        assert cost[np.arange(n), metrics.assign(cost)].sum() == pytest.approx(best)


def test_wilcoxon():
    assert evaluate.wilcoxon_p(0.0, np.array([])) == 1.0
    assert evaluate.wilcoxon_p(6.0, np.array([1.0, 2, 3])) == 1 / 8
    assert 0 < evaluate.wilcoxon_p(300.0, np.arange(1.0, 31)) < 0.5
    assert math.isclose(evaluate.wilcoxon_p(1.5, np.array([1.5, 1.5])), 0.5)


def test_folds_and_resample(spark):
    df = spark.range(60).withColumn("label", F.col("id") % 3)
    f = resample.folds(df, "id", 5, 0, "label").groupBy("label", "fold").count().collect()
    assert {r["count"] for r in f} == {4}
    s = resample.stratified_resample(df, "id", "label", F.col("id") < 30, 4).groupBy("label", "split").count().collect()
    assert {r["count"] for r in s} == {10}
    assert resample.fold_count(df, "label") == 10
    with pytest.raises(ValueError):
        resample.fold_count(df.where("id = 1"), "label")


def test_rocket_on_its_limit(spark):
    """A convolution that is 0 up to rounding is summed as written: products from the left, then the bias."""
    rows = [(i, [a, 0.0, b, 0.0, -a + 2 * b - 10]) for i, (a, b) in enumerate((k * 0.37, k * 0.61 + 7.1) for k in range(200))]
    s = spark.createDataFrame(rows, "k long, x array<double>")
    ppv, top = A.rocket(F.col("x"), [-1.0, 2.0, -1.0], -10.0, dilation=2)
    got = {r.k: (r.ppv, r.top) for r in s.select("k", ppv.alias("ppv"), top.alias("top")).collect()}
    for k, x in rows:
        c = -1 * x[0] + 2 * x[2] - x[4] - 10
        assert got[k] == (float(c > 0), c)
