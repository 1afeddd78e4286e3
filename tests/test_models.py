"""New distances, features, words, smoothing and votes against plain Python and known values."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import arrays as A
from chronoloom.functions import catch22, distances, kernels, spectral
from chronoloom.operators import ensemble, models, order, quality, smoothing
from chronoloom.plans import catalog

RND = np.random.default_rng(3)


def grid_dtw(x, y, cost, low=min):
    d = {(0, 0): 0.0}
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            d[i, j] = cost(i - 1, j - 1) + low(d.get(k, math.inf) for k in ((i - 1, j - 1), (i - 1, j), (i, j - 1)))
    return d[len(x), len(y)]


def test_soft_and_shape():
    x, y = RND.normal(size=9), RND.normal(size=7)
    soft = grid_dtw(x, y, lambda i, j: (x[i] - y[j]) ** 2, lambda w: -0.5 * math.log(sum(math.exp(-v / 0.5) for v in w)))
    assert distances.batch("soft_dtw", [x], [y], gamma=0.5)[0] == pytest.approx(soft)
    p, q = (np.pad(s, 2, mode="edge") for s in (x, y))
    shape = grid_dtw(x, y, lambda i, j: float(((p[i : i + 5] - q[j : j + 5]) ** 2).sum()))
    assert distances.batch("shape_dtw", [x], [y], reach=2)[0] == pytest.approx(shape)


def test_path_and_bounds():
    x, y = RND.normal(size=12), RND.normal(size=12)
    way = distances.path(x, y)
    assert way[0] == (0, 0) and way[-1] == (11, 11) and all(0 <= c - a <= 1 and 0 <= d - b <= 1 for (a, b), (c, d) in zip(way, way[1:], strict=False))
    full = distances.batch("dtw", [x], [y])[0]
    assert sum((x[i] - y[j]) ** 2 for i, j in way) == pytest.approx(full)
    assert distances.batch("dtw", [x], [y], abandon=full / 4)[0] == math.inf
    assert distances.batch("dtw", [x], [y], itakura=1.0)[0] == pytest.approx(((x - y) ** 2).sum()) and distances.batch("dtw", [x], [y], itakura=99.0)[0] == pytest.approx(full)
    assert math.isnan(distances.batch("dtw", [[]], [x])[0])


def test_canonical_features():
    t = np.arange(200.0)
    wave, noise = np.sin(2 * np.pi * t / 20), RND.normal(size=200)
    f, g = catch22.features(wave), catch22.features(noise)
    assert f["periodicity"] == 19 and f["centroid_freq"] == pytest.approx(2 * np.pi / 20, abs=0.05) and f["acf_first_min"] == 10
    assert f["acf_timescale"] > 2 > g["acf_timescale"] and f["low_freq_power"] > g["low_freq_power"] and f["trev"] == pytest.approx(0, abs=1e-3)
    assert f["ami2"] > g["ami2"] and g["entropy_pairs"] == pytest.approx(2 * math.log(3), abs=0.1) and 0 < g["dfa"] < 1 and 0 < g["rs_range"] < 1
    assert g["forecast_error"] == pytest.approx(np.std(noise[3:] - (noise[:-3] + noise[1:-2] + noise[2:-1]) / 3, ddof=1))
    flat = catch22.features(np.ones(20))
    assert math.isnan(flat["mode_5"]) and flat["stretch_high"] == 0 and set(flat) == set(catch22.NAMES) and len(catch22.NAMES) == 22
    assert catch22.features(np.array([0, 0, 5.0, 0, 0, 0]))["outlier_timing_pos"] == pytest.approx(0.0, abs=0.5)
    assert all(math.isnan(v) for v in catch22.features(np.ones(3)).values())


def test_fourier_words(spark):
    rnd = random.Random(2)
    rows = [(k, [rnd.random() for _ in range(rnd.randint(4, 30))]) for k in range(8)]
    df = spark.createDataFrame(rows, "k int, x array<double>")
    got = {(r.k, r.word): r.n for r in spectral.sfa(df, "k", 8, 4, 3, "equi-width", numerosity=False).collect()}
    coefficients = {}
    for k, x in rows:
        for i in range(len(x) - 7):
            w = np.array(x[i : i + 8])
            f = np.fft.rfft(w)[1:3] / math.sqrt(8) / w.std()
            coefficients[k, i] = [f[0].real, f[0].imag, f[1].real, f[1].imag]
    c = np.array(list(coefficients.values()))
    low, high = c.min(axis=0), c.max(axis=0)
    want = Counter((k, int(sum((v > low[j] + (high[j] - low[j]) * np.array([1, 2]) / 3).sum() * 3 ** (3 - j) for j, v in enumerate(row)))) for (k, _), row in coefficients.items())
    assert got == dict(want)


def test_kernels():
    x = RND.normal(size=(5, 40))
    w = np.full(9, -1.0)
    w[kernels.PLACES[10]] = 2
    wide = np.pad(x[0], 8)
    assert kernels.convolve(x, 10, 2)[0] == pytest.approx([sum(w[k] * wide[i + 2 * k] for k in range(9)) for i in range(40)])
    model = kernels.fit(x, 500)
    f = kernels.apply(x, model)
    assert f.shape == (5, model["biases"].size) and ((f >= 0) & (f <= 1)).all()


def test_unequal_and_chain(spark):
    df = spark.range(200).select("id", F.array(*[F.lit(float(i)) for i in range(20)]).alias("x"))
    for how in ("start", "end", "random", "resize"):
        sizes = [len(r.v) for r in df.select(A.unequal(F.col("x"), F.col("id"), how=how).alias("v")).collect()]
        assert min(sizes) >= 4 and max(sizes) == 20 and 20 < sizes.count(20) < 80
    r = df.limit(1).select(A.chain(A.diff, A.znorm)(F.col("x")).alias("a"), A.concat_channels(F.col("x"), F.col("x"), length=25).alias("b"), A.transform("Normaliser")(F.col("x")).alias("c")).first()
    assert r.a == [0.0] * 19 and len(r.b) == 50 and abs(sum(r.c)) < 1e-9
    assert A.random_intervals(20, 50, seed=1) == A.random_intervals(20, 50, seed=1) and all(3 <= b - a and b <= 20 for a, b in A.random_intervals(20, 50))


def test_smoothing():
    t = np.arange(60)
    wave = np.tile([3.0, -1.0, 2.0, 0.5, -4.0, -0.5], 10)
    exact = {
        ("additive", None, 1): 10 + 0.5 * t, ("multiplicative", None, 1): 10 * 1.02**t,
        (None, "additive", 6): 7 + wave, (None, "multiplicative", 6): 7 * (1 + wave / 10),
    }
    for (trend, season, period), x in exact.items():  # nothing to learn: errors are zero and forecasts go on exactly
        state = smoothing.fit(x[:48], "additive", trend, season, period, 0.3, 0.1, 0.1, 1.0)
        assert np.abs(state[3]).max() < 1e-9 and smoothing.forecast(state, 48, 12, trend, season, period, 1.0) == pytest.approx(x[48:])
    x, level = RND.normal(size=30), None
    for v in x:
        level = v if level is None else 0.3 * v + 0.7 * level
    assert smoothing.fit(x, alpha=0.3)[0] == pytest.approx(level)
    y = 10 * 1.02**t * (1 + 0.3 * np.sin(2 * np.pi * t / 6))
    state = smoothing.fit(y, "multiplicative", "multiplicative", "multiplicative", 6, 0.2, 0.01, 0.05, 1.0)
    ahead = smoothing.forecast(state, 60, 6, "multiplicative", "multiplicative", 6, 1.0)
    assert np.abs(ahead / (10 * 1.02 ** np.arange(60, 66) * (1 + 0.3 * np.sin(2 * np.pi * np.arange(60, 66) / 6))) - 1).max() < 0.1
    assert smoothing.fit(np.ones(3), season="additive", period=6) is None
    with pytest.raises(ValueError):
        smoothing.fit(x, trend="none")


def test_votes(spark):
    """Weights 0.9416, 0.8858, 0.8326 and 0.8326 to the power 4."""
    acc = {"a": 0.9416, "b": 0.8858, "c": 0.8326, "d": 0.8326}
    w = spark.createDataFrame([(e, "d", 0, a) for e, a in acc.items()], "estimator string, dataset string, resample int, accuracy double")
    p = {"a": 0.1, "b": 0.0, "c": 0.2, "d": 0.05}
    cases = spark.createDataFrame([(e, "d", "test", 0, 1, 1, [v, 1 - v]) for e, v in p.items()], "estimator string, dataset string, split string, resample int, case_id long, y_true int, probs array<double>")
    r = ensemble.vote(cases, ensemble.member_weights(w)).first()
    want = sum(acc[e] ** 4 * p[e] for e in acc) / sum(a**4 for a in acc.values())
    assert r.probs == pytest.approx([want, 1 - want]) and r.y_pred == 1
    assert ensemble.member_weights(w, 1.0, {"a": 5.0}, 0.9).count() == 2
    rnd = random.Random(1)
    rows = []
    for i in range(200):
        y = i % 2
        for e, good in (("good", 0.95), ("bad1", 0.6), ("bad2", 0.6)):
            q = y if rnd.random() < good else 1 - y
            rows.append((e, "d", 0, i, y, q, [1.0 - q, float(q)]))
    train = spark.createDataFrame(rows, "estimator string, dataset string, resample int, case_id long, y_true int, y_pred int, probs array<double>")
    assert ensemble.tune_alpha(train).first().alpha > 1


def test_iterative_vote(spark):
    rnd = random.Random(5)
    rows = [(i, e, (i % 3 + s) % 3 if rnd.random() > 0.1 else rnd.randrange(3)) for i in range(60) for e, s in (("a", 0), ("b", 1), ("c", 2))]
    df = spark.createDataFrame(rows, "case_id int, estimator string, y_pred int")
    for start in ("plus", "aligned"):
        got = {r.case_id: r.y_pred for r in ensemble.iterative_vote(df, 3, start=start).collect()}
        pairs = Counter((i % 3, c) for i, c in got.items())
        assert len(got) == 60 and sum(max(pairs[a, c] for c in range(3)) for a in range(3)) >= 54
    ensemble.check_clusters(df, 3)
    with pytest.raises(ValueError):
        ensemble.check_clusters(df, 4)


def test_running_order(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7919 % 1000).alias("v"))
    got = order.position(df, ["v"], F.floor(F.col("v") / 100)).collect()
    assert all(r.position == r.v + 1 for r in got)
    two = spark.createDataFrame([(float(i), int(i >= 5)) for i in range(10)], "v double, c int")
    r = quality.two_samples(two, "v", "c").first()
    assert r.ks == 1.0 and r.empirical == pytest.approx(5.0) and quality.information_gain(two, "v", "c").first().gain == pytest.approx(1.0)


def test_tuning():
    x = np.concatenate([np.sin(np.arange(12) + RND.normal(scale=0.1, size=(8, 1))), RND.normal(scale=0.1, size=(8, 12)) + 3])
    p, score = models.tune(x, "msm", 2)
    assert set(p) == {"c"} and 0 < score < 1 and models.davies_bouldin(x, np.zeros(16), "dtw") == math.inf


def outliers_by_threshold(x):
    """One threshold at a time, as the definition says."""
    steps = int(x.max() / 0.01) + 1
    medians, share, far = np.zeros(steps), np.zeros(steps), steps - 1
    for k in range(steps):
        at = np.flatnonzero(x >= k * 0.01) + 1
        if len(at):
            medians[k], share[k] = np.median(at) / (len(x) / 2) - 1, (len(at) - 1) * 100 / (x >= 0).sum()
        if len(at) == 1:
            far = steps - 1 - k
    busy = np.flatnonzero(share > 2)
    return np.median(medians[: max(int(busy[-1]) if len(busy) else 0, far) + 1])


def test_outliers_do_not_count_thresholds():
    for k in range(60):
        x = np.round(RND.normal(size=8 + k) * 10.0 ** (k % 3 - 1), 2 + k % 2)
        assert catch22._outliers(x) == outliers_by_threshold(x)
    wide = np.array([3e9, 0, 0, 8e9, 1e9, 0, 2e9])  # 8e11 thresholds
    assert catch22._outliers(wide) == pytest.approx(catch22._outliers(wide / 1e6), abs=1e-3)


@pytest.mark.parametrize("name", ["ami2", "forecast_error"])
def test_one_feature_alone(spark, name, monkeypatch):
    x = RND.normal(size=40)
    want = catch22.features(x)[name]
    for other in ("_outliers", "_mutual_scale", "_period", "_pairs"):
        monkeypatch.setattr(catch22, other, None)  # calling it is an error
    assert catch22.features(x, names=(name,)) == {name: want}
    assert spark.createDataFrame([(x.tolist(),)], "x array<double>").select(catch22.catch22(F.col("x"), names=(name,)).alias("f")).first().f.asDict() == {name: pytest.approx(want)}


@pytest.mark.parametrize("x", [[0.66, 0.12, 0.36, 2.17, 0.37, 1.87, 1.31, 0.51, 0.55, 0.47], [1.13, 1.07, 0.77, 1.4, 2.12, 0.47, 1.09, 0.77, 1.85, 0.88, 0.27]])
def test_ami2_of_a_point_on_an_edge(x):
    con = duckdb.connect()
    con.execute("create table events (user_id bigint, ts timestamp, value double)")
    con.executemany("insert into events values (1, ?, ?)", [(f"2024-01-{t + 1:02}", v) for t, v in enumerate(x)])
    assert con.execute(catalog.ORACLES["q_ami2"]).fetchall() == [(1, round(catch22.features(np.array(x), names=("ami2",))["ami2"], 6))]


def test_tuning_shuffles_cases_once(spark):
    """Votes of all powers are counted inside a case: no shuffle holds a row for each case, power and label."""
    rnd = random.Random(4)
    rows = [(e, "d", i % 2, i, y, p, [0.6 if c == p else 0.2 for c in range(3)]) for i in range(300) for y in [rnd.randrange(3)] for e, share in (("a", 0.5), ("b", 0.6), ("c", 0.9)) for p in [y if rnd.random() < share else rnd.randrange(3)]]
    train = spark.createDataFrame(rows, "estimator string, dataset string, resample int, case_id long, y_true int, y_pred int, probs array<double>")
    tuned = ensemble.tune_alpha(train)
    shuffles = [x for x in tuned._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert shuffles and not any("case_id" in x or "alpha" in x for x in shuffles)
    assert {r.resample for r in tuned.collect()} == {0, 1} and all(1 <= r.alpha <= 9 for r in tuned.collect())
