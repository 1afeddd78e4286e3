"""Experiments: a grid of (dataset, estimator, resample), each fitted and scored where its data lies.

Models are looked up by name (``operators.models``) or given as functions of a seed. One group,
one dataset's cases for one estimator and resample, goes to one task: the grid is what is spread
out, and a dataset is bounded by what one model is fitted on.
"""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import arrays as A
from chronoloom.operators import forecast, models
from chronoloom.operators.resample import stratified_resample
from chronoloom.session import ship
from chronoloom.sources import reports, results, series

RESULT = "dataset string, estimator string, split string, resample int, case_id long, y_true double, y_pred double, probs array<double>, fit_ms double, predict_ms double"


class NearestCentroid:
    """The label whose mean series is nearest."""

    def fit(self, x, y):
        self.labels = np.unique(y)
        self.centres = np.array([x[y == c].mean(axis=0) for c in self.labels])
        return self

    def proba(self, x):
        d = models.matrix(x, self.centres, "squared")
        return (d == d.min(axis=1, keepdims=True)) * 1.0

    def predict(self, x):
        return self.labels[models.matrix(x, self.centres, "squared").argmin(axis=1)]


models.CLASSIFIERS["nearestcentroid"] = lambda seed: NearestCentroid()


def estimator(name, task: str = "classification"):
    """A registered model's maker by name, or the function itself; an unknown name is an error."""
    if callable(name):
        return name
    models.named(task, name)
    return lambda seed, k=2: models.named(task, name, seed, k)


def fold_of(y: np.ndarray, k: int, classes: bool, seed: int = 0) -> np.ndarray:
    """Fold of each case for a train estimate: dealt in a random order, within each label if there are labels."""
    order = np.random.default_rng(seed).permutation(len(y))
    order = order[np.argsort(y[order], kind="stable")] if classes else order
    out = np.zeros(len(y), int)
    out[order] = np.arange(len(y)) % k
    return out


def train_folds(y: np.ndarray, classes: bool) -> int:
    """min(10, the rarest label's cases) but at least 2; for numbers min(10, cases)."""
    return max(2, min(10, int(np.unique(y, return_counts=True)[1].min()))) if classes else min(10, len(y))


def _fit_predict(make, train, test, task, seed, k):
    x, y, z = (np.array(v.tolist(), float) for v in (train["x"], train["y"], test["x"]))
    began = time.perf_counter()
    model = make(seed, k) if task == "clustering" else make(seed)
    model.fit(x, y)
    fitted = time.perf_counter()
    pred = np.asarray(model.predict(z), float) if len(z) else np.zeros(0)
    if task == "classification" and hasattr(model, "proba") and len(z):
        probs = list(np.asarray(model.proba(z), float))
    elif task == "clustering":
        probs = list((pred[:, None] == np.arange(k)) * 1.0)
    else:
        probs = [None] * len(z)
    return pred, probs, 1000 * (fitted - began), 1000 * (time.perf_counter() - fitted)


def run(cases: DataFrame, estimators: list, resamples: int = 1, task: str = "classification", train_estimate: bool = False, n_clusters: int | None = None) -> DataFrame:
    """RESULT rows for the test cases of the grid; with ``train_estimate`` cross-validated ones of the train cases too, clusterers always have both.

    ``cases`` holds (dataset, case_id, x, y, train boolean). Resample 0 keeps the given split;
    others are drawn anew, stratified by label for classes and clusters. A clusterer has as many
    clusters as there are labels unless ``n_clusters`` is given.
    """
    ship(cases.sparkSession)
    makers = {getattr(n, "__name__", n): estimator(n, task) for n in estimators}
    label = F.lit("all") if task == "regression" else F.col("y").cast("string")
    base = cases.withColumn("group", F.concat_ws("|", "dataset", label))
    splits = cases.select("*", F.lit(0).alias("resample"))
    for r in range(1, resamples):
        again = stratified_resample(base, "case_id", "group", F.col("train"), r)
        splits = splits.unionByName(again.withColumn("train", F.col("split") == "train").withColumn("resample", F.lit(r)).select(*splits.columns))
    grid = splits.withColumn("estimator", F.explode(F.array(*[F.lit(n) for n in makers])))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        name, seed = part["estimator"].iloc[0], int(part["resample"].iloc[0])
        train, test = part[part["train"]].sort_values("case_id"), part[~part["train"]].sort_values("case_id")
        k = n_clusters or part["y"].nunique()
        out = []

        def add(split, rows, pred, probs, fit_ms, predict_ms):
            head = rows[["dataset", "estimator", "resample", "case_id"]].copy()
            out.append(head.assign(split=split, y_true=rows["y"].astype(float), y_pred=pred, probs=probs, fit_ms=fit_ms, predict_ms=predict_ms))

        if len(train) and len(test):
            add("test", test, *_fit_predict(makers[name], train, test, task, seed, k))
        if len(train) and task == "clustering":
            add("train", train, *_fit_predict(makers[name], train, train, task, seed, k))
        elif len(train) > 1 and train_estimate:
            y = train["y"].to_numpy()
            fold = fold_of(y, train_folds(y, task == "classification"), task == "classification", seed)
            for f in np.unique(fold):
                add("train", train[fold == f], *_fit_predict(makers[name], train[fold != f], train[fold == f], task, seed, k))
        columns = [c.split()[0] for c in RESULT.split(", ")]
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

    return grid.groupBy("dataset", "estimator", "resample").applyInPandas(one, RESULT)


def as_results(rows: DataFrame, task: str, parameters: str = "") -> tuple[DataFrame, DataFrame]:
    """(runs, cases) in the shape that ``sources.results`` reads and writes; the headline is computed from the cases."""
    keys = ["estimator", "dataset", "split", "resample"]
    path = F.concat_ws("/", "estimator", F.lit("Predictions"), "dataset", F.concat(F.col("split"), F.lit("Resample"), F.col("resample"), F.lit(".csv")))
    d = rows.withColumn("path", path).withColumn("task", F.lit(task))
    cases = d.select("path", "task", *keys, "case_id", "y_true", "y_pred", "probs", F.lit(None).cast("double").alias("pred_time"), F.lit(None).cast("string").alias("pred_desc"))
    size = F.max(F.size("probs"))
    sizes = F.count_distinct("y_true").cast("int")
    runs = d.groupBy("path", "task", *keys).agg(
        F.max("fit_ms").alias("fit_time"), F.sum("predict_ms").alias("predict_time") if task == "forecasting" else F.max("predict_ms").alias("predict_time"),
        (size if task == "classification" else sizes).alias("n_classes"), size.alias("n_clusters"),
    )
    none = lambda n, t="double": F.lit(None).cast(t).alias(n)
    runs = runs.select(
        "*", none("headline"), none("benchmark_time"), none("memory"), none("train_est_method", "string"), none("train_est_time"), none("fit_and_est_time"),
        F.lit("MILLISECONDS").alias("time_unit"), F.lit("chronoloom").alias("description"), F.lit(parameters).alias("parameters"),
    )
    return reports.with_headline(runs, cases), cases


def save(rows: DataFrame, task: str, folder: str, parameters: str = "") -> None:
    """Write results files under ``folder``."""
    results.write(results.to_lines(*as_results(rows, task, parameters)), folder)


def load(spark: SparkSession, folder: str, dataset: str, resample: int = 0, predefined: bool = False, combine: bool = False) -> DataFrame:
    """(dataset, case_id, x, y, train) of <dataset>_TRAIN.ts and _TEST.ts, or of <dataset><resample>_TRAIN.ts where the resample is predefined.

    Channels are put end to end. Labels that aren't numbers are coded in sorted order.
    ``combine`` marks all cases as train and as test cases alike, twice.
    """
    name = f"{dataset}{resample}" if predefined else dataset
    parts = [series.read_ts(spark, f"{folder.rstrip('/')}/{dataset}/{name}_{p}.ts").withColumn("train", F.lit(p == "TRAIN")) for p in ("TRAIN", "TEST")]
    both = parts[0].unionByName(parts[1].withColumn("case_id", F.col("case_id") + F.lit(1 << 40)))
    codes = both.agg(F.sort_array(F.collect_set("label")).alias("l"), F.bool_and(F.col("label").try_cast("double").isNotNull()).alias("numbers"))
    d = both.crossJoin(codes)  # one row
    y = F.when(F.col("numbers"), F.col("label").try_cast("double")).otherwise((F.array_position("l", F.col("label")) - 1).cast("double"))
    d = d.select(F.lit(dataset).alias("dataset"), "case_id", F.flatten("channels").alias("x"), y.alias("y"), "train")
    if combine:
        d = d.withColumn("train", F.lit(True)).unionByName(d.withColumn("train", F.lit(False)).withColumn("case_id", F.col("case_id") + F.lit(1 << 41)))
    return d


def load_and_run(spark: SparkSession, folder: str, dataset: str, names: list, out: str, resample: int = 0, task: str = "classification", predefined: bool = False, train_estimate: bool = False) -> DataFrame:
    """Load a dataset, run the named models on one resample of it and write the results files; the rows come back."""
    cases = load(spark, folder, dataset, resample, predefined)
    wanted = 0 if predefined else resample
    rows = run(cases, names, wanted + 1, task, train_estimate).where(F.col("resample") == wanted).withColumn("resample", F.lit(resample))
    save(rows, task, out)
    return rows


#: Forecasters by name, in lower case: functions of a series and a horizon.
FORECASTERS = {
    "dummy": forecast.naive, "naiveforecaster": forecast.naive, "naive": forecast.naive, "mean": forecast.mean_forecast, "drift": forecast.drift, "ets": forecast.ets,
}


def forecaster(name):
    """A forecaster by name, without regard to case, or the function itself; an unknown name is an error."""
    if callable(name):
        return name
    if name.lower() not in FORECASTERS:
        raise ValueError(f"unknown forecaster {name!r}")
    return FORECASTERS[name.lower()]


def run_forecasts(train: DataFrame, test: DataFrame, names: list) -> DataFrame:
    """RESULT rows of each named forecaster: ``train`` and ``test`` hold (dataset, x array); the horizon is the length of the test series."""
    horizon = test.agg(F.max(F.size("x"))).first()[0] or 0
    parts = []
    for n in names:
        f = train.select("dataset", forecaster(n)(F.col("x"), horizon).alias("f")).join(test.select("dataset", F.col("x").alias("y")), "dataset")
        p = f.select("dataset", F.posexplode(F.arrays_zip("y", "f")).alias("case_id", "p")).where("p.y is not null")
        parts.append(p.select(
            "dataset", F.lit(getattr(n, "__name__", n)).alias("estimator"), F.lit("test").alias("split"), F.lit(0).alias("resample"), F.col("case_id").cast("long").alias("case_id"),
            F.col("p.y").alias("y_true"), F.col("p.f").cast("double").alias("y_pred"), F.lit(None).cast("array<double>").alias("probs"), F.lit(None).cast("double").alias("fit_ms"), F.lit(None).cast("double").alias("predict_ms"),
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scalability(spark: SparkSession, names: list, dimension: str = "n_cases", sizes: int = 10, loops: int = 10) -> DataFrame:
    """(estimator, size, ms): mean time of fitting and predicting on synthetic series as one dimension grows, one warm-up first; a timing is a group of its own."""
    step = {"n_cases": 50, "n_channels": 1, "n_timepoints": 100}[dimension]
    makers = {n: estimator(n) for n in names}
    ship(spark)
    grid = spark.createDataFrame([(n, step * i) for n in names for i in range(1, sizes + 1)], "estimator string, size int")

    def one(part: pd.DataFrame) -> pd.DataFrame:
        name, size = part.iloc[0]
        cases, channels, points = (size if d == dimension else v for d, v in (("n_cases", 20), ("n_channels", 1), ("n_timepoints", 50)))
        rng = np.random.default_rng(0)
        x, y = rng.normal(size=(cases, channels * points)), np.arange(cases) % 2
        took = []
        for _ in range(loops + 1):
            began = time.perf_counter()
            makers[name](0).fit(x, y).predict(x[:5])
            took.append(1000 * (time.perf_counter() - began))
        return pd.DataFrame({"estimator": [name], "size": [size], "ms": [float(np.mean(took[1:]))]})

    return grid.groupBy("estimator", "size").applyInPandas(one, "estimator string, size int, ms double")


def machine_speed(arrays: int = 1000, length: int = 20000) -> float:
    """Milliseconds that this machine takes to sort random arrays: the benchmark that timings are held against."""
    x = np.random.default_rng(0).random((arrays, length))
    began = time.perf_counter()
    x.sort(axis=1)
    return 1000 * (time.perf_counter() - began)


def pending(grid: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of a grid (dataset, estimator, resample) that have no results yet: what a batch still has to run."""
    return grid.join(done, ["dataset", "estimator", "resample"], "left_anti")


__all__ = ["A", "estimator", "forecaster", "load", "load_and_run", "machine_speed", "pending", "run", "run_forecasts", "save", "scalability"]
