"""Results files by problem: which files a grid of estimators, datasets, resamples and splits names, which of them exist, and loading them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.sources import results

GRID = "load_path string, load_name string, estimator string, dataset string, split string, resample int, path string"


def pair_map(pairs) -> dict:
    """A dict of a list of pairs, or of None (empty), or the dict itself."""
    return dict(pairs or {})


def find_name(name: str, groups) -> str | None:
    """The entry of nested lists that equals ``name`` without regard to case, or the first of the nested list that holds it."""
    for g in groups:
        if isinstance(g, str):
            if g.lower() == name.lower():
                return g
        elif any(find_name(name, [x]) for x in g):
            return g[0]
    return None


def resample_list(resamples) -> list:
    """0 .. n - 1 for a number, [None] for None (files without a number), else the list itself."""
    return [None] if resamples is None else list(range(resamples)) if isinstance(resamples, int) else list(resamples)


def file_name(folder: str, estimator: str, dataset: str, split: str, resample: int | None) -> str:
    number = "" if resample is None else str(resample)
    return f"{folder.rstrip('/')}/{estimator}/Predictions/{dataset}/{split}Resample{number}.csv"


def grid(spark: SparkSession, paths, estimators, datasets, resamples=1, splits=("test",)) -> DataFrame:
    """One row a file of the grid.

    ``paths`` is one folder or a list of folders; with a list, ``estimators`` may hold a list for
    each. An estimator is a name or a pair (name in the folder, name in the results); two of the
    same name in the results are an error. ``datasets`` is a list, or a name list file that Spark reads.
    """
    folders = [paths] if isinstance(paths, str) else list(paths)
    per = list(estimators)
    per = per if len(folders) > 1 and per and isinstance(per[0], list) else [per] * len(folders)
    if len(per) != len(folders):
        raise ValueError("one list of estimators for each folder is needed")
    if isinstance(datasets, str):
        datasets = [r.value.strip() for r in spark.read.text(datasets).collect() if r.value.strip()]
    rows, seen = [], {}
    for folder, names in zip(folders, per, strict=True):
        for e in names:
            load, shown = (e, e) if isinstance(e, str) else e
            if seen.setdefault(shown, (folder, load)) != (folder, load):
                raise ValueError(f"two estimators are called {shown!r}")
            rows += [(folder, load, shown, d, s.lower(), r, file_name(folder, load, d, s.lower(), r)) for d in datasets for s in splits for r in resample_list(resamples)]
    return spark.createDataFrame(list(dict.fromkeys(rows)), GRID)


def present(spark: SparkSession, folders) -> DataFrame:
    """(path, length) of the CSV files under some folders; only names are read."""
    folders = [folders] if isinstance(folders, str) else list(folders)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(folders)
    return found.select("path", "length")


def _plain(path):
    """A path without its scheme."""
    return F.regexp_replace(path, r"^[a-z]+:(//[^/]*)?(?=/)", "")


def split_grid(g: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the grid whose file exists, rows whose file is missing)."""
    spark = g.sparkSession
    found = present(spark, [r[0] for r in g.select("load_path").distinct().collect()]).select(_plain(F.col("path")).alias("p")).distinct()
    named = g.withColumn("p", _plain(F.col("path")))
    return named.join(found, "p", "left_semi").drop("p"), named.join(found, "p", "left_anti").drop("p")


def load_grid(g: DataFrame, error_on_missing: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, cases, missing rows of the grid). Estimators are called as the grid says, datasets as their folder; missing files are an error or left out."""
    have, lack = split_grid(g)
    if error_on_missing and (first := lack.first()):
        raise FileNotFoundError(first.path)
    files = [r.path for r in have.select("path").distinct().collect()]
    spark = g.sparkSession
    lines = results.read_files(spark, files) if files else spark.createDataFrame([], "path string, lines array<string>")
    names = have.select(_plain(F.col("path")).alias("p"), F.col("estimator").alias("shown"), F.col("dataset").alias("folder"))
    r = results.runs(lines).withColumn("p", _plain(F.col("path"))).join(F.broadcast(names), "p")
    r = r.withColumn("estimator", F.col("shown")).withColumn("dataset", F.col("folder")).drop("p", "shown", "folder")
    return r, results.cases(r), lack


def load_list(spark: SparkSession, paths: list[str], error_on_missing: bool = True) -> tuple[DataFrame, DataFrame]:
    """Runs and cases of a list of files; those that don't exist are an error or skipped."""
    folders = list(dict.fromkeys(p.rsplit("/", 1)[0] for p in paths))
    asked = spark.createDataFrame([(p,) for p in paths], "path string").withColumn("p", _plain(F.col("path")))
    found = asked.join(present(spark, folders).select(_plain(F.col("path")).alias("p")), "p", "left_semi")
    have = [r.path for r in found.select("path").distinct().collect()]
    if error_on_missing and len(have) < len(set(paths)):
        raise FileNotFoundError(sorted(set(paths) - set(have))[0])
    return results.load(spark, have) if have else results.load(spark, paths[:0])


def completeness(g: DataFrame, splits: str | None = "both") -> DataFrame:
    """(estimator, dataset, resample, ok): whether the files of ``test``, ``train``, ``both`` or (None) any split exist."""
    have, _ = split_grid(g)
    keys = ["estimator", "dataset", "resample"]
    n = have.groupBy(*keys).agg(F.count_if(F.col("split") == "test").alias("test"), F.count_if(F.col("split") == "train").alias("train"))
    ok = {"test": "test > 0", "train": "train > 0", "both": "test > 0 and train > 0", None: "test + train > 0"}[splits and splits.lower()]
    every = g.select(*keys).distinct()
    same = [F.col(f"g.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    return every.alias("g").join(n.alias("n"), same, "left").select("g.estimator", "g.dataset", "g.resample", F.coalesce(F.expr(ok), F.lit(False)).alias("ok"))


def count_complete(g: DataFrame, resamples: int) -> DataFrame:
    """(estimator, dataset, files, complete): how many files of each there are, and whether at least ``resamples``."""
    have, _ = split_grid(g)
    n = have.groupBy("estimator", "dataset").agg(F.count("*").alias("n"))
    every = g.select("estimator", "dataset").distinct().join(n, ["estimator", "dataset"], "left")
    return every.select("estimator", "dataset", F.coalesce("n", F.lit(0)).alias("files"), (F.coalesce("n", F.lit(0)) >= resamples).alias("complete"))


def verify(runs_: DataFrame, cases_: DataFrame) -> DataFrame:
    """(path, headline_ok, classes_ok, cases): the headline recomputed from the cases, and probabilities of the stated number that sum to 1."""
    c = cases_.groupBy("path").agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("acc"), F.avg(F.pow(F.col("y_true") - F.col("y_pred"), 2)).alias("mse"),
        F.count("*").alias("cases"), F.min(F.size("probs")).alias("low"), F.max(F.size("probs")).alias("high"),
        F.bool_and(F.aggregate("probs", F.lit(0.0), lambda s, v: s + v).between(0.99999, 1.00001)).alias("sums"),
    )
    want = F.when(F.col("task") == "classification", F.col("acc")).when(F.col("task") == "regression", F.col("mse"))
    k = F.coalesce(F.when(F.col("task") == "clustering", F.col("n_clusters")), F.col("n_classes"))
    near = F.abs(want - F.col("headline")) <= 1e-9 * F.greatest(F.abs(want), F.lit(1.0))
    sized = F.col("task").isin("regression", "forecasting") | ((F.col("low") == k) & (F.col("high") == k) & F.col("sums"))
    return runs_.join(c, "path").select("path", F.coalesce(near, F.lit(True)).alias("headline_ok"), F.coalesce(sized, F.lit(False)).alias("classes_ok"), "cases")


def one_hot(cases_: DataFrame, pred: str = "y_pred", keys: tuple = ("estimator", "dataset", "split", "resample")) -> DataFrame:
    """Add ``probs`` with 1 at the place of the hard label, as many places as the run has distinct labels."""
    size = cases_.groupBy(*keys).agg((F.count_distinct(pred)).cast("int").alias("__k"))
    place = F.transform(F.sequence(F.lit(0), F.col("__k") - 1), lambda i: F.when(i == F.col(pred), 1.0).otherwise(0.0))
    return cases_.join(size, list(keys)).withColumn("probs", place).drop("__k")


def to_dict(facts: DataFrame) -> dict:
    """{estimator: {dataset: value, or list of values by resample}} of report-sized facts.

    Every (estimator, dataset) must have one split and all of them the same resamples; else an error.
    """
    groups = facts.groupBy("estimator", "dataset").agg(
        F.count_distinct("split").alias("splits"), F.count("*").alias("n"), F.sort_array(F.collect_set("resample")).alias("r"),
        F.transform(F.array_sort(F.collect_list(F.struct("resample", "value"))), lambda p: p["value"]).alias("v"),
    ).collect()
    if any(g.splits != 1 or g.n != len(g.v) or (g.r and len(g.r) != g.n) for g in groups):
        raise ValueError("an estimator and dataset have more than one split or file a resample")
    if len({tuple(g.r) for g in groups}) > 1:
        raise ValueError("estimators and datasets differ in their resamples")
    out: dict = {}
    for g in sorted(groups, key=lambda g: (g.estimator, g.dataset)):
        out.setdefault(g.estimator, {})[g.dataset] = g.v[0] if len(g.v) == 1 else list(g.v)
    return out


def to_table(facts: DataFrame, include_missing: bool = False) -> DataFrame:
    """(dataset, one column an estimator): means over resamples; datasets that lack an estimator go, or keep NaN there."""
    names = [r[0] for r in facts.select("estimator").distinct().orderBy("estimator").collect()]
    wide = facts.groupBy("dataset").pivot("estimator", names).agg(F.avg("value"))
    return wide.fillna(float("nan")) if include_missing else wide.dropna()


def against_published(facts: DataFrame, published: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(estimator, dataset, value, published, same): means beside a published table (estimator, dataset, published)."""
    mean = facts.groupBy("estimator", "dataset").agg(F.avg("value").alias("value"))
    both = mean.join(published, ["estimator", "dataset"], "full")
    return both.withColumn("same", F.coalesce(F.abs(F.col("value") - F.col("published")) <= tolerance, F.lit(False)))
