"""Report files: statistics of many estimators as CSV, tables of parameters, dumps of attributes.

Figures are computed as DataFrames. A report has a row a dataset and a column an estimator, so
it is written as one file by the driver through Hadoop's file system.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import evaluate, metrics
from chronoloom.sources import grid


def put(spark: SparkSession, path: str, lines: list[str]) -> None:
    """Write a small text file."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(("\n".join(lines) + "\n").encode()))
    out.close()


def _csv(head: str, wide: DataFrame) -> list[str]:
    first, *names = wide.columns
    rows = sorted(wide.collect(), key=lambda r: str(r[0]))
    return [",".join([head, *names]), *[",".join(["" if v is None else str(v) for v in r]) for r in rows]]


def statistic(facts: DataFrame, stat: str, folder: str, higher_better: bool = True) -> None:
    """``folder``/<stat>/ with all_resamples/<estimator>_<stat>.csv, <stat>_mean.csv, <stat>_ranks.csv and <stat>_p_values.csv.

    ``facts`` holds (estimator, dataset, split, resample, value). Ranks are over datasets that every estimator has.
    """
    spark, top, low = facts.sparkSession, f"{folder.rstrip('/')}/{stat}", stat.lower()
    names = [r[0] for r in facts.select("estimator").distinct().orderBy("estimator").collect()]
    numbers = [r[0] for r in facts.select("resample").distinct().orderBy("resample").collect()]
    every = facts.groupBy("estimator", "dataset").pivot("resample", numbers).agg(F.avg("value"))
    for n in names:
        put(spark, f"{top}/all_resamples/{n}_{low}.csv", _csv("Resamples:", every.where(F.col("estimator") == n).drop("estimator")))
    table = grid.to_table(facts)
    put(spark, f"{top}/{low}_mean.csv", _csv("Estimators:", table))
    long = evaluate.mean_over_resamples(facts.join(table.select("dataset"), "dataset", "left_semi"))
    put(spark, f"{top}/{low}_ranks.csv", _csv("Estimators:", evaluate.ranks(long, higher_better).groupBy("dataset").pivot("estimator", names).agg(F.max("rank"))))
    p = evaluate.p_values(long).groupBy("a").pivot("b", names).agg(F.max("p"))
    put(spark, f"{top}/{low}_p_values.csv", _csv("Estimators:", p))


def summary(stats: dict[str, tuple[DataFrame, bool]], path: str) -> None:
    """For each statistic (facts, higher is better): the names, mean values and mean ranks of the estimators, best first."""
    lines, spark = [], None
    for stat, (facts, higher) in stats.items():
        spark = facts.sparkSession
        rows = evaluate.summary(evaluate.mean_over_resamples(facts), higher).collect()
        lines += [",".join([stat, *[r.estimator for r in rows]]), ",".join([f"{stat}Mean", *[str(r.mean_value) for r in rows]]), ",".join([f"{stat}AvgRank", *[str(r.avg_rank) for r in rows]])]
    if spark:
        put(spark, path, lines)


def summary_table(stats: dict[str, DataFrame]) -> DataFrame:
    """(statistic, one column an estimator): the overall mean of each statistic."""
    out = None
    for stat, facts in stats.items():
        part = evaluate.mean_over_resamples(facts).select(F.lit(f"{stat}Mean").alias("statistic"), "estimator", "value")
        out = part if out is None else out.unionByName(part)
    names = [r[0] for r in out.select("estimator").distinct().orderBy("estimator").collect()]
    return out.groupBy("statistic").pivot("estimator", names).agg(F.avg("value"))


def wide_by_problem(spark: SparkSession, paths, estimators, datasets, resamples, stat, splits=("test",), include_missing: bool = True) -> DataFrame:
    """The table of one statistic over a grid of files; ``stat(cases)`` gives (estimator, dataset, split, resample, value)."""
    g = grid.grid(spark, paths, estimators, datasets, resamples, splits)
    _, cases, _ = grid.load_grid(g, error_on_missing=not include_missing)
    return grid.to_table(stat(cases), include_missing)


def by_algorithm(facts: DataFrame, stat: str, folder: str) -> None:
    """One file an estimator, <folder>/<estimator>/<estimator>_<stat>.csv, with a row a dataset and a column a resample."""
    spark = facts.sparkSession
    numbers = [r[0] for r in facts.select("resample").distinct().orderBy("resample").collect()]
    wide = facts.groupBy("estimator", "dataset").pivot("resample", numbers).agg(F.avg("value"))
    for (n,) in facts.select("estimator").distinct().collect():
        put(spark, f"{folder.rstrip('/')}/{n}/{n}_{stat.lower()}.csv", _csv("folds:", wide.where(F.col("estimator") == n).drop("estimator")))


def extract(spark: SparkSession, folder: str, stats: list[str], to: str) -> int:
    """Copy all_resamples/*.csv of the chosen statistics to ``to``/<stat>; how many files that were."""
    files = grid.present(spark, [f"{folder.rstrip('/')}/{s}/all_resamples" for s in stats]).select("path").collect()
    for (path,) in files:
        stat, _, name = path.rsplit("/", 3)[1:]
        put(spark, f"{to.rstrip('/')}/{stat}/{name}", [r.value for r in spark.read.text(path).coalesce(1).collect()])
    return len(files)


def copy_series(spark: SparkSession, names: list[str], source: str, to: str) -> int:
    """Copy <name>/<name>_TRAIN.ts and _TEST.ts of the named datasets through Hadoop's file system; how many files that were."""
    hadoop, conf, n = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration(), 0
    for name in names:
        for part in ("TRAIN", "TEST"):
            a, b = (hadoop.Path(f"{top.rstrip('/')}/{name}/{name}_{part}.ts") for top in (source, to))
            n += bool(hadoop.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf))
    return n


def with_headline(runs_: DataFrame, cases_: DataFrame) -> DataFrame:
    """Runs whose headline is absent get it from their cases: accuracy, clustering accuracy, mean squared error or mean absolute percentage error."""
    keys = ["path"]
    plain = cases_.groupBy("path").agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("a"), F.avg(F.pow(F.col("y_true") - F.col("y_pred"), 2)).alias("m"),
        F.avg(F.abs(F.col("y_true") - F.col("y_pred")) / F.greatest(F.abs("y_true"), F.lit(metrics.EPS))).alias("p"),
    )
    clusters = cases_.where("task = 'clustering'").select("path", F.col("y_true").cast("int").alias("y_true"), F.col("y_pred").cast("int").alias("y_pred"))
    matched = metrics.matched_metrics(clusters, keys, adjusted=False).select("path", "clustering_accuracy")
    d = runs_.join(plain, "path", "left").join(matched, "path", "left")
    made = F.when(F.col("task") == "classification", F.col("a")).when(F.col("task") == "clustering", F.col("clustering_accuracy")).when(F.col("task") == "regression", F.col("m")).otherwise(F.col("p"))
    return d.withColumn("headline", F.coalesce("headline", made)).select(*runs_.columns)


def attributes(thing, depth: int = 2, most: int = 20) -> list[str]:
    """Lines "name: value" of an object's attributes, nested ones indented, to a depth; long lists give their length."""
    out = []
    for name, value in sorted(vars(thing).items()) if hasattr(thing, "__dict__") else []:
        if hasattr(value, "shape"):
            value = f"array of shape {tuple(value.shape)}"
        elif isinstance(value, (list, tuple, set, dict)) and len(value) > most:
            value = f"{type(value).__name__} of {len(value)}"
        nested = hasattr(value, "__dict__") and not callable(value)
        out.append(f"{name}: {type(value).__name__ if nested else value}")
        if nested and depth > 1:
            out += ["  " + line for line in attributes(value, depth - 1, most)]
    return out


def latex_parameters(rows: list[tuple[str, dict]], leave_out=("random_state", "n_jobs", "verbose")) -> str:
    """Rows "name & parameter: value, ... \\\\" of a LaTeX table."""
    clean = lambda s: str(s).replace("_", r"\_")
    return "\n".join(f"{clean(n)} & {', '.join(f'{clean(k)}: {clean(v)}' for k, v in sorted(p.items()) if k not in leave_out)} \\\\" for n, p in rows)
