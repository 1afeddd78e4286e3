"""Results files: reading, validation, repair and writing.

A file has three header lines (identity; parameters; figures, whose number and kind tell
the task) and one line a case. Files are read whole, one row each, in one scan however
many there are; a file is as long as one run's cases, and its lines explode to rows at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: task -> (number of figures on line 3, positions that must be numbers) (fixed values).
LINE3 = {
    "classification": (9, (0, 1, 2, 3, 4, 5, 7, 8)),
    "clustering": (7, (0, 1, 2, 3, 4, 5, 6)),
    "regression": (8, (0, 1, 2, 3, 4, 6, 7)),
    "forecasting": (5, (0, 1, 2, 3, 4)),
}
#: Names of the figures, in order (fixed values).
FIGURES = {
    "classification": ("headline", "fit_time", "predict_time", "benchmark_time", "memory", "n_classes", "train_est_method", "train_est_time", "fit_and_est_time"),
    "clustering": ("headline", "fit_time", "predict_time", "benchmark_time", "memory", "n_classes", "n_clusters"),
    "regression": ("headline", "fit_time", "predict_time", "benchmark_time", "memory", "train_est_method", "train_est_time", "fit_and_est_time"),
    "forecasting": ("headline", "fit_time", "predict_time", "benchmark_time", "memory"),
}


#: Milliseconds in each unit of time (fixed values).
UNITS = {"nanoseconds": 1e-6, "microseconds": 1e-3, "milliseconds": 1.0, "seconds": 1e3, "minutes": 6e4, "hours": 3.6e6, "days": 8.64e7}


def to_milliseconds(value: Column, unit: Column) -> Column:
    """Time in milliseconds; an unknown unit is an error."""
    scale = F.try_element_at(F.create_map(*[F.lit(x) for p in UNITS.items() for x in p]), F.lower(F.trim(unit)))
    return value * F.when(scale.isNull(), F.raise_error(F.concat(F.lit("unknown time unit "), unit))).otherwise(scale)


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, lines): the lines of each file, without carriage returns and a last empty line."""
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    clean = F.regexp_replace(F.regexp_replace("value", "\r", ""), r"\n+$", "")
    return text.select("path", F.split(clean, "\n").alias("lines"))


def task_of(line3: Column) -> Column:
    """The task that line 3 belongs to, tried in the order of LINE3; six figures are an old classification file."""
    f = F.split(line3, ",")
    out = F.lit(None).cast("string")
    for task, (n, places) in reversed(list(LINE3.items())):
        numbers = F.lit(True)
        for p in places:
            numbers = numbers & F.get(f, F.lit(p)).try_cast("double").isNotNull()
        out = F.when((F.size(f) == n) & numbers, task).otherwise(out)
    old = (F.size(f) == 6) & F.forall(f, lambda x: x.try_cast("double").isNotNull())
    return F.when(old, "classification").otherwise(out)


def runs(files: DataFrame) -> DataFrame:
    """One row a file: identity, parameters and the figures of line 3; -1 stands for unknown and becomes null."""
    line = lambda i: F.get("lines", F.lit(i))
    d = files.withColumn("task", task_of(line(2))).withColumn("h", F.split(line(0), ",")).withColumn("f", F.split(line(2), ","))
    figures = []
    for name in dict.fromkeys(n for names in FIGURES.values() for n in names):
        value = F.lit(None).cast("string")
        for task, names in FIGURES.items():
            if name in names:
                value = F.when(F.col("task") == task, F.get("f", F.lit(names.index(name)))).otherwise(value)
        kind = "string" if name == "train_est_method" else "int" if name.startswith("n_") else "double"
        value = value if kind == "string" else value.try_cast(kind)
        figures.append((value if kind == "string" else F.when(value != -1, value)).alias(name))
    h = lambda i: F.get("h", F.lit(i))
    return d.select(
        "path", "task", h(0).alias("dataset"), h(1).alias("estimator"), F.lower(h(2)).alias("split"), h(3).try_cast("int").alias("resample"),
        F.lower(h(4)).alias("time_unit"), F.array_join(F.slice("h", F.lit(6), F.greatest(F.size("h") - 5, F.lit(0))), ",").alias("description"),
        line(1).alias("parameters"), *figures, "lines",
    )


def cases(runs_: DataFrame) -> DataFrame:
    """One row a case: y_true (null for ?), y_pred, probs, pred_time, pred_desc."""
    body = F.slice("lines", F.lit(4), F.greatest(F.size("lines") - 3, F.lit(0)))
    keys = ["path", "task", "estimator", "dataset", "split", "resample"]
    width = F.when(F.col("task") == "classification", F.col("n_classes")).when(F.col("task") == "clustering", F.col("n_clusters")).otherwise(0)
    d = runs_.select(*keys, width.alias("k"), F.posexplode(body).alias("case_id", "line")).withColumn("c", F.split("line", ","))
    probs = F.transform(F.slice("c", F.lit(4), F.col("k")), lambda x: x.try_cast("double"))
    at = F.when(F.col("k") > 0, F.col("k") + 4).otherwise(3)
    return d.select(
        *keys,
        F.col("case_id").cast("long").alias("case_id"),
        F.when(F.get("c", F.lit(0)) != "?", F.get("c", F.lit(0))).try_cast("double").alias("y_true"),
        F.get("c", F.lit(1)).try_cast("double").alias("y_pred"),
        F.when(F.col("k") > 0, probs).alias("probs"),
        F.get("c", at).try_cast("double").alias("pred_time"),
        F.when(F.size("c") > at + 2, F.array_join(F.slice("c", at + 3, F.size("c")), ",")).alias("pred_desc"),
    )


def load(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    r = runs(read_files(spark, paths))
    return r, cases(r)


def validate(files: DataFrame, n_cases: int | None = None) -> DataFrame:
    """(path, ok): five fields on line 1, a second line, a known line 3, and every case line well-formed.

    A case line has numbers (or ? as label), a blank third field, and probabilities that
    sum to 1 within 1e-5 where the task has them. With ``n_cases`` there are just as many case lines.
    """
    r = runs(files)
    k = F.coalesce(F.when(F.col("task") == "classification", F.col("n_classes")).when(F.col("task") == "clustering", F.col("n_clusters")), F.lit(0))

    def good(line):
        c = F.split(line, ",")
        label = (F.get(c, F.lit(0)) == "?") | F.get(c, F.lit(0)).try_cast("double").isNotNull()
        probs = F.aggregate(F.transform(F.slice(c, F.lit(4), k), lambda x: x.try_cast("double")), F.lit(0.0), lambda s, v: s + v)
        sums = (k == 0) | ((F.size(c) >= k + 3) & (F.get(c, F.lit(2)) == "") & F.coalesce(probs.between(0.99999, 1.00001), F.lit(False)))
        return F.coalesce(label & F.get(c, F.lit(1)).try_cast("double").isNotNull() & sums, F.lit(False))

    body = F.slice("lines", F.lit(4), F.greatest(F.size("lines") - 3, F.lit(0)))
    head = (F.size(F.split(F.get("lines", F.lit(0)), ",")) >= 5) & (F.size("lines") >= 3) & F.col("task").isNotNull()
    many = F.lit(True) if n_cases is None else F.size(body) == n_cases
    return r.select("path", F.coalesce(head & many & F.forall(body, good), F.lit(False)).alias("ok"))


def repair(files: DataFrame) -> DataFrame:
    """Join lines from the second on until a valid third line is seen; files without one stay as they are."""
    n = F.size("lines")
    places = F.when(n > 2, F.sequence(F.lit(2), n - 1)).otherwise(F.array().cast("array<int>"))
    third = F.get(F.filter(places, lambda i: task_of(F.get("lines", i)).isNotNull()), F.lit(0))
    joined = F.array_join(F.transform(F.slice("lines", F.lit(2), third - 1), lambda x: F.trim(x)), " ")
    fixed = F.concat(F.slice("lines", 1, 1), F.array(joined), F.slice("lines", third + 1, n))
    return files.select("path", F.when(third.isNotNull(), fixed).otherwise(F.col("lines")).alias("lines"))


def to_lines(runs_: DataFrame, cases_: DataFrame) -> DataFrame:
    """(path, lines) in the file format from parsed runs and cases; unknown figures are -1, unknown labels ?."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-1"))
    whole = lambda v: F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))
    third = F.lit(None).cast("string")
    for task, names in FIGURES.items():
        third = F.when(F.col("task") == task, F.concat_ws(",", *[F.coalesce(F.col(n), F.lit("")) if n == "train_est_method" else text(n) for n in names])).otherwise(third)
    first = F.concat_ws(",", "dataset", "estimator", F.upper("split"), F.coalesce(F.col("resample").cast("string"), F.lit("None")), F.upper("time_unit"), "description")
    head = runs_.select("path", F.array(first, F.coalesce("parameters", F.lit("")), third).alias("head"))
    label = F.coalesce(F.when(F.col("task").isin("classification", "clustering"), whole(F.col("y_true"))).otherwise(F.col("y_true").cast("string")), F.lit("?"))
    pred = F.when(F.col("task").isin("classification", "clustering"), whole(F.col("y_pred"))).otherwise(F.col("y_pred").cast("string"))
    probs = F.when(F.size("probs") > 0, F.concat(F.lit(",,"), F.array_join(F.transform("probs", lambda p: p.cast("string")), ","))).otherwise("")
    time = F.when(F.col("pred_time").isNotNull(), F.concat(F.lit(",,"), whole(F.col("pred_time")))).otherwise("")
    desc = F.when(F.col("pred_desc").isNotNull() & F.col("pred_time").isNotNull(), F.concat(F.lit(",,"), F.col("pred_desc"))).otherwise("")
    line = F.concat(label, F.lit(","), pred, F.coalesce(probs, F.lit("")), time, desc)
    body = cases_.select("path", F.struct("case_id", line.alias("line")).alias("c")).groupBy("path").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["line"]).alias("body"))
    return head.join(body, "path", "left").select("path", F.concat("head", F.coalesce("body", F.array().cast("array<string>"))).alias("lines"))


def write(lines: DataFrame, folder: str) -> None:
    """One text file a run under ``folder``/run=<file name>, by Spark's own writer."""
    name = F.regexp_replace(F.concat_ws("_", F.slice(F.split("path", "/"), -4, 4)), r"\.csv$", "")
    lines.select(name.alias("run"), F.array_join("lines", "\n").alias("value")).write.mode("overwrite").partitionBy("run").text(folder)


def compare_labels(a: DataFrame, b: DataFrame) -> DataFrame:
    """(dataset, same): whether two sets of cases have equal labels in equal places."""
    keys = ["dataset", "split", "resample", "case_id"]
    both = a.select(*keys, F.col("y_true").alias("y")).join(b.select(*keys, F.col("y_true").alias("z")), keys, "full")
    return both.groupBy("dataset").agg(F.bool_and(F.col("y").eqNullSafe(F.col("z"))).alias("same"))
