"""Series files: .ts collections, forecasting CSVs, collated result CSVs and name lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import arrays as A


def read_ts(spark: SparkSession, paths: str | list[str], labelled: bool = True) -> DataFrame:
    """(path, case_id, channels array<array<double>>, label): case lines of .ts files, ragged or not.

    Lines that begin with #, % or @ are headers; ? is a missing point (null). ``case_id``
    counts from 0 in each file: a file is one collection, read whole.
    """
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = F.filter(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda x: ~x.rlike(r"^\s*([#%@]|$)"))
    d = text.select("path", F.posexplode(lines).alias("case_id", "line")).withColumn("p", F.split("line", ":"))
    n = F.size("p") - (1 if labelled else 0)
    channels = F.transform(F.slice("p", F.lit(1), n), lambda c: F.transform(F.split(c, ","), lambda v: F.trim(v).try_cast("double")))
    label = F.trim(F.element_at("p", -1)) if labelled else F.lit(None).cast("string")
    return d.select("path", F.col("case_id").cast("long").alias("case_id"), channels.alias("channels"), label.alias("label"))


def write_ts(collection: DataFrame, folder: str, name: str) -> None:
    """Write (case_id, channels, label) as a .ts text folder; lines in order of case_id."""
    line = F.concat_ws(":", F.transform("channels", lambda c: F.array_join(F.transform(c, lambda v: F.coalesce(v.cast("string"), F.lit("?"))), ",")), F.col("label"))
    head = collection.sparkSession.createDataFrame([(-1, f"@problemName {name}\n@data")], "k long, value string")
    rows = collection.select(F.col("case_id").alias("k"), line.alias("value"))
    head.unionByName(rows).repartitionByRange("k").sortWithinPartitions("k").select("value").write.mode("overwrite").text(folder)


def merge_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train cases, then test cases, numbered on."""
    n = train.agg(F.coalesce(F.max("case_id") + 1, F.lit(0)).alias("n"))
    return train.unionByName(test.crossJoin(n).withColumn("case_id", F.col("case_id") + F.col("n")).drop("n"))


def read_forecast_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, t, v) of CSVs with an index column and one value column."""
    d = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split(F.regexp_replace("value", "\r", ""), "\n").alias("l"))
    rows = F.filter(F.slice("l", F.lit(2), F.size("l")), lambda x: x != "")
    return d.select("path", F.posexplode(rows).alias("t", "r")).select("path", F.col("t").cast("long").alias("t"), F.element_at(F.split("r", ","), -1).try_cast("double").alias("v"))


def read_collated(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, dataset, resample, value) of CSVs with one dataset a line and one resample a column."""
    d = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.split("value", ",").alias("c"))
    d = d.where("size(c) > 1 and not lower(c[0]) in ('folds:', 'resamples:')")
    d = d.select("path", F.get("c", F.lit(0)).alias("dataset"), F.posexplode(F.slice("c", F.lit(2), F.size("c"))).alias("resample", "v"))
    return d.select("path", "dataset", "resample", F.col("v").try_cast("double").alias("value")).where("value is not null")


def read_names(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).select(F.trim("value").alias("name")).where("name <> ''")


def pad_channels(collection: DataFrame, fill: str | float = 0.0) -> DataFrame:
    """Every channel padded to the longest of the table; the length is one aggregate, joined as one row."""
    longest = collection.agg(F.max(F.array_max(F.transform("channels", lambda c: F.size(c)))).alias("__n"))
    d = collection.crossJoin(longest)
    return d.withColumn("channels", F.transform("channels", lambda c: A.pad(c, F.col("__n"), fill))).drop("__n")


def synthetic(spark: SparkSession, cases: int, channels: int, length: int, seed: int = 0) -> DataFrame:
    """Uniform random series from a hash of place, equal on every run."""
    point = lambda i, j: (F.xxhash64(F.col("id"), i, j, F.lit(seed)) % 1000003) / 1000003.0
    rows = F.transform(F.sequence(F.lit(1), F.lit(channels)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(length)), lambda j: point(i, j)))
    return spark.range(cases).select(F.col("id").alias("case_id"), rows.alias("channels"))
