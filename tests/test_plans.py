"""Experiment runner, streaming metrics, driver entry and independence from the llm folder."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from chronoloom.plans import experiment
from chronoloom.plans.views import view
from chronoloom.streaming.metrics import running_accuracy

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_llm(tmp_path):
    """With the subpackage gone, with and without the pipeline's file, the other queries are all there."""
    for f in ["__spark_entry__.py", *(str(p.relative_to(ROOT)) for p in (ROOT / "chronoloom").rglob("*.py") if "llm" not in p.parts)]:
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        shutil.copy(ROOT / f, tmp_path / f)
    code = "import __spark_entry__ as e; from chronoloom.plans import catalog as c; assert set(e.queries()) == set(c.QUERIES) and set(e.oracle_sql()) == set(c.ORACLES)"
    for pipeline in ("", "from chronoloom.llm import packing"):
        (tmp_path / "corpus_pipeline.py").write_text(pipeline)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": os.pathsep.join(x for x in sys.path if x and Path(x) != ROOT)})


def test_nothing_else_imports_llm():
    for f in (ROOT / "chronoloom").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import) chronoloom\.llm", f.read_text(), re.M), f


def test_experiment(spark):
    rows = [("d", i, [float(i % 2) * 3 + (i * 7 % 5) / 10 + k % 3 for k in range(16)], i % 2, i < 20) for i in range(40)]
    cases = spark.createDataFrame(rows, "dataset string, case_id long, x array<double>, y int, train boolean")
    out = experiment.run(cases, ["Dummy", "1NN-ED", "NearestCentroid", "ROCKET"], 2)
    acc = {(r.estimator, r.resample): r.a for r in out.groupBy("estimator", "resample").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("a")).collect()}
    assert acc["1NN-ED", 0] == acc["NearestCentroid", 1] == acc["ROCKET", 0] == 1.0 and acc["Dummy", 0] == 0.5
    with pytest.raises(ValueError):
        experiment.estimator("nobody")


def test_streaming(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00", 1, 1), ("2024-01-01 00:20:00", 1, 0), ("2024-01-01 02:00:00", 0, 0)], "t string, y_true int, y_pred int").select(
        F.to_timestamp("t").alias("ts"), "y_true", "y_pred", F.lit("e").alias("estimator")
    ).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, y_true int, y_pred int, estimator string").parquet(f"{tmp_path}/in")
    q = running_accuracy(stream).writeStream.format("memory").queryName("acc").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.accuracy for r in spark.table("acc").collect()) == [0.5, 1.0]


def sines(spark):
    rows = [("d", i, [float(i % 2) * 3 + (i * 7 % 5) / 10 + k % 3 for k in range(16)], float(i % 2), i < 20) for i in range(40)]
    return spark.createDataFrame(rows, "dataset string, case_id long, x array<double>, y double, train boolean")


@pytest.mark.parametrize(("task", "names"), [
    ("classification", ["1NN-DTW", "MiniROCKET", "catch22", "Summary", "TSF"]), ("regression", ["RocketRegressor", "5NN-msm", "TimeSeriesForestRegressor"]), ("clustering", ["KMeans-ED", "PAM-msm"]),
])
def test_named_models(spark, tmp_path, task, names):
    rows = experiment.run(sines(spark), names, 1, task, train_estimate=True)
    runs, cases = experiment.as_results(rows, task)
    got = runs.select("estimator", "split", "headline").collect()
    assert len(got) == 2 * len(names)
    assert all(r.headline < 0.2 if task == "regression" else r.headline > 0.9 for r in got), got
    experiment.save(rows, task, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").rglob("part-*"))) == 2 * len(names)


def test_load_and_run(spark, tmp_path):
    (tmp_path / "D").mkdir()
    for part, n in (("TRAIN", 20), ("TEST", 10)):
        lines = [",".join(str((i % 2) * 3 + (i * 7 % 5) / 10 + k % 3) for k in range(12)) + (":b" if i % 2 else ":a") for i in range(n)]
        (tmp_path / "D" / f"D_{part}.ts").write_text("@data\n" + "\n".join(lines) + "\n")
    rows = experiment.load_and_run(spark, str(tmp_path), "D", ["1NN-ED"], str(tmp_path / "out"), 1).collect()
    assert len(rows) == 10 and all(r.y_true == r.y_pred and r.resample == 1 for r in rows)


def test_forecast_runs(spark):
    train = spark.createDataFrame([("a", [1.0, 2.0, 3.0, 4.0])], "dataset string, x array<double>")
    test = spark.createDataFrame([("a", [5.0, 6.0])], "dataset string, x array<double>")
    got = {(r.estimator, r.case_id): r.y_pred for r in experiment.run_forecasts(train, test, ["Naive", "drift", "ETS"]).collect()}
    assert got["Naive", 1] == 4.0 and got["drift", 1] == 6.0 and 1 <= got["ETS", 0] <= 4
    with pytest.raises(ValueError):
        experiment.forecaster("nobody")
    assert experiment.machine_speed(2, 100) > 0
    assert experiment.scalability(spark, ["1NN-ED"], sizes=2, loops=1).count() == 2


def test_daily_sums_in_order_of_events(spark, tmp_path):
    """Daily sums are the same to the last bit, however files and tasks hold the events."""
    rows = [(i, f"2024-01-0{1 + i % 3} 05:00:00", u, 0.1 * (i + 1) * (u + 1)) for u in range(4) for i in range(24)]
    events = spark.createDataFrame([(u * 24 + i, t, u, v) for i, t, u, v in rows], "event_id long, t string, user_id long, value double").selectExpr("event_id", "cast(t as timestamp) as ts", "user_id", "value", "'a' as event_type")
    want = {}
    for i, t, u, v in rows:
        want[u, int(t[9]) - 1] = want.get((u, int(t[9]) - 1), 0.0) + v
    for name, dealt in (("back", events.orderBy(F.desc("event_id")).coalesce(1)), ("apart", events.repartition(5))):
        dealt.write.parquet(f"{tmp_path}/{name}/events.parquet")
        assert {(r.user_id, r.t): r.v for r in view(spark, f"{tmp_path}/{name}", "ts_long").collect()} == want
