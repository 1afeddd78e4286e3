"""Results and series files: reading, validation, repair, round trips."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import metrics
from chronoloom.sources import results, series

GOOD = "data,est,TEST,0,MILLISECONDS,a comment, with commas\n{'a': 1}\n0.6666666666666666,10,5,-1,7,2,,-1,-1\n0,0,,0.75,0.25\n1,0,,0.5,0.5,,3,,why, so\n1,1,,0.25,0.75\n"
BAD_SUM = GOOD.replace("0.75,0.25\n1,0", "0.75,0.5\n1,0")
BROKEN = GOOD.replace("{'a': 1}", "{'a':\n 1,\n 'b': 2}")


@pytest.fixture
def files(tmp_path):
    for name, text in (("good", GOOD), ("sum", BAD_SUM), ("broken", BROKEN), ("empty", "")):
        (tmp_path / f"{name}.csv").write_text(text)
    (tmp_path / "reg.csv").write_text("d,e,TRAIN,1,SECONDS,\np\n0.5,1,1,1,1,,1,1\n1.5,1.0\n?,2.0\n")
    return tmp_path


def name_of(path):
    return Path(path).name


def test_load(spark, files):
    r, c = results.load(spark, [f"{files}/good.csv", f"{files}/reg.csv"])
    by = {name_of(x.path): x for x in r.collect()}
    assert by["good.csv"].task == "classification" and by["good.csv"].description == "a comment, with commas"
    assert by["good.csv"].benchmark_time is None and by["good.csv"].n_classes == 2 and by["reg.csv"].resample == 1
    rows = {(name_of(x.path), x.case_id): x for x in c.collect()}
    assert rows["good.csv", 1].probs == [0.5, 0.5] and rows["good.csv", 1].pred_time == 3.0 and rows["good.csv", 1].pred_desc == "why, so"
    assert rows["reg.csv", 1].y_true is None and rows["reg.csv", 0].probs is None
    a = metrics.accuracy(c.where("task = 'classification'")).first()
    assert a.accuracy == by["good.csv"].headline


def test_validate_and_repair(spark, files):
    f = results.read_files(spark, f"{files}/*.csv")
    ok = {name_of(r.path): r.ok for r in results.validate(f).collect()}
    assert ok == {"good.csv": True, "reg.csv": True, "sum.csv": False, "broken.csv": False, **({"empty.csv": False} if "empty.csv" in ok else {})}
    assert {name_of(r.path) for r in results.validate(f, n_cases=3).collect() if r.ok} == {"good.csv"}
    fixed = {name_of(r.path): r.ok for r in results.validate(results.repair(f)).collect()}
    assert fixed["broken.csv"] and not fixed["sum.csv"]


def test_round_trip(spark, files, tmp_path):
    r, c = results.load(spark, f"{files}/good.csv")
    lines = results.to_lines(r, c)
    assert lines.first()["lines"][3:] == GOOD.strip().split("\n")[3:]
    results.write(lines, f"{tmp_path}/out")
    text = spark.read.text(f"{tmp_path}/out", wholetext=True).first().value
    assert text.strip().split("\n")[3:] == GOOD.strip().split("\n")[3:]


def test_compare_labels(spark, files):
    _, c = results.load(spark, f"{files}/good.csv")
    assert results.compare_labels(c, c).first().same
    assert not results.compare_labels(c, c.where("case_id > 0")).first().same


def test_ts(spark, tmp_path):
    (tmp_path / "x_TRAIN.ts").write_text("#c\n@problemName x\n@data\n1.0,2.0,3.0:4.0,?:a\n5.0:6.0:b\n")
    t = series.read_ts(spark, f"{tmp_path}/x_TRAIN.ts")
    rows = t.orderBy("case_id").collect()
    assert rows[0].channels == [[1.0, 2.0, 3.0], [4.0, None]] and rows[0].label == "a" and rows[1].channels == [[5.0], [6.0]]
    padded = series.pad_channels(t.where("case_id = 1").unionByName(t.where("case_id = 0")), 0.0)
    assert padded.select(F.size(F.get("channels", F.lit(1)))).distinct().first()[0] == 3
    series.write_ts(t, f"{tmp_path}/out", "x")
    assert series.read_ts(spark, f"{tmp_path}/out/*.txt").count() == 2
    assert series.merge_splits(t, t).agg(F.max("case_id")).first()[0] == 3


def test_synthetic(spark):
    a, b = (series.synthetic(spark, 3, 2, 4, 7).collect() for _ in range(2))
    assert a == b and len(a[0].channels) == 2 and len(a[0].channels[0]) == 4
