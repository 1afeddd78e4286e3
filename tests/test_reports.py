"""Loading by problem, dicts and tables, verification and report files, over result files made here."""

import random

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import metrics
from chronoloom.sources import grid, reports, results


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two estimators, two datasets, two resamples; one file is missing."""
    top, rnd = tmp_path_factory.mktemp("results"), random.Random(0)
    for e in ("A", "B"):
        for d in ("one", "two"):
            for r in (0, 1):
                if (e, d, r) == ("B", "two", 1):
                    continue
                f = top / e / "Predictions" / d / f"testResample{r}.csv"
                f.parent.mkdir(parents=True, exist_ok=True)
                y = [(rnd.randint(0, 1), rnd.random()) for _ in range(20)]
                acc = sum(a == (p > 0.5) for a, p in y) / 20
                cases = "\n".join(f"{a},{int(p > 0.5)},,{1 - p},{p}" for a, p in y)
                f.write_text(f"{d}x,{e},TEST,{r},MILLISECONDS,note\nparameters\n{acc},1,2,-1,-1,2,,-1,-1\n{cases}\n")
    return str(top)


def accuracy(cases):
    return metrics.accuracy(cases).withColumnRenamed("accuracy", "value")


def test_grid(spark, folder):
    g = grid.grid(spark, folder, [("A", "first"), "B"], ["one", "two"], 2)
    assert g.count() == 8
    with pytest.raises(FileNotFoundError):
        grid.load_grid(g)
    runs, cases, lack = grid.load_grid(g, error_on_missing=False)
    assert [(r.estimator, r.dataset, r.resample) for r in lack.collect()] == [("B", "two", 1)]
    assert {(r.estimator, r.dataset) for r in runs.collect()} == {("first", "one"), ("first", "two"), ("B", "one"), ("B", "two")} and cases.count() == 140
    checked = grid.verify(runs, cases).collect()
    assert len(checked) == 7 and all(r.headline_ok and r.classes_ok and r.cases == 20 for r in checked)
    assert {(r.estimator, r.dataset) for r in grid.completeness(g, "test").where("not ok").collect()} == {("B", "two")}
    assert {(r.estimator, r.dataset): (r.files, r.complete) for r in grid.count_complete(g, 2).collect()}["B", "two"] == (1, False)
    with pytest.raises(ValueError):
        grid.grid(spark, folder, [("A", "x"), ("B", "x")], ["one"])
    with pytest.raises(ValueError, match="resamples"):
        grid.to_dict(accuracy(cases))
    one = grid.to_dict(accuracy(cases).where("resample = 0"))
    assert set(one) == {"first", "B"} and isinstance(one["B"]["two"], float)
    assert all(len(v) == 2 for v in grid.to_dict(accuracy(cases).where("dataset = 'one'"))["B"].values() if isinstance(v, list))
    assert {r.dataset for r in grid.to_table(accuracy(cases)).collect()} == {"one", "two"}
    got, _ = grid.load_list(spark, [r.path for r in g.collect()], error_on_missing=False)
    assert got.count() == 7


def test_names():
    assert grid.pair_map(None) == {} and grid.pair_map([("a", 1)]) == {"a": 1}
    assert grid.find_name("rocket", [["ROCKET", "rocketclassifier"], "TSF"]) == "ROCKET" and grid.find_name("x", ["y"]) is None
    assert grid.resample_list(3) == [0, 1, 2] and grid.resample_list(None) == [None]


def test_reports(spark, folder, tmp_path):
    g = grid.grid(spark, folder, ["A", "B"], ["one", "two"], 2)
    runs, cases, _ = grid.load_grid(g, error_on_missing=False)
    facts = accuracy(cases)
    reports.statistic(facts, "Accuracy", str(tmp_path / "out"))
    top = tmp_path / "out" / "Accuracy"
    assert (top / "accuracy_mean.csv").read_text().startswith("Estimators:,A,B\none,")
    ranks = [x.split(",") for x in (top / "accuracy_ranks.csv").read_text().split()[1:]]
    assert all(float(a) + float(b) == 3 for _, a, b in ranks) and len(ranks) == 2
    assert (top / "all_resamples" / "A_accuracy.csv").read_text().startswith("Resamples:,0,1\n") and (top / "accuracy_p_values.csv").exists()
    reports.summary({"Accuracy": (facts, True)}, str(tmp_path / "summary.csv"))
    assert [x.split(",")[0] for x in (tmp_path / "summary.csv").read_text().split()] == ["Accuracy", "AccuracyMean", "AccuracyAvgRank"]
    assert reports.summary_table({"Accuracy": facts}).columns == ["statistic", "A", "B"]
    assert reports.extract(spark, str(tmp_path / "out"), ["Accuracy"], str(tmp_path / "pub")) == 2
    reports.by_algorithm(facts, "Accuracy", str(tmp_path / "alg"))
    assert (tmp_path / "alg" / "B" / "B_accuracy.csv").read_text().startswith("folds:,0,1")
    published = spark.createDataFrame([("A", "one", 0.5), ("C", "one", 0.1)], "estimator string, dataset string, published double")
    assert grid.against_published(facts, published).count() == 5
    empty = runs.withColumn("headline", F.lit(None).cast("double"))
    assert {r.path: r.headline for r in reports.with_headline(empty, cases).collect()} == pytest.approx({r.path: r.headline for r in runs.collect()})
    assert reports.wide_by_problem(spark, folder, ["A", "B"], ["one", "two"], 2, accuracy).count() == 2


def test_dumps():
    class Thing:
        def __init__(self, inner=None):
            self.size, self.names, self.inner = 3, list(range(99)), inner

    lines = reports.attributes(Thing(Thing()))
    assert "names: list of 99" in lines and "  size: 3" in lines and "size: 3" in lines
    assert reports.latex_parameters([("my_net", {"depth": 2, "n_jobs": 4})]) == r"my\_net & depth: 2 \\"


def test_one_hot(spark):
    d = spark.createDataFrame([("e", "d", "s", 0, 1), ("e", "d", "s", 0, 0)], "estimator string, dataset string, split string, resample int, y_pred int")
    assert sorted(r.probs for r in grid.one_hot(d).collect()) == [[0.0, 1.0], [1.0, 0.0]]


def test_copy_series(spark, tmp_path):
    for part in ("TRAIN", "TEST"):
        (tmp_path / "in" / "D").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "D" / f"D_{part}.ts").write_text("@data\n1,2:a\n")
    assert reports.copy_series(spark, ["D"], str(tmp_path / "in"), str(tmp_path / "to")) == 2 and (tmp_path / "to" / "D" / "D_TEST.ts").read_text() == "@data\n1,2:a\n"
    assert results.to_milliseconds is not None
