"""Every query with SQL beside it is run against DuckDB on the smallest tables; the others must run."""

import math
from pathlib import Path

import duckdb
import pytest

from chronoloom.operators import metrics
from chronoloom.plans import catalog
from chronoloom.plans.views import TABLES

SF = "/root/testdata/sf0.001"


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v if isinstance(v, (int, str, type(None))) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(normal(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    if name not in catalog.ORACLES:
        assert got
        return
    found = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(normal(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted(names) == columns
    assert got == want


def whole_msm(x, y, c=1.0):
    d = {}
    split = lambda v, a, b: c if a <= v <= b or a >= v >= b else c + min(abs(v - a), abs(v - b))
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            ways = [abs(a - b) + (d[i - 1, j - 1] if i and j else 0 if i == j else math.inf)]
            ways += [d[i - 1, j] + split(a, x[i - 1], b)] if i else []
            ways += [d[i, j - 1] + split(b, a, y[j - 1])] if j else []
            d[i, j] = min(ways)
    return d[len(x) - 1, len(y) - 1]


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_elastic_on_whole_series(spark, duck):
    series = {r.user_id: r.x for r in catalog._series(spark, SF).collect()}
    got = {r.user_id: r.d for r in catalog.QUERIES["q_msm"](spark, SF).collect()}
    assert max(map(len, series.values())) > 12 and set(got) == {u for u in series if u + 1 in series}
    assert all(d == pytest.approx(whole_msm(series[u], series[u + 1]), abs=2e-6) for u, d in got.items())


@pytest.mark.parametrize("metric", [metrics.log_loss, metrics.auroc])
def test_third_label_needs_probabilities(spark, metric):
    rows = [("a", y, p) for y, p in ((0, 0.2), (1, 0.7), (2, 0.4))] + [("b", 0, 0.2), ("b", 1, 0.7)]
    cases = spark.createDataFrame(rows, "g string, y_true int, p1 double")
    assert metric(cases.where("g = 'b'"), ["g"]).count() == 1
    with pytest.raises(Exception, match="more than two labels"):
        metric(cases, ["g"]).collect()
