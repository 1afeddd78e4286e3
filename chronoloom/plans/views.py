"""Views that give the test tables the shapes of results and series; one SQL text for both engines.

Table names stand in braces: Spark fills in DataFrames, DuckDB its own views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VIEWS = {
    # Binary predictions of three estimators.
    "clf_cases": """
        with c as (
          select ((l.l_orderkey * 8 + l.l_linenumber) * 1000003 + l.l_partkey) * 1009 + l.l_suppkey as case_id, o.o_orderpriority as dataset, l.l_linenumber % 3 as resample,
                 cast(l.l_returnflag = 'R' as int) as y_true, l.l_quantity, l.l_suppkey, l.l_partkey
          from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey),
        p as (
          select 'quantity' as estimator, c.*, l_quantity / 51e0 as p1 from c
          union all select 'supplier', c.*, (l_suppkey % 10 + 5e-1) / 1e1 from c
          union all select 'part', c.*, (l_partkey % 7 + 5e-1) / 7e0 from c)
        select estimator, dataset, 'test' as split, resample, case_id, y_true, cast(p1 >= 5e-1 as int) as y_pred, p1 from p""",
    # Three classes, hard predictions.
    "clf3_cases": """
        select 'size' as estimator, o.o_orderpriority as dataset, 'test' as split, l.l_linenumber % 3 as resample,
               case l.l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as y_true, cast(l.l_partkey % 3 as int) as y_pred
        from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey""",
    # Three classes with probabilities that sum to 1.
    "clf3p_cases": """
        with c as (
          select ((l.l_orderkey * 8 + l.l_linenumber) * 1000003 + l.l_partkey) * 1009 + l.l_suppkey as case_id, o.o_orderpriority as dataset, l.l_linenumber % 3 as resample,
                 case l.l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as y_true, 1e0 + l.l_quantity as a, 1e0 + l.l_suppkey % 37 as b, 1e0 + l.l_partkey % 41 as c
          from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey),
        p as (select 'weights' as estimator, case_id, dataset, resample, y_true, a / (a + b + c) as p0, b / (a + b + c) as p1, c / (a + b + c) as p2 from c
          union all select 'squares', case_id, dataset, resample, y_true, a * a / (a * a + b * b + c * c), b * b / (a * a + b * b + c * c), c * c / (a * a + b * b + c * c) from c)
        select estimator, dataset, 'test' as split, resample, case_id, y_true, p0, p1, p2,
               case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end as y_pred from p""",
    "reg_cases": """
        with c as (
          select p.p_type as dataset, l.l_linenumber % 3 as resample, l.l_extendedprice as y_true, l.l_quantity, p.p_retailprice
          from {lineitem} l join {part} p on l.l_partkey = p.p_partkey)
        select 'retail' as estimator, dataset, 'test' as split, resample, y_true, l_quantity * p_retailprice as y_pred from c
        union all select 'flat', dataset, 'test', resample, y_true, l_quantity * 1500e0 from c
        union all select 'constant', dataset, 'test', resample, y_true, 38000e0 from c""",
    "clu_cases": """
        with e as (select vec_id, label, embedding from {embeddings})
        select 'head' as estimator, 'vectors' as dataset, 'test' as split, 0 as resample, vec_id as case_id, label as y_true, cast(vec_id * 7 % 10 as int) as y_pred from e
        union all select 'mod', 'vectors', 'test', 0, vec_id, label, cast((label * 3 + vec_id % 4) % 10 as int) from e""",
    # Daily sums of each user over thirty days, absent days 0.
    "ts_long": """
        with s as (
          select user_id, cast(cast(ts as date) as date) as d, sum(value) as v from {events} group by user_id, cast(ts as date)),
        days as (select distinct d from s), users as (select distinct user_id from s),
        n as (select d, row_number() over (order by d) - 1 as t from days)
        select u.user_id, n.t, coalesce(s.v, 0e0) as v
        from users u cross join n left join s on s.user_id = u.user_id and s.d = n.d""",
    # The values of each user in order of time.
    "ragged_long": """
        select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as t, value as v from {events}""",
    "fc_long": """
        with s as (select event_type as series, cast(ts as date) as d, sum(value) as v from {events} group by event_type, cast(ts as date))
        select series, row_number() over (partition by series order by d) - 1 as t, row_number() over (partition by series order by d desc) - 1 as back, v from s""",
    "runs_time": """
        select o_orderkey as run, o_totalprice as fit, case o_orderpriority when '1-URGENT' then 'seconds' when '2-HIGH' then 'milliseconds'
          when '3-MEDIUM' then 'minutes' when '4-NOT SPECIFIED' then 'nanoseconds' else 'hours' end as unit from {orders}""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def daily(events: DataFrame) -> DataFrame:
    """One row for each user and day (``ts``), its ``value`` summed in order of event_id.

    Distances count points that lie within a limit, so the last bit of a sum matters: it must not
    depend on how the rows are dealt to tasks.
    """
    e = events.select("user_id", F.col("ts").cast("date").alias("ts"), "event_id", "value")
    order = Window.partitionBy("user_id", "ts").orderBy("event_id", "value")
    run = F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0))
    e = e.select("user_id", "ts", run.alias("run"), F.row_number().over(order).alias("n"))
    return e.groupBy("user_id", "ts").agg(F.max_by("run", "n").alias("value"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    if name == "ts_long":
        used["events"] = daily(used["events"])
    return spark.sql(sql, **used)


def duck(body: str) -> str:
    """``body`` with the views that it names put before it, for DuckDB."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", body)]
    parts = [f"{n} as materialized ({VIEWS[n].replace('{', '').replace('}', '')})" for n in used]
    body = body.strip()
    if body.lower().startswith("with recursive "):
        return "with recursive " + ", ".join([*parts, body[15:]])
    if body.lower().startswith("with "):
        return "with " + ", ".join([*parts, body[5:]])
    return ("with " + ", ".join(parts) + " " if parts else "") + body
