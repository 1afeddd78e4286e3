"""The registered queries and, where SQL can say the same, their DuckDB twins.

Queries are built from the package's operators over the views of ``views``. Floats are
rounded to six places on both sides, since sums depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.functions import arrays as A
from chronoloom.functions import catch22 as C
from chronoloom.functions import distances as D
from chronoloom.functions import kernels, spectral
from chronoloom.operators import ensemble, evaluate, forecast, metrics, nearest, quality, resample
from chronoloom.plans.views import duck, view
from chronoloom.sources import results

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEYS = metrics.KEYS
K = "estimator, dataset, split, resample"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = duck(sql)
        return f

    return register


def _rounded(df, places: int = 6):
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- metrics -----------------------------------------------------------------------------


@query("q_accuracy", f"select {K}, round(avg(case when y_true = y_pred then 1e0 else 0e0 end), 6) as accuracy from clf_cases group by {K}")
def q_accuracy(spark, sf):
    return _rounded(metrics.accuracy(view(spark, sf, "clf_cases")))


_CLASSES = f"""
  cm as (select {K}, y_true, y_pred, count(*) as n from CASES group by all),
  lab as (select {K}, y_true as label from cm union select {K}, y_pred from cm),
  pc as (select l.*, coalesce((select sum(n) from cm where (cm.estimator, cm.dataset, cm.resample) = (l.estimator, l.dataset, l.resample) and cm.y_true = l.label), 0) as support,
     coalesce((select sum(n) from cm where (cm.estimator, cm.dataset, cm.resample) = (l.estimator, l.dataset, l.resample) and cm.y_pred = l.label), 0) as predicted,
     coalesce((select sum(n) from cm where (cm.estimator, cm.dataset, cm.resample) = (l.estimator, l.dataset, l.resample) and cm.y_true = l.label and cm.y_pred = l.label), 0) as hits from lab l),
  m as (select *, case when support = 0 then 0e0 else hits / cast(support as double) end as recall,
     case when support + predicted = 0 then 0e0 else 2e0 * hits / cast(support + predicted as double) end as f1 from pc)"""


@query("q_bal_acc", f"with {_CLASSES.replace('CASES', 'clf_cases')} select {K}, round(avg(recall), 6) as balanced_accuracy from m where support > 0 group by {K}")
def q_bal_acc(spark, sf):
    return _rounded(metrics.class_metrics(view(spark, sf, "clf_cases")).select(*KEYS, "balanced_accuracy"))


@query(
    "q_sens_spec",
    f"""with {_CLASSES.replace('CASES', 'clf_cases')},
    o as (select *, row_number() over (partition by {K} order by support, label) as up, row_number() over (partition by {K} order by support desc, label desc) as down from m where support > 0)
    select {K}, round(max(case when up = 1 then recall end), 6) as sensitivity, round(max(case when down = 1 then recall end), 6) as specificity from o group by {K}""",
)
def q_sens_spec(spark, sf):
    return _rounded(metrics.class_metrics(view(spark, sf, "clf_cases")).select(*KEYS, "sensitivity", "specificity"))


@query(
    "q_f1_binary",
    f"""with {_CLASSES.replace('CASES', 'clf_cases')},
    o as (select *, row_number() over (partition by {K} order by support, label) as up from m where support > 0)
    select {K}, round(max(case when up = 1 then f1 end), 6) as f1 from o group by {K}""",
)
def q_f1_binary(spark, sf):
    return _rounded(metrics.class_metrics(view(spark, sf, "clf_cases")).select(*KEYS, "f1"))


@query("q_f1_weighted", f"with {_CLASSES.replace('CASES', 'clf3_cases')} select {K}, round(sum(f1 * support) / sum(support), 6) as f1 from m group by {K}")
def q_f1_weighted(spark, sf):
    return _rounded(metrics.class_metrics(view(spark, sf, "clf3_cases")).select(*KEYS, "f1"))


@query(
    "q_logloss",
    f"""select {K}, round(-avg(ln(greatest(least(case when y_true = 1 then p1 else 1 - p1 end, 1 - 2.220446049250313e-16), 2.220446049250313e-16))), 6) as log_loss
    from clf_cases group by {K}""",
)
def q_logloss(spark, sf):
    return _rounded(metrics.log_loss(view(spark, sf, "clf_cases")))


@query(
    "q_auroc",
    f"""with r as (select *, rank() over (partition by {K} order by p1) + (count(*) over (partition by {K}, p1) - 1) / 2e0 as rk from clf_cases)
    select {K}, round((sum(case when y_true = 1 then rk else 0e0 end) - count(*) filter (y_true = 1) * (count(*) filter (y_true = 1) + 1) / 2e0)
      / (count(*) filter (y_true = 1) * cast(count(*) filter (y_true = 0) as double)), 6) as auroc from r group by {K}""",
)
def q_auroc(spark, sf):
    return _rounded(metrics.auroc(view(spark, sf, "clf_cases")))


_P3 = f"x as (select {K}, y_true, unnest([0, 1, 2]) as label, unnest([p0, p1, p2]) as score from clf3p_cases)"


@query("q_logloss_multi", f"select {K}, round(-avg(ln(greatest(least([p0, p1, p2][y_true + 1], 1 - 2.220446049250313e-16), 2.220446049250313e-16))), 6) as log_loss from clf3p_cases group by {K}")
def q_logloss_multi(spark, sf):
    return _rounded(metrics.log_loss(view(spark, sf, "clf3p_cases").withColumn("p", F.array("p0", "p1", "p2")), probs="p"))


@query(
    "q_auroc_multi",
    f"""with {_P3}, r as (select *, rank() over (partition by {K}, label order by score) + (count(*) over (partition by {K}, label, score) - 1) / 2e0 as rk from x),
    a as (select {K}, label, count(*) filter (y_true = label) as n, (sum(case when y_true = label then rk else 0e0 end) - count(*) filter (y_true = label) * (count(*) filter (y_true = label) + 1) / 2e0)
      / (count(*) filter (y_true = label) * cast(count(*) filter (y_true <> label) as double)) as area from r group by {K}, label)
    select {K}, round(sum(area * n) / sum(n), 6) as auroc from a group by {K}""",
)
def q_auroc_multi(spark, sf):
    return _rounded(metrics.auroc(view(spark, sf, "clf3p_cases").withColumn("p", F.array("p0", "p1", "p2")), probs="p"))


@query("q_confusion_matrix", f"select {K}, y_true, y_pred, count(*) as n from clf3_cases group by {K}, y_true, y_pred")
def q_confusion_matrix(spark, sf):
    return metrics.contingency(view(spark, sf, "clf3_cases"))


@query(
    "q_mse_rmse_mae",
    f"select {K}, round(avg((y_true - y_pred) ** 2), 2) as mse, round(sqrt(avg((y_true - y_pred) ** 2)), 4) as rmse, round(avg(abs(y_true - y_pred)), 4) as mae from reg_cases group by {K}",
)
def q_mse_rmse_mae(spark, sf):
    m = metrics.regression_metrics(view(spark, sf, "reg_cases"))
    return m.select(*KEYS, F.round("mse", 2).alias("mse"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"))


@query("q_r2", f"select {K}, round(1 - sum((y_true - y_pred) ** 2) / count(*) / var_pop(y_true), 6) as r2 from reg_cases group by {K}")
def q_r2(spark, sf):
    return _rounded(metrics.regression_metrics(view(spark, sf, "reg_cases")).select(*KEYS, "r2"))


@query("q_mape", f"select {K}, round(avg(abs(y_true - y_pred) / greatest(abs(y_true), 2.220446049250313e-16)), 6) as mape from reg_cases group by {K}")
def q_mape(spark, sf):
    return _rounded(metrics.regression_metrics(view(spark, sf, "reg_cases")).select(*KEYS, "mape"))


_PAIRS = f"""t as (select {K}, y_true, y_pred, count(*) as n from clu_cases group by all),
  ta as (select {K}, y_true, sum(n) as a from t group by all), tb as (select {K}, y_pred, sum(n) as b from t group by all),
  tn as (select {K}, sum(n) as m from t group by all)"""


@query(
    "q_rand_ari",
    f"""with {_PAIRS}, s as (select n.*, (select sum(n * (n - 1) / 2e0) from t where t.estimator = n.estimator) as same_pairs,
      (select sum(a * (a - 1) / 2e0) from ta where ta.estimator = n.estimator) as sa, (select sum(b * (b - 1) / 2e0) from tb where tb.estimator = n.estimator) as sb, m * (m - 1) / 2e0 as pairs from tn n)
    select {K}, round((pairs + 2 * same_pairs - sa - sb) / pairs, 6) as rand, round((same_pairs - sa * sb / pairs) / ((sa + sb) / 2 - sa * sb / pairs), 6) as adjusted_rand from s""",
)
def q_rand_ari(spark, sf):
    return _rounded(metrics.pair_metrics(view(spark, sf, "clu_cases")).select(*KEYS, "rand", "adjusted_rand"))


@query(
    "q_mi_nmi",
    f"""with {_PAIRS}, s as (select {K}, sum(n / cast(m as double) * ln(m * n / cast(a * b as double))) as mi from t join ta using ({K}, y_true) join tb using ({K}, y_pred) join tn using ({K}) group by all),
    ha as (select {K}, -sum(a / cast(m as double) * ln(a / cast(m as double))) as h from ta join tn using ({K}) group by all),
    hb as (select {K}, -sum(b / cast(m as double) * ln(b / cast(m as double))) as g from tb join tn using ({K}) group by all)
    select {K}, round(mi, 6) as mutual_information, round(mi / ((h + g) / 2), 6) as normalised_mi from s join ha using ({K}) join hb using ({K})""",
)
def q_mi_nmi(spark, sf):
    return _rounded(metrics.pair_metrics(view(spark, sf, "clu_cases")).select(*KEYS, "mutual_information", "normalised_mi"))


@query("q_clacc")
def q_clacc(spark, sf):
    return _rounded(metrics.matched_metrics(view(spark, sf, "clu_cases"), adjusted=False).select(*KEYS, "clustering_accuracy"))


@query(
    "q_ami",
    f"""with {_PAIRS}, lf as (select i as k, sum(case when i = 0 then 0e0 else ln(i) end) over (order by i) as f from (select unnest(range(0, (select cast(max(m) as bigint) + 1 from tn))) as i)),
    mi as (select {K}, sum(n / cast(m as double) * ln(m * n / cast(a * b as double))) as mi from t join ta using ({K}, y_true) join tb using ({K}, y_pred) join tn using ({K}) group by all),
    ha as (select {K}, -sum(a / cast(m as double) * ln(a / cast(m as double))) as h from ta join tn using ({K}) group by all),
    hb as (select {K}, -sum(b / cast(m as double) * ln(b / cast(m as double))) as g from tb join tn using ({K}) group by all),
    ab as (select {K}, a, b, m, count(*) as often from ta join tb using ({K}) join tn using ({K}) group by all),
    cells as (select *, unnest(range(greatest(1, cast(a + b - m as bigint)), cast(least(a, b) as bigint) + 1)) as k from ab),
    e as (select {K}, sum(often * c.k / m * ln(m * c.k / cast(a * b as double)) * exp(f1.f + f2.f + f3.f + f4.f - f5.f - f6.f - f7.f - f8.f - f9.f)) as e from cells c
      join lf f1 on f1.k = a join lf f2 on f2.k = b join lf f3 on f3.k = m - a join lf f4 on f4.k = m - b join lf f5 on f5.k = m join lf f6 on f6.k = c.k
      join lf f7 on f7.k = a - c.k join lf f8 on f8.k = b - c.k join lf f9 on f9.k = m - a - b + c.k group by all)
    select {K}, round((mi - e) / ((h + g) / 2 - e), 6) as adjusted_mi from mi join ha using ({K}) join hb using ({K}) join e using ({K})""",
)
def q_ami(spark, sf):
    return _rounded(metrics.matched_metrics(view(spark, sf, "clu_cases")).select(*KEYS, "adjusted_mi"))


# --- evaluation --------------------------------------------------------------------------

_FACTS = f"f as (select {K}, avg(case when y_true = y_pred then 1e0 else 0e0 end) as value from clf_cases group by {K})"
_GAPS = f"{_FACTS}, g as (select * from f where not (estimator = 'part' and dataset = '1-URGENT' and resample = 2))"
_MEANS = f"{_FACTS}, m as (select dataset, estimator, avg(value) as value from f group by dataset, estimator)"
_RANKS = f"{_MEANS}, r as (select *, rank() over (partition by dataset order by value desc) + (count(*) over (partition by dataset, value) - 1) / 2e0 as rk from m)"


def _facts(spark, sf):
    return metrics.accuracy(view(spark, sf, "clf_cases")).withColumnRenamed("accuracy", "value")


def _means(spark, sf):
    return evaluate.mean_over_resamples(_facts(spark, sf))


def _gaps(spark, sf):
    return _facts(spark, sf).where("not (estimator = 'part' and dataset = '1-URGENT' and resample = 2)")


@query("q_mean_over_resamples", f"with {_MEANS} select dataset, estimator, round(value, 6) as value from m")
def q_mean_over_resamples(spark, sf):
    return _rounded(_means(spark, sf))


@query("q_rank_ties", f"with {_RANKS} select dataset, estimator, round(value, 6) as value, rk as rank from r")
def q_rank_ties(spark, sf):
    return _rounded(evaluate.ranks(_means(spark, sf)))


@query("q_avg_rank_summary", f"with {_RANKS} select estimator, round(avg(value), 6) as mean_value, round(avg(rk), 6) as avg_rank from r group by estimator")
def q_avg_rank_summary(spark, sf):
    return _rounded(evaluate.summary(_means(spark, sf)))


@query("q_missing_report", f"with {_GAPS} select e.estimator, d.dataset, r.resample from (select distinct estimator from g) e, (select distinct dataset from g) d, (select distinct resample from g) r where not exists (select 1 from g where (g.estimator, g.dataset, g.resample) = (e.estimator, d.dataset, r.resample))")
def q_missing_report(spark, sf):
    return evaluate.missing(_gaps(spark, sf))


@query("q_complete_datasets", f"with {_GAPS} select dataset from g group by dataset having count(distinct (estimator, resample)) = (select count(distinct estimator) * count(distinct resample) from g)")
def q_complete_datasets(spark, sf):
    return evaluate.complete_datasets(_gaps(spark, sf))


@query("q_results_pivot", f"with {_MEANS} select dataset, round(max(value) filter (estimator = 'part'), 6) as part, round(max(value) filter (estimator = 'quantity'), 6) as quantity, round(max(value) filter (estimator = 'supplier'), 6) as supplier from m group by dataset")
def q_results_pivot(spark, sf):
    return _rounded(_means(spark, sf).groupBy("dataset").pivot("estimator", ["part", "quantity", "supplier"]).agg(F.max("value")))


@query("q_win_draw_loss", f"with {_MEANS} select a.estimator as a, b.estimator as b, count(*) filter (a.value > b.value) as wins, count(*) filter (a.value = b.value) as draws, count(*) filter (a.value < b.value) as losses from m a join m b on a.dataset = b.dataset and a.estimator <> b.estimator group by 1, 2")
def q_win_draw_loss(spark, sf):
    return evaluate.win_draw_loss(_means(spark, sf))


@query("q_pairwise_scatter", f"with {_MEANS} select a.dataset, a.estimator as a, b.estimator as b, round(a.value, 6) as value_a, round(b.value, 6) as value_b from m a join m b on a.dataset = b.dataset and a.estimator <> b.estimator")
def q_pairwise_scatter(spark, sf):
    return _rounded(evaluate.paired(_means(spark, sf)))


@query(
    "q_wilcoxon_w",
    f"""with {_MEANS}, d as (select a.estimator as a, b.estimator as b, a.value - b.value as d from m a join m b on a.dataset = b.dataset and a.estimator <> b.estimator where a.value <> b.value),
    k as (select *, rank() over (partition by a, b order by abs(d)) + (count(*) over (partition by a, b, abs(d)) - 1) / 2e0 as rk from d)
    select a, b, sum(case when d > 0 then rk else 0e0 end) as w_plus, sum(case when d < 0 then rk else 0e0 end) as w_minus, count(*) as n from k group by a, b""",
)
def q_wilcoxon_w(spark, sf):
    return evaluate.signed_ranks(_means(spark, sf))


@query("q_wilcoxon_p")
def q_wilcoxon_p(spark, sf):
    return _rounded(evaluate.p_values(_means(spark, sf)))


@query("q_dedupe_last", "select o_custkey, max_by(o_orderkey, o_orderkey) as o_orderkey, max_by(o_totalprice, o_orderkey) as o_totalprice from orders group by o_custkey")
def q_dedupe_last(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_totalprice", "o_orderkey")
    return evaluate.last_written(o, ["o_custkey"], "o_orderkey")


@query("q_time_to_ms", "select run, round(fit * case unit when 'seconds' then 1e3 when 'milliseconds' then 1e0 when 'minutes' then 6e4 when 'nanoseconds' then 1e-6 else 3.6e6 end, 1) as ms from runs_time")
def q_time_to_ms(spark, sf):
    return _rounded(view(spark, sf, "runs_time").select("run", results.to_milliseconds(F.col("fit"), F.col("unit")).alias("ms")), 1)


@query("q_prob_verify", f"select {K}, count(*) filter (p1 + (1 - p1) between 0.99999 and 1.00001 and p1 between 0 and 1) as good, count(*) as n from clf_cases group by {K}")
def q_prob_verify(spark, sf):
    c = view(spark, sf, "clf_cases").withColumn("probs", F.array(1 - F.col("p1"), F.col("p1")))
    ok = A.total(F.col("probs")).between(0.99999, 1.00001) & F.forall("probs", lambda p: p.between(0, 1))
    return c.groupBy(*KEYS).agg(F.count_if(ok).alias("good"), F.count("*").alias("n"))


@query("q_argmax_pred", "select vec_id, list_position(embedding, list_max(embedding)) - 1 as y_pred from embeddings")
def q_argmax_pred(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("p", F.col("embedding"))
    return e.select("vec_id", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("y_pred"))


@query("q_label_encode", "select event_id, dense_rank() over (order by event_type) - 1 as code from events")
def q_label_encode(spark, sf):
    # The dictionary is as short as the number of labels; cases join to it without a global window.
    e = spark.read.parquet(f"{sf}/events.parquet")
    labels = e.select("event_type").distinct()
    codes = labels.agg(F.sort_array(F.collect_set("event_type")).alias("l")).select(F.posexplode("l").alias("code", "event_type"))
    return e.join(codes, "event_type").select("event_id", F.col("code").cast("long").alias("code"))


@query("q_minority_majority", "with c as (select p_type as dataset, p_size % 5 as label, count(*) as n from part group by all) select dataset, arg_min(label, (n, label)) as minority, arg_max(label, (n, label)) as majority from c group by dataset")
def q_minority_majority(spark, sf):
    c = spark.read.parquet(f"{sf}/part.parquet").groupBy(F.col("p_type").alias("dataset"), (F.col("p_size") % 5).alias("label")).agg(F.count("*").alias("n"))
    return c.groupBy("dataset").agg(F.min_by("label", F.struct("n", "label")).alias("minority"), F.max_by("label", F.struct("n", "label")).alias("majority"))


@query("q_same_resample", "with a as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag as y from lineitem), b as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_partkey % 100 = 0 then 'X' else l_returnflag end as y from lineitem where l_suppkey % 50 <> 0) select count(*) filter (a.y <> b.y) as differ, count(*) filter (a.y is null or b.y is null) as unmatched from a full join b using (l_orderkey, l_linenumber, l_partkey, l_suppkey)")
def q_same_resample(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    a = li.select(*keys, F.col("l_returnflag").alias("y"))
    b = li.where("l_suppkey % 50 <> 0").select(*keys, F.when(F.col("l_partkey") % 100 == 0, "X").otherwise(F.col("l_returnflag")).alias("z"))
    both = a.join(b, keys, "full")
    return both.agg(F.count_if(F.col("y") != F.col("z")).alias("differ"), F.count_if(F.col("y").isNull() | F.col("z").isNull()).alias("unmatched"))


@query("q_skip_existing", "select c.c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey)")
def q_skip_existing(spark, sf):
    c, o = spark.read.parquet(f"{sf}/customer.parquet"), spark.read.parquet(f"{sf}/orders.parquet")
    return c.join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


# --- resampling --------------------------------------------------------------------------

_HASH = "(((({k} % 65536) * 40503 + ({k} // 65536) * 30011 + {s} * 7919) % 4294967296 * 69069 + 12345) % 4294967296)"


@query("q_resample", f"select vec_id, case when row_number() over (order by {_HASH.format(k='vec_id', s=1)}, vec_id) <= 300 then 'train' else 'test' end as split from embeddings")
def q_resample(spark, sf):
    return resample.resample(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id"), "vec_id", 300, 1)


@query("q_stratified_resample", f"select vec_id, label, case when row_number() over (partition by label order by {_HASH.format(k='vec_id', s=2)}, vec_id) <= count(*) filter (vec_id % 3 = 0) over (partition by label) then 'train' else 'test' end as split from embeddings")
def q_stratified_resample(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label")
    return resample.stratified_resample(e, "vec_id", "label", F.col("vec_id") % 3 == 0, 2)


@query("q_stratified_kfold", f"select vec_id, label, cast((row_number() over (partition by label order by {_HASH.format(k='vec_id', s=0)}, vec_id) - 1) % 10 as int) as fold from embeddings")
def q_stratified_kfold(spark, sf):
    return resample.folds(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label"), "vec_id", 10, 0, "label")


@query("q_kfold", f"select vec_id, cast((row_number() over (order by {_HASH.format(k='vec_id', s=0)}, vec_id) - 1) % 10 as int) as fold from embeddings")
def q_kfold(spark, sf):
    return resample.folds(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id"), "vec_id", 10)


@query("q_hashed_split", f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when {_HASH.format(k='l_orderkey', s=3)} < 3006477107 then 'train' else 'test' end as split from lineitem")
def q_hashed_split(spark, sf):
    return resample.hashed_split(spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey", 0.7, 3)


# --- series ------------------------------------------------------------------------------


def _series(spark, sf):
    return A.series(view(spark, sf, "ts_long"), ["user_id"])


def _points(df, name="v"):
    return df.select("user_id", F.posexplode(name).alias("t", "v")).select("user_id", F.col("t").cast("long").alias("t"), F.round("v", 6).alias("v"))


@query("q_znorm", "select user_id, t, round((v - avg(v) over w) / stddev_pop(v) over w, 6) as v from ts_long window w as (partition by user_id)")
def q_znorm(spark, sf):
    return _points(_series(spark, sf).select("user_id", A.znorm(F.col("x")).alias("v")))


@query("q_pad_zero", "with n as (select user_id, count(*) as n from ragged_long group by user_id), m as (select max(n) as m from n) select u.user_id, g.t, round(coalesce(r.v, 0e0), 6) as v from n u cross join m cross join (select unnest(range(0, (select m from m))) as t) g left join ragged_long r on r.user_id = u.user_id and r.t = g.t")
def q_pad_zero(spark, sf):
    s = A.series(view(spark, sf, "ragged_long"), ["user_id"])
    return _points(s.crossJoin(s.agg(F.max(F.size("x")).alias("m"))).select("user_id", A.pad(F.col("x"), F.col("m")).alias("v")))


@query("q_pad_stat", "with n as (select user_id, count(*) as n, avg(v) as a from ragged_long group by user_id), m as (select max(n) as m from n) select u.user_id, g.t, round(coalesce(r.v, u.a), 6) as v from n u cross join m cross join (select unnest(range(0, (select m from m))) as t) g left join ragged_long r on r.user_id = u.user_id and r.t = g.t")
def q_pad_stat(spark, sf):
    s = A.series(view(spark, sf, "ragged_long"), ["user_id"])
    return _points(s.crossJoin(s.agg(F.max(F.size("x")).alias("m"))).select("user_id", A.pad(F.col("x"), F.col("m"), "mean").alias("v")))


@query("q_diff", "select user_id, t - 1 as t, round(v - p, 6) as v from (select user_id, t, v, lag(v) over (partition by user_id order by t) as p from ts_long) where p is not null")
def q_diff(spark, sf):
    return _points(_series(spark, sf).select("user_id", A.diff(F.col("x")).alias("v")))


@query("q_derivative", "select user_id, t - 1 as t, round(((v - p) + (n - p) / 2) / 2, 6) as v from (select user_id, t, v, lag(v) over w as p, lead(v) over w as n from ts_long window w as (partition by user_id order by t)) where p is not null and n is not null")
def q_derivative(spark, sf):
    return _points(_series(spark, sf).select("user_id", A.derivative(F.col("x")).alias("v")))


@query("q_acf", "with p as (select user_id, l.lag as lag, v as a, lead(v, 1) over w as b1, lead(v, 2) over w as b2, lead(v, 3) over w as b3 from ts_long, (select 1 as lag) l window w as (partition by user_id order by t)) select user_id, round(corr(a, b1), 6) as acf1, round(corr(a, b2), 6) as acf2, round(corr(a, b3), 6) as acf3 from p group by user_id")
def q_acf(spark, sf):
    return _rounded(_series(spark, sf).select("user_id", *[A.autocorrelation(F.col("x"), k).alias(f"acf{k}") for k in (1, 2, 3)]))


@query("q_sliding_windows", "select user_id, t as start, round(a, 6) as total from (select user_id, t, sum(v) over (partition by user_id order by t rows between current row and 6 following) as a, count(*) over (partition by user_id order by t rows between current row and 6 following) as n from ts_long) where n = 7")
def q_sliding_windows(spark, sf):
    w = _series(spark, sf).select("user_id", F.posexplode(A.windows(F.col("x"), 7)).alias("start", "w"))
    return w.select("user_id", F.col("start").cast("long").alias("start"), F.round(A.total(F.col("w")), 6).alias("total"))


_ROLL = "over (partition by user_id order by t rows between 4 preceding and current row)"


@query("q_rolling_stats", f"select user_id, t, round(avg(v) {_ROLL}, 6) as mean, round(stddev_pop(v) {_ROLL}, 6) as std from ts_long")
def q_rolling_stats(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("t").rowsBetween(-4, 0)
    t = view(spark, sf, "ts_long")
    return t.select("user_id", F.col("t").cast("long").alias("t"), F.round(F.avg("v").over(w), 6).alias("mean"), F.round(F.stddev_pop("v").over(w), 6).alias("std"))


@query("q_summary_stats", "select user_id, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, round(min(v), 6) as low, round(max(v), 6) as high, round(median(v), 6) as median, round(regr_slope(v, t), 6) as slope from ts_long group by user_id")
def q_summary_stats(spark, sf):
    x = F.col("x")
    return _rounded(_series(spark, sf).select("user_id", A.mean(x).alias("mean"), F.sqrt(A.variance(x)).alias("std"), F.array_min(x).alias("low"), F.array_max(x).alias("high"), A.median(x).alias("median"), A.slope(x).alias("slope")))


@query("q_interval_features", "select user_id, t // 10 as interval, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, round(regr_slope(v, t), 6) as slope from ts_long group by user_id, t // 10")
def q_interval_features(spark, sf):
    x = F.slice("x", F.col("interval").cast("int") * 10 + 1, F.lit(10))
    s = _series(spark, sf).withColumn("interval", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.size("x") - 1) / 10))))
    return _rounded(s.select("user_id", "interval", A.mean(x).alias("mean"), F.sqrt(A.variance(x)).alias("std"), A.slope(x).alias("slope")))


@query("q_longest_run", "with f as (select user_id, t, v > avg(v) over (partition by user_id) as up from ts_long), g as (select *, t - row_number() over (partition by user_id, up order by t) as island from f), r as (select user_id, count(*) as n from g where up group by user_id, island) select u.user_id, coalesce(max(n), 0) as stretch_high from (select distinct user_id from f) u left join r using (user_id) group by u.user_id")
def q_longest_run(spark, sf):
    return _series(spark, sf).select("user_id", A.stretch_high(F.col("x")).cast("long").alias("stretch_high"))


@query("q_trev", "select user_id, round(avg((v - p) ** 3), 4) as trev from (select user_id, v, lag(v) over (partition by user_id order by t) as p from ts_long) where p is not null group by user_id")
def q_trev(spark, sf):
    return _rounded(_series(spark, sf).select("user_id", A.trev(F.col("x")).alias("trev")), 4)


@query("q_pnn40", "with z as (select user_id, t, (v - avg(v) over w) / stddev_pop(v) over w as z from ts_long window w as (partition by user_id)), d as (select user_id, abs(z - lag(z) over (partition by user_id order by t)) * 1000 as d from z) select user_id, round(avg(case when d > 40 then 1e0 else 0e0 end), 6) as pnn40 from d where d is not null group by user_id")
def q_pnn40(spark, sf):
    return _rounded(_series(spark, sf).select("user_id", A.pnn40(F.col("x")).alias("pnn40")))


@query("q_hist_mode", "with b as (select user_id, v, min(v) over w as lo, (max(v) over w - min(v) over w) / 5 as width from ts_long window w as (partition by user_id)), c as (select user_id, lo, width, least(cast(floor((v - lo) / width) as int), 4) as bin, count(*) as n from b group by all), d as (select *, max(n) over (partition by user_id) as top from c) select user_id, round(avg(lo + (bin + 5e-1) * width), 6) as mode_5 from d where n = top group by user_id")
def q_hist_mode(spark, sf):
    return _rounded(_series(spark, sf).select("user_id", A.histogram_mode(F.col("x"), 5).alias("mode_5")))


@query("q_word_bag")
def q_word_bag(spark, sf):
    w = _series(spark, sf).select("user_id", F.explode(A.windows(F.col("x"), 8)).alias("w")).select("user_id", A.word(F.col("w"), 4, 4).alias("word"))
    return w.groupBy("user_id", "word").agg(F.count("*").alias("n"))


@query("q_rocket_ppv_max", "with c as (select user_id, t, -1 * v + 2 * lead(v, 2) over w - lead(v, 4) over w - 10 as c from ts_long window w as (partition by user_id order by t)) select user_id, round(avg(case when c > 0 then 1e0 else 0e0 end), 6) as ppv, round(max(c), 6) as top from c where c is not null group by user_id")
def q_rocket_ppv_max(spark, sf):
    ppv, top = A.rocket(F.col("x"), [-1.0, 2.0, -1.0], -10.0, dilation=2)
    return _rounded(_series(spark, sf).select("user_id", ppv.alias("ppv"), top.alias("top")))


@query("q_catch22")
def q_catch22(spark, sf):
    return _rounded(_series(spark, sf).select("user_id", C.catch22(F.col("x")).alias("f")).select("user_id", "f.*"), 5)


@query("q_forecast_error", "select user_id, round(stddev_samp(e), 6) as forecast_error from (select user_id, t, v - avg(v) over (partition by user_id order by t rows between 3 preceding and 1 preceding) as e from ts_long) where t >= 3 group by user_id")
def q_forecast_error(spark, sf):
    return _rounded(_series(spark, sf).select("user_id", C.catch22(F.col("x"), names=("forecast_error",)).alias("f")).select("user_id", "f.forecast_error"))


@query("q_ami2", "with b as (select user_id, t, least(floor((v - lo) / ((hi - lo) / 5)), 4) as a from (select user_id, t, v, min(v) over w - 1e-1 as lo, max(v) over w + 1e-1 as hi from ts_long window w as (partition by user_id))), p as (select user_id, a, lead(a, 2) over (partition by user_id order by t) as b from b), h as (select user_id, a, b, count(*) as n from p where b is not null group by all), s as (select *, sum(n) over (partition by user_id, a) as na, sum(n) over (partition by user_id, b) as nb, sum(n) over (partition by user_id) as m from h) select user_id, round(sum(n / m * ln(n * m / (na * nb))), 6) as ami2 from s group by user_id")
def q_ami2(spark, sf):
    return _rounded(_series(spark, sf).select("user_id", C.catch22(F.col("x"), names=("ami2",)).alias("f")).select("user_id", "f.ami2"))


_DFT = "with n as (select user_id, max(t) + 1 as n, avg(v) as m from ts_long group by user_id), p as (select user_id, m, cast(2 ** ceil(log2(n)) as bigint) as w from n), k as (select *, unnest(range(0, w // 2)) as f from p) select k.user_id, k.f, round(sqrt(sum(VALUE * cos(2 * pi() * k.f * t / w)) ** 2 + sum(VALUE * sin(2 * pi() * k.f * t / w)) ** 2), 5) as v from k join ts_long s on s.user_id = k.user_id group by k.user_id, k.f"


def _frequencies(df):
    return df.select("user_id", F.posexplode("v").alias("f", "v")).select("user_id", F.col("f").cast("long").alias("f"), F.round("v", 5).alias("v"))


@query("q_power_spectrum", _DFT.replace("VALUE", "s.v"))
def q_power_spectrum(spark, sf):
    return _frequencies(_series(spark, sf).select("user_id", spectral.power_spectrum(F.col("x")).alias("v")))


@query("q_periodogram", _DFT.replace("VALUE", "(s.v - k.m)"))
def q_periodogram(spark, sf):
    return _frequencies(_series(spark, sf).select("user_id", spectral.periodogram(F.col("x")).alias("v")))


@query("q_sfa_words")
def q_sfa_words(spark, sf):
    return spectral.sfa(_series(spark, sf), "user_id", 8, 4, 4)


@query("q_sfa_dilated")
def q_sfa_dilated(spark, sf):
    return spectral.sfa(_series(spark, sf), "user_id", 6, 4, 2, "equi-width", dilation=3, difference=True, bigrams=True)


@query("q_kernel_features")
def q_kernel_features(spark, sf):
    f = kernels.kernel_features(_series(spark, sf), "user_id", features=168)
    return f.select("user_id", F.size("features").alias("n"), F.round(F.aggregate("features", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query("q_r_clustering")
def q_r_clustering(spark, sf):
    return kernels.r_cluster(_series(spark, sf), "user_id", 3, features=168)


@query("q_random_intervals")
def q_random_intervals(spark, sf):
    s = _series(spark, sf)
    longest = s.agg(F.max(F.size("x"))).first()[0] or 0
    return _rounded(s.select("user_id", F.posexplode(A.interval_features(F.col("x"), A.random_intervals(longest, 6, seed=1))).alias("place", "v")))


@query("q_low_noise_pad", "with n as (select user_id, count(*) as n from ragged_long group by user_id), m as (select max(n) as m from n) select user_id, (select m from m) as size, n as kept from n")
def q_low_noise_pad(spark, sf):
    s = A.series(view(spark, sf, "ragged_long"), ["user_id"])
    p = s.crossJoin(s.agg(F.max(F.size("x")).alias("m"))).select("user_id", "x", A.noisy_pad(F.col("x"), F.col("m"), F.col("user_id")).alias("p"))
    kept = F.size(F.filter("p", lambda v, i: (i < F.size("x")) | (F.abs(v) > 0.1))).cast("long")
    return p.select("user_id", F.size("p").cast("long").alias("size"), kept.alias("kept"))


@query("q_unequal")
def q_unequal(spark, sf):
    s = _series(spark, sf)
    return s.select("user_id", *[F.size(A.unequal(F.col("x"), F.col("user_id"), how=h)).alias(h) for h in ("start", "end", "random", "resize")])


# --- distances ---------------------------------------------------------------------------


def _neighbours(spark, sf):
    """Each series beside that of the next user id: an equi-join, one pair a user."""
    s = _series(spark, sf)
    other = s.select((F.col("user_id") - 1).alias("user_id"), F.col("x").alias("y"))
    return s.join(other, "user_id")


_BESIDE = "with l as (select user_id, list(v order by t) as x from ts_long group by user_id)"


@query("q_euclid", f"{_BESIDE} select a.user_id, round(list_distance(a.x, b.x), 6) as d from l a join l b on b.user_id = a.user_id + 1")
def q_euclid(spark, sf):
    return _rounded(_neighbours(spark, sf).select("user_id", D.euclidean(F.col("x"), F.col("y")).alias("d")))


@query("q_minkowski", f"{_BESIDE} select a.user_id, round(list_sum(list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2]) ** 3)) ** (1e0 / 3), 6) as d from l a join l b on b.user_id = a.user_id + 1")
def q_minkowski(spark, sf):
    return _rounded(_neighbours(spark, sf).select("user_id", D.minkowski(F.col("x"), F.col("y"), 3).alias("d")))


#: One cell a step: k numbers the cells row by row, ``above`` is the last whole row and ``r`` the row so far.
_CELLS = """with recursive l as (select user_id, list(v order by t) as s from ts_long group by user_id),
  o as (select user_id, SERIES as s from l),
  q as (select a.user_id, a.s as x, b.s as y, len(a.s) as n, len(b.s) as m from o a join o b on b.user_id = a.user_id + 1),
  c as (select user_id, x, y, n, m, 0 as k, ROW0 as above, [COLUMN0(1)] as r from q
    union all
    select user_id, x, y, n, m, k + 1, if(j = m, list_append(r, v), above), if(j = m, [COLUMN0(i + 1)], list_append(r, v))
    from (select *, WAYS as v from (select *, k // m + 1 as i, k % m + 1 as j, x[k // m + 1] as a, y[k % m + 1] as b, above[k % m + 1] as d, above[k % m + 2] as u, r[-1] as f,
      if(k // m = 0, 0e0, x[k // m]) as pa, if(k % m = 0, 0e0, y[k % m]) as pb from c where k < n * m)))
  select user_id, round(LAST, 6) as d from c where k = n * m"""
_WALL = "list_concat([0e0], list_transform(range(m), lambda z: cast('infinity' as double)))"
_NONE = "list_transform(range(m + 1), lambda z: 0e0)"
_SPLIT = "if(({p} <= {v} and {v} <= {q}) or ({p} >= {v} and {v} >= {q}), 1e0, 1e0 + least(abs({v} - {p}), abs({v} - {q})))"
_BAND = "if(abs(i / n - j / m) > 2e-1, cast('infinity' as double), {})"
_SLOPE = "list_transform(range(2, len(s)), lambda z: ((s[z] - s[z - 1]) + (s[z + 1] - s[z - 1]) / 2) / 2)"
_FAR = "cast('infinity' as double)"


def _cells(ways: str, series: str = "s", row0: str = _WALL, column0: str = _FAR, last: str = "above[-1]") -> str:
    return _CELLS.replace("WAYS", ways).replace("SERIES", series).replace("ROW0", row0).replace("COLUMN0(1)", column0.replace("@", "1")).replace("COLUMN0(i + 1)", column0.replace("@", "(i + 1)")).replace("LAST", last)


_ELASTIC = {
    "dtw": ({}, _cells(_BAND.format("(a - b) ** 2 + least(d, u, f)"))),
    "ddtw": ({}, _cells(_BAND.format("(a - b) ** 2 + least(d, u, f)"), _SLOPE)),
    "wdtw": ({}, _cells("(a - b) ** 2 / (1 + exp(-5e-2 * (abs(i - j) - n / 2e0))) + least(d, u, f)")),
    "wddtw": ({}, _cells("(a - b) ** 2 / (1 + exp(-5e-2 * (abs(i - j) - n / 2e0))) + least(d, u, f)", _SLOPE)),
    "adtw": ({}, _cells("(a - b) ** 2 + least(d, u + 1, f + 1)")),
    "msm": ({}, _cells(f"least(d + abs(a - b), if(i = 1, {_FAR}, u + {_SPLIT.format(v='a', p='pa', q='b')}), if(j = 1, {_FAR}, f + {_SPLIT.format(v='b', p='a', q='pb')}))")),
    "erp": ({}, _cells("least(d + abs(a - b), u + abs(a - 5e-2), f + abs(b - 5e-2))", row0="list_transform(range(m + 1), lambda z: coalesce(list_sum(list_transform(y[1:z], lambda w: abs(w - 5e-2))), 0e0))", column0="list_sum(list_transform(x[1:@], lambda w: abs(w - 5e-2)))")),
    "lcss": ({}, _cells("if(abs(a - b) <= 1, d + 1, greatest(u, f))", row0=_NONE, column0="0e0", last="1 - above[-1] / least(n, m)")),
    "edr": ({"epsilon": 10.0}, _cells("least(d + if(abs(a - b) <= 10, 0e0, 1e0), u + 1, f + 1)", row0=_NONE, column0="0e0", last="above[-1] / greatest(n, m)")),
    "twe": ({}, _cells("least(d + abs(a - b) + abs(pa - pb) + 2e-3 * abs(i - j), u + abs(a - pa) + 1.001e0, f + abs(b - pb) + 1.001e0)")),
    "soft_dtw": ({}, None),
    "shape_dtw": ({"reach": 3}, None),
}


def _elastic(name: str, parameters: dict, sql: str | None):
    @query(f"q_{name}", sql)
    def q(spark, sf):
        return _rounded(_neighbours(spark, sf).select("user_id", D.distance(name, F.col("x"), F.col("y"), **parameters).alias("d")))

    return q


for _name, (_parameters, _sql) in _ELASTIC.items():
    _elastic(_name, _parameters, _sql)


@query("q_warp_path")
def q_warp_path(spark, sf):
    return D.paths(_neighbours(spark, sf)).select("user_id", F.size("path").cast("long").alias("steps"))


@query("q_erp_scale", "select round(sum(s), 4) as deviation from (select t, stddev_pop(v) as s from ts_long group by t)")
def q_erp_scale(spark, sf):
    return _rounded(D.column_deviation(_series(spark, sf)), 4)


@query("q_warp_penalty")
def q_warp_penalty(spark, sf):
    return D.warp_penalty(_series(spark, sf), "user_id")


@query(
    "q_1nn_ed",
    """with p as (select a.vec_id, b.vec_id as other, b.label, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (cast(z[1] as double) - cast(z[2] as double)) ** 2)) as d
      from embeddings a, embeddings b where a.vec_id % 10 = 0 and b.vec_id % 10 <> 0)
    select vec_id, arg_min(label, (round(d, 9), other)) as y_pred from p group by vec_id""",
)
def q_1nn_ed(spark, sf):
    """Queries, every tenth vector, against all others."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", F.col("label").alias("y_pred"))
    out = nearest.nearest_label(e.where("vec_id % 10 = 0"), e.where("vec_id % 10 <> 0"), "vec_id", "embedding", "y_pred")
    return out.withColumn("y_pred", F.col("y_pred").cast("int"))


@query("q_shapelet_dist")
def q_shapelet_dist(spark, sf):
    s = _series(spark, sf)
    shapelet = s.orderBy("user_id").limit(1).select(F.slice("x", 6, 8).alias("s"))
    return _rounded(s.crossJoin(shapelet).select("user_id", A.shapelet_distance(F.col("x"), F.col("s")).alias("d")))


@query("q_hist_intersection", "with h as (select user_id, event_type, count(*) as n from events group by all) select a.user_id, cast(sum(least(a.n, b.n)) as bigint) as shared from h a join h b on b.user_id = a.user_id + 1 and a.event_type = b.event_type group by a.user_id")
def q_hist_intersection(spark, sf):
    h = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    other = h.select((F.col("user_id") - 1).alias("user_id"), "event_type", F.col("n").alias("m"))
    return h.join(other, ["user_id", "event_type"]).groupBy("user_id").agg(F.sum(F.least("n", "m")).alias("shared"))


# --- quality of splits -------------------------------------------------------------------


@query(
    "q_info_gain",
    """with e as (select label, cast(embedding[1] as double) as d, cast(label < 5 as int) as c from embeddings),
    g as (select d, sum(c) as c1, count(*) - sum(c) as c0 from e group by d),
    s as (select d, sum(c1) over (order by d) as l1, sum(c0) over (order by d) as l0, sum(c1) over () as t1, sum(c0) over () as t0 from g),
    h as (select d, l1 + l0 as l, t1 + t0 - l1 - l0 as r, l1, l0, t1 - l1 as r1, t0 - l0 as r0, t1, t0, t1 + t0 as n from s where t1 + t0 > l1 + l0),
    i as (select d, (case when t1 > 0 then -t1 / n * log2(t1 / n) else 0 end + case when t0 > 0 then -t0 / n * log2(t0 / n) else 0 end)
      - l / n * (case when l1 > 0 then -l1 / l * log2(l1 / l) else 0 end + case when l0 > 0 then -l0 / l * log2(l0 / l) else 0 end)
      - r / n * (case when r1 > 0 then -r1 / r * log2(r1 / r) else 0 end + case when r0 > 0 then -r0 / r * log2(r0 / r) else 0 end) as gain from h)
    select round(max(gain), 6) as gain from i""",
)
def q_info_gain(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.get("embedding", F.lit(0)).cast("double").alias("d"), (F.col("label") < 5).cast("int").alias("c"))
    return quality.information_gain(e, "d", "c").select(F.round("gain", 6).alias("gain"))


@query(
    "q_gini_gain",
    """with c as (select p_brand as leaf, p_size % 3 as label, count(*) as n from part group by all), l as (select leaf, sum(n) as m, 1 - sum(cast(n as double) ** 2) / sum(n) ** 2 as g from c group by leaf),
    t as (select label, sum(n) as n from c group by label), p as (select 1 - sum(cast(n as double) ** 2) / sum(n) ** 2 as g, sum(n) as n from t)
    select round((select g from p) - sum(m * g) / (select n from p), 6) as gini_gain from l""",
)
def q_gini_gain(spark, sf):
    c = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("leaf"), (F.col("p_size") % 3).alias("label"))
    return quality.gini_gain(c, "leaf", "label").select(F.round("gain", 6).alias("gini_gain"))


@query("q_f_stat", "with e as (select label, cast(embedding[1] as double) as v from embeddings), g as (select label, count(*) as n, avg(v) as m, var_pop(v) * count(*) as s from e group by label), a as (select avg(v) as m, count(*) as n from e) select round((sum(g.n * (g.m - a.m) ** 2) / (count(*) - 1)) / (sum(g.s) / (max(a.n) - count(*))), 6) as f_stat from g, a")
def q_f_stat(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("label", F.get("embedding", F.lit(0)).cast("double").alias("v"))
    return quality.f_statistic(e, "v", "label").select(F.round("f_stat", 6).alias("f_stat"))


_E1 = "e as (select label, vec_id, cast(embedding[1] as double) as v from embeddings)"


@query("q_median_test", f"with {_E1}, m as (select median(v) as m from e), t as (select label, v > m as up, count(*) as n from e, m group by all), r as (select label, sum(n) as r from t group by label), c as (select up, sum(n) as c from t group by up), g as (select r.label, c.up, r, c, coalesce(t.n, 0) as n, sum(coalesce(t.n, 0)) over () as m from r cross join c left join t on t.label = r.label and t.up = c.up) select round(sum((n - r * c / cast(m as double)) ** 2 / (r * c / cast(m as double))), 6) as chi2 from g")
def q_median_test(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("label", F.get("embedding", F.lit(0)).cast("double").alias("v"))
    return quality.median_test(e, "v", "label").select(F.round("chi2", 6).alias("chi2"))


@query("q_kruskal_wallis", f"with {_E1}, r as (select label, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2e0 as rk, count(*) over () as m from e), g as (select label, count(*) as n, sum(rk) as s, max(m) as m from r group by label), ties as (select sum(n ** 3 - n) as t from (select count(*) as n from e group by v)) select round((12e0 / (max(m) * (max(m) + 1)) * sum(s * s / n) - 3 * (max(m) + 1)) / (1 - (select t from ties) / (max(m) ** 3 - max(m))), 5) as h from g")
def q_kruskal_wallis(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("label", F.get("embedding", F.lit(0)).cast("double").alias("v"))
    return quality.kruskal_wallis(e, "v", "label").select(F.round("h", 5).alias("h"))


@query("q_kolmogorov_smirnov", f"with {_E1}, r as (select v, sum(case when label < 5 then 1 else 0 end) as a, sum(case when label < 5 then 0 else 1 end) as b from e group by v), s as (select sum(a) over (order by v) / cast(sum(a) over () as double) as fa, sum(b) over (order by v) / cast(sum(b) over () as double) as fb from r) select round(max(abs(fa - fb)), 6) as ks from s")
def q_kolmogorov_smirnov(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select((F.col("label") < 5).cast("int").alias("c"), F.get("embedding", F.lit(0)).cast("double").alias("v"))
    return quality.two_samples(e, "v", "c").select(F.round("ks", 6).alias("ks"))


@query("q_wasserstein", f"with {_E1}, r as (select v, sum(case when label < 5 then 1 else 0 end) as a, sum(case when label < 5 then 0 else 1 end) as b from e group by v), s as (select v, lead(v) over (order by v) as w, sum(a) over (order by v) / cast(sum(a) over () as double) as fa, sum(b) over (order by v) / cast(sum(b) over () as double) as fb from r), g as (select avg(v) filter (label < 5) as m1, avg(v) filter (label >= 5) as m2, stddev_pop(v) filter (label < 5) as s1, stddev_pop(v) filter (label >= 5) as s2 from e) select round(sum(abs(fa - fb) * (w - v)), 6) as empirical, (select round(sqrt((m1 - m2) ** 2 + (s1 - s2) ** 2), 6) from g) as gaussian from s where w is not null")
def q_wasserstein(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select((F.col("label") < 5).cast("int").alias("c"), F.get("embedding", F.lit(0)).cast("double").alias("v"))
    return _rounded(quality.two_samples(e, "v", "c").select("empirical", "gaussian"))


@query("q_target_r2", f"with {_E1} select round(corr(v, vec_id) ** 2, 6) as r2 from e")
def q_target_r2(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("double").alias("y"), F.get("embedding", F.lit(0)).cast("double").alias("v"))
    return quality.r_squared(e, "v", "y").select(F.round("r2", 6).alias("r2"))


# --- ensembles ---------------------------------------------------------------------------


@query("q_hive_weighted", f"with {_FACTS} select c.dataset, c.resample, c.case_id, round(sum(f.value ** 4 * c.p1) / sum(f.value ** 4), 6) as p1 from clf_cases c join f on f.estimator = c.estimator and f.dataset = c.dataset and f.resample = c.resample group by c.dataset, c.resample, c.case_id")
def q_hive_weighted(spark, sf):
    cases = view(spark, sf, "clf_cases")
    acc = metrics.accuracy(cases)
    return _rounded(ensemble.weighted_vote(cases, acc).select("dataset", "resample", "case_id", "p1"))


_ACC3 = f"f3 as (select {K}, avg(case when y_true = y_pred then 1e0 else 0e0 end) as value from clf3p_cases group by {K})"


@query("q_hive_multi", f"with {_ACC3}, v as (select c.dataset, c.resample, c.case_id, sum(w * p0) as s0, sum(w * p1) as s1, sum(w * p2) as s2 from (select *, f3.value ** 4 as w from clf3p_cases c join f3 using ({K})) c group by all) select dataset, resample, case_id, round(s0 / (s0 + s1 + s2) + 1e-9, 6) as p0, round(s1 / (s0 + s1 + s2) + 1e-9, 6) as p1, round(s2 / (s0 + s1 + s2) + 1e-9, 6) as p2 from v")
def q_hive_multi(spark, sf):
    c = view(spark, sf, "clf3p_cases").withColumn("probs", F.array("p0", "p1", "p2"))
    v = ensemble.hive_from_files(c, c)
    return _rounded(v.select("dataset", "resample", "case_id", *[(F.get("probs", F.lit(i)) + 1e-9).alias(f"p{i}") for i in range(3)]))


@query("q_hive_tuned")
def q_hive_tuned(spark, sf):
    return ensemble.tune_alpha(view(spark, sf, "clf3p_cases").withColumn("probs", F.array("p0", "p1", "p2")))


@query("q_acc_filter", f"with {_ACC3}, b as (select *, max(value) over (partition by dataset, resample) as best from f3) select estimator, dataset, resample, round(value ** 4, 6) as w from b where value >= best * 9.9e-1")
def q_acc_filter(spark, sf):
    return _rounded(ensemble.member_weights(metrics.accuracy(view(spark, sf, "clf3p_cases")), 4.0, share_of_best=0.99))


@query("q_simple_vote")
def q_simple_vote(spark, sf):
    return _rounded(ensemble.simple_vote(ensemble.align(view(spark, sf, "clu_cases"), "head")))


@query("q_ivc")
def q_ivc(spark, sf):
    return ensemble.iterative_vote(view(spark, sf, "clu_cases"), 10)


# --- forecasting -------------------------------------------------------------------------


def _train_test(spark, sf):
    s = A.series(view(spark, sf, "fc_long"), ["series"])
    return s.select("series", F.slice("x", F.lit(1), F.size("x") - 6).alias("x"), F.slice("x", F.size("x") - 5, F.lit(6)).alias("y"))


def _forecast(spark, sf, make):
    s = _train_test(spark, sf).withColumn("f", make(F.col("x")))
    p = s.select("series", F.posexplode("f").alias("h", "v"))
    return p.select("series", F.col("h").cast("long").alias("h"), F.round("v", 6).alias("v"))


_H = "(select unnest(range(0, 6)) as h) g"


@query("q_fc_naive", f"select series, h, round(arg_max(v, t), 6) as v from fc_long, {_H} where back >= 6 group by series, h")
def q_fc_naive(spark, sf):
    return _forecast(spark, sf, lambda x: forecast.naive(x, 6))


@query("q_fc_mean", f"select series, h, round(avg(v), 6) as v from fc_long, {_H} where back >= 6 group by series, h")
def q_fc_mean(spark, sf):
    return _forecast(spark, sf, lambda x: forecast.mean_forecast(x, 6))


@query("q_fc_drift", f"select series, h, round(arg_max(v, t) + (h + 1) * (arg_max(v, t) - arg_min(v, t)) / (count(*) - 1), 6) as v from fc_long, {_H} where back >= 6 group by series, h")
def q_fc_drift(spark, sf):
    return _forecast(spark, sf, lambda x: forecast.drift(x, 6))


@query("q_fc_ses", f"select series, h, round(sum(case when t = 0 then v * 7e-1 ** (back - 6) else v * 3e-1 * 7e-1 ** (back - 6) end), 6) as v from fc_long, {_H} where back >= 6 group by series, h")
def q_fc_ses(spark, sf):
    return _forecast(spark, sf, lambda x: forecast.ses(x, 6, 0.3))


@query("q_fc_seasonal_naive", f"select f.series, h, round(f.v, 6) as v from {_H} join fc_long f on f.back = 12 - h % 7")
def q_fc_seasonal_naive(spark, sf):
    return _forecast(spark, sf, lambda x: forecast.seasonal_naive(x, 6, 7))


@query("q_ets")
def q_ets(spark, sf):
    return _forecast(spark, sf, lambda x: forecast.ets(x, 6, trend="additive", season="additive", period=7))


@query("q_ets_grid")
def q_ets_grid(spark, sf):
    grid = [(a, b, p) for a in (0.1, 0.5, 0.9) for b in (0.0, 0.1) for p in (0.9, 1.0)]
    return _forecast(spark, sf, lambda x: forecast.ets_grid(x, 6, grid))


@query("q_fc_mape", "with p as (select series, arg_max(v, t) as f from fc_long where back >= 6 group by series) select p.series, round(avg(abs(l.v - f) / greatest(abs(l.v), 2.220446049250313e-16)), 6) as mape from p join fc_long l on l.series = p.series and l.back < 6 group by p.series")
def q_fc_mape(spark, sf):
    s = _train_test(spark, sf).select("series", F.explode(F.arrays_zip("y", forecast.naive(F.col("x"), 6).alias("f"))).alias("p"))
    cases = s.select("series", F.col("p.y").alias("y_true"), F.col("p.f").alias("y_pred")).where("y_true is not null")
    return _rounded(metrics.regression_metrics(cases, ["series"]).select("series", "mape"))


# --- extension ---------------------------------------------------------------------------


@query("q_rollup_ext", "select estimator, dataset, round(avg(case when y_true = y_pred then 1e0 else 0e0 end), 6) as accuracy, count(*) as n from clf_cases group by rollup (estimator, dataset)")
def q_rollup_ext(spark, sf):
    c = view(spark, sf, "clf_cases")
    return _rounded(c.rollup("estimator", "dataset").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"), F.count("*").alias("n")))
