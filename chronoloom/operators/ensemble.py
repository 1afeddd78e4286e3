"""Ensembles over stored predictions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.metrics import assign


def weighted_vote(cases: DataFrame, accuracies: DataFrame, alpha: float = 4.0, keys: tuple = ("dataset", "split", "resample", "case_id")) -> DataFrame:
    """Probability of label 1 from members' ``p1``, each weighted by its train accuracy to the power ``alpha``.

    ``accuracies`` holds (estimator, dataset, resample, accuracy): a few rows, joined by Catalyst's choice.
    """
    w = accuracies.select("estimator", "dataset", "resample", F.pow("accuracy", F.lit(alpha)).alias("w"))
    both = cases.join(w, ["estimator", "dataset", "resample"])
    out = both.groupBy(*keys).agg((F.sum(F.col("w") * F.col("p1")) / F.sum("w")).alias("p1"), F.first("y_true").alias("y_true"))
    return out.withColumn("y_pred", F.when(F.col("p1") > 0.5, 1).otherwise(0))


def filter_members(accuracies: DataFrame, share_of_best: float) -> DataFrame:
    """Members whose accuracy is at least ``share_of_best`` of the best of their dataset and resample."""
    best = F.max("accuracy").over(Window.partitionBy("dataset", "resample"))
    return accuracies.withColumn("best", best).where(F.col("accuracy") >= F.col("best") * share_of_best).drop("best")


def align(cases: DataFrame, reference: str, case: str = "case_id") -> DataFrame:
    """Rename each clusterer's clusters to those of ``reference`` that they share most cases with.

    The contingency tables, one small table a clusterer, are solved as assignments.
    """
    import numpy as np

    from chronoloom.session import ship

    ship(cases.sparkSession)
    base = cases.where(F.col("estimator") == reference).select(case, F.col("y_pred").alias("base"))
    pairs = cases.join(base, case).groupBy("estimator", "y_pred", "base").agg(F.count("*").alias("n"))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        size = int(max(part["y_pred"].max(), part["base"].max())) + 1
        m = np.zeros((size, size))
        m[part["y_pred"], part["base"]] = part["n"]
        to = assign(-m)
        return pd.DataFrame({"estimator": part["estimator"].iloc[0], "y_pred": range(size), "aligned": to})

    table = pairs.groupBy("estimator").applyInPandas(solve, "estimator string, y_pred int, aligned int")
    return cases.join(table, ["estimator", "y_pred"]).withColumn("y_pred", F.col("aligned")).drop("aligned")


def simple_vote(aligned: DataFrame, case: str = "case_id") -> DataFrame:
    """Cluster with most votes, the least at a tie, and its share."""
    votes = aligned.groupBy(case, "y_pred").agg(F.count("*").alias("n"))
    return votes.groupBy(case).agg(
        F.max_by("y_pred", F.struct(F.col("n"), -F.col("y_pred"))).alias("y_pred"),
        (F.max("n") / F.sum("n")).alias("share"),
    )


def vote(cases: DataFrame, weights: DataFrame, seed: int = 0, keys: tuple = ("dataset", "split", "resample", "case_id")) -> DataFrame:
    """(keys, probs, y_true, y_pred): members' class probabilities, weighted and scaled to sum 1; the greatest wins, a tie falls by a seeded hash of the case.

    ``cases`` holds ``probs`` of equal length, ``weights`` (estimator, dataset, resample, w).
    """
    both = cases.join(weights.select("estimator", "dataset", "resample", "w"), ["estimator", "dataset", "resample"])
    each = both.select(*keys, "y_true", "w", F.posexplode("probs").alias("label", "p"))
    s = each.groupBy(*keys, "label").agg(F.sum(F.col("w") * F.col("p")).alias("s"), F.first("y_true").alias("y_true"))
    rows = s.groupBy(*keys).agg(F.first("y_true").alias("y_true"), F.transform(F.array_sort(F.collect_list(F.struct("label", "s"))), lambda v: v["s"]).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda t, v: t + v)
    rows = rows.withColumn("probs", F.when(total > 0, F.transform("s", lambda v: v / total)).otherwise(F.transform("s", lambda v: 1.0 / F.size("s"))))
    best = F.filter(F.sequence(F.lit(0), F.size("probs") - 1), lambda i: F.get("probs", i) == F.array_max("probs"))
    pick = F.get(best, F.pmod(F.xxhash64(F.lit(seed), *keys), F.size(best)).cast("int"))
    return rows.select(*keys, "probs", "y_true", pick.alias("y_pred"))


def member_weights(accuracies: DataFrame, alpha: float = 4.0, new_weights: dict[str, float] | None = None, share_of_best: float | None = None) -> DataFrame:
    """(estimator, dataset, resample, w): accuracy to the power ``alpha``, or the weights given by name; members under a share of the best are left out."""
    kept = accuracies if share_of_best is None else filter_members(accuracies, share_of_best)
    w = F.pow("accuracy", F.lit(float(alpha)))
    if new_weights:
        given = F.try_element_at(F.create_map(*[F.lit(x) for p in new_weights.items() for x in p]), F.col("estimator"))
        w = F.coalesce(given, w)
    return kept.select("estimator", "dataset", "resample", w.alias("w"))


def tune_alpha(train: DataFrame, alphas: tuple = tuple(range(1, 10)), k: int = 10) -> DataFrame:
    """(dataset, resample, alpha): the power whose weighted vote does best over ``k`` stratified folds of the train cases, the least at a tie.

    A fold's weights come from the members' accuracies on the other folds. ``train`` holds
    (estimator, dataset, resample, case_id, probs, y_true, y_pred).
    """
    from chronoloom.operators.resample import order_bin, order_key

    group = ["dataset", "resample"]
    # One shuffle of the train rows: bins of the hash order hold whole cases, and all that follows is inside a bin or has few rows.
    d = train.withColumn("ok", (F.col("y_true") == F.col("y_pred")).cast("double")).withColumn("bin", order_bin("case_id"))
    d = d.select(*group, "bin", "case_id", F.struct("estimator", "ok", "y_true", "probs").alias("m")).repartition(*group, "bin")
    one = d.groupBy(*group, "bin", "case_id").agg(F.sort_array(F.collect_list("m")).alias("members"))
    one = one.withColumn("y_true", F.array_min(F.transform("members", lambda m: m["y_true"])))
    before = Window.partitionBy(*group, "y_true").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sizes = one.groupBy(*group, "bin", "y_true").agg(F.count("*").alias("n")).select(*group, "bin", "y_true", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))
    sizes = sizes.where("y_true is not null").groupBy(*group, "bin").agg(F.map_from_entries(F.collect_list(F.struct("y_true", "n"))).alias("before"))
    place = F.row_number().over(Window.partitionBy(*group, "bin", "y_true").orderBy(order_key("case_id"), "case_id")) - 1
    dealt = one.join(sizes, [*group, "bin"]).withColumn("fold", ((F.try_element_at("before", "y_true") + place) % k).cast("int"))
    member = dealt.select(*group, "fold", F.explode("members").alias("m")).groupBy(*group, "m.estimator", "fold").agg(F.sum("m.ok").alias("ok"), F.count("*").alias("n"))
    every = Window.partitionBy(*group, "estimator")
    outside = (F.sum("ok").over(every) - F.col("ok")) / F.nullif(F.sum("n").over(every) - F.col("n"), F.lit(0))
    powers = F.array(*[F.pow(F.coalesce(outside, F.lit(0.0)), F.lit(int(a))) for a in alphas])
    weights = member.select(*group, "fold", "estimator", powers.alias("w")).groupBy(*group, "fold").agg(F.map_from_entries(F.collect_list(F.struct("estimator", "w"))).alias("w"))
    each = dealt.join(F.broadcast(weights), [*group, "fold"]).select(*group, "y_true", F.transform("members", lambda m: F.struct(m["probs"].alias("p"), F.try_element_at("w", m["estimator"]).alias("w"))).alias("v"))
    each = each.withColumn("labels", F.array_max(F.transform("v", lambda m: F.size(m["p"])))).where("labels > 0")

    def right(i: int):
        score = lambda label: F.aggregate("v", F.lit(0.0), lambda t, m: t + F.coalesce(F.get(m["w"], F.lit(i)) * F.get(m["p"], label), F.lit(0.0)))
        best = F.array_max(F.transform(F.sequence(F.lit(0), F.col("labels") - 1), lambda label: F.struct(F.round(score(label), 12).alias("s"), (-label).alias("l"))))
        return F.avg((-best["l"] == F.col("y_true")).cast("double"))

    score = each.groupBy(*group).agg(*[right(i).alias(f"s{i}") for i in range(len(alphas))])
    best = F.array_max(F.array(*[F.struct(F.round(f"s{i}", 12).alias("s"), F.lit(-int(a)).alias("a")) for i, a in enumerate(alphas)]))
    return score.select(*group, (-best["a"]).alias("alpha"))


def hive_from_files(test: DataFrame, train: DataFrame, alpha: float | None = 4.0, share_of_best: float | None = None, new_weights: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """The weighted vote of members whose test and train cases were read from results files; ``alpha`` None tunes it on the train cases."""
    acc = train.groupBy("estimator", "dataset", "resample").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))
    if alpha is None:
        kept = acc if share_of_best is None else filter_members(acc, share_of_best)
        w = kept.join(tune_alpha(train), ["dataset", "resample"]).select("estimator", "dataset", "resample", F.pow("accuracy", F.col("alpha")).alias("w"))
    else:
        w = member_weights(acc, alpha, new_weights, share_of_best)
    return vote(test, w, seed)


def check_clusters(cases: DataFrame, k: int) -> None:
    """An error unless every member has the labels 0 .. k - 1, all of them."""
    bad = cases.groupBy("estimator").agg(F.count_distinct("y_pred").alias("n"), F.min("y_pred").alias("low"), F.max("y_pred").alias("high")).where((F.col("n") != k) | (F.col("low") != 0) | (F.col("high") != k - 1))
    if row := bad.first():
        raise ValueError(f"{row.estimator} has not the labels 0 to {k - 1}")


def simple_vote_from_files(cases: DataFrame, k: int, reference: str | None = None) -> DataFrame:
    """The simple vote of clusterers whose cases were read from results files of one dataset, split and resample."""
    check_clusters(cases, k)
    d = cases.withColumn("y_pred", F.col("y_pred").cast("int"))
    return simple_vote(align(d, reference or d.agg(F.min("estimator")).first()[0]))


def iterative_vote_from_files(cases: DataFrame, k: int, start: str = "plus", seed: int = 0) -> DataFrame:
    """Iterative voting over clusterers whose cases were read from results files."""
    return iterative_vote(cases.withColumn("y_pred", F.col("y_pred").cast("int")), k, start=start, seed=seed)


def _first_centres(distinct: DataFrame, k: int, start: str, seed: int, sample: int) -> list[list[int]]:
    """k vectors to start from, out of ``sample`` distinct ones with the least hash.

    plus: each next one drawn with a chance in proportion to the squared distance from the
    chosen; random: any; aligned: modes of the clusters of the first member.
    """
    import numpy as np

    held = distinct.orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(sample).collect()
    x, n = np.array([r.v for r in held]), np.array([r.n for r in held], float)
    if not len(x):
        return []
    rng = np.random.default_rng(seed)
    if start == "aligned":
        out = []
        for c in np.unique(x[:, 0])[:k]:
            own = x[:, 0] == c
            out.append([int(np.bincount(x[own, d], n[own]).argmax()) for d in range(x.shape[1])])
        return out
    if start == "random":
        return x[rng.choice(len(x), min(k, len(x)), replace=False, p=n / n.sum())].tolist()
    if start != "plus":
        raise ValueError(f"unknown start {start!r}")
    at = [int(rng.choice(len(x), p=n / n.sum()))]
    while len(at) < min(k, len(x)):
        d = n * (x[:, None] != x[at][None]).sum(axis=2).min(axis=1) ** 2.0
        if not d.sum():
            break
        at.append(int(rng.choice(len(x), p=d / d.sum())))
    return x[at].tolist()


def iterative_vote(labels: DataFrame, k: int, case: str = "case_id", rounds: int = 500, start: str = "plus", seed: int = 0, sample: int = 2000) -> DataFrame:
    """(case, y_pred): k-modes over label vectors by Hamming distance, until no vector moves.

    ``labels`` holds (case, estimator, y_pred). Vectors fold to distinct ones with their counts.
    A round is a map over these against k centres, the only rows on the driver, and one
    aggregate of the label counts by cluster and member. A centre that is empty or equals an
    earlier one takes the vector farthest from its own.
    """
    vector = labels.groupBy(case).agg(F.transform(F.array_sort(F.collect_list(F.struct("estimator", "y_pred"))), lambda p: p["y_pred"]).alias("v"))
    distinct = vector.groupBy("v").agg(F.count("*").alias("n"))
    centres = _first_centres(distinct, k, start, seed, sample)

    def placed(c):
        far = F.array(*[F.struct(F.size(F.filter(F.zip_with("v", F.array(*[F.lit(int(x)) for x in row]), lambda a, b: a != b), lambda t: t)).alias("d"), F.lit(i).alias("c")) for i, row in enumerate(c)])
        return distinct.select("v", "n", F.array_min(far).alias("m")).select("v", "n", F.col("m.c").alias("c"), F.col("m.d").alias("d"))

    for _ in range(rounds if centres else 0):
        p = placed(centres)
        modes = p.select("c", "n", F.posexplode("v").alias("at", "y")).groupBy("c", "at", "y").agg(F.sum("n").alias("n"))
        modes = modes.groupBy("c", "at").agg(F.max_by("y", F.struct(F.col("n"), -F.col("y"))).alias("y")).groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "y"))), lambda q: q["y"]).alias("v"))
        found = {r.c: list(r.v) for r in modes.collect()}
        new, lost = [], []
        for i in range(len(centres)):
            row = found.get(i)
            (new.append(row) if row is not None and row not in new else lost.append(i))
        if lost:
            far = [list(r.v) for r in p.orderBy(F.col("d").desc(), "v").limit(len(centres)).collect()]
            new += [v for v in far if v not in new][: len(lost)]
        if sorted(new) == sorted(centres):
            break
        centres = new
    if not centres:
        return vector.select(case, F.lit(None).cast("int").alias("y_pred"))
    return vector.join(placed(sorted(centres)).select("v", F.col("c").alias("y_pred")), "v").select(case, "y_pred")
