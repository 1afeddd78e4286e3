"""Train/test resampling and cross-validation by an arithmetic hash order.

The order depends on the key and seed alone, so it is the same in any engine and after any
retry. Places in it are counted by bins of the hash, so no task sorts a whole table or label;
a share instead of a count (``hashed_split``) needs no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.order import position

#: Bits of the hash below its bin's number: at most 2 ** 14 bins.
_BIN_BITS = 18


def order_key(key: str, seed: int = 0) -> Column:
    """Integer in 0 .. 2**32 - 1; modular arithmetic kept inside 64 bits."""
    a = (F.col(key) % 65536) * 40503 + F.floor(F.col(key) / 65536).cast("long") * 30011 + seed * 7919
    return (a % 4294967296 * 69069 + 12345) % 4294967296


def order_bin(key: str, seed: int = 0) -> Column:
    """The bin of a key in the hash order; all rows of a key are in one."""
    return F.floor(order_key(key, seed) / (1 << _BIN_BITS))


def _place(cases: DataFrame, key: str, seed: int, label: str | None = None) -> DataFrame:
    """Add ``position``, the place from 1 in hash order, within each label if given."""
    h = order_key(key, seed)
    return position(cases, [h, key], order_bin(key, seed), [label] if label else None)


def resample(cases: DataFrame, key: str, n_train: int, seed: int = 0) -> DataFrame:
    """Mark the first ``n_train`` cases in hash order as train, the rest as test."""
    return _place(cases, key, seed).withColumn("split", F.when(F.col("position") <= n_train, "train").otherwise("test")).drop("position")


def stratified_resample(cases: DataFrame, key: str, label: str, was_train: Column, seed: int = 0) -> DataFrame:
    """As many train cases of each label as there were, chosen anew among all of them."""
    size = cases.groupBy(label).agg(F.count_if(was_train).alias("__n"))
    out = _place(cases, key, seed, label).join(size, label).withColumn("split", F.when(F.col("position") <= F.col("__n"), "train").otherwise("test"))
    return out.select(*cases.columns, "split")


def check_labels(cases: DataFrame, label: str, was_train: Column) -> DataFrame:
    """Labels that only one of the two splits has, with their counts; none if both have the same set."""
    n = cases.groupBy(label).agg(F.count_if(was_train).alias("train"), F.count_if(~was_train).alias("test"))
    return n.where("train = 0 or test = 0")


def hashed_split(cases: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    return cases.withColumn("split", F.when(order_key(key, seed) < int(share * 4294967296), "train").otherwise("test"))


def folds(cases: DataFrame, key: str, k: int = 10, seed: int = 0, label: str | None = None) -> DataFrame:
    """Fold 0 .. k - 1 of each case, dealt in hash order, within each label if given."""
    return _place(cases, key, seed, label).withColumn("fold", ((F.col("position") - 1) % k).cast("int")).select(*cases.columns, "fold")


def fold_count(cases: DataFrame, label: str, most: int = 10) -> int:
    """min(most, size of the rarest label); an error under 2."""
    least = cases.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    if least < 2:
        raise ValueError("a label has fewer than two cases")
    return min(most, least)
