"""Positions and running sums in a total order, without one task that sorts everything.

Rows fall into bins that follow the order. Sums per bin (a partial aggregate, as many rows
as bins) give each bin its offset, and a window within the bin adds the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, values: list[str], order: list[str | Column], bin_: Column, by: list[str] | None = None) -> DataFrame:
    """Add ``run_<value>``, the sum of the value over all rows up to this one in ``order``, within ``by`` if given.

    ``bin_`` must not fall as the order goes on. Rows that tie in ``order`` get sums in some order.
    """
    by = by or []
    d = df.withColumn("__bin", bin_)
    sums = d.groupBy(*by, "__bin").agg(*[F.sum(v).alias(f"__s_{v}") for v in values])
    before = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)  # one row a bin
    offsets = sums.select(*by, "__bin", *[F.coalesce(F.sum(f"__s_{v}").over(before), F.lit(0)).alias(f"__o_{v}") for v in values])
    within = Window.partitionBy(*by, "__bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(offsets, [*by, "__bin"])
    return d.select(*df.columns, *[(F.sum(v).over(within) + F.col(f"__o_{v}")).alias(f"run_{v}") for v in values])


def position(df: DataFrame, order: list[str | Column], bin_: Column, by: list[str] | None = None) -> DataFrame:
    """Add ``position``, the row's place from 1 in ``order``, within ``by`` if given."""
    d = running(df.withColumn("__one", F.lit(1).cast("long")), ["__one"], order, bin_, by)
    return d.withColumnRenamed("run___one", "position").drop("__one")


def value_bin(df: DataFrame, value: str, bins: int = 4096) -> Column:
    """Equal-width bins between the least and greatest value of a column, found in one pass."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None or low == high:
        return F.lit(0)
    return F.width_bucket(F.col(value), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
