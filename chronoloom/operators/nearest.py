"""Exact nearest neighbour of many queries among all rows, in blocks of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.session import ship


def nearest_label(queries: DataFrame, rows: DataFrame, key: str, vector: str, label: str, block_bytes: int = 16 << 20) -> DataFrame:
    """(key, label of the nearest row by squared Euclidean distance to nine places, the least key at a tie).

    Queries go to the workers in blocks of at most ``block_bytes``, one pass over the rows a
    block. A task returns its best row of each query, and a partial aggregate picks among tasks,
    so that no pairs are shuffled.
    """
    spark = rows.sparkSession
    ship(spark)
    q = queries.select(key, F.col(vector).cast("array<double>").alias("v"))
    total, wide = q.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-(total or 0) * (wide or 0) * 8 // block_bytes))
    data = rows.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("long").alias("y"))
    parts = []
    for b in range(blocks):
        held = q.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).collect()
        names = np.array([r[0] for r in held], np.int64)
        points = np.array([r[1] for r in held], float).reshape(len(held), -1)
        shared = spark.sparkContext.broadcast((names, points))

        def run(batches, shared=shared):
            names, points = shared.value
            best = np.full((len(names), 3), np.inf)  # distance, key, label
            for batch in batches:
                k, y = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                x = np.array(batch.column(1).flatten()).reshape(len(k), -1)
                for at in range(0, len(k), 256):
                    d = np.zeros((len(names), len(k[at : at + 256])))
                    for j in range(points.shape[1] if len(names) else 0):
                        d += (points[:, j, None] - x[None, at : at + 256, j]) ** 2
                    d = np.round(d, 9)
                    order = np.argsort(k[at : at + 256], kind="stable")
                    i = order[d[:, order].argmin(axis=1)] if len(names) else np.zeros(0, int)
                    near = d[np.arange(len(names)), i]
                    better = (near < best[:, 0]) | ((near == best[:, 0]) & (k[at + i] < best[:, 1]))
                    best[better] = np.stack([near, k[at + i], y[at + i]], axis=1)[better]
            found = np.isfinite(best[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(names[found]), pa.array(best[found, 0]), pa.array(best[found, 1].astype(np.int64)), pa.array(best[found, 2].astype(np.int64))], ["q", "d", "k", "y"])

        parts.append(data.mapInArrow(run, "q bigint, d double, k bigint, y bigint"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(F.col("q").alias(key)).agg(F.min_by("y", F.struct("d", "k")).alias(label))
