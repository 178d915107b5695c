"""Exact cosine search of a stated query set against all vectors, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unit(vectors: DataFrame) -> DataFrame:
    """(id, v) scaled to length one; null, empty, zero or NaN vectors are left out."""
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))
    d = vectors.filter(ok & F.col("id").isNotNull()).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    return d.filter("norm > 0").select("id", F.transform("v", lambda x: x.cast("double") / F.col("norm")).alias("v"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, at_least: float = -1.0, block_bytes: int = 8_000_000) -> DataFrame:
    """(query, id, similarity, rank): the k most similar vectors of every query, itself excluded; ties by id.

    Queries are numbered into blocks of a fixed size in bytes; every partition of the vectors meets each block once, as
    one matrix product, and gives k rows a query.  The block, not the collection, bounds a task's memory.
    """
    q, all_ = unit(queries), unit(vectors)
    dims = all_.select(F.max(F.size("v"))).first()[0] or 1
    per_block = max(64, block_bytes // (8 * dims))
    n = q.count()
    blocks = max(1, -(-n // per_block))
    qb = q.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    parts = max(1, min(256, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    side = all_.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    left = qb.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("part", F.col("part").cast("bigint"))
    right = side.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("bigint"))
    id_type = dict(all_.dtypes)["id"]

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query", "id", "similarity"]
        ids_a, ids_b = a.column("id"), b.column("id")
        kind = (ids_a if len(a) else ids_b).type
        if not len(a) or not len(b):
            return pa.table([pa.array([], kind), pa.array([], kind), pa.array([], pa.float64())], names=names)
        x = a.column("v").combine_chunks().flatten().to_numpy().reshape(len(a), -1)
        y = b.column("v").combine_chunks().flatten().to_numpy().reshape(len(b), -1)
        s = x @ y.T
        take = min(k + 1, s.shape[1])
        cut = np.partition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take]
        # everything at the k-th value is kept, so that ties are settled by id below
        r, c = np.nonzero((s >= cut[:, None] - 1e-12) & (s >= at_least))
        return pa.table([ids_a.combine_chunks().take(pa.array(r)), ids_b.combine_chunks().take(pa.array(c)), pa.array(s[r, c])], names=names)

    met = left.groupBy("part", "block").cogroup(right.select(F.col("part").alias("p2"), F.col("block").alias("b2"), "id", "v").groupBy("p2", "b2")).applyInArrow(meet, f"query {id_type}, id {id_type}, similarity double")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    rounded = met.filter(F.col("query") != F.col("id")).withColumn("similarity", F.floor(F.col("similarity") * 1e6 + 0.5) / 1e6)
    return rounded.withColumn("rank", rank).filter(F.col("rank") <= k)
