"""Ordered work over keys of any size: range-sorted chunks and what crosses their borders.

A window per key puts a key into one task. Here the rows are range-sorted by key and order, so a key with very
many rows spreads over several chunks; windows run per (key, chunk), and what a key carries over the borders of its
chunks is one summary row per chunk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize

#: Rows that a chunk aims at.
CHUNK_ROWS = 500_000


def in_chunks(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows range-sorted by keys and order, with their ``chunk`` number, written so that they stay put.

    They are written before the sort too, since a range sort reads its input twice. There are as many chunks
    as the rows need, so a chunk does not grow with the data.
    """
    rows = materialize(rows)
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, -(-rows.count() // CHUNK_ROWS))
    return materialize(rows.repartitionByRange(n, *keys, *order).withColumn("chunk", F.spark_partition_id()))


def border_keys(chunked: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with rows in several chunks: at most one per border between chunks."""
    e = F.struct(*keys)
    ends = chunked.groupBy("chunk").agg(F.array_distinct(F.array(F.min(e), F.max(e))).alias("e"))
    e = ends.select("chunk", F.explode("e").alias("e")).select("chunk", "e.*")
    return materialize(e.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1").select(*keys))


def with_carry(rows: DataFrame, border: DataFrame, keys: list[str], values: dict[str, Column], merge, ahead: bool = False) -> DataFrame:
    """Add what earlier (or later) chunks of the row's key say: ``merge`` over their ``values``, by name; null if nothing.

    ``border`` has one row per chunk border at most and its keys one summary per chunk, so both
    small sides are bounded by twice the number of chunks and are broadcast. Null keys are keys, too.
    """
    same = lambda df: reduce(lambda a, b: a & b, [rows[k].eqNullSafe(df[f"_{k}"]) for k in keys])
    named = lambda df: df.withColumnsRenamed({k: f"_{k}" for k in keys})
    b = named(border)
    per = rows.join(F.broadcast(b), same(b), "left_semi").groupBy(*keys, "chunk").agg(*[v.alias(k) for k, v in values.items()])
    w = Window.partitionBy(*keys).orderBy("chunk")
    w = w.rowsBetween(1, Window.unboundedFollowing) if ahead else w.rowsBetween(Window.unboundedPreceding, -1)
    carry = named(per.select(*keys, F.col("chunk").alias("_chunk"), *[merge(F.col(k)).over(w).alias(k) for k in values]))
    return rows.join(F.broadcast(carry), same(carry) & (rows["chunk"] == carry["_chunk"]), "left").drop("_chunk", *[f"_{k}" for k in keys])
