"""Time-aware state of slots: timelines, current and as-of values, conflicts, duplicates, message buffers.

A slot is a tuple of key columns (a subject's property). Operators that look along the history of a slot run in
range-sorted chunks (``chunks``), so a slot with a third of all rows spreads over many tasks; the others are one
aggregate per slot, or filter by rank, which Spark prunes before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import border_keys, in_chunks, with_carry


def latest_per_slot(df: DataFrame, slot: list[str], order: list[str], n: int = 1) -> DataFrame:
    """The ``n`` newest rows of each slot with ``age`` 1 for the newest; ``order`` must be unique in a slot."""
    w = Window.partitionBy(*slot).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def timeline(df: DataFrame, slot: list[str], order: list[str], at: str) -> DataFrame:
    """Adds ``valid_to`` (the next observation of the slot) and ``state`` (active or superseded)."""
    rows = in_chunks(df, slot, order)
    first = F.min(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(at).alias("next")))
    rows = with_carry(rows, border_keys(rows, slot), slot, {"_far": first}, F.min, ahead=True)
    w = Window.partitionBy(*slot, "chunk").orderBy(*order)
    last = F.lead(F.lit(True)).over(w).isNull()
    out = rows.withColumn("valid_to", F.when(last, F.col("_far.next")).otherwise(F.lead(at).over(w))).drop("_far", "chunk")
    return out.withColumn("state", F.when(F.col("valid_to").isNull(), "active").otherwise("superseded"))


def as_of(line: DataFrame, at: str, instant: Column) -> DataFrame:
    """Rows of a timeline that hold at an instant: begun by then and not ended by then."""
    return line.where((F.col(at) <= instant) & (F.col("valid_to").isNull() | (F.col("valid_to") > instant)))


def conflicts(df: DataFrame, slot: list[str], period: Column, value: str) -> DataFrame:
    """Slots that hold several values within one period: slot, period, values, first and last value."""
    g = df.where(F.col(value).isNotNull()).groupBy(*slot, period.alias("period"))
    out = g.agg(F.countDistinct(value).alias("n_values"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.where("n_values > 1")


def late_rows(df: DataFrame, group: list[str], arrival: list[str], at: str) -> DataFrame:
    """Rows observed before something that arrived earlier (``newest`` before them in arrival order)."""
    rows = in_chunks(df, group, arrival)
    rows = with_carry(rows, border_keys(rows, group), group, {"_far": F.max(at)}, F.max)
    w = Window.partitionBy(*group, "chunk").orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("newest", F.greatest(F.max(at).over(w), F.col("_far"))).drop("_far", "chunk")
    return out.where(F.col(at) < F.col("newest"))


def forward_fill(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last known ``value`` up to and including each row."""
    rows = in_chunks(df.withColumn(name, value), group, order)
    last = F.max(F.when(F.col(name).isNotNull(), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(name).alias("v"))))
    rows = with_carry(rows, border_keys(rows, group), group, {"_far": last}, F.max)
    w = Window.partitionBy(*group, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.coalesce(F.last(name, ignorenulls=True).over(w), F.col("_far.v"))).drop("_far", "chunk")


def merge_duplicates(df: DataFrame, key: list[Column], order: Column, ident: str, lists: list[str]) -> DataFrame:
    """Rows with equal keys as one: smallest-ordered id, count and the union of the list columns, sorted.

    List elements are reduced to distinct (key, element) rows with map-side combine before they meet, so a key
    that many rows repeat costs a row per different element; the union itself is the result that is asked for.
    """
    names = [f"k{i}" for i in range(len(key))]
    rows = df.select(*[k.alias(n) for k, n in zip(key, names)], order.alias("_order"), F.col(ident), *lists)
    out = rows.groupBy(*names).agg(F.min_by(ident, "_order").alias(ident), F.count("*").alias("copies"))
    same = [F.coalesce(F.col(n).cast("string"), F.lit("\0")).alias(n) for n in names]
    for c in lists:
        each = rows.select(*same, F.explode(c).alias("_e")).distinct().groupBy(*names).agg(F.array_sort(F.collect_list("_e")).alias(c))
        out = out.join(each.select(F.struct(*names).alias("_k"), c), F.struct(*same) == F.col("_k"), "left").drop("_k")
        out = out.withColumn(c, F.coalesce(c, F.array().cast(dict(df.dtypes)[c])))
    return out


def corroboration(df: DataFrame, key: list[Column], source: str, least: int = 2) -> DataFrame:
    """Keys stated by at least ``least`` different sources."""
    keys = [k.alias(f"k{i}") for i, k in enumerate(key)]
    return df.groupBy(*keys).agg(F.countDistinct(source).alias("sources")).where(F.col("sources") >= least)


def pattern_cards(df: DataFrame, slot: list[str], value: Column, least: int = 2) -> DataFrame:
    """Slots with several distinct values as one card: ``values`` sorted and joined, ``n_values``."""
    g = df.where(value.isNotNull() & (value != "")).select(*slot, value.alias("v")).distinct().groupBy(*slot).agg(F.collect_list("v").alias("v"))
    return g.where(F.size("v") >= least).select(*slot, F.array_join(F.array_sort("v"), ", ").alias("values"), F.size("v").alias("n_values"))


def receipts(df: DataFrame, key: list[str], payload: Column, order: list[str]) -> DataFrame:
    """What becomes of repeated requests: ``accepted`` (first), ``replayed`` (same payload) or ``conflict``."""
    w = Window.partitionBy(*key).orderBy(*order)
    first = F.first("payload_hash").over(w)
    out = df.withColumn("payload_hash", F.sha2(payload, 256)).withColumn("nth", F.row_number().over(w))
    kind = F.when(F.col("nth") == 1, "accepted").when(F.col("payload_hash") == first, "replayed").otherwise("conflict")
    return out.withColumn("outcome", kind)


def global_ordinals(df: DataFrame, order: list[str]) -> DataFrame:
    """Gapless numbers from 0 in ``order`` over the whole table, without gathering it in one task.

    A range sort gives partitions in order; their counts (one row per partition) give each its offset.
    """
    from ..sources.tables import materialize

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    counts = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return cut.join(F.broadcast(offsets), "_part").withColumn("ordinal", nth + F.col("_off") - 1).drop("_part", "_off")
