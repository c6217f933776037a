"""Packing texts into containers of fixed capacity by multiway differencing.

Texts are hashed into shards of about ``WINDOWS`` containers each, and every shard is packed on its
own in one task: a shard's size depends on the capacity, not on the data, so more data means more
shards. What sharding loses is part of one container per shard.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize

#: Containers per shard, and the most texts a shard is meant to get.
WINDOWS = 256
ITEMS = 10_000


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window of each item after Karmarkar-Karp differencing into ``k`` windows.

    Every item starts as a partial partition with itself in one window. The two partitions with the
    widest spread merge with opposing imbalances (the fullest window of one with the emptiest of the
    other) until one is left. Windows are trees of items, so a merge costs O(k) whatever they hold.
    """
    n = len(sizes)
    if k <= 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    left, right = [], []
    heap: list = []
    for i, s in enumerate(sizes):
        # a partition: spread, tie-break, sums of its nonempty windows (descending), their tree nodes
        heap.append((-int(s), i, np.array([s], dtype=np.int64), np.array([i], dtype=np.int64)))
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        la, lb = len(a), len(b)
        over = la + lb - k
        if over <= 0:
            sums, nodes = np.concatenate([a, b]), np.concatenate([x, y])
        else:
            # the smallest windows of a meet the largest of b
            sums = np.concatenate([a, b[over:]])
            nodes = np.concatenate([x, y[over:]])
            sums[la - over : la] += b[:over][::-1]
            first = n + len(left)
            left.extend(x[la - over :].tolist())
            right.extend(y[:over][::-1].tolist())
            nodes[la - over : la] = np.arange(first, first + over)
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        low = int(sums[-1]) if len(sums) == k else 0
        heapq.heappush(heap, (low - int(sums[0]), tick, sums, nodes))
        tick += 1
    where = np.zeros(n, dtype=np.int64)
    for w, root in enumerate(heap[0][3].tolist()):
        stack = [root]
        while stack:
            v = stack.pop()
            if v < n:
                where[v] = w
            else:
                stack += (left[v - n], right[v - n])
    return where


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item such that none holds more than ``capacity``; every item must fit one.

    Items are differenced into as many windows as their total or the items above half the capacity need.
    While the fullest window exceeds the capacity, the window count rises and all items are differenced
    again: first by the part that the fullest was too full, then counts in between are halved until one
    that fits lies next to one that does not.
    """
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    least = max(1, -(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))

    def attempt(k: int) -> tuple[np.ndarray, int]:
        part = differencing(sizes, k)
        return part, int(np.bincount(part, weights=sizes, minlength=k).max())

    short, k = least - 1, least
    part, most = attempt(k)
    while most > capacity:
        # as many windows as there are items always fit
        short, k = k, min(len(sizes), max(k + 1, -(-k * most // capacity)))
        part, most = attempt(k)
    while k - short > 1:
        middle = (k + short) // 2
        other, most = attempt(middle)
        if most > capacity:
            short = middle
        else:
            k, part = middle, other
    # windows that stayed empty get no number
    return np.unique(part, return_inverse=True)[1]


def pack(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Assign every text to containers of each capacity.

    ``items``: doc_id, tokens. ``limits``: limit_id, capacity_tokens (a fixed handful of rows; invalid
    capacities are left out). Out: limit_id, capacity, container, doc_id, piece, tokens; a text is one
    piece unless it is longer than the capacity: then it fills whole containers and its rest is packed
    like a text. A text without tokens takes part and takes no space; equal texts are packed each for
    itself; rows without doc_id are left out; no items or no limits give no rows.
    """
    sizes = items.where("doc_id is not null").select("doc_id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    caps = limits.where("limit_id is not null and capacity_tokens > 0").groupBy("limit_id").agg(F.max("capacity_tokens").cast("long").alias("capacity"))
    every = sizes.join(F.broadcast(caps))
    whole = every.where("tokens >= capacity").select(
        "limit_id", "capacity", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("c"), "doc_id",
        F.explode(F.expr("sequence(0L, tokens div capacity - 1)")).alias("piece"), F.col("capacity").alias("tokens"),
    )
    whole = whole.withColumn("c", F.concat_ws("-", "c", F.col("piece").cast("string")))
    rest = every.where("tokens % capacity > 0 or tokens = 0").select(
        "limit_id", "capacity", "doc_id", F.expr("tokens div capacity").alias("piece"), F.expr("tokens % capacity").alias("tokens")
    )
    need = rest.groupBy("limit_id").agg(
        F.greatest(F.ceil(F.sum("tokens") / (F.first("capacity") * WINDOWS)), F.ceil(F.count("*") / ITEMS), F.lit(1)).alias("shards")
    )
    shard = F.pmod(F.xxhash64("doc_id"), F.col("shards")).alias("shard")
    sharded = rest.join(F.broadcast(need), "limit_id").select("limit_id", "capacity", "doc_id", "piece", "tokens", shard)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable")
        w = windows(pdf["tokens"].to_numpy(np.int64), int(pdf["capacity"].iloc[0]))
        pdf["container"] = [f"s{a}-{b}" for a, b in zip(pdf["shard"], w)]
        return pdf[["limit_id", "capacity", "container", "doc_id", "piece", "tokens"]]

    schema = "limit_id string, capacity long, container string, doc_id long, piece long, tokens long"
    packed = sharded.groupBy("limit_id", "shard").applyInPandas(one, schema)
    return packed.unionByName(whole.withColumnRenamed("c", "container"))


def assignments(documents: DataFrame, limits: DataFrame, **kw) -> DataFrame:
    """``pack`` for a table of documents, with sizes from the tokenizer."""
    from .tokens import sized

    return pack(materialize(sized(documents.withColumn("source", F.lit(None).cast("string")), **kw)), limits)


def containers(packed: DataFrame) -> DataFrame:
    """Per container its texts, used and unused tokens."""
    per = packed.groupBy("limit_id", "container").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("used"), F.max("capacity").alias("capacity"))
    return per.withColumn("unused", F.col("capacity") - F.col("used"))


def fill_report(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, texts, tokens, fill (used share of the space) and unused tokens."""
    per = containers(packed)
    return per.groupBy("limit_id", "capacity").agg(
        F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("used").alias("used"), F.sum("unused").alias("unused"),
        (F.sum("used") / F.sum("capacity")).alias("fill"), F.max("unused").alias("most_unused"),
    )
