"""Combining the hits of several search routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rank offset and route weights of reciprocal-rank fusion, the weight of an entity boost.
RANK_OFFSET = 60
WEIGHTS = {"semantic": 1.0, "lexical": 1.0, "entity": 0.5, "source": 0.85}
ENTITY_BOOST = 0.5


def rrf(routes: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal-rank fusion of (query, doc, rank) routes: (query, doc, score, signals).

    A full outer join on (query, doc) written as union and aggregate, so it combines map-side.
    """
    w = WEIGHTS | (weights or {})
    parts = None
    for name, hits in routes.items():
        part = hits.select("query", "doc", (F.lit(w[name]) / (RANK_OFFSET + F.col("rank"))).alias("s"), F.lit(name).alias("route"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("query", "doc").agg(F.sum("s").alias("score"), F.array_sort(F.collect_set("route")).alias("signals"))


def additive(semantic: DataFrame, keyword: DataFrame, entity: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(query, doc, score): semantic hits above the threshold plus keyword and entity scores, over the most possible.

    Only semantic hits can be returned; the divisor of a query grows by 1 if it has keyword hits and by
    the boost weight if it has entity hits.
    """
    has = lambda df, name: df.select("query").distinct().withColumn(name, F.lit(1.0))
    s = semantic.where(F.col("score") >= threshold).select("query", "doc", F.col("score").alias("sem"))
    s = s.join(keyword.select("query", "doc", F.col("score").alias("key")), ["query", "doc"], "left")
    s = s.join(entity.select("query", "doc", F.col("score").alias("ent")), ["query", "doc"], "left")
    s = s.join(has(keyword, "hk"), "query", "left").join(has(entity, "he"), "query", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    most = 1.0 + z("hk") + ENTITY_BOOST * z("he")
    return s.select("query", "doc", F.least((z("sem") + z("key") + z("ent")) / most, F.lit(1.0)).alias("score"))


def option_hits(base: DataFrame, options: DataFrame, factor: float = 0.5) -> DataFrame:
    """Base hits, and at a reduced score those that only an option's query found (best of them)."""
    extra = options.join(base.select("query", "doc"), ["query", "doc"], "left_anti")
    extra = extra.groupBy("query", "doc").agg((F.max("score") * factor).alias("score"))
    return base.select("query", "doc", "score").unionByName(extra)


def entity_boost(similarity: Column, linked: Column) -> Column:
    """Boost of a memory by one matched entity: less for entities that link to many memories."""
    return F.lit(ENTITY_BOOST) * similarity / (1 + 0.001 * (linked - 1) * (linked - 1))


def multiplier(state: Column, modality: Column, winner: Column, history: Column, sources: Column, mode: str = "current") -> Column:
    """Score multiplier of a fact inside its slot.

    ``winner``: the slot has an active confirmed fact. ``history``: it has a superseded or retracted one.
    """
    top = winner & (state == "active") & (modality == "confirmed")
    if mode == "history":
        return F.when(top, 1.2).when(state.isin("superseded", "retracted"), 2.5).otherwise(1.0)
    return (
        F.when(top & history, 3.0)
        .when(winner & (state == "active") & (modality == "tentative"), 0.4)
        .when(winner & (state == "conflicted"), F.when(sources >= 2, 0.9).otherwise(0.6))
        .otherwise(1.0)
    )


def demotion(subject: Column, named: Column, own: Column, factor: float = 0.3) -> Column:
    """Multiplier of a hit by whose fact it is: less if the question is about somebody else.

    ``named``: canonical names in the question, ``own``: it speaks of the asker. A question with neither demotes nothing.
    """
    others = F.size(named) > 0
    wrong = (
        F.when(subject == "user", others & ~own)
        .when(subject == "assistant", own)
        .when(others, ~F.coalesce(F.array_contains(named, subject), F.lit(False)))
        .otherwise(own)
    )
    return F.when(wrong, factor).otherwise(1.0)
