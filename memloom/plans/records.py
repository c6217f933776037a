"""Registered queries of the record-keeping operators: change feed, references, version history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changefeed, history, references
from ..sources.tables import materialize, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Memories that exist after all changes, with the change that set each."""
    now = changefeed.current_state(changefeed.changes(table(spark, d, "memory_history")))
    return now.select(F.col("entity").alias("memory_id"), F.col("n").alias("history_id"))


def p2_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The same from two batches, of which only a summary of the first meets the second."""
    feed = table(spark, d, "memory_history")
    base = materialize(changefeed.carried(changefeed.changes(feed.where("id % 2 = 0"))))
    now = changefeed.current_state(changefeed.changes(feed.where("id % 2 <> 0 or id is null")), base)
    return now.select(F.col("entity").alias("memory_id"), F.col("n").alias("history_id"))


def p2_current_memories(spark: SparkSession, d: str) -> DataFrame:
    """The same with the text."""
    return changefeed.current_rows(table(spark, d, "memory_history")).drop("set_at")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    facts, feed = table(spark, d, "facts"), table(spark, d, "memory_history")
    refs = [
        references.fact_references(facts, "source_ids", "messages"),
        references.fact_references(facts, "supersedes", "facts"),
        references.history_references(feed),
    ]
    targets = [
        references.message_targets(table(spark, d, "messages")),
        references.fact_targets(facts),
        references.memory_targets(table(spark, d, "memories")),
    ]
    return references.orphans(refs, targets)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """References without a valid target."""
    return _orphans(spark, d).select("ref_field", "record_id", "ref_key")


def p3_orphans_per_month(spark: SparkSession, d: str) -> DataFrame:
    """Their number per referring field, reason and month of arrival."""
    return references.orphan_counts(_orphans(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """All versions of memories and of replaced or replacing facts."""
    spans = history.all_versions(table(spark, d, "memory_history"), table(spark, d, "facts"))
    return spans.select(F.col("source").alias("source_table"), "opened_by", "closed_by")


QUERIES = {f.__name__: f for f in (p2_found, p2_incremental, p2_current_memories, p3_found, p3_orphans_per_month, p5_found)}
