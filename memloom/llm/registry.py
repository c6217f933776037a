"""Registered queries of the training-text operators and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import conversations, mixing, oracles, packing, pii, subjects


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that cannot become a conversation."""
    out = conversations.excluded_sessions(table(spark, d, "messages"), table(spark, d, "role_aliases"))
    return out.select("session_id")


def p1_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The turns of all others, in order."""
    return conversations.conversations(table(spark, d, "messages"), table(spark, d, "role_aliases"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Personal data in messages and quotes, one row per item."""
    return pii.found(table(spark, d, "messages"), table(spark, d, "facts"), table(spark, d, "name_lexicon"))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text with typed placeholders."""
    return pii.redacted(table(spark, d, "messages"), table(spark, d, "facts"), table(spark, d, "name_lexicon"))


def p6_assignments(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, for each capacity."""
    return packing.assignments(table(spark, d, "documents"), table(spark, d, "pack_limits"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Used and unused tokens of every container."""
    return packing.containers(p6_assignments(spark, d))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, fill and unused tokens per capacity."""
    return packing.fill_report(p6_assignments(spark, d))


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    """Chosen documents and how often each is used."""
    sizes = mixing.sized_sources(table(spark, d, "documents"))
    return mixing.mix(sizes, mixing.budgets(sizes, table(spark, d, "mix_targets")))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share and the repeats used, per source."""
    sizes = mixing.sized_sources(table(spark, d, "documents"))
    plan = mixing.budgets(sizes, table(spark, d, "mix_targets"))
    return mixing.report(mixing.mix(sizes, plan), plan)


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subjects"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The subject areas of each document."""
    return _subjects(spark, d).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents per subject, language and source."""
    return subjects.composition(_subjects(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_conversations, p4_found, p4_redacted, p6_assignments, p6_containers, p6_fill,
        p7_selection, p7_shares, p8_found, p8_composition,
    )
}
ORACLES = oracles.SQL
