"""All registered queries of the core library and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import evidence, memory, oracle_records, payload, records, retrieval, state

QUERIES = records.QUERIES | payload.QUERIES | retrieval.QUERIES | state.QUERIES | evidence.QUERIES | memory.QUERIES
ORACLES = oracle_records.SQL | payload.SQL | retrieval.SQL | state.SQL | evidence.SQL | memory.SQL


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Keyword search, dedupe and packing under a token budget, for a batch of queries."""
    return retrieval.budget_pack(spark, d)
