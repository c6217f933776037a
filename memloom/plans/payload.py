"""Registered queries of the metadata filter language over typed and JSON payloads."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, store
from ..sources.tables import table

#: Name, table, key columns, filter and the condition it means.
FILTERS = {
    "eq": ("orders", ["o_orderkey"], {"o_orderstatus": "F"}, "o_orderstatus = 'F'"),
    "ne": ("orders", ["o_orderkey"], {"o_orderstatus": {"ne": "F"}}, "o_orderstatus IS DISTINCT FROM 'F'"),
    "range": ("orders", ["o_orderkey"], {"o_totalprice": {"gte": 1000.0, "lt": 150000.0}}, "o_totalprice >= 1000 AND o_totalprice < 150000"),
    "in": ("part", ["p_partkey"], {"p_size": [1, 5, 9]}, "p_size IN (1, 5, 9)"),
    "nin": ("part", ["p_partkey"], {"p_size": {"nin": [1, 5, 9]}}, "NOT coalesce(p_size IN (1, 5, 9), false)"),
    "contains": ("part", ["p_partkey"], {"p_type": {"contains": "S"}}, "contains(p_type, 'S')"),
    "icontains": ("part", ["p_partkey"], {"p_name": {"icontains": "A"}}, "contains(lower(p_name), 'a')"),
    "wildcard": ("customer", ["c_custkey"], {"c_mktsegment": "*", "c_acctbal": {"gt": 0.0}}, "c_acctbal > 0"),
    "and_or_not": (
        "customer", ["c_custkey"],
        {"$or": [{"c_acctbal": {"lt": 0.0}}, {"AND": [{"c_nationkey": {"gte": 20}}, {"c_mktsegment": {"ne": "BUILDING"}}]}], "NOT": [{"c_nationkey": 3}, {"c_nationkey": 24}]},
        "(c_acctbal < 0 OR (c_nationkey >= 20 AND c_mktsegment IS DISTINCT FROM 'BUILDING')) AND c_nationkey NOT IN (3, 24)",
    ),
    "null_semantics": (
        "messages", ["id", "ordinal"], {"NOT": [{"name": {"contains": "a"}}], "role": {"ne": "user"}},
        "NOT coalesce(contains(name, 'a'), false) AND role IS DISTINCT FROM 'user'",
    ),
}
TODAY = "2024-01-20"


def _filtered(case: str, spark: SparkSession, d: str) -> DataFrame:
    name, keys, spec, _ = FILTERS[case]
    return table(spark, d, name).where(filters.compile_filter(spec)).select(*keys)


def filter_first_operator(spark: SparkSession, d: str) -> DataFrame:
    """The evaluator that honours one operator of a field only, the first in a fixed order."""
    spec = {"o_totalprice": {"lt": 150000.0, "gt": 100000.0}}
    return table(spark, d, "orders").where(filters.compile_filter(spec, first_only=True)).select("o_orderkey")


def json_payload_filter(spark: SparkSession, d: str) -> DataFrame:
    """Events by a number inside their JSON payload."""
    cond = filters.compile_filter({"k": {"gte": 50, "lt": 90}}, filters.payload_field("props", "int"))
    return table(spark, d, "events").where(cond).select("event_id", "event_type")


def expiry_filter(spark: SparkSession, d: str) -> DataFrame:
    """Events that have not expired a week after they happened."""
    e = table(spark, d, "events").withColumn("expires", F.date_format(F.col("ts") + F.expr("INTERVAL 7 DAYS"), "yyyy-MM-dd"))
    return e.where(filters.not_expired(F.col("expires"), TODAY)).select("event_id", "expires")


def page_with_total(spark: SparkSession, d: str) -> DataFrame:
    """A page of the most valuable open orders with the number of all of them."""
    rows = table(spark, d, "orders").where(filters.compile_filter({"o_orderstatus": "O"}))
    return store.page(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], 100).select("o_orderkey", F.round("o_totalprice", 2).alias("price"), "total")


def metadata_projection(spark: SparkSession, d: str) -> DataFrame:
    """Message bodies without the reserved members, as sorted names of what is left."""
    reserved = ["role", "content"]
    m = table(spark, d, "messages").select("id", F.json_object_keys("body").alias("keys")).where("keys is not null")
    left = F.array_join(F.array_sort(F.array_except("keys", F.array(*[F.lit(r) for r in reserved]))), ",")
    return m.groupBy(left.alias("members")).agg(F.count("*").alias("messages"))


QUERIES = {f"filter_dsl_{c}": partial(_filtered, c) for c in FILTERS} | {
    f.__name__: f for f in (filter_first_operator, json_payload_filter, expiry_filter, page_with_total, metadata_projection)
}

SQL = {
    f"filter_dsl_{c}": f"SELECT {', '.join(keys)} FROM {name} WHERE {cond}"
    for c, (name, keys, _, cond) in FILTERS.items()
} | {
    "filter_first_operator": "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000",
    "json_payload_filter": "SELECT event_id, event_type FROM events WHERE CAST(json_extract(props, '$.k') AS INT) >= 50 AND CAST(json_extract(props, '$.k') AS INT) < 90",
    "expiry_filter": f"SELECT event_id, strftime(ts + INTERVAL 7 DAY, '%Y-%m-%d') AS expires FROM events WHERE CAST(ts + INTERVAL 7 DAY AS DATE) >= DATE '{TODAY}'",
    "page_with_total": "SELECT o_orderkey, round(o_totalprice, 2) AS price, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "metadata_projection": """WITH k AS (SELECT json_keys(body) AS ks FROM messages WHERE json_valid(body))
 SELECT array_to_string(list_sort(list_filter(list_distinct(ks), lambda x: x NOT IN ('role', 'content'))), ',') AS members, count(*) AS messages FROM k GROUP BY 1""",
}
