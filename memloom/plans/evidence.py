"""Registered queries on facts as evidence: lifecycle, rendering, sources, fallback, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intent import intent, named
from ..functions.text import instant, key
from ..operators import changefeed, lexical, lifecycle
from ..sources.tables import table
from .retrieval import _postings, _terms
from .sqltext import BM25_SQL
from .state import _FACTS, _TURNS, _canon, _facts, _turns

SLOT = ["s0", "s1", "s2", "s3"]


def _slotted(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark, d)
    return f.select("*", *lifecycle.slot_of("user_id", "subject", "predicate", "scope"))


def fact_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """State that observation order gives to the confirmed facts of single-valued slots."""
    f = _slotted(spark, d).where("cardinality = 'single' and modality = 'confirmed'").withColumn("at", instant(F.col("observed_at")))
    return lifecycle.settle(f, SLOT, "at", "value").select("id", "verdict", "ended")


def evidence_rendering(spark: SparkSession, d: str) -> DataFrame:
    """Text of every fact that may be shown, with state and successor."""
    f = _slotted(spark, d).where("state <> 'erased'")
    return lifecycle.render(lifecycle.with_successor(f, SLOT)).select("id", F.md5("shown").alias("shown_md5"))


def memory_events(spark: SparkSession, d: str) -> DataFrame:
    """Audit events of the change feed, without values."""
    return lifecycle.event_trail(changefeed.changes(table(spark, d, "memory_history")))


def slot_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    """Properties of a user that exist under several scopes or values."""
    f = _facts(spark, d).where("state = 'active'").select("user_id", "predicate", "scope", "value")
    return lifecycle.ambiguous(f, ["user_id", "predicate"], ["scope", "value"])


def fact_sources(spark: SparkSession, d: str) -> DataFrame:
    """First two sources of each fact, with the speaker of those that exist and are not redacted."""
    f = _facts(spark, d).select("id", F.posexplode("source_ids").alias("pos", "s")).where("pos < 2").select("id", "pos", key(F.col("s")).alias("source"))
    m = _turns(spark, d).where("not redacted").select(key(F.col("id")).alias("source"), F.lower(F.trim("role")).alias("role"))
    return f.join(m, "source").select("id", "pos", "source", "role")


def raw_fallback(spark: SparkSession, d: str) -> DataFrame:
    """User messages in the first person that no invisible fact was drawn from."""
    hidden = _facts(spark, d).where("state in ('erased', 'retracted', 'superseded') or modality in ('hypothetical', 'quoted')")
    hidden = hidden.select(F.explode("source_ids").alias("s")).select(key(F.col("s")).alias("id"))
    m = _turns(spark, d).where("lower(trim(role)) = 'user' and length(content) <= 2500 and not redacted")
    m = m.where(F.lower("content").rlike(r"(?<![a-z0-9_])(?:i|my|we|our)(?![a-z0-9_])"))
    return m.join(hidden.where("id is not null").distinct(), "id", "left_anti").select("id")


def _coverage(spark: SparkSession, d: str, most: int | None) -> DataFrame:
    post, terms = _postings(spark, d), _terms(spark, d, most)
    top = lexical.search(post, terms, 6).select("query", "doc")
    want = terms.groupBy("query").agg(F.count("*").alias("wanted"))
    got = top.join(post, "doc").join(terms, ["query", "term"]).groupBy("query", "doc").agg(F.count("*").alias("matched"))
    return got.join(want, "query").groupBy("query").agg(F.round(F.max(F.col("matched") / F.col("wanted")), 6).alias("coverage"))


def coverage_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Largest share of a query's terms that one of its six best documents has (64 terms, as its statement has it)."""
    return _coverage(spark, d, lexical.QUERY_TERMS)


def coverage_ratio_all(spark: SparkSession, d: str) -> DataFrame:
    """The same over all terms of a query."""
    return _coverage(spark, d, None)


def question_intents(spark: SparkSession, d: str) -> DataFrame:
    """What the questions among the users' messages ask for."""
    q = _turns(spark, d).where("lower(trim(role)) = 'user' and content like '%?%'").select(intent(F.col("content")).alias("i"))
    return q.groupBy("i.mode", "i.temporal", "i.operation").agg(F.count("*").alias("questions"))


def named_entities(spark: SparkSession, d: str) -> DataFrame:
    """Names in facts and the number of facts that have them."""
    f = _facts(spark, d).where("content is not null").select("id", F.explode(named(F.col("content"))).alias("name"))
    return f.groupBy("name").agg(F.countDistinct("id").alias("facts"))


def exact_options(spark: SparkSession, d: str) -> DataFrame:
    """Facts that meet one of two answer options of their slot exactly (the value, or another one of the slot)."""
    f = _slotted(spark, d).where("state = 'active' and cardinality = 'single' and value <> ''")
    other = f.groupBy(*SLOT).agg(F.max("value").alias("option"))
    hit = f.join(other, SLOT).where(lifecycle.match_level(F.col("option"), F.col("value"), F.col("content")) == 1)
    return hit.select("id", "option")


QUERIES = {
    f.__name__: f
    for f in (
        fact_lifecycle, evidence_rendering, memory_events, slot_ambiguity, fact_sources, raw_fallback, coverage_ratio, coverage_ratio_all,
        question_intents, named_entities, exact_options,
    )
}

_S = ", ".join(f"{_canon(f'coalesce({c}, {chr(39) * 2})')} AS s{i}" for i, c in enumerate(("user_id", "subject", "predicate", "scope")))
_SLOTTED = f"{_FACTS}, g AS (SELECT *, {_S} FROM f)"

SQL = {
    "fact_lifecycle": f"""WITH {_SLOTTED}, h AS (SELECT *, epoch_us(observed_at::TIMESTAMPTZ) AS at_us FROM g WHERE cardinality = 'single' AND modality = 'confirmed' AND value <> '' AND observed_at IS NOT NULL),
 p AS (SELECT s0, s1, s2, s3, at_us, count(DISTINCT {_canon('value')}) AS n FROM h GROUP BY ALL), q AS (SELECT *, lead(at_us) OVER (PARTITION BY s0, s1, s2, s3 ORDER BY at_us) AS ended FROM p)
 SELECT id, CASE WHEN ended IS NOT NULL THEN 'superseded' WHEN n > 1 THEN 'conflicted' ELSE 'active' END AS verdict, ended FROM h JOIN q USING (s0, s1, s2, s3, at_us)""",
    "evidence_rendering": f"""WITH {_SLOTTED}, h AS (SELECT * FROM g WHERE state <> 'erased'),
 b AS (SELECT s0, s1, s2, s3, arg_min(value, (modality = 'tentative', id)) AS successor FROM h WHERE state = 'active' AND modality IN ('confirmed', 'tentative') GROUP BY ALL),
 r AS (SELECT h.*, successor, len(list_distinct(source_ids)) + CASE WHEN len(list_filter(source_ids, lambda x: x IS NULL)) > 0 THEN 1 ELSE 0 END AS n FROM h LEFT JOIN b USING (s0, s1, s2, s3))
 SELECT id, md5(CASE WHEN observed_at IS NULL OR time_basis = 'ordering' THEN '[time: session order only] ' ELSE '[' || observed_at[:10] || ' | ' || coalesce(subject, '') || '] ' END ||
  CASE WHEN state IN ('superseded', 'retracted') THEN 'Former ' || coalesce(predicate, '') || CASE WHEN value <> '' THEN ': "' || value || '"' ELSE '' END || ' (' || CASE WHEN state = 'retracted' THEN 'removed at user request' ELSE 'superseded' END
   || CASE WHEN valid_to <> '' AND time_basis <> 'ordering' THEN ' on ' || valid_to[:10] ELSE '' END || CASE WHEN successor IS NOT NULL THEN '; current ' || predicate || ': "' || successor || '"' ELSE '' END || '). Original statement: ' || coalesce(content, '')
  WHEN state = 'conflicted' THEN '[Conflicting statements recorded; no single current value] ' || coalesce(content, '') || CASE WHEN n >= 2 THEN ' (this value is corroborated by ' || n || ' independent statements)' ELSE '' END
  ELSE coalesce(content, '') END) AS shown_md5 FROM r""",
    "slot_ambiguity": "WITH " + _FACTS + " SELECT user_id, predicate, count(DISTINCT scope) AS scopes, count(DISTINCT value) AS \"values\" FROM f WHERE state = 'active' GROUP BY user_id, predicate HAVING count(DISTINCT scope) > 1 OR count(DISTINCT value) > 1",
    "fact_sources": f"""WITH {_FACTS}, {_TURNS}, s AS (SELECT id, generate_subscripts(source_ids, 1) - 1 AS pos, lower(trim(unnest(source_ids))) AS source FROM f)
 SELECT s.id, CAST(pos AS INT) AS pos, source, lower(trim(role)) AS role FROM s JOIN turns t ON lower(trim(t.id)) = source AND NOT redacted WHERE pos < 2""",
    "raw_fallback": f"""WITH {_FACTS}, {_TURNS}, h AS (SELECT DISTINCT lower(trim(unnest(source_ids))) AS id FROM f WHERE state IN ('erased', 'retracted', 'superseded') OR modality IN ('hypothetical', 'quoted'))
 SELECT id FROM turns WHERE lower(trim(role)) = 'user' AND length(content) <= 2500 AND NOT redacted AND regexp_matches(lower(content), '(^|[^a-z0-9_])(i|my|we|our)($|[^a-z0-9_])') AND id NOT IN (SELECT id FROM h WHERE id IS NOT NULL)""",
    "coverage_ratio": BM25_SQL.format(k1=1.5, idf="ln((n - df + 0.5) / (df + 0.5) + 1)", qtf="qtf")
    + """, top AS (SELECT query, doc FROM scores QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) <= 6),
 w AS (SELECT query, count(*) AS wanted FROM terms GROUP BY query), m AS (SELECT query, doc, count(*) AS matched FROM top JOIN post USING (doc) JOIN terms USING (query, term) GROUP BY ALL)
 SELECT query, round(max(matched / wanted), 6) AS coverage FROM m JOIN w USING (query) GROUP BY query""",
}
