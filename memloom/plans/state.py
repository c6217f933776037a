"""Registered queries over slots, versions, buffers, facts and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar
from ..functions import lexicon as lx
from ..functions.text import instant, key
from ..operators import extraction, fusion, graph, state, store
from ..sources.tables import table
from ..streaming import events as stream

SLOT = ["user_id", "event_type"]
ORDER = ["ts", "event_id"]
AS_OF = "2024-01-15 00:00:00"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Counting versions of messages."""
    w = Window.partitionBy("id").orderBy(F.desc("ingested_at"), F.desc_nulls_last("created_at"))
    return table(spark, d, "messages").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Counting versions of facts (the one that came last; the highest revision of those)."""
    w = Window.partitionBy("id").orderBy(F.desc("ingested_at"), F.desc("revision"), F.desc_nulls_last("observed_at"))
    return table(spark, d, "facts").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def slot_current_state(spark: SparkSession, d: str) -> DataFrame:
    """Newest observation of each slot."""
    return state.latest_per_slot(_events(spark, d), SLOT, ORDER).select(*SLOT, "event_id", "value")


def slot_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Observations with the end of their validity and state."""
    line = state.timeline(_events(spark, d), SLOT, ORDER, "ts")
    return line.select("event_id", *SLOT, F.unix_micros("ts").alias("begun"), F.unix_micros("valid_to").alias("ended"), "state")


def as_of_state(spark: SparkSession, d: str) -> DataFrame:
    """Values that held at an instant."""
    line = state.timeline(_events(spark, d), SLOT, ORDER, "ts")
    return state.as_of(line, "ts", F.lit(AS_OF).cast("timestamp")).select(*SLOT, "event_id", "value")


def slot_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Slots with several values in one day."""
    out = state.conflicts(_events(spark, d), SLOT, F.date_format("ts", "yyyy-MM-dd"), "value")
    return out.select(*SLOT, "period", "n_values", "low", "high")


def late_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """History rows of a memory made before a change that arrived earlier."""
    h = table(spark, d, "memory_history").withColumn("made", F.coalesce(instant(F.col("updated_at")), instant(F.col("created_at"))))
    h = h.where("made is not null").withColumn("memory", key(F.col("memory_id")))
    return state.late_rows(h, ["memory"], ["id"], "made").select("id", "memory", "made", "newest")


def anchor_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    """Last purchase value known at each event of a user."""
    out = state.forward_fill(_events(spark, d), ["user_id"], ORDER, F.when(F.col("event_type") == "purchase", F.col("value")), "anchor")
    return out.select("event_id", "anchor")


def duplicate_merge(spark: SparkSession, d: str) -> DataFrame:
    """Facts with the same slot, value and modality as one, with their sources united."""
    f = _facts(spark, d).where("kind <> 'event'").withColumn("source_ids", F.filter("source_ids", lambda x: F.trim(x) != ""))
    k = [lx.canonical(F.col(c)) for c in ("user_id", "subject", "predicate", "scope", "value")] + [F.col("modality")]
    out = state.merge_duplicates(f, k, F.struct("observed_at", "id"), "id", ["source_ids"])
    return out.where("copies > 1").select("id", "copies", F.array_join("source_ids", ",").alias("sources"))


def corroboration_count(spark: SparkSession, d: str) -> DataFrame:
    """Texts that at least two document sources have."""
    docs = table(spark, d, "documents").where("text is not null").withColumn("s", F.lower(F.trim("source")))
    return state.corroboration(docs, [F.md5(F.trim("text"))], "s").select(F.col("k0").alias("text_md5"), "sources")


def pattern_cards(spark: SparkSession, d: str) -> DataFrame:
    """Multi-valued confirmed active facts of a slot as one card."""
    f = _facts(spark, d).where("cardinality = 'multiple' and modality = 'confirmed' and state = 'active' and kind = 'preference'")
    return state.pattern_cards(f, ["user_id", "subject", "predicate"], F.trim(F.lower("value"))).select("user_id", "subject", "predicate", "values", "n_values")


def arbitration_multipliers(spark: SparkSession, d: str) -> DataFrame:
    """Score multiplier of every single-valued fact inside its slot, for current and for history questions."""
    f = _facts(spark, d).where("cardinality = 'single'")
    slot = [F.coalesce("user_id", F.lit("\0")).alias("u"), *[F.coalesce(lx.canonical(F.col(c)), F.lit("\0")).alias(f"k_{c}") for c in ("subject", "predicate", "scope")]]
    f = f.select("id", "state", "modality", F.size(F.array_distinct("source_ids")).alias("n"), *slot)
    by = ["u", "k_subject", "k_predicate", "k_scope"]
    # an aggregate per slot and a join, which splits a hot slot where a window would not
    flags = f.groupBy(*by).agg(
        F.max((F.col("state") == "active") & (F.col("modality") == "confirmed")).alias("win"), F.max(F.col("state").isin("superseded", "retracted")).alias("old")
    )
    m = lambda mode: fusion.multiplier(F.col("state"), F.col("modality"), F.col("win"), F.col("old"), F.col("n"), mode)
    return f.join(flags, by).select("id", m("current").alias("current"), m("history").alias("history"))


def dependency_closure(spark: SparkSession, d: str) -> DataFrame:
    """Facts that are visible with all they depend on, transitively."""
    f = _facts(spark, d).select("id", "state", "modality", F.transform("depends_on", key).alias("depends_on"))
    ok = ~F.col("state").isin("erased", "retracted", "superseded") & ~F.col("modality").isin("hypothetical", "quoted")
    f = f.withColumn("depends_on", F.filter("depends_on", lambda x: x.isNotNull() & (x != F.col("id"))))
    return graph.visible_rows(f, ok).select("id")


def session_tail(spark: SparkSession, d: str) -> DataFrame:
    """Last ten messages of each session."""
    return store.newest(_turns(spark, d).where("ordinal is not null"), "session_id", "ordinal", 10).where("age <= 10").groupBy("session_id").agg(
        F.count("*").alias("kept"), F.min("ordinal").alias("oldest"), F.max("ordinal").alias("newest")
    )


def global_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Gapless numbers of all history rows in order of memory and id."""
    h = table(spark, d, "memory_history").select(F.coalesce("memory_id", F.lit("")).alias("memory_id"), "id")
    return state.global_ordinals(h, ["memory_id", "id"])


def message_ids_sha256(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic ids of messages from user, session and position."""
    m = table(spark, d, "messages").select("id", F.sha2(F.concat_ws(chr(31), F.coalesce("user_id", F.lit("")), "session_id", F.col("ordinal").cast("string")), 256).alias("digest"))
    return m.distinct()


def synthetic_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Ordering stamps a minute apart for sessions whose messages lack times."""
    m = _turns(spark, d).where("created_at is null")
    return m.select("id", F.expr("unix_micros(timestamp'2000-01-01 00:00:00 UTC' + make_dt_interval(0, 0, 1 + ordinal, 0))").alias("stamp"))


def participants(spark: SparkSession, d: str) -> DataFrame:
    """Messages of users and of named speakers, counted per role."""
    m = _turns(spark, d).select(F.lower(F.trim("role")).alias("role"), lx.speaker_of(F.col("content")).alias("speaker"))
    return m.where("role = 'user' or speaker is not null").groupBy("role").agg(F.count("*").alias("messages"), F.count("speaker").alias("named"))


def md5_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """First document of each exact text."""
    return store.first_by_md5(table(spark, d, "documents").where("text is not null"), F.col("text"), [F.col("doc_id")]).select("doc_id", "text_md5")


def idempotent_receipts(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each stored message version as a request: accepted, replayed or in conflict."""
    m = table(spark, d, "messages").withColumn("p", F.coalesce("content", F.lit("")))
    out = state.receipts(m, ["id"], F.col("p"), ["ingested_at", "p"])
    return out.groupBy("id").agg(*[F.sum((F.col("outcome") == o).cast("long")).alias(o) for o in ("accepted", "replayed", "conflict")])


def _links(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark, d).select(F.col("id").alias("memory_id"), F.explode("entities").alias("text"), F.col("kind").alias("type"))
    return store.link_rows(f)


def entity_links(spark: SparkSession, d: str) -> DataFrame:
    """Entities of facts with the number of facts that mention them."""
    out = _links(spark, d).groupBy("entity").agg(F.min("type").alias("type"), F.countDistinct("memory_id").alias("facts"))
    return out.select("entity", "type", F.col("facts").cast("int").alias("facts"))


def entity_link_rows(spark: SparkSession, d: str) -> DataFrame:
    """Entities of facts and each fact that mentions them, one row per link."""
    return _links(spark, d).select("entity", "memory_id").distinct()


def history_of_memories(spark: SparkSession, d: str) -> DataFrame:
    """Number of change rows per memory and its newest three ids."""
    h = table(spark, d, "memory_history").select(key(F.col("memory_id")).alias("memory"), "id")
    new = state.latest_per_slot(h, ["memory"], ["id"], 3).groupBy("memory").agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list("id"))), lambda x: x.cast("string")), ",").alias("newest"))
    counts = h.groupBy("memory").agg(F.count("*").alias("changes"))
    return counts.join(new, counts["memory"].eqNullSafe(new["memory"])).select(counts["memory"], "changes", "newest")


def history_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every change row, by memory and newest id first (a range sort)."""
    h = table(spark, d, "memory_history")
    return h.select(key(F.col("memory_id")).alias("memory"), "*").orderBy("memory", F.desc("id"))


def fact_times(spark: SparkSession, d: str) -> DataFrame:
    """Time texts of facts resolved against the day they were observed."""
    f = _facts(spark, d).where("time_text <> ''").select("id", "time_text", F.substring("observed_at", 1, 10).alias("anchor"))
    out = calendar.with_resolution(f, "time_text", "anchor", "t")
    return out.select("id", F.col("t.start").cast("string").alias("start"), F.col("t.end_exclusive").cast("string").alias("stop"), "t.precision", "t.resolution")


def extracted_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Attributes that message sentences state."""
    out = extraction.extract(_turns(spark, d).where("content is not null"))
    return out.groupBy("predicate", "modality").agg(F.count("*").alias("facts"), F.countDistinct("value").alias("different"))


def passages(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the documents with their places."""
    s = extraction.sentences(table(spark, d, "documents").where("text is not null"), "doc_id", "text")
    return s.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("passages"), F.max("start").alias("last_start"))


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and type, by the streaming engine: the hours that the watermark has closed."""
    e = stream.timed(stream.source(spark, d, "events"))
    aggs = [F.count("*").alias("n"), F.sum((F.col("value") * 100).cast("decimal(20,0)")).alias("cents")]
    out = stream.run(stream.windowed(e, "ts", ["event_type"], aggs, "1 hour"))
    return out.select(F.unix_micros("start").alias("start"), "event_type", "n", F.col("cents").cast("long").alias("cents"))


def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Events in windows of six hours that begin every two, closed ones."""
    e = stream.timed(stream.source(spark, d, "events"))
    out = stream.run(stream.windowed(e, "ts", ["event_type"], [F.count("*").alias("n")], "6 hours", "2 hours"))
    return out.select(F.unix_micros("start").alias("start"), "event_type", "n")


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Visits of users: events less than three hours apart, closed ones."""
    e = stream.timed(stream.source(spark, d, "events"))
    out = stream.run(stream.sessions(e, "ts", ["user_id"], [F.count("*").alias("n")], "3 hours"))
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("stop").alias("stop"), "n")


def stream_slot_updates(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of each event for its slot, with state per slot."""
    e = stream.source(spark, d, "events").select(*SLOT, F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), "value")
    return stream.slot_updates(e, SLOT).select("seq", *SLOT, "outcome")


def stream_session_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Session time that holds at each stored message: that of its header or of the last one before it in the session."""
    m = stream.source(spark, d, "messages").where("session_id is not null and id is not null and ordinal is not null")
    header = F.nullif(F.regexp_extract("content", r"\[Session time: *([^\]]+)\]", 1), F.lit(""))
    m = m.select("session_id", "ordinal", "id", F.coalesce("ingested_at", F.lit("1970-01-01").cast("timestamp_ntz")).alias("at"), header.alias("anchor"))
    return stream.carried(m, ["session_id"], ["ordinal", "at", "id", "anchor"], "anchor").where("anchor is not null").select("session_id", "id", "ordinal", "anchor").distinct()


QUERIES = {
    f.__name__: f
    for f in (
        slot_current_state, slot_timeline, as_of_state, slot_conflicts, late_arrivals, anchor_forward_fill, duplicate_merge,
        corroboration_count, pattern_cards, arbitration_multipliers, dependency_closure, session_tail, global_ordinals,
        message_ids_sha256, synthetic_timestamps, participants, md5_dedupe, idempotent_receipts, entity_links,
        history_of_memories, history_rows, entity_link_rows, fact_times, extracted_attributes, passages, stream_tumbling, stream_sliding, stream_sessions,
        stream_slot_updates, stream_session_anchors,
    )
}

_LINE = "WITH line AS (SELECT *, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nxt FROM events)"
_TURNS = "turns AS (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, created_at DESC NULLS LAST) = 1)"
_FACTS = "f AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, revision DESC, observed_at DESC NULLS LAST) = 1)"


def _canon(c: str) -> str:
    return rf"regexp_replace(trim(lower({c})), '[\s_\-]+', ' ', 'g')"


# windows are closed by a watermark one day behind the latest event
_CLOSED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 day FROM events)"
_SLOT = f"PARTITION BY user_id, {_canon('subject')}, {_canon('predicate')}, {_canon('scope')}"

SQL = {
    "slot_current_state": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "slot_timeline": _LINE + " SELECT event_id, user_id, event_type, epoch_us(ts) AS begun, epoch_us(nxt) AS ended, CASE WHEN nxt IS NULL THEN 'active' ELSE 'superseded' END AS state FROM line",
    "as_of_state": _LINE + f" SELECT user_id, event_type, event_id, value FROM line WHERE ts <= TIMESTAMP '{AS_OF}' AND (nxt IS NULL OR nxt > TIMESTAMP '{AS_OF}')",
    "slot_conflicts": "SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS period, count(DISTINCT value) AS n_values, min(value) AS low, max(value) AS high FROM events WHERE value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT value) > 1",
    "late_arrivals": """WITH h AS (SELECT id, lower(trim(memory_id)) AS memory, coalesce(epoch_us(updated_at::TIMESTAMPTZ), epoch_us(created_at::TIMESTAMPTZ)) AS made FROM memory_history),
 m AS (SELECT *, max(made) OVER (PARTITION BY memory ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM h WHERE made IS NOT NULL)
 SELECT id, memory, made, newest FROM m WHERE made < newest""",
    "anchor_forward_fill": "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS anchor FROM events",
    "duplicate_merge": f"""WITH {_FACTS}, g AS (SELECT arg_min(id, (observed_at, id)) AS id, count(*) AS copies, list_sort(list_distinct(flatten(list(list_filter(source_ids, lambda x: trim(x) <> ''))))) AS s
 FROM f WHERE kind <> 'event' GROUP BY {", ".join(_canon(c) for c in ("user_id", "subject", "predicate", "scope", "value"))}, modality HAVING count(*) > 1) SELECT id, copies, array_to_string(s, ',') AS sources FROM g""",
    "corroboration_count": "SELECT md5(trim(text)) AS text_md5, count(DISTINCT lower(trim(source))) AS sources FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lower(trim(source))) >= 2",
    "pattern_cards": f"""WITH {_FACTS}, v AS (SELECT DISTINCT user_id, subject, predicate, trim(lower(value)) AS v FROM f WHERE cardinality = 'multiple' AND modality = 'confirmed' AND state = 'active' AND kind = 'preference' AND trim(lower(value)) <> '')
 SELECT user_id, subject, predicate, string_agg(v, ', ' ORDER BY v) AS "values", CAST(count(*) AS INT) AS n_values FROM v GROUP BY ALL HAVING count(*) >= 2""",
    "arbitration_multipliers": f"""WITH {_FACTS}, w AS (SELECT *, bool_or(state = 'active' AND modality = 'confirmed') OVER ({_SLOT}) AS win, bool_or(state IN ('superseded', 'retracted')) OVER ({_SLOT}) AS old FROM f WHERE cardinality = 'single')
 SELECT id, CASE WHEN win AND old AND state = 'active' AND modality = 'confirmed' THEN 3.0 WHEN win AND state = 'active' AND modality = 'tentative' THEN 0.4
  WHEN win AND state = 'conflicted' THEN CASE WHEN len(list_distinct(source_ids)) + CASE WHEN list_contains(list_transform(source_ids, lambda x: x IS NULL), true) THEN 1 ELSE 0 END >= 2 THEN 0.9 ELSE 0.6 END ELSE 1.0 END::DOUBLE AS current,
  CASE WHEN win AND state = 'active' AND modality = 'confirmed' THEN 1.2 WHEN state IN ('superseded', 'retracted') THEN 2.5 ELSE 1.0 END::DOUBLE AS history FROM w""",
    "dependency_closure": f"""WITH RECURSIVE {_FACTS}, e AS (SELECT DISTINCT id, lower(trim(x)) AS needs FROM (SELECT id, unnest(depends_on) AS x FROM f) WHERE trim(x) <> '' AND lower(trim(x)) <> id),
 bad AS (SELECT id FROM f WHERE state IN ('erased', 'retracted', 'superseded') OR modality IN ('hypothetical', 'quoted') UNION SELECT needs FROM e WHERE needs NOT IN (SELECT id FROM f)
  UNION SELECT e.id FROM e JOIN bad ON e.needs = bad.id) SELECT id FROM f WHERE id NOT IN (SELECT id FROM bad)""",
    "session_tail": f"WITH {_TURNS}, t AS (SELECT session_id, ordinal FROM turns WHERE ordinal IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ordinal DESC) <= 10) SELECT session_id, count(*) AS kept, min(ordinal) AS oldest, max(ordinal) AS newest FROM t GROUP BY 1",
    "global_ordinals": "SELECT coalesce(memory_id, '') AS memory_id, id, row_number() OVER (ORDER BY coalesce(memory_id, ''), id) - 1 AS ordinal FROM memory_history",
    "message_ids_sha256": "SELECT DISTINCT id, sha256(concat_ws(chr(31), coalesce(user_id, ''), session_id, ordinal::VARCHAR)) AS digest FROM messages",
    "synthetic_timestamps": f"WITH {_TURNS} SELECT id, epoch_us(TIMESTAMP '2000-01-01' + to_minutes(1 + ordinal)) AS stamp FROM turns WHERE created_at IS NULL",
    "md5_dedupe": "SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL GROUP BY 2",
    "idempotent_receipts": """WITH r AS (SELECT id, row_number() OVER w AS n, coalesce(content, '') = first_value(coalesce(content, '')) OVER w AS same FROM messages WINDOW w AS (PARTITION BY id ORDER BY ingested_at, coalesce(content, '')))
 SELECT id, count(*) FILTER (n = 1) AS accepted, count(*) FILTER (n > 1 AND same) AS replayed, count(*) FILTER (n > 1 AND NOT same) AS conflict FROM r GROUP BY id""",
    "entity_links": rf"WITH {_FACTS}, e AS (SELECT id, kind, regexp_replace(lower(trim(t)), '\s+', ' ', 'g') AS entity FROM (SELECT id, kind, unnest(entities) AS t FROM f)) SELECT entity, min(kind) AS type, CAST(count(DISTINCT id) AS INT) AS facts FROM e WHERE entity <> '' GROUP BY 1",
    "history_of_memories": "SELECT lower(trim(memory_id)) AS memory, count(*) AS changes, array_to_string(list(id ORDER BY id DESC)[1:3], ',') AS newest FROM memory_history GROUP BY 1",
    "stream_tumbling": f"SELECT epoch_us(w) AS start, event_type, count(*) AS n, CAST(sum(round(value * 100)) AS BIGINT) AS cents FROM (SELECT *, time_bucket(INTERVAL 1 hour, ts) AS w FROM events) WHERE w + INTERVAL 1 hour <= {_CLOSED} GROUP BY ALL",
    "stream_sliding": f"SELECT epoch_us(w) AS start, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 2 hour, ts) - to_hours(2 * k) AS w FROM events, (SELECT unnest([0, 1, 2]) AS k)) WHERE w + INTERVAL 6 hour <= {_CLOSED} GROUP BY ALL",
    "stream_sessions": f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 3 hour THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
 SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 3 hour) AS stop, count(*) AS n FROM s GROUP BY user_id, sid HAVING max(ts) + INTERVAL 3 hour <= {_CLOSED}""",
    "stream_session_anchors": r"""WITH m AS (SELECT session_id, ordinal, id, coalesce(ingested_at, TIMESTAMP '1970-01-01') AS came, nullif(regexp_extract(content, '\[Session time: *([^\]]+)\]', 1), '') AS a FROM messages WHERE session_id IS NOT NULL AND id IS NOT NULL AND ordinal IS NOT NULL),
 f AS (SELECT *, last_value(a IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ordinal, came, id, a NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS anchor FROM m)
 SELECT DISTINCT session_id, id, ordinal, anchor FROM f WHERE anchor IS NOT NULL""",
    "stream_slot_updates": """WITH s AS (SELECT *, max(ts) OVER w AS top, arg_max(value, ts) OVER w AS held FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT event_id AS seq, user_id, event_type, CASE WHEN top IS NULL THEN 'new' WHEN ts > top THEN CASE WHEN value = held THEN 'same' ELSE 'update' END WHEN ts = top THEN CASE WHEN value = held THEN 'same' ELSE 'conflict' END ELSE 'late' END AS outcome FROM s""",
}
