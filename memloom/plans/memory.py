"""Registered queries of passages, forgetting, intervals, events, paths and the read query as one tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import intent as it
from ..functions.intent import NO_NAMES, named
from ..functions.text import instant, key
from ..operators import erasure, extraction, filters, fusion, graph, lexical, lifecycle, packing, passages, store, vectors
from ..sources.tables import materialize, table
from .evidence import _SLOTTED, SLOT, _slotted
from .retrieval import _KEY, ASK, LEXICAL, SEMANTIC
from .sqltext import KNN_SQL, tokens_sql
from .state import _FACTS, _TURNS, SQL as STATE_SQL, _facts, _turns, arbitration_multipliers, dependency_closure

OWN = r"\b(?:i|my|me|mine|we|our|us)\b"


def _messages(spark: SparkSession, d: str) -> DataFrame:
    m = _turns(spark, d).where("lower(trim(role)) = 'user' and not redacted and content <> ''")
    return m.select(key(F.col("id")).alias("source"), F.col("content").alias("text"), "user_id")


def _quotes(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    f = _facts(spark, d).where(where).select(F.col("id").alias("fact"), F.explode(F.arrays_zip("source_ids", "source_quotes")).alias("z"))
    return f.select("fact", key(F.col("z.source_ids")).alias("source"), F.col("z.source_quotes").alias("quote"))


def passage_visibility(spark: SparkSession, d: str) -> DataFrame:
    """Sentence passages of the users' messages with the facts quoted from them; shown if all of those are visible."""
    m = materialize(_messages(spark, d))
    spans = passages.source_spans(_quotes(spark, d), m)
    seen = dependency_closure(spark, d).select(F.col("id").alias("fact"))
    return passages.visibility(passages.passages(m), spans, seen).select("source", "start", "stop", "facts", "hidden", "shown")


def passage_redaction(spark: SparkSession, d: str) -> DataFrame:
    """Passages as they read once the quotes of retracted facts are cut out."""
    m = materialize(_messages(spark, d))
    holes = passages.source_spans(_quotes(spark, d, "state = 'retracted'"), m)
    out = passages.redacted(passages.passages(m), holes, m)
    return out.select("source", "start", "stop", "fragments", F.md5("text").alias("text_md5"), "state")


def interval_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """What validity intervals make of the confirmed values of single-valued slots."""
    f = _slotted(spark, d).where("cardinality = 'single' and modality = 'confirmed'")
    f = f.withColumn("begins", F.coalesce(instant(F.col("valid_from")), instant(F.col("observed_at")))).withColumn("ends", instant(F.col("valid_to")))
    return lifecycle.overlaps(f, SLOT, "value", "begins", "ends").select("id", "verdict", "ended")


def event_projection(spark: SparkSession, d: str) -> DataFrame:
    """The event of each fact (stored, replaced others, or was withdrawn) as text, with only visible facts in it."""
    f = _facts(spark, d)
    kind = F.when(F.col("state") == "retracted", "forget").when(F.size("supersedes") > 0, "update").otherwise("remember")
    ids = F.filter(F.transform("supersedes", key), lambda x: x.isNotNull())
    own = key(F.col("id"))
    events = f.select(own.alias("id"), kind.alias("type"), F.when(kind == "forget", F.array(own)).otherwise(ids).alias("before"),
                      F.when(kind == "forget", F.array().cast("array<string>")).otherwise(F.array(own)).alias("after"))
    facts = f.select(own.alias("fact"), "content", "modality", "state")
    seen = dependency_closure(spark, d).select(key(F.col("id")).alias("fact"))
    return lifecycle.project_events(events, facts, seen).select("id", "type", F.md5("shown").alias("shown_md5"))


def forget_replays(spark: SparkSession, d: str) -> DataFrame:
    """Facts that repeat what their user had withdrawn before they arrived, and by how many withdrawals."""
    f = _slotted(spark, d).withColumn("slot", F.concat_ws(chr(31), *SLOT)).withColumn("arrived", instant(F.col("ingested_at")))
    gone = f.where("state = 'retracted' and length(value) > 3")
    marks = gone.select(F.col("user_id").alias("tenant"), "slot", lx.value_digest(F.col("value")).alias("value_hash"), F.size(lx.value_words(F.col("value"))).alias("words"),
                        F.col("arrived").alias("made"), F.lit(None).cast("long").alias("lifted"))
    facts = f.where("state <> 'retracted'").select("id", F.col("user_id").alias("tenant"), "slot", "value", "content", "arrived")
    return erasure.blocked(facts, marks)


def marker_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a user that have all words of a value the user withdrew, per value."""
    f = _facts(spark, d).where("state = 'retracted' and value <> ''")
    words = F.array_sort(F.array_distinct(lx.value_words(F.col("value"))))
    phrases = f.select(F.col("user_id").alias("tenant"), words.alias("words"), F.concat_ws("|", "user_id", F.array_join(words, " ")).alias("phrase")).distinct()
    docs = _messages(spark, d).select(F.col("source").alias("doc"), F.col("user_id").alias("tenant"), "text")
    return erasure.mentioning(docs, phrases).groupBy("phrase").agg(F.count("*").alias("messages"))


def relation_paths(spark: SparkSession, d: str) -> DataFrame:
    """Facts reached from every hundredth fact (by its number) over at most two dependencies or replacements whose validity overlaps."""
    f = _facts(spark, d).withColumn("node", key(F.col("id")))
    begins, ends = F.coalesce(instant(F.col("valid_from")), instant(F.col("observed_at"))), instant(F.col("valid_to"))
    to = F.array_union(F.transform("depends_on", key), F.transform("supersedes", key))
    edges = f.select("node", begins.alias("begins"), ends.alias("ends"), F.explode(to).alias("dst")).where("dst is not null and dst <> node")
    edges = edges.select(F.concat_ws(">", "node", "dst").alias("id"), F.col("node").alias("src"), "dst", "begins", "ends").distinct()
    seeds = f.where(_hundredth("node")).select(F.col("node").alias("query"), "node")
    return graph.typed_paths(seeds, edges).select("query", "id", "depth", "begins", "ends", "rank")


def _hundredth(c: str) -> str:
    """Condition that the number a hexadecimal id begins with is divisible by ``ASK``."""
    return f"try_cast(conv(substring({c}, 1, 8), 16, 10) as bigint) % {ASK} = 0"


def store_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Revision of each user's store and how many facts it holds."""
    return table(spark, d, "facts").where("user_id is not null").groupBy("user_id").agg(F.max("revision").alias("revision"), F.countDistinct("id").alias("facts"))


def facts_at_revision(spark: SparkSession, d: str) -> DataFrame:
    """Facts as a reader saw them who holds the snapshot of revision 200."""
    rows = table(spark, d, "facts").where("revision <= 200 and id is not null").select("id", "revision", "ingested_at", "state")
    return rows.groupBy("id").agg(F.max(F.struct("revision", "ingested_at", "state")).alias("x")).select("id", "x.revision", "x.state")


def fact_time_grounding(spark: SparkSession, d: str) -> DataFrame:
    """The time expression of each fact: its own if a quote has it, else the only one in its quotes."""
    f = _facts(spark, d).select("id", "time_text", F.array_join(F.coalesce("source_quotes", F.array().cast("array<string>")), "\n").alias("source"))
    found = F.array_distinct(F.regexp_extract_all(F.lower("source"), F.lit(TIME), F.lit(1)))
    own = (F.col("time_text") != "") & F.contains(F.lower("source"), F.lower("time_text"))
    text = F.when(F.coalesce(own, F.lit(False)), F.col("time_text")).when(F.size(found) == 1, F.element_at(found, 1))
    return f.select("id", text.alias("expression"), F.coalesce(own, F.lit(False)).alias("grounded")).where("expression is not null")


TIME = (
    r"\b(yesterday|today|tomorrow|(?:last|this|next) (?:week|month|year|monday|tuesday|wednesday|thursday|friday|saturday|sunday)|"
    r"[0-9]{1,3} days ago|in [0-9]{1,3} days|20[0-9]{2}-[0-9]{2}-[0-9]{2})\b"
)


def candidate_options(spark: SparkSession, d: str) -> DataFrame:
    """Options that users' questions enumerate and the user's facts that meet one, exactly (1) or closely (4)."""
    q = _messages(spark, d).where("text like '%?%' and user_id is not null").select("source", "user_id", F.explode(lifecycle.options(F.col("text"))).alias("option"))
    f = _facts(spark, d).where("state = 'active'").select("user_id", "id", "value", "content")
    hit = q.join(f, "user_id").withColumn("level", lifecycle.match_level(F.col("option"), F.col("value"), F.col("content"))).where("level > 0")
    return hit.groupBy("source", "option", "level").agg(F.count("*").alias("facts"))


def semantic_route(spark: SparkSession, d: str) -> DataFrame:
    """The 150 nearest vectors above .15 of every asking row, over vectors of unit length."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), vectors.unit(F.col("embedding")).alias("vector"))
    asks = rows.where(F.col("doc") % ASK == 0).select(F.col("doc").alias("query"), "vector")
    hits = vectors.knn(asks, rows, SEMANTIC, least=0.15)
    return hits.groupBy("query").agg(F.count("*").alias("hits"), F.round(F.min("score"), 6).alias("least"), F.round(F.max("score"), 6).alias("most"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Questions: the users' messages whose number is divisible by ``ASK``."""
    m = _messages(spark, d).where("user_id is not null").where(_hundredth("source"))
    names = F.transform(named(F.col("text")), lx.canonical)
    return m.select(F.col("source").alias("query"), F.col("user_id").alias("tenant"), "text", names.alias("names"), F.lower("text").rlike(OWN).alias("own"))


def _ranking(spark: SparkSession, d: str) -> DataFrame:
    """The read query up to its ranking: query, doc, score, signals.

    Keyword hits are limited before invisible facts go, as a full-text index does it; names of the question in the text of
    facts are the entity route. Both fuse by reciprocal rank; other people's facts count less, and a slot's winner more.
    """
    asks = materialize(_asked(spark, d))
    facts = _facts(spark, d).where("id is not null and content is not null").join(asks.select(F.col("tenant").alias("user_id")).distinct(), "user_id", "left_semi")
    facts = materialize(facts.select(F.col("id").alias("doc"), F.col("user_id").alias("tenant"), "content", lx.canonical(F.col("subject")).alias("subject")))
    seen = materialize(dependency_closure(spark, d).select(F.col("id").alias("doc")).join(facts.select("doc"), "doc", "left_semi"))
    post = lexical.postings(facts, "doc", F.col("content")).join(facts.select("doc", "tenant"), "doc")
    terms = lexical.query_terms(asks, "query", F.col("text"), lexical.QUERY_TERMS).join(asks.select("query", "tenant"), "query")
    words = lexical.top_k(lexical.bm25_by_tenant(post, terms), LEXICAL).drop("rank").join(seen, "doc", "left_semi")
    names = asks.select("query", "tenant", F.explode("names").alias("name")).where("name <> ''").distinct()
    text = facts.join(seen, "doc", "left_semi")
    met = lexical.containing(text.select("doc", F.lower("content").alias("text")), names.select("name"))
    met = met.join(text.select("doc", "tenant"), "doc").join(names, ["name", "tenant"]).groupBy("query", "doc").agg(F.count("*").alias("score"))
    by = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    fused = fusion.rrf({"lexical": words.withColumn("rank", F.row_number().over(by)), "entity": met.withColumn("rank", F.row_number().over(by))})
    weights = arbitration_multipliers(spark, d).select(F.col("id").alias("doc"), "current")
    out = fused.join(facts.select("doc", "subject"), "doc").join(asks.select("query", "names", "own"), "query").join(weights, "doc", "left")
    score = F.col("score") * fusion.demotion(F.col("subject"), F.col("names"), F.col("own")) * F.coalesce("current", F.lit(1.0))
    return out.select("query", "doc", F.round(score, 8).alias("score"), F.array_join("signals", "+").alias("signals"))


def search_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Ranked evidence for every asking message among its user's facts."""
    return _ranking(spark, d)


def search_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The read query as one tree: routes, visibility, fusion, demotion, arbitration, dedupe and packing under the budget."""
    facts = _facts(spark, d).select(F.col("id").alias("doc"), F.md5(lx.evidence_key(F.col("subject"), F.col("scope"), F.col("content"))).alias("key"),
                                    lx.estimate_tokens(F.col("content")).cast("long").alias("cost"))
    return packing.pack(_ranking(spark, d).join(facts, "doc").select("query", "doc", "score", "key", "cost"), budget=60)


def _revisions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "facts").where("id is not null").groupBy("id", "revision").agg(F.max("state").alias("state"))


def store_upsert_delete(spark: SparkSession, d: str) -> DataFrame:
    """The facts of revision 200 with all later rows put in and those that were erased taken out."""
    rows = _revisions(spark, d)
    now = store.upsert(rows.where("revision <= 200"), rows.where("revision > 200"))
    return store.delete(now, now.where("state = 'erased'")).select("id", "revision", "state")


def checked_writes(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of all rows as writes that expect the revision before theirs in their fact: one per revision wins."""
    rows = table(spark, d, "facts").where("id is not null").select("id", "revision", F.coalesce("content", F.lit("")).alias("content"), "ingested_at")
    held = rows.where("revision <= 200").groupBy("id").agg(F.max("revision").alias("held"))
    return store.compare_and_set(held, rows.withColumn("expected", F.when(F.col("revision") % 2 == 0, F.col("revision") - 1).otherwise(F.col("revision"))))


def identity_scoped(spark: SparkSession, d: str) -> DataFrame:
    """Messages of one user per session, by the identity filter."""
    m = table(spark, d, "messages")
    user = m.groupBy("user_id").count().where("user_id is not null").orderBy(F.desc("count"), "user_id").first()
    scope = filters.identity_scope(user_id=user[0] if user else "none")
    return m.where(filters.compile_filter(scope)).groupBy("session_id").agg(F.count("*").alias("messages"))


def best_entity_type(spark: SparkSession, d: str) -> DataFrame:
    """Best type of every entity that documents mention, and how many mention it: names before codes before quoted words."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    typed = lambda n, p: F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), lambda e: F.struct(F.lit(n).alias("rank"), e.alias("entity")))
    found = [typed(n, p) for n, p in enumerate((rf"{EDGE[0]}([A-Z][a-z]+(?: [A-Z][a-z]+)+){EDGE[1]}", rf"{EDGE[0]}([A-Z]{{2,}}-?[0-9][A-Z0-9-]*)", r'"([^"\n]{2,60})"'))]
    rows = docs.select("doc_id", F.explode(F.array_distinct(F.concat(*found))).alias("m")).select("doc_id", "m.rank", F.lower("m.entity").alias("entity"))
    per = rows.groupBy("entity").agg(F.min("rank").alias("rank"), F.countDistinct("doc_id").alias("documents"))
    return per.select("entity", F.element_at(F.array(*map(F.lit, TYPES)), F.col("rank") + 1).alias("type"), "documents")


EDGE = (r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])")
TYPES = ("PROPER", "IDENTIFIER", "QUOTED")

QUERIES = {
    f.__name__: f
    for f in (
        store_upsert_delete, checked_writes, identity_scoped, best_entity_type, passage_visibility, passage_redaction, interval_conflicts, event_projection, forget_replays, marker_mentions, relation_paths,
        store_revisions, facts_at_revision, fact_time_grounding, candidate_options, semantic_route, search_ranking, search_pipeline,
    )
}

_END = ".!?。！？;；\\n"
_SEEN = "seen AS (SELECT id FROM f WHERE id NOT IN (SELECT id FROM bad))"
_BAD = STATE_SQL["dependency_closure"].split("WITH RECURSIVE", 1)[1].rsplit("SELECT id FROM f", 1)[0].replace(_FACTS + ",", "", 1)
_M = "m AS (SELECT lower(trim(id)) AS source, content AS text, user_id FROM turns WHERE lower(trim(role)) = 'user' AND NOT redacted AND content <> '')"
# no sentence of the messages is longer than a passage may be, so the plain rule holds
_PASS = rf"""cutup AS (SELECT source, text, regexp_extract_all(text, '[^{_END}]+(?:[{_END}]+\s*|$)|[{_END}]+\s*') AS s FROM m),
 p AS (SELECT source, text, CAST(coalesce(list_sum(list_transform(s[1:i - 1], lambda x: length(x))), 0) AS INT) AS start, s[i] AS piece FROM (SELECT *, unnest(generate_series(1, len(s))) AS i FROM cutup)),
 pas AS (SELECT source, text, start, CAST(start + length(piece) AS INT) AS stop FROM p WHERE regexp_matches(piece, '[^\s\p{{Z}}\p{{Cc}}\p{{Cf}}]'))"""


def _spans(where: str) -> str:
    return f"""z AS (SELECT id AS fact, lower(trim(source_ids[i])) AS source, source_quotes[i] AS quote FROM (SELECT *, unnest(generate_series(1, greatest(len(source_ids), len(source_quotes)))) AS i FROM f WHERE {where})),
 o AS (SELECT fact, source, quote, string_split(text, quote) AS parts FROM z JOIN m USING (source) WHERE quote <> '' AND contains(text, quote)),
 spans AS (SELECT DISTINCT fact, source, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(quote) AS INT) AS a, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + k * length(quote) AS INT) AS b
  FROM (SELECT *, unnest(generate_series(1, len(parts) - 1)) AS k FROM o))"""


_NAMES = ", ".join(f"'{n}'" for n in NO_NAMES)
_CANON = lambda c: rf"regexp_replace(trim(lower({c})), '[\s_\-]+', ' ', 'g')"
_WORDS = lambda c: rf"regexp_extract_all({_CANON(c)}, '[\p{{L}}\p{{N}}]+')"
_NUMBER = lambda c: f"TRY_CAST('0x' || substr({c}, 1, 8) AS BIGINT) % 100 = 0"
_WHEN = "coalesce(epoch_us(valid_from::TIMESTAMPTZ), epoch_us(observed_at::TIMESTAMPTZ))"
_RANKING = rf"""{_FACTS}, {_TURNS}, {_M}, {_BAD}, {_SEEN},
 q0 AS (SELECT source AS query, user_id AS tenant, text, regexp_matches(lower(text), '{OWN}') AS own,
  list_distinct(list_concat(regexp_extract_all(text, '\b[A-Z][a-z]+(?: [A-Z][a-z]+)*\b'), regexp_extract_all(text, '[A-Z]{{2,}}[-0-9][A-Z0-9-]+'))) AS raw FROM m WHERE user_id IS NOT NULL AND {_NUMBER('source')}),
 q AS (SELECT *, list_transform(list_filter(raw, lambda w: length(w) >= 2 AND w NOT IN ({_NAMES})), lambda w: {_CANON('w')}) AS names FROM q0),
 g AS (SELECT id AS doc, user_id AS tenant, content, {_CANON('subject')} AS subject FROM f WHERE content IS NOT NULL AND user_id IN (SELECT tenant FROM q)),
 tok AS (SELECT doc, tenant, {tokens_sql('content')} AS t FROM g),
 post AS (SELECT doc, tenant, len(t) AS doc_len, term, count(*) AS tf FROM (SELECT *, unnest(t) AS term FROM tok) GROUP BY ALL),
 stats AS (SELECT tenant, count(*) AS n, avg(doc_len) AS avg_len FROM (SELECT DISTINCT tenant, doc, doc_len FROM post) GROUP BY 1),
 dfs AS (SELECT tenant, term, count(*) AS df FROM post GROUP BY ALL),
 qt AS (SELECT query, tenant, term FROM (SELECT query, tenant, term, min(pos) AS first FROM (SELECT query, tenant, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT *, {tokens_sql('text')} AS t FROM q)) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY query ORDER BY first) <= 64),
 sc AS (SELECT query, doc, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 9) AS score
  FROM post JOIN qt USING (tenant, term) JOIN dfs USING (tenant, term) JOIN stats USING (tenant) GROUP BY ALL),
 lexi AS (SELECT query, doc, score FROM (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) <= 180) WHERE doc IN (SELECT id FROM seen)),
 qn AS (SELECT DISTINCT query, tenant, unnest(names) AS name FROM q),
 ent AS (SELECT query, doc, count(*) AS score FROM qn JOIN g USING (tenant) WHERE name <> '' AND contains(lower(content), name) AND doc IN (SELECT id FROM seen) GROUP BY ALL),
 fu AS (SELECT query, doc, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)) AS s, 'lexical' AS r FROM lexi
  UNION ALL SELECT query, doc, 0.5::DOUBLE / (60 + row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)), 'entity' FROM ent),
 fz AS (SELECT query, doc, sum(s) AS s, string_agg(r, '+' ORDER BY r) AS signals FROM fu GROUP BY ALL),
 arb AS ({STATE_SQL['arbitration_multipliers'].replace('WITH ' + _FACTS + ',', 'WITH', 1)}),
 ranked AS (SELECT query, doc, signals, round(s * CASE WHEN CASE WHEN subject = 'user' THEN len(names) > 0 AND NOT own WHEN subject = 'assistant' THEN own
   WHEN len(names) > 0 THEN NOT coalesce(list_contains(names, subject), false) ELSE own END THEN 0.3 ELSE 1.0 END * coalesce(current, 1.0), 8) AS score
  FROM fz JOIN g USING (doc) JOIN q USING (query) LEFT JOIN arb ON arb.id = doc)"""

SQL = {
    "passage_visibility": f"""WITH RECURSIVE {_FACTS}, {_TURNS}, {_M}, {_PASS}, {_spans('true')}, {_BAD}, {_SEEN},
 l AS (SELECT DISTINCT source, start, stop, fact FROM pas JOIN spans USING (source) WHERE a < stop AND b > start),
 c AS (SELECT source, start, stop, count(*) AS facts, count(*) FILTER (fact NOT IN (SELECT id FROM seen)) AS hidden FROM l GROUP BY ALL)
 SELECT source, start, stop, coalesce(facts, 0) AS facts, coalesce(hidden, 0) AS hidden, coalesce(hidden, 0) = 0 AS shown FROM pas LEFT JOIN c USING (source, start, stop)""",
    "passage_redaction": rf"""WITH {_FACTS}, {_TURNS}, {_M}, {_PASS}, {_spans("state = 'retracted'")},
 h AS (SELECT DISTINCT source, start, stop, text, a, b FROM pas JOIN (SELECT DISTINCT source, a, b FROM spans) USING (source) WHERE a < stop AND b > start),
 w AS (SELECT *, greatest(start, coalesce(max(b) OVER (PARTITION BY source, start ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start)) AS lo FROM h),
 e AS (SELECT source, start, stop, text, lo AS x, least(a, stop) AS y FROM w UNION ALL SELECT source, start, stop, text, max(b), stop FROM h GROUP BY ALL),
 k AS (SELECT source, start, stop, count(piece) AS fragments, coalesce(string_agg(piece, ' […] ' ORDER BY x), '') AS t FROM (SELECT *, CASE WHEN x < y AND regexp_matches(substr(text, x + 1, y - x), '[\p{{L}}\p{{N}}]') THEN substr(text, x + 1, y - x) END AS piece FROM e) GROUP BY ALL)
 SELECT source, start, stop, CAST(fragments AS INT) AS fragments, md5(t) AS text_md5, CASE WHEN fragments = 0 THEN 'erased' ELSE 'active' END AS state FROM k""",
    "interval_conflicts": f"""WITH {_SLOTTED}, h AS (SELECT s0, s1, s2, s3, {_CANON('value')} AS v, id, {_WHEN} AS a, epoch_us(valid_to::TIMESTAMPTZ) AS z FROM g WHERE cardinality = 'single' AND modality = 'confirmed'),
 r AS (SELECT s0, s1, s2, s3, v, arg_min(id, (a, id)) AS id, arg_min(a, (a, id)) AS a, arg_min({{'z': z}}, (a, id)).z AS z FROM h WHERE a IS NOT NULL AND v <> '' GROUP BY ALL),
 i AS (SELECT *, CASE WHEN z > a THEN z ELSE a + 1 END AS b FROM r),
 x AS (SELECT i.id, bool_or(o.a < i.b AND i.a < o.b) AS crossed, min(o.a) FILTER ((o.a, o.id) > (i.a, i.id)) AS nxt FROM i JOIN i o ON o.s0 = i.s0 AND o.s1 = i.s1 AND o.s2 = i.s2 AND o.s3 = i.s3 AND o.v <> i.v GROUP BY 1)
 SELECT id, CASE WHEN coalesce(crossed, false) THEN 'conflicted' WHEN nxt IS NULL THEN 'active' ELSE 'superseded' END AS verdict, CASE WHEN NOT coalesce(crossed, false) THEN nxt END AS ended FROM i LEFT JOIN x USING (id)""",
    "event_projection": f"""WITH RECURSIVE {_FACTS}, {_BAD}, {_SEEN}, t AS (SELECT lower(trim(id)) AS id, content, modality, state, CASE WHEN state = 'retracted' THEN 'forget' WHEN len(supersedes) > 0 THEN 'update' ELSE 'remember' END AS type, supersedes FROM f),
 shown AS (SELECT t.id, content || ' (' || modality || '; ' || state || ')' AS text FROM t WHERE state NOT IN ('erased', 'retracted') AND id IN (SELECT lower(trim(id)) FROM seen)),
 ev AS (SELECT id, type, CASE WHEN type = 'forget' THEN [id] ELSE list_filter(list_transform(supersedes, lambda x: lower(trim(x))), lambda x: x <> '') END AS before, CASE WHEN type = 'forget' THEN []::VARCHAR[] ELSE [id] END AS after FROM t),
 b AS (SELECT e.id, pos, coalesce(s.text, '[unavailable]') AS x FROM (SELECT id, unnest(before) AS fact, generate_subscripts(before, 1) AS pos FROM ev) e LEFT JOIN shown s ON s.id = e.fact),
 a AS (SELECT e.id, pos, coalesce(s.text, '[unavailable]') AS x FROM (SELECT id, unnest(after) AS fact, generate_subscripts(after, 1) AS pos FROM ev) e LEFT JOIN shown s ON s.id = e.fact)
 SELECT id, type, md5(type || ' before: ' || coalesce((SELECT string_agg(x, ' | ' ORDER BY pos) FROM b WHERE b.id = e.id), '[none]') || ' after: ' || coalesce((SELECT string_agg(x, ' | ' ORDER BY pos) FROM a WHERE a.id = e.id), '[none]')) AS shown_md5 FROM ev e""",
    "forget_replays": f"""WITH {_SLOTTED}, v AS (SELECT *, array_to_string({_WORDS('value')}, ' ') AS v, ' ' || array_to_string({_WORDS('content')}, ' ') || ' ' AS c FROM g WHERE user_id IS NOT NULL),
 k AS (SELECT DISTINCT user_id, s0, s1, s2, s3, v, ingested_at AS made FROM v WHERE state = 'retracted' AND length(value) > 3 AND v <> '')
 SELECT v.id, count(DISTINCT (k.s0, k.s1, k.s2, k.s3, k.v, k.made)) AS markers FROM v JOIN k ON v.user_id = k.user_id AND v.ingested_at > k.made
  AND ((v.s0 = k.s0 AND v.s1 = k.s1 AND v.s2 = k.s2 AND v.s3 = k.s3 AND v.v = k.v) OR contains(v.c, ' ' || k.v || ' ')) WHERE v.state <> 'retracted' GROUP BY 1""",
    "marker_mentions": f"""WITH {_FACTS}, {_TURNS}, {_M}, p AS (SELECT DISTINCT user_id, list_sort(list_distinct({_WORDS('value')})) AS w FROM f WHERE state = 'retracted' AND value <> '' AND user_id IS NOT NULL),
 t AS (SELECT source, user_id, {_WORDS('text')} AS w FROM m) SELECT p.user_id || '|' || array_to_string(p.w, ' ') AS phrase, count(*) AS messages FROM p JOIN t USING (user_id) WHERE len(p.w) > 0 AND list_has_all(t.w, p.w) GROUP BY 1""",
    "relation_paths": f"""WITH {_FACTS}, n AS (SELECT *, lower(trim(id)) AS node, {_WHEN} AS b, epoch_us(valid_to::TIMESTAMPTZ) AS e FROM f),
 ed AS (SELECT DISTINCT node || '>' || dst AS id, node AS src, dst, b, e FROM (SELECT node, b, e, lower(trim(unnest(list_concat(coalesce(depends_on, []), coalesce(supersedes, []))))) AS dst FROM n) WHERE dst <> '' AND dst <> node),
 s AS (SELECT node AS query FROM n WHERE {_NUMBER('node')}),
 h0 AS (SELECT query, id, dst, b, e FROM s JOIN ed ON src = query WHERE b IS NULL OR e IS NULL OR b < e QUALIFY row_number() OVER (PARTITION BY query ORDER BY id) <= 8),
 f1 AS (SELECT DISTINCT query, dst, b, e FROM h0 WHERE dst <> query),
 h1 AS (SELECT query, ed.id, greatest(f1.b, ed.b) AS b, least(f1.e, ed.e) AS e, src FROM f1 JOIN ed ON src = f1.dst),
 h1k AS (SELECT query, id, b, e FROM h1 WHERE b IS NULL OR e IS NULL OR b < e QUALIFY row_number() OVER (PARTITION BY query, src ORDER BY id, b NULLS FIRST, e NULLS FIRST) <= 8),
 u AS (SELECT query, id, 0 AS depth, b, e FROM h0 UNION ALL SELECT query, id, 1, b, e FROM h1k),
 d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query, id ORDER BY depth, b NULLS FIRST, e NULLS FIRST) = 1)
 SELECT query, id, depth, b AS begins, e AS ends, row_number() OVER (PARTITION BY query ORDER BY depth, id) AS rank FROM d QUALIFY rank <= 40""",
    "store_upsert_delete": "WITH r AS (SELECT id, revision, max(state) AS state FROM facts WHERE id IS NOT NULL GROUP BY ALL), n AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY revision DESC) = 1) SELECT id, revision, state FROM n WHERE state IS DISTINCT FROM 'erased'",
    "checked_writes": """WITH r AS (SELECT id, revision, coalesce(content, '') AS content, ingested_at, CASE WHEN revision % 2 = 0 THEN revision - 1 ELSE revision END AS expected FROM facts WHERE id IS NOT NULL), h AS (SELECT id, max(revision) AS held FROM r WHERE revision <= 200 GROUP BY 1),
 m AS (SELECT r.*, coalesce(held, 0) = expected AS fits, row_number() OVER (PARTITION BY r.id, coalesce(held, 0) = expected ORDER BY ingested_at, content) AS n FROM r LEFT JOIN h USING (id))
 SELECT id, count(*) FILTER (fits AND n = 1) AS accepted, count(*) FILTER (NOT (fits AND n = 1)) AS conflicts FROM m GROUP BY id""",
    "identity_scoped": "WITH u AS (SELECT user_id FROM messages WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1) SELECT session_id, count(*) AS messages FROM messages JOIN u USING (user_id) GROUP BY 1",
    # letters beyond ASCII become underscores, so that the ASCII word borders of the statement's patterns hold
    "best_entity_type": r"""WITH d AS (SELECT doc_id, text, regexp_replace(text, '[\x{AA}\x{B5}\x{BA}\x{C0}-\x{24F}\x{370}-\x{1FFF}]', '_', 'g') AS t FROM documents),
 m AS (SELECT doc_id, 1 AS rank, unnest(regexp_extract_all(t, '\b([A-Z][a-z]+(?: [A-Z][a-z]+)+)\b', 1)) AS e FROM d UNION ALL SELECT doc_id, 2, unnest(regexp_extract_all(t, '\b([A-Z]{2,}-?[0-9][A-Z0-9-]*)', 1)) FROM d
  UNION ALL SELECT doc_id, 3, unnest(regexp_extract_all(text, '"([^"\n]{2,60})"', 1)) FROM d) SELECT lower(e) AS entity, ['PROPER', 'IDENTIFIER', 'QUOTED'][min(rank)] AS type, count(DISTINCT doc_id) AS documents FROM m GROUP BY 1""",
    "store_revisions": "SELECT user_id, max(revision) AS revision, count(DISTINCT id) AS facts FROM facts WHERE user_id IS NOT NULL GROUP BY 1",
    "facts_at_revision": "SELECT id, revision, state FROM facts WHERE revision <= 200 QUALIFY row_number() OVER (PARTITION BY id ORDER BY revision DESC, ingested_at DESC, state DESC) = 1",
    "fact_time_grounding": f"""WITH {_FACTS}, s AS (SELECT id, time_text, coalesce(array_to_string(source_quotes, chr(10)), '') AS src FROM f), x AS (SELECT *, list_distinct(regexp_extract_all(lower(src), '{TIME}', 1)) AS found,
  coalesce(time_text <> '' AND contains(lower(src), lower(time_text)), false) AS grounded FROM s) SELECT id, CASE WHEN grounded THEN time_text ELSE found[1] END AS expression, grounded FROM x WHERE grounded OR len(found) = 1""",
    "semantic_route": KNN_SQL.format(where="true") + """, n AS (SELECT * FROM sims WHERE score > 0.15 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) <= 150)
 SELECT query, count(*) AS hits, round(min(score), 6) AS least, round(max(score), 6) AS most FROM n GROUP BY 1""",
    "search_ranking": f"WITH RECURSIVE {_RANKING} SELECT query, doc, score, signals FROM ranked",
    "search_pipeline": f"""WITH RECURSIVE {_RANKING}, keyed AS (SELECT query, doc, {_KEY.replace("'||' ||", "lower(subject) || '|' || lower(scope) || '|' ||").replace('text', 'content')} AS key, CAST(ceil(length(content) / 3) AS BIGINT) AS cost, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rn FROM (SELECT query, doc, score FROM ranked) JOIN f ON f.id = doc),
 walk AS (SELECT query, 0::BIGINT AS rn, NULL::VARCHAR AS doc, []::VARCHAR[] AS keys, 0::BIGINT AS spent, 0::BIGINT AS place, 0::BIGINT AS cost, false AS took FROM (SELECT DISTINCT query FROM keyed)
  UNION ALL SELECT w.query, r.rn, r.doc, CASE WHEN ok THEN list_append(keys, key) ELSE keys END, spent + CASE WHEN ok THEN r.cost ELSE 0 END, place + CASE WHEN ok THEN 1 ELSE 0 END, r.cost, ok
  FROM walk w JOIN keyed r ON r.query = w.query AND r.rn = w.rn + 1, LATERAL (SELECT NOT list_contains(keys, key) AND spent + r.cost <= 60 AND place < 100 AS ok))
 SELECT query, doc, CAST(place AS INT) AS place, cost, spent FROM walk WHERE took""",
}

_RAW_NAMES = lambda c: f"list_filter(list_distinct(list_concat(regexp_extract_all({c}, '\\b[A-Z][a-z]+(?: [A-Z][a-z]+)*\\b'), regexp_extract_all({c}, '[A-Z]{{2,}}[-0-9][A-Z0-9-]+'))), lambda w: length(w) >= 2 AND w NOT IN ({_NAMES}))"
_SPEAKER = r"""regexp_extract(content, '^(\p{Lu}[\p{L}''-]{0,20}\.?(?: \p{Lu}[\p{L}''-]{0,20}\.?){0,2}):\s', 1)"""
_STOPS = ", ".join(f"'{w}'" for w in lx.NO_SPEAKER)
_NAMED = rf"""CASE WHEN n <> '' AND lower(regexp_extract(n, '^([\p{{L}}''-]+)', 1)) NOT IN ({_STOPS}) AND NOT regexp_matches(n, '\p{{L}}{{5,}}\.') THEN n END"""


def _sql(text: str) -> str:
    return text.replace("'", "''")


def _rule(i: int, group: str) -> str:
    name, wording = extraction.RULES[i]
    if group == "predicate":
        return f"WHEN regexp_matches(quote, '{_sql(wording)}') THEN " + (f"regexp_extract(quote, '{_sql(wording)}', 1)" if name is None else f"'{name}'")
    return f"WHEN regexp_matches(quote, '{_sql(wording)}') THEN trim(regexp_extract(quote, '{_sql(wording)}', {2 if name is None else 1}))"


_TALK = r"(regexp_matches(quote, '{d}') AND regexp_matches(quote, '(?i)\b(?:forget|delete|erase|remove|discard)\b'))".replace("{d}", _sql(extraction.DENIED))

# statements of older queries
SQL |= {
    "participants": f"""WITH {_TURNS}, s AS (SELECT lower(trim(role)) AS role, {_SPEAKER} AS n FROM turns), t AS (SELECT role, {_NAMED} AS speaker FROM s)
 SELECT role, count(*) AS messages, count(speaker) AS named FROM t WHERE role = 'user' OR speaker IS NOT NULL GROUP BY role""",
    "memory_events": r"""WITH h AS (SELECT lower(trim(memory_id)) AS entity, id, upper(trim(action)) AS act, new_value, coalesce(epoch_us(updated_at::TIMESTAMPTZ), epoch_us(created_at::TIMESTAMPTZ)) AS made, epoch_us(ingested_at) AS arrived FROM memory_history),
 c AS (SELECT entity, act, new_value, CASE WHEN act = 'DELETE' THEN coalesce(made, 9223372036854775807) ELSE coalesce(made, arrived, 0) END AS ts, id FROM h
  WHERE entity <> '' AND (act = 'DELETE' OR (act IN ('ADD', 'UPDATE') AND regexp_matches(new_value, '[^\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')))),
 d AS (SELECT entity, act, min(id) AS n FROM c GROUP BY entity, act, new_value, ts)
 SELECT 'event-' || sha256(entity || chr(0) || n::VARCHAR) AS id, CASE act WHEN 'ADD' THEN 'remember' WHEN 'UPDATE' THEN 'update' ELSE 'forget' END AS kind, sha256(entity) AS slot_hash, n FROM d""",
    "question_intents": f"""WITH {_TURNS}, q AS (SELECT lower(content) AS q FROM turns WHERE lower(trim(role)) = 'user' AND content LIKE '%?%'), x AS (SELECT CASE WHEN regexp_matches(q, '{it.TRAJECTORY}') THEN 'trajectory'
  WHEN regexp_matches(q, '{it.OPERATION}') THEN 'operation' WHEN regexp_matches(q, '{it.LISTING}') THEN 'list' WHEN regexp_matches(q, '{it.HISTORY}') THEN 'historical' ELSE 'current' END AS mode,
  regexp_matches(q, '{it.TEMPORAL}') AS temporal, regexp_matches(q, '{it.OPERATION}') AS operation FROM q) SELECT mode, temporal, operation, count(*) AS questions FROM x GROUP BY ALL""",
    "named_entities": f"WITH {_FACTS} SELECT name, count(DISTINCT id) AS facts FROM (SELECT id, unnest({_RAW_NAMES('content')}) AS name FROM f WHERE content IS NOT NULL) GROUP BY 1",
    "exact_options": f"""WITH {_SLOTTED}, a AS (SELECT * FROM g WHERE state = 'active' AND cardinality = 'single' AND value <> ''), o AS (SELECT s0, s1, s2, s3, max(value) AS option FROM a GROUP BY ALL)
 SELECT id, option FROM a JOIN o USING (s0, s1, s2, s3) WHERE {_CANON('option')} <> '' AND ({_CANON('value')} = {_CANON('option')} OR (length({_CANON('option')}) >= 4 AND contains({_CANON('content')}, {_CANON('option')})))""",
    "candidate_options": rf"""WITH {_FACTS}, {_TURNS}, {_M}, t AS (SELECT source, user_id, regexp_extract(text, '(?:(?i:\bbetween\b|\bprefer\b|\bchoose\b)|:)\s*([^:]*)$', 1) AS tail FROM m WHERE text LIKE '%?%' AND user_id IS NOT NULL),
 s AS (SELECT source, user_id, list_transform(string_split_regex(tail, '(?i),|;|\bor\b|\band\b'), lambda p: trim(regexp_replace(p, '[?.!\s]+$', ''))) AS raw FROM t),
 u AS (SELECT source, user_id, part, min(i) AS i FROM (SELECT source, user_id, unnest(raw) AS part, generate_subscripts(raw, 1) AS i FROM s) WHERE length(part) >= 2 AND len(string_split_regex(part, '\s+')) <= 14 GROUP BY ALL),
 o AS (SELECT source, user_id, part AS option FROM u QUALIFY count(*) OVER (PARTITION BY source) >= 2 AND row_number() OVER (PARTITION BY source ORDER BY i) <= 6),
 j AS (SELECT o.*, {_CANON('option')} AS c, {_CANON('value')} AS v, {_CANON('content')} AS k, list_distinct({tokens_sql('option')}) AS a, {tokens_sql('content')} AS b FROM o JOIN f USING (user_id) WHERE state = 'active'),
 l AS (SELECT source, option, CASE WHEN c <> '' AND (v = c OR (length(c) >= 4 AND contains(k, c))) THEN 1 WHEN len(string_split_regex(trim(option), '\s+')) > 3 AND len(list_intersect(a, b)) / greatest(len(a), 1) >= 0.8 THEN 4 ELSE 0 END AS level FROM j)
 SELECT source, option, level, count(*) AS facts FROM l WHERE level > 0 GROUP BY ALL""",
    "extracted_attributes": rf"""WITH {_TURNS}, c AS (SELECT id, lower(trim(role)) AS role, trim(regexp_replace(content, '\[Session time:[^\]]*\]', '', 'g'), ' ') AS content FROM turns WHERE content IS NOT NULL),
 n AS (SELECT *, {_SPEAKER} AS n FROM c), p AS (SELECT *, {_NAMED} AS name FROM n),
 q AS (SELECT trim(regexp_replace(unnest(regexp_extract_all(content, '[^{_END}]+(?:[{_END}]+\s*|$)|[{_END}]+\s*')), '[\n\s]+$', ''), ' ') AS quote FROM p WHERE role = 'user' OR name IS NOT NULL),
 a AS (SELECT quote, CASE {" ".join(_rule(i, "predicate") for i in range(len(extraction.RULES)))} END AS predicate, CASE {" ".join(_rule(i, "value") for i in range(len(extraction.RULES)))} END AS value FROM q
  WHERE NOT regexp_matches(quote, '{_sql(extraction.RESTORE)}') AND NOT (regexp_matches(quote, '{_sql(extraction.FORGET)}') AND NOT {_TALK}) AND NOT {_TALK})
 SELECT predicate, CASE WHEN regexp_matches(quote, '{_sql(extraction.TENTATIVE)}') THEN 'tentative' ELSE 'confirmed' END AS modality, count(*) AS facts, count(DISTINCT value) AS different FROM a WHERE predicate <> '' AND value <> '' GROUP BY ALL""",
    "passages": rf"""WITH s AS (SELECT doc_id, regexp_extract_all(text, '[^{_END}]+(?:[{_END}]+\s*|$)|[{_END}]+\s*') AS s FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(s) AS piece, generate_subscripts(s, 1) AS i FROM s),
 t AS (SELECT doc_id, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(piece) AS start FROM e)
 SELECT doc_id, count(*) AS passages, CAST(max(start) AS INT) AS last_start FROM t WHERE trim(regexp_replace(piece, '[\n\s]+$', ''), ' ') <> '' GROUP BY 1""",
}
