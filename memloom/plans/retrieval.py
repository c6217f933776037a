"""Registered queries of search: text keys, keyword and vector search, fusion, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.intent import NO_NAMES, named
from ..operators import erasure, fuseblocks, fusion, graph, lexical, packing, vectors
from ..sources.tables import materialize, once, table
from .sqltext import BM25_SQL, FIRST_TERMS, KNN_SQL, TOKENS_SQL

#: A row asks a query if its id is divisible by this.
ASK = 100
# Most hits of the semantic and of the lexical route.
SEMANTIC, LEXICAL = 150, 180


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "source", "lang", "n_chars")


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "postings", lambda: lexical.postings(_docs(spark, d), "doc_id", F.col("text")))


def _terms(spark: SparkSession, d: str, most: int | None = lexical.QUERY_TERMS) -> DataFrame:
    return lexical.query_terms(_docs(spark, d).where(F.col("doc_id") % ASK == 0), "doc_id", F.col("text"), most)


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"), "label")
    return rows.where(F.col("doc") % ASK == 0).select(F.col("doc").alias("query"), "vector"), rows


def tokens_postings(spark: SparkSession, d: str) -> DataFrame:
    """Inverted index: term, document and frequency."""
    return _postings(spark, d)


def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The inverted index of half of the documents after the others, and every third again, were put in."""
    docs = _docs(spark, d)
    half = lexical.postings(docs.where("doc_id % 2 = 0"), "doc_id", F.col("text"))
    return lexical.upsert_postings(half, docs.where("doc_id % 2 = 1 or doc_id % 3 = 0"), "doc_id", F.col("text"))


def _topk(spark: SparkSession, d: str, most: int | None) -> DataFrame:
    hits = lexical.search(_postings(spark, d), _terms(spark, d, most), 20)
    return hits.select("query", "doc", F.round("score", 6).alias("score"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Keyword top 20 of every asking document, in-memory flavour, by its first 64 terms as its statement has it."""
    return _topk(spark, d, lexical.QUERY_TERMS)


def bm25_topk_all(spark: SparkSession, d: str) -> DataFrame:
    """Keyword top 20 of every asking document by all its terms."""
    return _topk(spark, d, None)


def bm25_fts_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same, full-text index flavour, which takes 64 terms of a query."""
    hits = lexical.search(_postings(spark, d), _terms(spark, d), 20, k1=1.2, floor=1e-6, repeats=False)
    return hits.select("query", "doc", F.round("score", 6).alias("score"))


def _sigmoid(spark: SparkSession, d: str, most: int | None) -> DataFrame:
    tenth = lambda score, terms: F.floor(F.round(lx.sigmoid_score(F.round(score, 6), terms), 6) * 10)
    return lexical.matches_by_tenth(_postings(spark, d), _terms(spark, d, most), tenth)


def bm25_sigmoid(spark: SparkSession, d: str) -> DataFrame:
    """Keyword scores of all matches on a scale of 0 to 1, counted per query and tenth (64 terms, as its statement has it)."""
    return _sigmoid(spark, d, lexical.QUERY_TERMS)


def bm25_sigmoid_all(spark: SparkSession, d: str) -> DataFrame:
    """The same by all terms of a query."""
    return _sigmoid(spark, d, None)


def knn_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Exact nearest 10 vectors of every asking row."""
    q, rows = _vectors(spark, d)
    return vectors.knn(q, rows.select("doc", "vector"), 10).select("query", "doc", F.round("score", 6).alias("score"), "rank")


def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The same among rows of some labels, above a least similarity."""
    q, rows = _vectors(spark, d)
    hits = vectors.knn(q, rows.where(F.col("label").isin(1, 3, 5)).select("doc", "vector"), 10, least=0.15)
    return hits.select("query", "doc", F.round("score", 6).alias("score"), "rank")


def knn_metric_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of each vector against the previous one under every metric."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("b"))
    both = rows.join(rows.select((F.col("vec_id") + 1).alias("vec_id"), F.col("b").alias("a")), "vec_id")
    scored = [F.round(vectors.SCORES[m](vectors.distance(F.col("a"), F.col("b"), m)), 6).alias(m) for m in ("cosine", "l2", "l2_squared", "l1", "dot")]
    return both.select("vec_id", *scored)


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Vector neighbours fused with the label route (same label, nearest ids first), 20 each as its statement has it."""
    q, rows = _vectors(spark, d)
    near = vectors.knn(q, rows.select("doc", "vector"), 20)
    ask = rows.where(F.col("doc") % ASK == 0).select(F.col("doc").alias("query"), "label")
    same = ask.join(rows.select("doc", "label"), "label").select("query", "doc", (-F.abs(F.col("doc") - F.col("query"))).alias("score"))
    fused = fusion.rrf({"semantic": near, "entity": lexical.top_k(same, 20)})
    return fused.select("query", "doc", F.round("score", 8).alias("score"), F.array_join("signals", "+").alias("signals"))


def additive_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Arithmetic of the fusion alone, as its statement has it: neighbours with stand-in scores by id."""
    q, rows = _vectors(spark, d)
    near = vectors.knn(q, rows.select("doc", "vector"), 20)
    key = near.where(F.col("doc") % 2 == 0).select("query", "doc", (1 / (1 + F.col("rank"))).alias("score"))
    ent = near.where(F.col("doc") % 3 == 0).select("query", "doc", F.lit(0.25).alias("score"))
    return fusion.additive(near, key, ent).select("query", "doc", F.round("score", 6).alias("score"))


def _routes(spark: SparkSession, d: str, most: int | None, near_only: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Semantic and lexical hits of every asking document among the documents, the names in each, and where names are found.

    A document's vector is the one under its id, if there is one. (query, doc, score, rank) for the first two
    routes, (query, name) and (doc, name) for the entity route, and the asking documents. The lexical route asks by the
    first ``most`` terms of a document, or by all. With ``near_only`` the other two routes run only for documents that have
    semantic hits.
    """
    docs = _docs(spark, d).where("doc_id is not null")
    asks = docs.where(F.col("doc_id") % ASK == 0)
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    rows = rows.join(docs.select(F.col("doc_id").alias("doc")), "doc", "left_semi")
    asking = rows.where(F.col("doc") % ASK == 0).select(F.col("doc").alias("query"), F.col("vector").alias("vector"))
    near = vectors.knn(asking, rows, SEMANTIC, least=0.15)
    if near_only:
        near = materialize(near)
        asks = asks.join(near.select(F.col("query").alias("doc_id")).distinct(), "doc_id", "left_semi")
    terms = lexical.query_terms(asks, "doc_id", F.col("text"), most)
    words = lexical.search(_postings(spark, d), terms, LEXICAL, k1=1.2, floor=1e-6, repeats=False)
    names = asks.select(F.col("doc_id").alias("query"), F.explode(named(F.col("text"))).alias("name"))
    names = names.select("query", F.lower("name").alias("name")).distinct()
    hits = lexical.containing(docs.select(F.col("doc_id").alias("doc"), F.lower("text").alias("text")), names)
    return near, words, names, hits, asks


def rrf_routes(spark: SparkSession, d: str) -> DataFrame:
    """Vector, keyword (all terms) and entity search of every asking document, fused by reciprocal rank.

    The entity route reaches most documents, so its pairs are ranked and fused where they are found.
    """
    near, words, names, hits, _ = _routes(spark, d, None)
    ids = _docs(spark, d).where("doc_id is not null").select(F.col("doc_id").alias("doc"))
    return fuseblocks.rrf({"semantic": near, "lexical": words}, hits, names, ids)


def additive_routes(spark: SparkSession, d: str) -> DataFrame:
    """Vector hits plus their keyword score on a scale of 0 to 1 and their entity boost, over the most possible.

    Keyword search takes 64 terms, as the statement has it. Only vector hits can be returned, so queries without any are not
    searched for.
    """
    near, words, names, hits, asks = _routes(spark, d, lexical.QUERY_TERMS, near_only=True)
    size = F.size(F.split(F.trim("text"), r"\s+")).alias("words")
    words = words.join(asks.select(F.col("doc_id").alias("query"), size), "query")
    hits = materialize(hits)
    linked = hits.groupBy("name").agg(F.count("*").alias("linked"))
    found = hits.join(names, "name").join(linked, "name").groupBy("query", "doc").agg(F.max(fusion.entity_boost(F.lit(1.0), F.col("linked"))).alias("boost"))
    key = words.select("query", "doc", lx.sigmoid_score(F.col("score"), F.col("words")).alias("score"))
    out = fusion.additive(near, key, found.select("query", "doc", F.col("boost").alias("score")))
    return out.select("query", "doc", F.round("score", 6).alias("score"))


def token_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share more than a third of an asking document's tokens (similarity join by token)."""
    post = _postings(spark, d).select("doc", "term")
    return lexical.sharing(post, post.where(F.col("doc") % ASK == 0).withColumnRenamed("doc", "query"))


def estimate_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Estimated size of each document."""
    return _docs(spark, d).select("doc_id", lx.estimate_tokens(F.col("text")).alias("est_tokens"))


def evidence_key_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Smallest id and number of documents that say the same."""
    k = F.md5(lx.evidence_key(F.lit(""), F.lit(""), F.col("text")))
    return _docs(spark, d).where("text is not null").groupBy(k.alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def entity_contains_join(spark: SparkSession, d: str) -> DataFrame:
    """Facts whose text contains the name of one of the fact's own entities, counted per entity, as its statement has it."""
    facts = table(spark, d, "facts").select("id", F.lower("content").alias("content"), F.explode("entities").alias("e"))
    hit = facts.where("e <> '' and contains(content, lower(e))")
    return hit.groupBy(F.lower("e").alias("entity")).agg(F.countDistinct("id").alias("facts"))


def entity_contains_all(spark: SparkSession, d: str) -> DataFrame:
    """Facts whose text contains the name of any entity of the table, counted per entity."""
    facts = table(spark, d, "facts")
    names = facts.select(F.explode("entities").alias("name")).select(F.lower("name").alias("name"))
    texts = facts.where("id is not null").select("id", F.lower("content").alias("text")).distinct()
    hits = lexical.containing(texts.select(F.struct("id", F.md5("text").alias("version")).alias("doc"), "text"), names)
    return hits.groupBy(F.col("name").alias("entity")).agg(F.countDistinct("doc.id").alias("facts"))


def forget_marker_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Facts that stay after the values of all erased or retracted facts' subjects are forgotten by hash."""
    facts = table(spark, d, "facts")
    gone = erasure.markers(facts.where("state = 'retracted' and length(value) > 3"), F.col("value"))
    kept = erasure.without_marked(facts.select("id", "content").distinct(), "id", F.col("content"), gone)
    return kept.select("id", F.md5("content").alias("content_md5")).distinct()


def redact_spans(spark: SparkSession, d: str) -> DataFrame:
    """Message versions of redacted messages with their user id masked wherever the text names it."""
    m = table(spark, d, "messages").where("name is not null and content is not null")
    return m.select("id", F.md5(erasure.redact_value(F.col("content"), F.col("name"))).alias("masked_md5")).distinct()


def _two_hops(spark: SparkSession, d: str, every: int) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("entity"))
    seeds = li.where(F.col("doc") % every == 0).select(F.col("doc").alias("query"), "entity")
    hits = graph.expand_hops(seeds, li, 2)
    return hits.groupBy("query", "depth").agg(F.count("*").alias("docs"), F.round(F.sum("score"), 6).alias("score"))


def two_hop_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Orders reached over shared parts from every asking order: parts in one hop, their orders in the next."""
    return _two_hops(spark, d, ASK)


def two_hop_expansion_all(spark: SparkSession, d: str) -> DataFrame:
    """The same under its older name."""
    return two_hop_expansion(spark, d)


def _ranked(spark: SparkSession, d: str, most: int | None = None) -> DataFrame:
    scores = lexical.search(_postings(spark, d), _terms(spark, d, most), 180)
    docs = _docs(spark, d).select(
        F.col("doc_id").alias("doc"), F.md5(lx.evidence_key(F.lit(""), F.lit(""), F.col("text"))).alias("key"),
        lx.estimate_tokens(F.col("text")).cast("long").alias("cost"), F.coalesce("lang", F.lit("")).alias("item"), F.coalesce("source", F.lit("")).alias("source"),
    )
    return scores.join(docs, "doc").select("query", "doc", F.round("score", 6).alias("score"), "key", "cost", "item", "source")


def budget_pack(spark: SparkSession, d: str) -> DataFrame:
    """Keyword search (64 terms, as its statement has it), dedupe and packing under the token budget."""
    return packing.pack(_ranked(spark, d, lexical.QUERY_TERMS))


def budget_pack_all(spark: SparkSession, d: str) -> DataFrame:
    """Keyword search by all terms, dedupe and packing under the token budget: the offline search path end to end."""
    return packing.pack(_ranked(spark, d))


def coverage_pack(spark: SparkSession, d: str) -> DataFrame:
    """The same, preferring languages and sources that the answer lacks."""
    return packing.pack(_ranked(spark, d), coverage=True)


QUERIES = {
    f.__name__: f
    for f in (
        tokens_postings, index_upsert, bm25_topk, bm25_topk_all, bm25_fts_topk, bm25_sigmoid, bm25_sigmoid_all, knn_cosine_topk, knn_filtered, knn_metric_scores, rrf_fusion,
        additive_fusion, rrf_routes, additive_routes, token_overlap_join, estimate_tokens, evidence_key_dedupe, entity_contains_join, entity_contains_all, forget_marker_antijoin,
        redact_spans, two_hop_expansion, two_hop_expansion_all, budget_pack, budget_pack_all, coverage_pack,
    )
}

_KEY = r"md5('||' || regexp_replace(lower(regexp_replace(regexp_replace(text, '\[(Session time|Source id):[^\]]*\]', '', 'g'), '^\p{L}[\p{L} .''-]{0,40}:\s*', '')), '[^\p{L}\p{N}]', '', 'g'))"
_NEAR = "near AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sims QUALIFY rank <= 20)"

_ROUTES_SQL = (
    BM25_SQL.format(k1=1.2, idf="greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6)", qtf="1")
    + """, lexi AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scores QUALIFY rank <= 180),
 v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
 sims AS (SELECT a.vec_id AS query, b.vec_id AS doc, list_cosine_similarity(a.x, b.x) AS score FROM v a, v b WHERE a.vec_id % 100 = 0),
 near AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sims WHERE score > 0.15 QUALIFY rank <= 150),
 nm AS (SELECT DISTINCT query, lower(unnest(list_filter(list_concat(regexp_extract_all(text, '\\b[A-Z][a-z]+(?: [A-Z][a-z]+)*\\b'), regexp_extract_all(text, '[A-Z]{2,}[-0-9][A-Z0-9-]+')), lambda w: length(w) >= 2 AND w NOT IN (""" + ", ".join(f"'{n}'" for n in NO_NAMES) + """)))) AS name
  FROM (SELECT doc_id AS query, text FROM documents WHERE doc_id % 100 = 0)),
 hit AS (SELECT name, doc_id AS doc FROM (SELECT DISTINCT name FROM nm) JOIN documents ON contains(lower(text), name)), li AS (SELECT name, count(*) AS linked FROM hit GROUP BY 1),
 ent AS (SELECT query, doc, count(*) AS matches, max(0.5 / (1 + 0.001 * (linked - 1) * (linked - 1))) AS boost FROM hit JOIN nm USING (name) JOIN li USING (name) GROUP BY ALL)"""
)

SQL = {
    "tokens_postings": TOKENS_SQL + " SELECT doc, doc_len, term, tf FROM post",
    "index_upsert": TOKENS_SQL + " SELECT doc, doc_len, term, tf FROM post",
    "bm25_topk": BM25_SQL.format(k1=1.5, idf="ln((n - df + 0.5) / (df + 0.5) + 1)", qtf="qtf")
    + " SELECT query, doc, round(score, 6) AS score FROM scores QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) <= 20",
    "bm25_fts_topk": BM25_SQL.format(k1=1.2, idf="greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6)", qtf="1")
    + " SELECT query, doc, round(score, 6) AS score FROM scores QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) <= 20",
    "bm25_sigmoid": BM25_SQL.format(k1=1.5, idf="ln((n - df + 0.5) / (df + 0.5) + 1)", qtf="qtf")
    + """, t AS (SELECT query, count(*) AS terms FROM terms GROUP BY query),
 p AS (SELECT query, round(score, 6) AS s, CASE WHEN terms <= 3 THEN 5.0 WHEN terms <= 6 THEN 7.0 WHEN terms <= 9 THEN 9.0 WHEN terms <= 15 THEN 10.0 ELSE 12.0 END AS m,
  CASE WHEN terms <= 3 THEN 0.7 WHEN terms <= 6 THEN 0.6 ELSE 0.5 END AS k FROM scores JOIN t USING (query))
 SELECT query, CAST(floor(round(1 / (1 + exp(-k * (s - m))), 6) * 10) AS BIGINT) AS tenth, count(*) AS docs FROM p GROUP BY ALL""",
    "knn_cosine_topk": KNN_SQL.format(where="true")
    + " SELECT query, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sims QUALIFY rank <= 10",
    "knn_filtered": KNN_SQL.format(where="b.label IN (1, 3, 5)")
    + " SELECT query, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sims WHERE score > 0.15 QUALIFY rank <= 10",
    "knn_metric_scores": """WITH p AS (SELECT b.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
 q AS (SELECT vec_id, list_cosine_similarity(a, b) AS c, list_distance(a, b) AS l, list_dot_product(a, b) AS dp, list_sum(list_transform(list_zip(a, b), lambda x: abs(x[1] - x[2]))) AS l1 FROM p)
 SELECT vec_id, round(greatest(0.0, least(1.0, 1 - (1 - c))), 6) AS cosine, round(1 / (1 + l), 6) AS l2, round(1 / (1 + l * l), 6) AS l2_squared, round(1 / (1 + l1), 6) AS l1, round(dp, 6) AS dot FROM q""",
    "rrf_fusion": KNN_SQL.format(where="true") + f""", {_NEAR},
 same AS (SELECT a.vec_id AS query, b.vec_id AS doc, row_number() OVER (PARTITION BY a.vec_id ORDER BY abs(b.vec_id - a.vec_id), b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 100 = 0 QUALIFY rank <= 20),
 u AS (SELECT query, doc, 1.0::DOUBLE / (60 + rank) AS s, 'semantic' AS r FROM near UNION ALL SELECT query, doc, 0.5::DOUBLE / (60 + rank), 'entity' FROM same)
 SELECT query, doc, round(sum(s), 8) AS score, string_agg(r, '+' ORDER BY r) AS signals FROM u GROUP BY ALL""",
    "additive_fusion": KNN_SQL.format(where="true") + f""", {_NEAR},
 f AS (SELECT query, bool_or(doc % 2 = 0) AS hk, bool_or(doc % 3 = 0) AS he FROM near GROUP BY query)
 SELECT query, doc, round(least((score + CASE WHEN doc % 2 = 0 THEN 1.0::DOUBLE / (1 + rank) ELSE 0 END + CASE WHEN doc % 3 = 0 THEN 0.25 ELSE 0 END)
  / (1 + CASE WHEN hk THEN 1 ELSE 0 END + CASE WHEN he THEN 0.5 ELSE 0 END), 1.0), 6) AS score FROM near JOIN f USING (query) WHERE score >= 0.1""",
    "rrf_routes": _ROUTES_SQL.replace(FIRST_TERMS, "") + """, u AS (SELECT query, doc, 1.0::DOUBLE / (60 + rank) AS s, 'semantic' AS r FROM near UNION ALL SELECT query, doc, 1.0::DOUBLE / (60 + rank), 'lexical' FROM lexi
  UNION ALL SELECT query, doc, 0.5::DOUBLE / (60 + row_number() OVER (PARTITION BY query ORDER BY matches DESC, doc)), 'entity' FROM ent)
 SELECT query, doc, round(sum(s), 8) AS score, string_agg(r, '+' ORDER BY r) AS signals FROM u GROUP BY ALL""",
    "additive_routes": _ROUTES_SQL + """, z AS (SELECT doc_id AS query, len(string_split_regex(trim(text), '\\s+')) AS n FROM documents WHERE doc_id % 100 = 0),
 k AS (SELECT query, doc, 1 / (1 + exp(-CASE WHEN n <= 3 THEN 0.7 WHEN n <= 6 THEN 0.6 ELSE 0.5 END * (score - CASE WHEN n <= 3 THEN 5.0 WHEN n <= 6 THEN 7.0 WHEN n <= 9 THEN 9.0 WHEN n <= 15 THEN 10.0 ELSE 12.0 END))) AS s FROM lexi JOIN z USING (query))
 SELECT n.query, n.doc, round(least((n.score + coalesce(k.s, 0) + coalesce(e.boost, 0)) / (1 + CASE WHEN n.query IN (SELECT query FROM k) THEN 1 ELSE 0 END + CASE WHEN n.query IN (SELECT query FROM ent) THEN 0.5 ELSE 0 END), 1.0), 6) AS score
 FROM near n LEFT JOIN k ON k.query = n.query AND k.doc = n.doc LEFT JOIN ent e ON e.query = n.query AND e.doc = n.doc WHERE n.score >= 0.1""",
    "token_overlap_join": TOKENS_SQL + """, a AS (SELECT doc AS query, term FROM post WHERE doc % 100 = 0), z AS (SELECT query, count(*) AS size FROM a GROUP BY query),
 s AS (SELECT query, doc, count(*) AS shared FROM a JOIN post USING (term) GROUP BY ALL)
 SELECT query, count(*) AS partners, max(shared) AS most_shared FROM s JOIN z USING (query) WHERE shared * 3 > size AND query <> doc GROUP BY query""",
    "estimate_tokens": r"SELECT doc_id, CAST(ceil(length(text) / 3) AS BIGINT) AS est_tokens FROM documents",
    "evidence_key_dedupe": f"SELECT {_KEY} AS key, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "entity_contains_join": "SELECT lower(e) AS entity, count(DISTINCT id) AS facts FROM (SELECT id, lower(content) AS content, unnest(entities) AS e FROM facts) WHERE e <> '' AND contains(content, lower(e)) GROUP BY 1",
    "forget_marker_antijoin": r"""WITH g AS (SELECT DISTINCT array_to_string(regexp_extract_all(regexp_replace(trim(lower(value)), '[\s_\-]+', ' ', 'g'), '[\p{L}\p{N}]+'), ' ') AS v FROM facts WHERE state = 'retracted' AND length(value) > 3),
 c AS (SELECT DISTINCT id, content, ' ' || array_to_string(regexp_extract_all(regexp_replace(trim(lower(content)), '[\s_\-]+', ' ', 'g'), '[\p{L}\p{N}]+'), ' ') || ' ' AS w FROM facts),
 hit AS (SELECT DISTINCT id FROM c JOIN g ON v <> '' AND contains(w, ' ' || v || ' '))
 SELECT DISTINCT id, md5(content) AS content_md5 FROM c WHERE id NOT IN (SELECT id FROM hit)""",
    "two_hop_expansion": """WITH li AS (SELECT l_orderkey AS doc, l_partkey AS entity FROM lineitem), s AS (SELECT DISTINCT doc AS query, entity FROM li WHERE doc % 100 = 0),
 h0 AS (SELECT DISTINCT query, doc FROM s JOIN li USING (entity)), e1 AS (SELECT DISTINCT query, entity FROM h0 JOIN li USING (doc) EXCEPT SELECT query, entity FROM s),
 h1 AS (SELECT DISTINCT query, doc FROM e1 JOIN li USING (entity)),
 u AS (SELECT query, doc, min(dep) AS depth FROM (SELECT query, doc, 0 AS dep FROM h0 UNION ALL SELECT query, doc, 1 FROM h1) GROUP BY ALL)
 SELECT query, depth, count(*) AS docs, round(sum(0.012::DOUBLE / (depth + 1)), 6) AS score FROM u GROUP BY ALL""",
    "budget_pack": BM25_SQL.format(k1=1.5, idf="ln((n - df + 0.5) / (df + 0.5) + 1)", qtf="qtf").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", r AS (SELECT query, doc, {_KEY} AS key, CAST(ceil(length(text) / 3) AS BIGINT) AS cost, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rn
  FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS k FROM scores QUALIFY k <= 180) JOIN documents ON doc_id = doc),
 walk AS (SELECT query, 0::BIGINT AS rn, NULL::BIGINT AS doc, []::VARCHAR[] AS keys, 0::BIGINT AS spent, 0::BIGINT AS place, 0::BIGINT AS cost, false AS took FROM (SELECT DISTINCT query FROM r)
  UNION ALL SELECT w.query, r.rn, r.doc, CASE WHEN ok THEN list_append(keys, key) ELSE keys END, spent + CASE WHEN ok THEN r.cost ELSE 0 END, place + CASE WHEN ok THEN 1 ELSE 0 END, r.cost, ok
  FROM walk w JOIN r ON r.query = w.query AND r.rn = w.rn + 1, LATERAL (SELECT NOT list_contains(keys, key) AND spent + r.cost <= 6000 AND place < 100 AS ok))
 SELECT query, doc, CAST(place AS INT) AS place, cost, spent FROM walk WHERE took""",
}
