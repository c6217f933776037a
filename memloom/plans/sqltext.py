"""DuckDB text shared by the retrieval statements."""

from __future__ import annotations

# The search tokens' stop words and suffix rules (suffix, least length, letters to cut, replacement), stated
# here on their own so that the statements do not depend on what they check.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by "
    "can cannot could did do does doing down during each few for from further get got had has have having he her here hers "
    "herself him himself his how i if in into is it its itself just me might more most must my myself no nor not of off on "
    "once only or other ought our ours ourselves out over own same shall she should so some such than that the their theirs "
    "them themselves then there these they this those through to too under until up very was we were what when where which "
    "while who whom why will with would you your yours yourself yourselves"
).split()
SUFFIXES = (
    ("ies", 5, 3, "i"), ("sses", 4, 2, ""), ("ness", 4, 4, ""), ("ment", 6, 4, ""), ("ation", 7, 5, "e"), ("ting", 6, 3, ""),
    ("ing", 6, 3, ""), ("ed", 5, 2, ""), ("ly", 5, 2, ""), ("er", 5, 2, ""), ("est", 5, 3, ""),
)


def stem_sql(w: str) -> str:
    """The stemming rules as SQL."""
    whens = [f"WHEN length({w}) <= 3 THEN {w}"]
    whens += [f"WHEN {w} LIKE '%{s}' AND length({w}) >= {n} THEN {w}[:length({w}) - {k}] || '{add}'" for s, n, k, add in SUFFIXES]
    whens.append(f"WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN {w}[:length({w}) - 1]")
    return "CASE " + " ".join(whens) + f" ELSE {w} END"


def tokens_sql(text: str) -> str:
    """List of tokens of a text without Han characters."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    ws = f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: w NOT IN ({stops}))"
    stem = stem_sql("w")
    return f"list_filter(flatten(list_transform({ws}, lambda w: CASE WHEN w LIKE '%ing' AND ({stem}) <> w THEN [{stem}, w] ELSE [{stem}] END)), lambda w: w <> '')"


TOKENS_SQL = f"""WITH tok AS (SELECT doc_id AS doc, {tokens_sql("text")} AS t FROM documents WHERE text IS NOT NULL),
 post AS (SELECT doc, CAST(len(t) AS INT) AS doc_len, term, count(*) AS tf FROM (SELECT doc, t, unnest(t) AS term FROM tok) GROUP BY ALL)"""

#: The cut of a query to its first terms, for statements that take all to leave out.
FIRST_TERMS = " QUALIFY row_number() OVER (PARTITION BY query ORDER BY first) <= 64"

BM25_SQL = (
    TOKENS_SQL.replace("{", "{{").replace("}", "}}")
    + """, stats AS (SELECT count(*) AS n, avg(doc_len) AS avg_len FROM (SELECT DISTINCT doc, doc_len FROM post)),
 dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
 firsts AS (SELECT doc AS query, term, min(pos) AS first, count(*) AS qtf FROM (SELECT doc, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM tok WHERE doc % 100 = 0) GROUP BY ALL),
 terms AS (SELECT query, term, qtf FROM firsts"""
    + FIRST_TERMS
    + """),
 scores AS (SELECT query, doc, round(sum({qtf} * {idf} * tf * ({k1} + 1) / (tf + {k1} * (1 - 0.75 + 0.75 * doc_len / avg_len))), 9) AS score
  FROM post JOIN terms USING (term) JOIN dfs USING (term), stats GROUP BY ALL)"""
)

KNN_SQL = """WITH sims AS (SELECT a.vec_id AS query, b.vec_id AS doc, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND {where})"""
