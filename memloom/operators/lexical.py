"""Keyword search: postings and two BM25 flavours for batches of queries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.lexicon import HAN, SIGMOID, STOP_WORDS, han_tokens, split_words, stem, tokens
from ..sources.tables import materialize, ship
from . import blocks

#: Distinct terms of a query that the full-text index takes, in order of their first place.
QUERY_TERMS = 64
#: Leading characters by which names meet texts, most names that every task holds at once.
GRAM, HELD = 4, 20_000


def postings(docs: DataFrame, id_col: str, text: Column, keep: bool = True) -> DataFrame:
    """(doc, doc_len, term, tf) of every document with tokens, written once as an index (``keep``).

    Same tokens as ``functions.lexicon.tokens``, but with the words as rows, so that stop words and stems
    run in generated code. Texts are shuffled once, by document; the words, which are many more bytes, stay where
    their text is. Null ids and texts have no postings.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), text.alias("text")).repartition("doc")
    words = rows.select("doc", F.explode(split_words(F.col("text"))).alias("w")).where(~F.col("w").isin(STOP_WORDS))
    words = words.select("doc", "w", stem(F.col("w")).alias("s"))
    both = F.when(F.col("w").endswith("ing") & (F.col("s") != F.col("w")), F.array("s", "w")).otherwise(F.array("s"))
    terms = words.select("doc", F.explode(both).alias("term")).where("term <> ''")
    terms = terms.unionByName(rows.where(F.col("text").rlike(HAN)).select("doc", F.explode(han_tokens(F.col("text"))).alias("term")))
    counts = terms.groupBy("doc", "term").agg(F.count("*").alias("tf"))
    post = counts.select("doc", F.sum("tf").over(Window.partitionBy("doc")).cast("int").alias("doc_len"), "term", "tf")
    return materialize(post) if keep else post


def upsert_postings(index: DataFrame, docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """The index with the given documents added or replaced; those with a null or empty text leave it."""
    old = index.join(docs.select(F.col(id_col).alias("doc")).where("doc is not null").distinct(), "doc", "left_anti")
    return old.unionByName(postings(docs, id_col, text, keep=False))


def query_terms(queries: DataFrame, id_col: str, text: Column, most: int | None = None) -> DataFrame:
    """(query, term, qtf) of all terms of each query, or of the first ``most`` distinct ones, with their repeats."""
    rows = queries.select(F.col(id_col).alias("query"), tokens(text).alias("t"))
    if most is None:
        return rows.select("query", F.explode("t").alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))
    rows = rows.select("query", "t", F.slice(F.array_distinct("t"), 1, most).alias("keep"))
    rows = rows.select("query", F.explode(F.filter("t", lambda x: F.array_contains(F.col("keep"), x))).alias("term"))
    return rows.groupBy("query", "term").agg(F.count("*").alias("qtf"))


def containing(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc, name) of every text that contains a name anywhere, also inside a word; both sides come in one case.

    ``docs``: (doc, text). ``names``: (name). Texts that have the first ``GRAM`` characters of a name (of a short one
    all) are candidates, which are checked in full. Up to ``HELD`` names go to the texts, which then stay where they are; of
    more names only the different beginnings, few as letters are, are broadcast.
    """
    heads = names.where("name <> ''").select("name").distinct().withColumn("gram", F.substring("name", 1, GRAM))
    docs = docs.where("doc is not null and text is not null")
    held = [r.name for r in heads.select("name").limit(HELD + 1).collect()]
    if len(held) <= HELD:
        ship(docs.sparkSession)
        kind = StructType([docs.schema["doc"], StructField("name", StringType())])
        return docs.select("doc", "text").mapInArrow(_finder(held), kind).distinct()
    runs = [F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(1, GRAM + 1)]
    rows = docs.select("doc", F.explode(F.array_distinct(F.concat(*runs))).alias("gram"))
    rows = rows.join(F.broadcast(heads.select("gram").distinct()), "gram", "left_semi")
    pairs = rows.join(heads.hint("shuffle_hash"), "gram").select("doc", "name")
    return pairs.join(docs, "doc").where(F.contains("text", "name")).select("doc", "name").distinct()


def _finder(names: list[str]):
    """Rows (doc, name) of batches (doc, text) for the names that a text contains."""
    short = [n for n in names if len(n) < GRAM]
    grams: dict[str, list[str]] = {}
    for n in names:
        if len(n) >= GRAM:
            grams.setdefault(n[:GRAM], []).append(n)

    def run(batches):
        for b in batches:
            at, found = [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                hits = [n for n in short if n in t]
                for g in grams.keys() & {t[j : j + GRAM] for j in range(len(t) - GRAM + 1)}:
                    hits += [n for n in grams[g] if n in t]
                at += [i] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(at, pa.int32())), pa.array(found, pa.string())], names=["doc", "name"])

    return run


def bm25(post: DataFrame, terms: DataFrame, k1: float = 1.5, b: float = 0.75, floor: float | None = None, repeats: bool = True) -> DataFrame:
    """Scores (query, doc, score) of all documents that share a term with a query: a row for nearly every pair, so for few queries only.

    With ``floor`` the plain idf is used and cut from below (the full-text index flavour); without it
    one is added inside the logarithm (the in-memory flavour). ``repeats`` counts repeated query terms.
    Scores are rounded to nine places, so that equal texts tie whatever the order of summation.
    The document frequency of a term is joined to the query side, which is small, so the postings are
    shuffled once, for the term join; a term that a third of all documents contain is split by AQE.
    """
    stats = post.select("doc", "doc_len").distinct().agg(F.count("*").alias("n"), F.avg("doc_len").alias("avg_len"))
    weight = _weight(floor, repeats)
    wanted = terms.join(_frequencies(post), "term").crossJoin(F.broadcast(stats))  # stats is a single row
    wanted = wanted.select("query", "term", weight.alias("w"), "avg_len")
    norm = F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_len"))
    part = F.col("w") * F.col("tf") * (k1 + 1) / norm
    return post.join(wanted, "term").groupBy("query", "doc").agg(F.round(F.sum(part), 9).alias("score"))


def _frequencies(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def _weight(floor: float | None, repeats: bool) -> Column:
    odds = (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    idf = F.log(odds + 1) if floor is None else F.greatest(F.log(odds), F.lit(floor))
    return idf * (F.col("qtf") if repeats else F.lit(1))


def _meet(post: DataFrame, terms: DataFrame, use, k1: float, b: float, floor: float | None, repeats: bool) -> DataFrame:
    """What ``use`` finds in the blocks of documents and queries under BM25 (``blocks.meet``)."""
    terms = materialize(terms)
    n, avg = post.select("doc", "doc_len").distinct().agg(F.count("*"), F.avg("doc_len")).first()
    asked = terms.groupBy("query").agg(F.count("*").alias("size"))
    m = asked.count()
    wanted = terms.join(_frequencies(post), "term").withColumn("n", F.lit(n)).withColumn("w", _weight(floor, repeats)).join(asked, "query")
    factor = lambda tf, size: tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / avg))
    docs = post.select(F.col("doc").alias("id"), F.col("doc_len").alias("size"), "term", F.col("tf").alias("value"))
    return blocks.meet(docs, wanted.select(F.col("query").alias("id"), "size", "term", F.col("w").alias("value")), n, m, use, factor)


def search(post: DataFrame, terms: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, floor: float | None = None, repeats: bool = True) -> DataFrame:
    """The k best of ``bm25`` per query with ``rank``, ties by document; ids are whole numbers.

    Pairs are scored in blocks of documents and queries that keep only their best, so no table of all pairs arises.
    """
    return top_k(_meet(post, terms, blocks.best(k), k1, b, floor, repeats).select("query", "doc", "score"), k)


def matches_by_tenth(post: DataFrame, terms: DataFrame, tenth, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, tenth, docs): all matches of ``bm25``, counted by tenth of their score on a scale of 0 to 1.

    ``tenth`` says it as a column from (score, terms); blocks count by the same scale and return the pairs near a border.
    """
    found = _meet(post, terms, blocks.tenths(SIGMOID), k1, b, None, True)
    n = terms.groupBy("query").agg(F.count("*").alias("terms"))
    tenth = F.when(F.col("score").isNull(), F.col("tenth")).otherwise(tenth(F.round("score", 9), F.col("terms")))
    return found.join(n, "query").groupBy("query", tenth.alias("tenth")).agg(F.sum("n").alias("docs"))


def sharing(post: DataFrame, asks: DataFrame) -> DataFrame:
    """(query, partners, most_shared): documents with over a third of a query's terms. ``asks``: (query, term); ids are whole numbers."""
    sized = asks.join(asks.groupBy("query").agg(F.count("*").alias("size")), "query")
    row = post.agg(F.countDistinct("doc")).crossJoin(asks.agg(F.countDistinct("query"))).first()
    one = F.lit(1).alias("value")
    docs = post.select(F.col("doc").alias("id"), F.lit(0).alias("size"), "term", one)
    found = blocks.meet(docs, sized.select(F.col("query").alias("id"), "size", "term", one), row[0], row[1], blocks.partners, merge=False)
    return found.groupBy("query").agg(F.sum("n").alias("partners"), F.max("tenth").alias("most_shared"))


def bm25_by_tenant(post: DataFrame, terms: DataFrame, k1: float = 1.2, b: float = 0.75, floor: float = 1e-6) -> DataFrame:
    """Scores (query, doc, score) where every tenant has a corpus of its own (full-text index flavour).

    ``post``: postings with ``tenant``; ``terms``: (query, tenant, term). Number and length of documents count per tenant and
    frequencies per (tenant, term), so a big tenant spreads over its terms; only terms that are asked for are counted.
    """
    asked = terms.select("tenant", "term").distinct()
    stats = post.join(terms.select("tenant").distinct(), "tenant", "left_semi").select("tenant", "doc", "doc_len").distinct()
    stats = stats.groupBy("tenant").agg(F.count("*").alias("n"), F.avg("doc_len").alias("avg_len"))
    hits = post.join(asked, ["tenant", "term"], "left_semi")
    df = hits.groupBy("tenant", "term").agg(F.count("*").alias("df")).join(stats, "tenant")
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(floor))
    wanted = terms.select("query", "tenant", "term").distinct().join(df, ["tenant", "term"]).select("query", "tenant", "term", idf.alias("w"), "avg_len")
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_len")))
    return hits.join(wanted, ["tenant", "term"]).groupBy("query", "doc").agg(F.round(F.sum(part), 9).alias("score"))


def top_k(scores: DataFrame, k: int, by: str = "query", score: str = "score", tie: str = "doc") -> DataFrame:
    """The k best per group with ``rank``, ties by id (pruned before the shuffle by the group limit)."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
