"""Forgetting: markers that hold only hashes, what they match, and redaction of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import ngram_digests, value_digest, value_words


def markers(values: DataFrame, value: Column) -> DataFrame:
    """(value_hash, words) of the values to forget; no plain text is kept. Blank values make no marker."""
    m = values.select(value_digest(value).alias("value_hash"), F.size(value_words(value)).alias("words"))
    return m.where("words > 0").distinct()


def containing(docs: DataFrame, id_col: str, text: Column, marks: DataFrame) -> DataFrame:
    """(id, value_hash): documents that contain a marked value as a run of words.

    The n-grams of each length that occurs among the markers are hashed and equi-joined with them; the
    lengths (a handful) are the only thing broadcast.
    """
    lengths = marks.select("words").distinct()
    grams = docs.select(F.col(id_col).alias("id"), value_words(text).alias("w")).crossJoin(F.broadcast(lengths))
    grams = grams.select("id", "words", F.explode(F.array_distinct(ngram_digests(F.col("w"), F.col("words")))).alias("value_hash"))
    return grams.join(marks, ["value_hash", "words"]).select("id", "value_hash").distinct()


def without_marked(docs: DataFrame, id_col: str, text: Column, marks: DataFrame) -> DataFrame:
    """Documents that contain no marked value."""
    hit = containing(docs, id_col, text, marks).select(F.col("id").alias(id_col)).distinct()
    return docs.join(hit, id_col, "left_anti")


def redact_value(text: Column, value: Column, mask: str = "[redacted]") -> Column:
    """The text with every whole-word occurrence of a literal value masked, in any case."""
    literal = F.regexp_replace(value, r"([\\.\[\]{}()*+\-?^$|])", r"\\$1")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])"), literal, F.lit(r"(?![\p{L}\p{N}])"))
    return F.when(F.length(F.trim(value)) > 0, F.regexp_replace(text, pattern, F.lit(mask))).otherwise(text)


def boundary_key(subject: Column, predicate: Column, scope: Column, boundary: Column) -> Column:
    """Hash that identifies what a marker covers."""
    return F.sha2(F.to_json(F.array(subject, predicate, scope, boundary)), 256)


def blocked(facts: DataFrame, marks: DataFrame) -> DataFrame:
    """(id, markers): facts that a marker of their tenant forbids, and how many do: the replay protection of a deletion.

    ``facts``: (id, tenant, slot, value, content, arrived). ``marks``: (tenant, slot, value_hash, words, made, lifted), ``lifted``
    being the instant from which the value may be stored again (null: never). A marker forbids what arrived after
    it was made and before it was lifted, if the fact has its slot and value or its text contains the value as a run
    of words. The words of a text are hashed per length that its tenant's markers have, and equi-joined with them.
    """
    live = marks.where("tenant is not null and words > 0").withColumn("mark", F.struct("slot", "value_hash", "made"))
    rows = facts.where("tenant is not null")
    same = rows.select("id", "tenant", "slot", "arrived", value_digest(F.col("value")).alias("value_hash")).join(live, ["tenant", "slot", "value_hash"])
    lengths = live.select("tenant", "words").distinct()
    grams = rows.select("id", "tenant", "arrived", value_words(F.col("content")).alias("w")).join(lengths, "tenant")
    grams = grams.select("id", "tenant", "arrived", "words", F.explode(F.array_distinct(ngram_digests(F.col("w"), F.col("words")))).alias("value_hash"))
    inside = grams.join(live, ["tenant", "words", "value_hash"])
    cols = ["id", "mark", "arrived", "made", "lifted"]
    hits = same.select(*cols).unionByName(inside.select(*cols)).where("arrived > made and (lifted is null or arrived < lifted)")
    return hits.select("id", "mark").distinct().groupBy("id").agg(F.count("*").alias("markers"))


def mentioning(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc, phrase) of texts that have all words of a phrase, in any order, within one tenant.

    ``docs``: (doc, tenant, text), ``phrases``: (phrase, tenant, words array). Words are counted after an equi-join on
    (tenant, word); phrases enter by their rarest word first, so common words do not multiply pairs.
    """
    words = docs.where("tenant is not null").select("doc", "tenant", F.explode(F.array_distinct(value_words(F.col("text")))).alias("word"))
    wanted = phrases.where("tenant is not null").select("phrase", "tenant", F.array_distinct("words").alias("words")).where("size(words) > 0")
    each = wanted.select("phrase", "tenant", F.size("words").alias("size"), F.explode("words").alias("word"))
    counts = words.groupBy("tenant", "word").agg(F.count("*").alias("n"))
    rare = each.join(counts, ["tenant", "word"], "left").groupBy("phrase", "tenant", "size").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    first = rare.join(words, ["tenant", "word"]).select("phrase", "tenant", "size", "doc")
    every = first.join(each.select("phrase", "tenant", "word"), ["phrase", "tenant"]).join(words, ["tenant", "doc", "word"])
    return every.groupBy("doc", "phrase", "size").agg(F.count("*").alias("met")).where("met = size").select("doc", "phrase")
