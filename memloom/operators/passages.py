"""Passages of messages: their places, the facts drawn from them, visibility, and cutting spans out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_visible
from .extraction import pieces

#: What stands where a stretch was cut out of a passage.
GAP = " […] "


def occurrences(text: Column, quote: Column) -> Column:
    """Start positions (from 0) of all occurrences of a quote in a text that do not overlap; none of a null or empty quote."""
    parts = F.split(text, F.concat(F.lit("\\Q"), F.replace(quote, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    step = lambda at, i: at + F.length(F.get(parts, i)) + F.when(i > 0, F.length(quote)).otherwise(0)
    starts = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 2),
        lambda k: F.aggregate(F.sequence(F.lit(0), k), F.lit(0), lambda at, i: step(at, i).cast("int")),
    )
    some = (F.length(quote) > 0) & F.contains(text, quote)
    return F.when(F.coalesce(some, F.lit(False)), starts).otherwise(F.array().cast("array<int>"))


def source_spans(facts: DataFrame, messages: DataFrame) -> DataFrame:
    """(fact, source, start, stop): where the quotes of each fact stand in the messages it names.

    ``facts``: (fact, source, quote), ``messages``: (source, text). A quote that does not occur has no span.
    """
    both = facts.where("quote <> ''").join(messages.select("source", "text"), "source")
    spans = both.select("fact", "source", "quote", F.explode(occurrences(F.col("text"), F.col("quote"))).alias("start"))
    return spans.select("fact", "source", "start", (F.col("start") + F.length("quote")).alias("stop")).distinct()


def passages(messages: DataFrame) -> DataFrame:
    """(source, start, stop) of the sentence passages of messages (source, text) that have a character to show."""
    rows = pieces(messages, "source", "text").where(is_visible(F.col("piece")))
    return rows.select(F.col("id").alias("source"), "start", (F.col("start") + F.length("piece")).alias("stop"))


def linked(parts: DataFrame, spans: DataFrame) -> DataFrame:
    """(source, start, stop, fact) of the facts whose spans overlap a passage: an equi-join on the message with a range test."""
    s = spans.select("source", "fact", F.col("start").alias("a"), F.col("stop").alias("b"))
    return parts.join(s, "source").where("a < stop and b > start").select("source", "start", "stop", "fact").distinct()


def visibility(parts: DataFrame, spans: DataFrame, visible: DataFrame) -> DataFrame:
    """Passages with ``facts`` (linked to them), ``hidden`` (of those not among ``visible`` (fact)) and ``shown`` if none is.

    A passage without facts is shown.
    """
    links = linked(parts, spans).join(visible.select("fact", F.lit(1).alias("ok")).distinct(), "fact", "left")
    per = links.groupBy("source", "start", "stop").agg(F.count("*").alias("facts"), F.count(F.when(F.col("ok").isNull(), 1)).alias("hidden"))
    out = parts.join(per, ["source", "start", "stop"], "left").na.fill(0, ["facts", "hidden"])
    return out.withColumn("shown", F.col("hidden") == 0)


def cut(start: Column, stop: Column, holes: Column) -> Column:
    """What is left of [start, stop) without the holes (array of struct start, stop, any order): fragments in order."""
    piece = lambda a, b: F.array(F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop")))
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def step(acc: Column, hole: Column) -> Column:
        at, end = acc["at"], F.least(hole["start"], stop)
        kept = F.when(end > at, F.concat(acc["kept"], piece(at, end))).otherwise(acc["kept"])
        return F.struct(F.greatest(at, hole["stop"]).cast("int").alias("at"), kept.alias("kept"))

    first = F.struct(start.cast("int").alias("at"), none.alias("kept"))
    return F.aggregate(
        F.array_sort(holes), first, step, lambda acc: F.when(acc["at"] < stop, F.concat(acc["kept"], piece(acc["at"], stop))).otherwise(acc["kept"])
    )


def redacted(parts: DataFrame, holes: DataFrame, messages: DataFrame) -> DataFrame:
    """Passages that a hole (source, start, stop) touches, as they read without it: source, start, stop, fragments, text, state.

    Fragments without a letter or digit go; a passage with none left is ``erased``. Holes of a passage are bounded by
    the distinct stretches of its message.
    """
    h = holes.select("source", F.col("start").alias("a"), F.col("stop").alias("b")).distinct()
    hit = parts.join(h, "source").where("a < stop and b > start")
    hit = hit.groupBy("source", "start", "stop").agg(F.collect_list(F.struct(F.col("a").alias("start"), F.col("b").alias("stop"))).alias("holes"))
    hit = hit.join(messages.select("source", F.col("text").alias("whole")), "source")
    kept = F.transform(cut(F.col("start"), F.col("stop"), F.col("holes")), lambda p: F.substring(F.col("whole"), p["start"] + 1, p["stop"] - p["start"]))
    out = hit.withColumn("kept", F.filter(kept, lambda t: t.rlike(r"[\p{L}\p{N}]")))
    return out.select(
        "source", "start", "stop", F.size("kept").alias("fragments"), F.array_join("kept", GAP).alias("text"),
        F.when(F.size("kept") == 0, "erased").otherwise("active").alias("state"),
    )
