"""What becomes of facts of one slot, how they are shown, and the value-free trail of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import canonical, overlap, tokens


def slot_of(*cols: str) -> list[Column]:
    """Columns s0, s1, ... that name a slot."""
    return [canonical(F.coalesce(F.col(c), F.lit(""))).alias(f"s{i}") for i, c in enumerate(cols)]


def settle(facts: DataFrame, slot: list[str], at: str, value: str) -> DataFrame:
    """Facts of single-valued slots with the ``verdict`` that observation order gives them, and its end.

    The newest observation is ``active``, or ``conflicted`` if different values share its instant;
    older ones are ``superseded`` and end (``ended``) at the next instant, also when they arrived late. Two
    steps: values per (slot, instant) are counted by an aggregate, and only those counts are put in order.
    Facts without an instant or value stay out.
    """
    rows = facts.where(F.col(at).isNotNull() & F.col(value).isNotNull() & (F.col(value) != ""))
    points = rows.groupBy(*slot, at).agg(F.countDistinct(canonical(F.col(value))).alias("values_then"))
    w = Window.partitionBy(*slot).orderBy(at)
    points = points.withColumn("ended", F.lead(at).over(w))
    verdict = F.when(F.col("ended").isNotNull(), "superseded").when(F.col("values_then") > 1, "conflicted").otherwise("active")
    return rows.join(points.withColumn("verdict", verdict), [*slot, at])


def overlaps(facts: DataFrame, slot: list[str], value: str, begins: str, ends: str) -> DataFrame:
    """Verdict of each value of a slot by its validity interval [begins, ends): slot, value, id, verdict, ended.

    Rows with one canonical value are one statement, the earliest (then smallest id) of them. Values whose intervals
    overlap are ``conflicted``; of the others the one that begins last is ``active`` and the rest ``superseded``,
    ended by the next beginning. An end that is missing or not after the beginning means one microsecond. Rows without
    a beginning or value stay out. Overlap with an earlier value is a running maximum of ends and with a later one the
    next beginning, so no pairs are formed; only distinct values of a slot are put in order.
    """
    v = canonical(F.col(value))
    rows = facts.where(F.col(begins).isNotNull() & (F.coalesce(v, F.lit("")) != "")).select(*slot, v.alias("value"), "id", F.col(begins).alias("a"), F.col(ends).alias("z"))
    rows = rows.groupBy(*slot, "value").agg(F.min(F.struct("a", "id", "z")).alias("x")).select(*slot, "value", "x.*")
    rows = rows.withColumn("b", F.when(F.col("z") > F.col("a"), F.col("z")).otherwise(F.col("a") + 1))
    w = Window.partitionBy(*slot).orderBy("a", "id")
    before, after = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lead("a").over(w)
    rows = rows.withColumn("crossed", F.coalesce(before > F.col("a"), F.lit(False)) | F.coalesce(after < F.col("b"), F.lit(False))).withColumn("next", after)
    verdict = F.when(F.col("crossed"), "conflicted").when(F.col("next").isNull(), "active").otherwise("superseded")
    return rows.select(*slot, "value", "id", verdict.alias("verdict"), F.when(verdict == "superseded", F.col("next")).alias("ended"))


def project_events(events: DataFrame, facts: DataFrame, visible: DataFrame) -> DataFrame:
    """Events as text: id, type and ``shown`` (before, then after), with only what may be seen.

    ``events``: (id, type, before array, after array) of fact ids; ``facts``: (fact, content, modality, state); ``visible``: (fact).
    A fact that is missing, invisible, erased or retracted shows as unavailable, no facts as none. Ids are joined one per row
    and put back in their order; an event names a handful.
    """
    side = lambda c, n: events.select("id", "type", F.lit(n).alias("side"), F.posexplode(c).alias("pos", "fact"))
    named = side("before", 0).unionByName(side("after", 1))
    ok = facts.where("state not in ('erased', 'retracted')").join(visible.select("fact").distinct(), "fact", "left_semi")
    ok = ok.select("fact", F.concat("content", F.lit(" ("), "modality", F.lit("; "), "state", F.lit(")")).alias("text"))
    rows = named.join(ok, "fact", "left").withColumn("text", F.coalesce("text", F.lit("[unavailable]")))
    per = rows.groupBy("id").agg(*[
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == n, F.struct("pos", "text")))), lambda x: x["text"]), " | ").alias(c)
        for n, c in enumerate(("b", "a"))
    ])
    none = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("[none]"))
    shown = F.concat_ws(" ", "type", F.lit("before:"), none("b"), F.lit("after:"), none("a"))
    return events.join(per, "id", "left").select("id", "type", shown.alias("shown"))


def render(f: DataFrame) -> DataFrame:
    """Adds ``shown``: the text of a fact with its date, state and, for old values, what replaced them.

    Needs content, subject, predicate, value, state, modality, observed_at, valid_to, time_basis,
    source_ids and ``successor`` (the slot's present value, null if none).
    """
    n = F.size(F.array_distinct("source_ids"))
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    old = F.concat(
        F.lit("Former "), F.coalesce("predicate", F.lit("")), F.when(has("value"), F.concat(F.lit(': "'), "value", F.lit('"'))).otherwise(""),
        F.lit(" ("), F.when(F.col("state") == "retracted", "removed at user request").otherwise("superseded"),
        F.when(has("valid_to") & (F.col("time_basis") != "ordering"), F.concat(F.lit(" on "), F.substring("valid_to", 1, 10))).otherwise(""),
        F.when(F.col("successor").isNotNull(), F.concat(F.lit("; current "), "predicate", F.lit(': "'), "successor", F.lit('"'))).otherwise(""),
        F.lit("). Original statement: "), F.coalesce("content", F.lit("")),
    )
    torn = F.concat(
        F.lit("[Conflicting statements recorded; no single current value] "), F.coalesce("content", F.lit("")),
        F.when(n >= 2, F.concat(F.lit(" (this value is corroborated by "), n.cast("string"), F.lit(" independent statements)"))).otherwise(""),
    )
    body = F.when(F.col("state").isin("superseded", "retracted"), old).when(F.col("state") == "conflicted", torn).otherwise(F.coalesce("content", F.lit("")))
    lead = F.when(F.col("observed_at").isNull() | (F.col("time_basis") == "ordering"), "[time: session order only] ").otherwise(
        F.concat(F.lit("["), F.substring("observed_at", 1, 10), F.lit(" | "), F.coalesce("subject", F.lit("")), F.lit("] "))
    )
    return f.withColumn("shown", F.concat(lead, body))


def with_successor(facts: DataFrame, slot: list[str]) -> DataFrame:
    """Adds ``successor``: the value of the slot's active confirmed (else tentative) fact, the smallest id of several."""
    live = F.when((F.col("state") == "active") & F.col("modality").isin("confirmed", "tentative"), F.struct((F.col("modality") == "tentative").alias("t"), "id", "value"))
    best = facts.groupBy(*slot).agg(F.min(live).alias("b")).where("b is not null").select(*slot, F.col("b.value").alias("successor"))
    return facts.join(best, slot, "left")


def event_trail(changes: DataFrame) -> DataFrame:
    """Value-free audit events of a change feed (entity, ts, n, op): id, kind, slot_hash and n (their order)."""
    kind = F.when(F.col("op") == "A", "remember").when(F.col("op") == "U", "update").otherwise("forget")
    return changes.select(F.concat(F.lit("event-"), F.sha2(F.concat_ws(chr(0), "entity", F.col("n").cast("string")), 256)).alias("id"), kind.alias("kind"), F.sha2("entity", 256).alias("slot_hash"), "n")


def ambiguous(rows: DataFrame, key: list[str], what: list[str]) -> DataFrame:
    """Keys under which a column of ``what`` has several values: an operation on the key would be ambiguous."""
    out = rows.groupBy(*key).agg(*[F.countDistinct(c).alias(f"{c}s") for c in what])
    return out.where(" or ".join(f"{c}s > 1" for c in what))


def match_level(candidate: Column, value: Column, content: Column) -> Column:
    """How an answer option meets a fact: 1 equal or verbatim (four characters at least), 4 an option of over three
    words that shares four fifths of its tokens with the text, else 0."""
    c = canonical(candidate)
    hit = (c != "") & ((canonical(value) == c) | ((F.length(c) >= 4) & F.contains(canonical(content), c)))
    close = (F.size(F.split(F.trim(candidate), r"\s+")) > 3) & (overlap(tokens(candidate), tokens(content)) >= 0.8)
    no = F.lit(False)
    return F.when(F.coalesce(hit, no), 1).when(F.coalesce(close, no), 4).otherwise(0)


def options(question: Column) -> Column:
    """Answer options that a question enumerates: the parts between commas, semicolons and "or" after the last colon or
    "between", 2 to 14 words short, at most six; none if there are fewer than two."""
    tail = F.regexp_extract(question, r"(?:(?i:\bbetween\b|\bprefer\b|\bchoose\b)|:)\s*([^:]*)$", 1)
    parts = F.transform(F.split(tail, r"(?i),|;|\bor\b|\band\b"), lambda p: F.trim(F.regexp_replace(p, r"[?.!\s]+$", "")))
    parts = F.slice(F.filter(F.array_distinct(parts), lambda p: (F.length(p) >= 2) & (F.size(F.split(p, r"\s+")) <= 14)), 1, 6)
    return F.when(F.size(parts) >= 2, parts).otherwise(F.array().cast("array<string>"))
