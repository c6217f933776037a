"""References to records that do not exist, found with sparse bitmaps over dictionary-encoded keys.

Keys are numbered per *key range*: the keys of one target table whose first row arrived in the same
period (and the same hash slice of it) share a range and get dense positions in the order of their
arrival. So "arrived before an instant" is a comparison of positions: per range and instant one number
tells how many keys were there, and the parents as of that instant are the parent bitmap below it. A
bitmap is stored as its nonzero 64-bit words, one row each: empty stretches cost nothing, words merge with
``bit_or`` before the shuffle, and AND-NOT is an equi-join on (range, word).

A reference bitmap of period p against the parents of a range of period q:

* p > q: the references AND-NOT the parents; what survives is absent or removed.
* p < q or never arrived: all of it survives, its targets come later or not at all.
* p = q: the references AND-NOT the parents as of the second of the first reference; what survives is
  absent, removed or came later (or within that second, which the records' instants settle).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import instant, key
from ..sources.tables import materialize

#: Keys per slice of a period that the numbering window aims at.
SLICE = 50_000
DAY = 86_400_000_000
SECOND = 1_000_000
#: Period of references without an instant of arrival; their bits stay for the exact check.
UNDATED = -1
#: A group of references is hot above this part (one in HOT) of all; it is split SALTS ways.
HOT, SALTS = 1000, 32


def latest(df: DataFrame, id_col: str, *cols: Column) -> DataFrame:
    """Per key the row that arrived last (``cols`` break ties) with the first arrival as ``seen``."""
    rows = df.select(key(F.col(id_col)).alias("key"), instant(F.col("ingested_at")).alias("at"), *cols).where("key is not null")
    names = [c for c in rows.columns if c not in ("key", "at")]
    newest = F.max(F.struct("at", *names)).alias("x")
    return rows.groupBy("key").agg(F.min("at").alias("seen"), newest).select("key", "seen", *[F.col(f"x.{n}").alias(n) for n in names])


def message_targets(messages: DataFrame) -> DataFrame:
    """Messages by id; removed if the latest version is redacted."""
    t = latest(messages, "id", F.coalesce("redacted", F.lit(False)).alias("gone"))
    return t.select(F.lit("messages").alias("target"), "key", "seen", "gone", F.lit(None).cast("long").alias("purged"))


def fact_targets(facts: DataFrame) -> DataFrame:
    """Facts by id; removed if the latest version is erased."""
    t = latest(facts, "id", F.coalesce(F.lower(F.trim("state")) == "erased", F.lit(False)).alias("gone"))
    return t.select(F.lit("facts").alias("target"), "key", "seen", "gone", F.lit(None).cast("long").alias("purged"))


def memory_targets(memories: DataFrame) -> DataFrame:
    """Memories by id; removed from the instant of the earliest purge on."""
    rows = memories.select(key(F.col("id")).alias("key"), instant(F.col("ingested_at")).alias("at"), instant(F.col("purged_at")).alias("p"))
    t = rows.where("key is not null").groupBy("key").agg(F.min("at").alias("seen"), F.min("p").alias("purged"))
    return t.select(F.lit("memories").alias("target"), "key", "seen", F.lit(False).alias("gone"), "purged")


def fact_references(facts: DataFrame, column: str, target: str) -> DataFrame:
    """One row per fact and key in an array column; the fact counts from its first row on."""
    rows = facts.select(
        key(F.col("id")).alias("record_id"), instant(F.col("ingested_at")).alias("at"), F.explode(column).alias("ref")
    ).select("record_id", "at", key(F.col("ref")).alias("key"))
    rows = rows.where("record_id is not null and key is not null")
    rows = rows.groupBy("record_id", "key").agg(F.min("at").alias("at"))
    return rows.select(F.lit(f"fact.{column}").alias("ref_field"), F.lit(target).alias("target"), "record_id", "key", "at")


def history_references(history: DataFrame) -> DataFrame:
    """One row per change and the memory it names; a change has one row, its id is unique."""
    rows = history.select(
        F.lit("memory_history.memory_id").alias("ref_field"), F.lit("memories").alias("target"),
        F.col("id").cast("string").alias("record_id"), key(F.col("memory_id")).alias("key"), instant(F.col("ingested_at")).alias("at"),
    )
    return rows.where("record_id is not null and key is not null")


def number_keys(targets: DataFrame, wanted: DataFrame) -> DataFrame:
    """The key dictionary: every target or referenced key with its range and position.

    ``wanted`` is (target, key, period, ...). Columns out: target, key, seen, gone, purged, born (period of
    first arrival, null if none), slice, pos. The window numbers keys inside one (target, born,
    slice); slices are as many as keep a group near ``SLICE`` keys whatever the size of the data. Positions follow the
    arrival of the keys.
    """
    ghosts = wanted.select("target", "key").distinct().select(
        "target", "key", F.lit(None).cast("long").alias("seen"), F.lit(None).cast("boolean").alias("gone"), F.lit(None).cast("long").alias("purged")
    )
    all_keys = targets.unionByName(ghosts).groupBy("target", "key").agg(
        F.min("seen").alias("seen"), F.max("gone").alias("gone"), F.min("purged").alias("purged")
    )
    all_keys = materialize(all_keys.withColumn("born", F.expr(f"seen div {DAY}")))
    sizes = all_keys.groupBy("target", "born").count().agg(F.max("count")).first()[0] or 0
    slices = max(1, -(-sizes // SLICE))
    sliced = all_keys.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int"))
    w = Window.partitionBy("target", "born", "slice").orderBy("seen", "key")
    return materialize(sliced.withColumn("pos", F.row_number().over(w) - 1))


def words(rows: DataFrame, *by: str) -> DataFrame:
    """Bitmaps of ``pos`` per ``by`` as their nonzero words: columns ``by``, word, bits."""
    bit = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    return rows.groupBy(*by, F.expr("cast(pos div 64 as int)").alias("word")).agg(F.bit_or(bit).alias("bits"))


def arrived(keys: DataFrame, asked: DataFrame, span: list[str]) -> DataFrame:
    """How many keys of a range had arrived before a second, for the ranges and seconds ``asked`` (span, tick): column ``had``.

    One running sum per range over the arrivals of its keys (about ``SLICE``) and the seconds asked for
    (at most those of one period).
    """
    came = keys.where("born is not null").groupBy(*span, F.expr(f"seen div {SECOND}").alias("tick")).agg(F.count("*").alias("n"))
    rows = came.unionByName(asked.select(*span, "tick", F.lit(0).cast("long").alias("n"))).groupBy(*span, "tick").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*span).orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*span, "tick", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("had"))


def below(limit: str, word: str) -> Column:
    """The bits of a word whose positions lie below a limit (both columns by name)."""
    n = f"cast(least(greatest({limit} - cast({word} as bigint) * 64, 0), 64) as int)"
    return F.expr(f"case when {n} = 64 then -1L else ~shiftleft(-1L, {n}) end")


def positions(word: Column, bits: Column) -> Column:
    """Positions of the set bits of a word, as an array of bigint."""
    on = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(bits, i) == 1)
    return F.transform(on, lambda i: word.cast("long") * 64 + i)


def orphans(references: Iterable[DataFrame], targets: Iterable[DataFrame]) -> DataFrame:
    """All references without a valid target: ref_field, record_id, ref_key, at, reason.

    reason is ``absent``, ``removed`` or ``late``. Null and blank elements are no references; a
    repeated element is one reference; empty tables give an empty result. A reference without an instant is never
    late: its target counts as absent if it never arrived and as removed if it is
    gone (whether a purge came before it cannot be told, so a purge does not count). References are reduced to
    distinct (field, key, period) with counts combined map-side before anything is joined, so a key that a third
    of all rows name is one row per period here; only the surviving groups are joined back to records, hot ones
    split by salt.
    """
    refs = None
    for r in references:
        refs = r if refs is None else refs.unionByName(r)
    tgts = None
    for t in targets:
        tgts = t if tgts is None else tgts.unionByName(t)
    refs = materialize(refs.withColumn("period", F.coalesce(F.expr(f"at div {DAY}"), F.lit(UNDATED))))
    wanted = refs.groupBy("ref_field", "target", "key", "period").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    keys = number_keys(tgts, wanted)

    span = ["target", "born", "slice"]
    coded = wanted.join(keys.select("key", *span, "pos"), ["target", "key"])
    # only references of the range's own period need their second
    coded = coded.withColumn("tick", F.when(F.col("period") == F.col("born"), F.expr(f"first div {SECOND}")))
    asked = materialize(words(coded, "ref_field", "period", "tick", *span))
    never = F.col("gone") | F.col("purged").isNotNull()
    parents = words(keys.where(F.col("born").isNotNull() & ~never), *span).withColumnRenamed("bits", "has")
    had = arrived(keys, asked.where("tick is not null").select(*span, "tick").distinct(), span)
    left = asked.join(parents, [*span, "word"], "left").join(had, [*span, "tick"], "left")
    before = F.when(F.col("tick").isNull(), F.col("has")).otherwise(F.col("has").bitwiseAND(below("had", "word")))
    left = left.withColumn("before", F.coalesce(before, F.lit(0).cast("long"))).withColumn(
        "bits", F.expr(f"case when period >= born and period <> {UNDATED} then bits & ~before else bits end")
    )
    survivors = left.where("bits <> 0").select(
        "ref_field", "period", *span, F.explode(positions(F.col("word"), F.col("bits"))).alias("pos")
    )
    # ranges of keys that never arrived have a null period, so the join compares it null-safely
    k = keys.alias("k")
    s = survivors.alias("s")
    on = (F.col("k.target") == F.col("s.target")) & F.col("k.born").eqNullSafe(F.col("s.born")) & (F.col("k.slice") == F.col("s.slice")) & (F.col("k.pos") == F.col("s.pos"))
    open_keys = s.join(k, on).select("s.ref_field", "s.period", "k.key", "k.seen", "k.gone", "k.purged")

    # the exact check by instant
    reason = (
        F.when(F.col("seen").isNull(), "absent")
        .when(F.col("gone") | F.coalesce(F.col("purged") <= F.col("at"), F.lit(False)), "removed")
        .when(F.col("seen") > F.col("at"), "late")
    )
    # a group (field, key, period) with over a thousandth of all references is split: there are at most a
    # thousand of those, so their list can be broadcast
    group = ["ref_field", "period", "key"]
    total = F.broadcast(wanted.agg(F.sum("n").alias("all")))  # a single row
    hot = wanted.crossJoin(total).where(F.col("n") * HOT > F.col("all")).select(*group, F.lit(SALTS).alias("salts"))
    salted = refs.join(F.broadcast(hot), group, "left").withColumn(
        "salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    )
    spread = open_keys.join(F.broadcast(hot), group, "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0))))
    )
    return (
        salted.drop("salts").join(spread.drop("salts"), [*group, "salt"])
        .withColumn("reason", reason)
        .where("reason is not null")
        .select("ref_field", "record_id", F.col("key").alias("ref_key"), "at", "reason")
    )


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per referring field, reason and month of arrival."""
    month = F.date_format(F.timestamp_micros("at"), "yyyy-MM")
    return found.groupBy("ref_field", "reason", month.alias("month")).agg(F.count("*").alias("orphans"))
