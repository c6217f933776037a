"""Version history of changing attributes, read off presence bitmaps.

The changes of an entity, in order, are its snapshots. For each (entity, value) one bit is set per
snapshot after which the entity held the value; a run of consecutive bits is one version. A deleted
entity holds the tombstone value, so a gap in a value's bits ends its version by itself and repeated
writes of the same text just lengthen the run.

Positions come from a range sort on (entity, time), which also splits an entity with very many
changes over several tasks; what such an entity carries over a chunk border is a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import instant, key
from ..sources.tables import materialize
from .changefeed import changes
from .chunks import border_keys, in_chunks, with_carry
from .references import positions

ENTITY = ["source", "entity"]
ORDER = ["ts", "rank", "n", "ref"]


def memory_feed(history: DataFrame) -> DataFrame:
    """Changes of memories as a feed (see ``versions``)."""
    return changes(history).select(
        F.lit("memory_history").alias("source"), "entity", "ts", F.lit(1).alias("rank"), "n",
        F.col("n").cast("string").alias("ref"), "op", "state", "replaces",
    )


def fact_feed(facts: DataFrame) -> DataFrame:
    """Facts as a feed: a fact inserts itself when observed and deletes the facts it supersedes.

    At one instant deletes sort before the insert: a fact is replaced only by one observed later.
    Facts without a readable ``observed_at`` take no part; a fact never replaces itself.
    """
    rows = facts.select(key(F.col("id")).alias("ref"), instant(F.col("observed_at")).alias("ts"), "supersedes").where(
        "ref is not null and ts is not null"
    )
    made = rows.select(F.col("ref").alias("entity"), "ts", "ref", F.lit("A").alias("op"))
    gone = rows.select(F.explode("supersedes").alias("e"), "ts", "ref").select(key(F.col("e")).alias("entity"), "ts", "ref", F.lit("D").alias("op"))
    feed = made.unionByName(gone.where("entity is not null and entity <> ref"))
    feed = feed.groupBy("entity", "ref", "op").agg(F.min("ts").alias("ts"))
    own = F.when(F.col("op") == "A", F.unhex(F.md5("ref")))
    return feed.select(
        F.lit("facts").alias("source"), "entity", "ts", F.when(F.col("op") == "D", 0).otherwise(1).alias("rank"),
        F.lit(0).cast("long").alias("n"), "ref", "op", own.alias("state"), F.lit(False).alias("replaces"),
    )


def applied(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The changes that take effect, numbered per entity, and the entities that cross chunks.

    Takes out updates of deleted entities. Adds ``pos`` (0 is kept free for a version before the
    first change) and ``known`` (an insert came before).
    """
    rows = in_chunks(feed, ENTITY, ORDER)
    border = border_keys(rows, ENTITY)
    w = Window.partitionBy(*ENTITY, "chunk").orderBy(*ORDER)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("op") != "U", F.col("op"))
    past = F.max(F.when(mark.isNotNull(), F.struct(*ORDER, mark.alias("m"))))
    rows = with_carry(rows, border, ENTITY, {"past": past, "knew": F.max(F.col("op") == "A")}, F.max)
    last = F.coalesce(F.last(mark, ignorenulls=True).over(before), F.col("past.m"))
    rows = rows.select(
        *ENTITY, *ORDER, "op", "state", "replaces", "chunk", last.alias("last"),
        (F.coalesce(F.max(F.col("op") == "A").over(before), F.lit(False)) | F.coalesce("knew", F.lit(False))).alias("known"),
    )
    rows = rows.where("op <> 'U' or last is null or last = 'A'")
    rows = with_carry(rows, border, ENTITY, {"offset": F.count("*")}, F.sum)
    pos = F.row_number().over(w) + F.coalesce("offset", F.lit(0))
    tomb = F.coalesce("state", F.lit(b"deleted"))
    rows = rows.select(*ENTITY, "ref", "op", tomb.alias("state"), "replaces", "known", "chunk", pos.cast("long").alias("pos"))
    return materialize(rows), border


def run_starts(steps: DataFrame) -> DataFrame:
    """First positions of the runs of consecutive bits in the presence bitmap of each value.

    A bitmap is kept as its nonzero 64-bit words. A row at either end of a word also tells the
    neighbouring word of the same value, so runs that cross words need no join.
    """
    by = [*ENTITY, "state"]
    here = steps.select(*by, F.expr("pos div 64").alias("word"), F.expr("shiftleft(1L, cast(pos % 64 as int))").alias("bit"), F.lit(0).alias("cin"))
    after = steps.where("pos % 64 = 63").select(*by, F.expr("pos div 64 + 1").alias("word"), F.lit(0).cast("long").alias("bit"), F.lit(1).alias("cin"))
    words = here.unionByName(after).groupBy(*by, "word").agg(F.bit_or("bit").alias("bits"), F.max("cin").cast("long").alias("cin"))
    starts = F.expr("bits & ~(shiftleft(bits, 1) | cin)")
    return words.select(*by, "word", starts.alias("bits")).where("bits <> 0").select(
        *ENTITY, F.explode(positions(F.col("word"), F.col("bits"))).alias("pos")
    )


def versions(feed: DataFrame) -> DataFrame:
    """All versions: source, entity, opened_by, closed_by ('' = none) and whether the closer deleted.

    ``feed``: source, entity, ts, rank, n, ref (order within the entity), op (A insert, U update, D
    delete), state (digest of the value, null for D), replaces (a previous value is given). An insert
    or a live update with another value than before opens a version; the next change of value or the
    delete closes it. If an entity's first change is an update or delete that names a previous
    value, a version with opened_by '' precedes it. An empty feed gives an empty result.
    """
    steps, border = applied(feed)
    return _versions(steps, border)


def _versions(steps: DataFrame, border: DataFrame) -> DataFrame:
    prior = steps.where("pos = 1 and op <> 'A' and replaces").select(
        *ENTITY, F.lit("").alias("ref"), F.lit("A").alias("op"), F.lit(b"before").alias("state"), "chunk", F.lit(0).cast("long").alias("pos")
    )
    steps = steps.select(*ENTITY, "ref", "op", "state", "chunk", "pos").unionByName(prior)
    marks = steps.join(run_starts(steps), [*ENTITY, "pos"], "left_semi")
    # runs tile the positions of an entity, so a run ends where the next one starts
    w = Window.partitionBy(*ENTITY, "chunk").orderBy("pos")
    at = F.struct("pos", "ref")
    marks = with_carry(marks, border, ENTITY, {"far": F.min(at)}, F.min, ahead=True)
    closer = F.coalesce(F.lead("ref").over(w), F.col("far.ref"), F.lit(""))
    return marks.select(*ENTITY, F.col("ref").alias("opened_by"), closer.alias("closed_by"), "op").where("op <> 'D'").drop("op")


def memory_versions(history: DataFrame) -> DataFrame:
    """Versions of memories from their change feed."""
    return versions(memory_feed(history))


def fact_versions(facts: DataFrame) -> DataFrame:
    """Versions of facts: each fact that replaces another or is replaced, and what replaced it."""
    steps, border = applied(fact_feed(facts))
    return _fact_versions(steps, border)


def _fact_versions(steps: DataFrame, border: DataFrame) -> DataFrame:
    spans = _versions(steps, border)
    replacers = steps.where("op = 'D' and known").select(F.col("ref").alias("entity"), F.lit("").alias("closed_by"))
    closed = spans.where("closed_by <> ''").select("entity", "closed_by").unionByName(replacers)
    return closed.groupBy("entity").agg(F.max("closed_by").alias("closed_by")).select(
        F.lit("facts").alias("source"), "entity", F.col("entity").alias("opened_by"), "closed_by"
    )


def all_versions(history: DataFrame, facts: DataFrame) -> DataFrame:
    """Versions of memories and facts in one pass: source, entity, opened_by, closed_by."""
    steps, border = applied(memory_feed(history).unionByName(fact_feed(facts)))
    of = F.col("source") == "facts"
    return _versions(steps.where(~of), border).unionByName(_fact_versions(steps.where(of), border))
