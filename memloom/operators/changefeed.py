"""Applying a feed of inserts, updates and deletes to the table it describes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import digest, instant, is_blank, key, squeeze

#: A delete without any time applies after every other change of its key.
END = 2**63 - 1


def changes(history: DataFrame) -> DataFrame:
    """The distinct changes of a history feed, one row each, that have an effect.

    Columns: ``entity``, ``ts`` (microseconds), ``n`` (smallest id of the copies), ``op`` (A, U, D),
    ``state`` (digest of the text with squeezed white space, null for D), ``replaces`` (whether the
    change carries a previous text) and ``raw`` (digest of the text as it is).

    Copies (same key, action, new value and time) collapse in one aggregate with map-side combine, so
    a change that was delivered a million times costs one row per task. Rows without a key or id, with
    an unknown action, NONE, and an insert or update to a blank value have no effect. An insert or
    update without any time counts as made when it arrived. An empty feed gives an empty result.
    """
    h = history.select(
        key(F.col("memory_id")).alias("entity"),
        F.col("id").cast("long").alias("n"),
        F.substring(F.upper(F.trim("action")), 1, 6).alias("act"),
        F.coalesce(instant(F.col("updated_at")), instant(F.col("created_at"))).alias("made"),
        instant(F.col("ingested_at")).alias("arrived"),
        "new_value",
        F.col("previous_value"),
    ).where("entity is not null and n is not null and act in ('ADD', 'UPDATE', 'DELETE')")
    h = h.where((F.col("act") == "DELETE") | ~is_blank(F.col("new_value")))
    h = h.select(
        "entity", "n", F.substring("act", 1, 1).alias("op"), digest(F.col("new_value")).alias("raw"),
        F.when(F.col("act") == "DELETE", F.coalesce("made", F.lit(END))).otherwise(F.coalesce("made", "arrived", F.lit(0))).alias("ts"),
        F.when(F.col("act") != "DELETE", digest(squeeze(F.col("new_value")))).alias("state"),
        (~is_blank(F.col("previous_value"))).alias("replaces"),
    )
    first = F.min(F.struct("n", "state", "replaces"))
    return h.groupBy("entity", "op", "raw", "ts").agg(first.alias("x")).select("entity", "ts", "x.n", "op", "x.state", "x.replaces", "raw")


def last_changes(feed: DataFrame) -> DataFrame:
    """Per entity and kind of change the latest one by (ts, n).

    A ranking window whose filter ``rank = 1`` Spark also runs before the shuffle (window group
    limit), so each task sends at most three rows per entity however long its history is.
    """
    w = Window.partitionBy("entity", "op").orderBy(F.desc("ts"), F.desc("n"))
    return feed.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def carried(feed: DataFrame) -> DataFrame:
    """What a later batch of changes needs to know of this feed: a base for ``current_state``.

    Per entity and kind of change all changes of the latest instant, deletes too. So a delete stays known, and a
    late copy of one of several changes of that instant is still told from a new change.
    """
    w = Window.partitionBy("entity", "op").orderBy(F.desc("ts"))
    return feed.withColumn("rank", F.rank().over(w)).where("rank = 1").select("entity", "ts", "n", "op", "raw")


def current_state(feed: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Entities that exist after all changes: ``entity``, ``n`` (the change that set the text), ``ts``.

    ``base`` is what ``carried`` kept of earlier batches; the result is that of all their changes together, in
    whatever order the batches came.

    An insert sets the text always, an update unless the entity is deleted, and a delete holds until a
    later insert. So the latest of each kind decides: the entity lives if nothing deleted it or an
    insert is later than the last delete, and the later of last insert and last update set its text.
    """
    if base is not None:
        cols = ["entity", "ts", "n", "op", "raw"]
        both = feed.select(*cols).unionByName(base.select(*cols))
        feed = both.groupBy("entity", "op", "raw", "ts").agg(F.min("n").alias("n"))
    at = F.struct("ts", "n")
    last = last_changes(feed.select("entity", "ts", "n", "op")).groupBy("entity").agg(
        *[F.max(F.when(F.col("op") == o, at)).alias(o) for o in "AUD"]
    )
    alive = F.col("D").isNull() | F.coalesce(F.col("A") > F.col("D"), F.lit(False))
    return (
        last.where(alive)
        .select("entity", F.greatest("A", "U").alias("set"))
        .where("set is not null")
        .select("entity", "set.n", "set.ts")
    )


def current_rows(history: DataFrame) -> DataFrame:
    """The present memories with text: ``memory_id``, ``history_id``, ``text``, ``set_at``."""
    now = current_state(changes(history))
    texts = history.select(F.col("id").cast("long").alias("n"), F.col("new_value").alias("text"))
    return now.join(texts, "n").select(
        F.col("entity").alias("memory_id"), F.col("n").alias("history_id"), "text",
        F.timestamp_micros("ts").alias("set_at"),
    )
