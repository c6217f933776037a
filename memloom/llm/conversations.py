"""Rebuilding conversations from message rows.

A turn's parent is its predecessor's turn, one ordinal before. Parent pointers are resolved by pointer
jumping over turns: each round every open turn adopts the pointer of the turn it points at, so a chain
of n turns needs log2 n joins. What comes out of it for a turn (its root, the length of its path, or
that it is an orphan or on a cycle) decides gaps and turn numbers. No step gathers a session in one
task: turns and session verdicts are aggregates with map-side combine, and joins are on
(session, turn) or (session, stretch of turns).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import instant, is_visible, key, strip
from ..sources.tables import discard, materialize

#: Turns per join key where a verdict goes back to the turns of its session, so that a huge session spreads.
STRETCH = 1024
#: Texts are compared by two independent 64-bit hashes and their length.
SEED = 17


def chain_roots(nodes: DataFrame, group: str, node: str, parent: str) -> DataFrame:
    """Root of every node under parent pointers inside a group, by pointer jumping.

    ``nodes`` has unique (group, node); ``parent`` is null for a root. Adds ``root`` (null if none),
    ``hops`` and ``status``: ``rooted``, ``orphan`` (the chain ends at a parent that has no row) or
    ``cycle``. Empty input gives empty output. A round joins the open nodes with the nodes they point
    at. Solved nodes leave the work: they are kept as targets only while an open node points at them
    (a pointer is only ever replaced by the pointer of an open node, so none comes back). The loop
    ends when no node is open, or, for cycles, when 2^rounds exceeds the number of nodes.
    """
    at = nodes.select(F.col(group).alias("g"), F.col(node).alias("v"), F.col(parent).alias("p"))
    top = F.col("p").isNull()
    state = materialize(at.select("g", "v", "p", F.when(top, 0).otherwise(1).cast("long").alias("hops"), F.when(top, F.lit("rooted")).alias("status"), F.when(top, F.col("v")).alias("root")))
    solved, opened = [state.where("status is not null")], state.where("status is null")
    total, rounds, written = None, 0, []
    targets, size = state, None
    while left := opened.count():
        total = total or state.count()
        size = size or total
        if 2**rounds > total:
            solved.append(opened.withColumn("status", F.lit("cycle")))
            break
        if 2 * left < size:
            targets = materialize(targets.join(opened.select("g", F.col("p").alias("v")).distinct(), ["g", "v"], "left_semi"))
            written.append(targets)
            size = 2 * left
        step = targets.select("g", F.col("v").alias("p"), F.col("p").alias("p2"), F.col("hops").alias("h2"), F.col("status").alias("s2"), F.col("root").alias("r2"), F.lit(True).alias("there"))
        moved = materialize(opened.select("g", "v", "p", "hops").join(step, ["g", "p"], "left").select(
            "g", "v", F.when(F.col("s2").isNull(), F.col("p2")).alias("p"),
            (F.col("hops") + F.coalesce("h2", F.lit(0))).alias("hops"),
            F.when(F.col("there").isNull(), "orphan").otherwise(F.col("s2")).alias("status"), F.col("r2").alias("root"),
        ))
        targets = targets.where("status is not null").unionByName(moved)
        solved.append(moved.where("status is not null"))
        opened = moved.where("status is null")
        rounds += 1
    for t in written:
        discard(t)
    return reduce(DataFrame.unionByName, solved).select(F.col("g").alias(group), F.col("v").alias(node), "root", "hops", "status")


def message_versions(messages: DataFrame, with_text: bool = False) -> DataFrame:
    """The counting version of each message: the row of its id that arrived last.

    Role and text come from the columns, where null from ``body`` (unreadable JSON gives null). The
    text itself travels only if asked for; else its hashes do. Rows without id or session are no part
    of any conversation and are left out; rows that tie on arrival are told apart by their content.
    """
    body = lambda member: F.get_json_object("body", f"$.{member}")
    text = F.coalesce("content", body("content"))
    rows = messages.select(
        key(F.col("id")).alias("id"), key(F.col("session_id")).alias("session_id"), F.col("ordinal").cast("long").alias("ordinal"),
        key(F.coalesce("role", body("role"))).alias("role"), text.alias("text"), instant(F.col("ingested_at")).alias("arrived"),
    ).where("id is not null and session_id is not null")
    t = strip(F.col("text"))
    rows = rows.select(
        "id", "session_id", "ordinal", "role", "arrived", F.struct(F.xxhash64(t), F.xxhash64(F.lit(SEED), t), F.length(t)).alias("same"),
        is_visible(F.col("text")).alias("visible"), *(["text"] if with_text else []),
    )
    cols = [c for c in rows.columns if c not in ("id", "arrived")]
    newest = F.max(F.struct("arrived", *cols)).alias("x")
    return rows.groupBy("id").agg(newest).select("id", "x.arrived", *[F.col(f"x.{c}").alias(c) for c in cols])


def turns(versions: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per (session, ordinal): speaker, text and whether its messages disagree.

    ``aliases`` is a fixed list of role names, joined by broadcast (it is cut to its distinct aliases;
    a role that two speakers claim goes to the first in order).
    """
    names = aliases.select(key(F.col("alias")).alias("role"), F.lower(F.trim("speaker")).alias("speaker")).where("role is not null")
    names = names.groupBy("role").agg(F.min("speaker").alias("speaker"))
    rows = versions.join(F.broadcast(names), "role", "left")
    text = [F.min_by("text", F.struct("arrived", "id")).alias("text")] if "text" in versions.columns else []
    who = F.coalesce("speaker", F.lit("?"))
    return rows.groupBy("session_id", "ordinal").agg(
        F.max(who).alias("speaker"),
        ((F.min(who) != F.max(who)) | (F.min("same") != F.max("same"))).alias("conflict"),
        F.max(F.col("speaker").isNull()).alias("stranger"),
        F.max(~F.col("visible") & who.isin("user", "assistant")).alias("blank"),
        *text,
    )


def turn_paths(turn_rows: DataFrame) -> DataFrame:
    """Path of every turn that has an ordinal: session_id, ordinal, root, hops and status (see ``chain_roots``).

    The pointer names the predecessor's turn whether or not it has a row; turn 0 opens the session.
    """
    link = turn_rows.where("ordinal is not null").select("session_id", "ordinal", F.when(F.col("ordinal") != 0, F.col("ordinal") - 1).alias("parent"))
    return chain_roots(link, "session_id", "ordinal", "parent")


def session_verdicts(turn_rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Per session the reasons to leave it out, as boolean columns, and ``bad`` if any holds.

    gap: a turn has no path to the opening turn (or no ordinal at all). conflict: messages of one turn differ.
    stranger: a role has no speaker. blank: a user or assistant turn has no visible text. one_sided:
    no user or no assistant turn. unanswered: the last of their turns is the user's.
    """
    user, both = F.col("speaker") == "user", F.col("speaker").isin("user", "assistant")
    no = F.lit(False)
    flags = turn_rows.select(
        "session_id", F.col("ordinal").isNull().alias("gap"), "conflict", "stranger", "blank", user.alias("user"), (F.col("speaker") == "assistant").alias("assistant"),
        # order of the turn and who speaks in one number, so that the maximum tells the last speaker
        F.when(both & F.col("ordinal").isNotNull(), F.col("ordinal") * 2 + user.cast("long")).alias("end"),
    )
    lost = paths.where("status <> 'rooted'").select("session_id", F.lit(True).alias("gap"), *[no.alias(c) for c in ("conflict", "stranger", "blank", "user", "assistant")], F.lit(None).cast("long").alias("end"))
    per = flags.unionByName(lost).groupBy("session_id").agg(*[F.max(c).alias(c) for c in flags.columns[1:]])
    out = per.select(
        "session_id", "gap", "conflict", "stranger", "blank", (~F.col("user") | ~F.col("assistant")).alias("one_sided"),
        F.coalesce(F.pmod("end", F.lit(2)) == 1, no).alias("unanswered"),
    )
    return out.withColumn("bad", F.expr("gap or conflict or stranger or blank or one_sided or unanswered"))


def excluded_sessions(messages: DataFrame, aliases: DataFrame) -> DataFrame:
    """Sessions to leave out with their reasons."""
    rows = materialize(turns(message_versions(messages), aliases))
    return session_verdicts(rows, turn_paths(rows)).where("bad").drop("bad")


def conversations(messages: DataFrame, aliases: DataFrame) -> DataFrame:
    """Turns of the intact sessions: session_id, turn (0, 1, ...), speaker, text.

    The turn is the length of the turn's path from the root. Verdicts go back to the paths per (session,
    stretch of turns), so a session that holds a third of all rows spreads over many keys.
    """
    rows = materialize(turns(message_versions(messages, with_text=True), aliases))
    paths = turn_paths(rows.select("session_id", "ordinal"))
    good = session_verdicts(rows, paths).where("not bad").select("session_id")
    keyed = paths.withColumn("stretch", F.expr(f"ordinal div {STRETCH}"))
    kept = keyed.select("session_id", "stretch").distinct().join(good, "session_id")
    turn_of = keyed.join(kept, ["session_id", "stretch"]).select("session_id", "ordinal", F.col("hops").alias("turn"))
    return rows.join(turn_of, ["session_id", "ordinal"]).select("session_id", "turn", "speaker", "text")
