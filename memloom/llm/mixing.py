"""Choosing documents so that each source makes up a target share of all tokens.

Within a source, documents are ordered by a hash of their id. Prefix sums of tokens are computed in
two levels: the hash range of a source is cut into about sqrt(n) slices, slices are summed by an
aggregate, and each slice then sums inside itself. So neither level gathers a large source in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import key
from ..sources.tables import materialize


def budgets(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per source: available docs and tokens, target share, max_repeats and the token budget.

    A source name compares trimmed and in lower case; its targets add up and the smallest repeat cap
    counts. Shares of sources without any tokens go to the others in proportion. With no
    ``total_tokens`` the total is the largest at which every share can be met within the repeat caps;
    with a total beyond that, sources that run out give all their repeats and the rest keep their
    share of the total. Sources without target, and targets without documents, get a budget of 0.
    """
    have = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("available"))
    want = targets.select(key(F.col("source")).alias("source"), "target_share", F.col("max_repeats").cast("long").alias("max_repeats"))
    want = want.where("source is not null and target_share > 0").groupBy("source").agg(
        F.sum("target_share").alias("target_share"), F.greatest(F.min(F.coalesce("max_repeats", F.lit(1))), F.lit(0)).alias("max_repeats")
    )
    both = have.join(want, "source", "full")
    both = both.select(
        "source", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("available", F.lit(0)).alias("available"),
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
    )
    most = F.col("available") * F.col("max_repeats")
    usable = (F.col("target_share") > 0) & (most > 0)
    # one row over the sources' names: a total per source, not per document
    all_rows = both.agg(F.sum(F.when(usable, F.col("target_share"))).alias("reachable"), F.min(F.when(usable, most / F.col("target_share"))).alias("scarcest"))
    both = both.crossJoin(F.broadcast(all_rows))  # a single aggregate row
    total = F.lit(float(total_tokens)) if total_tokens else F.col("scarcest") * F.col("reachable")
    budget = F.when(usable, F.least(most, F.col("target_share") / F.col("reachable") * total)).otherwise(0.0)
    return both.select("source", "docs", "available", "target_share", "max_repeats", budget.alias("budget"))


def prefix_sums(rows: DataFrame) -> DataFrame:
    """Adds ``end``: tokens of the source's documents up to and including this one in hash order.

    ``rows`` has source, slice, h, doc_id and tokens. Slices are summed by an aggregate, the sums of a source
    (about sqrt(n) rows) by one window and the documents of a slice (about sqrt(n) again) by another.
    """
    sums = rows.groupBy("source", "slice").agg(F.sum("tokens").alias("t"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "slice", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "slice").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("tokens").over(inside)).join(starts, ["source", "slice"])
    return rows.withColumn("end", F.col("start") + F.col("upto")).drop("start", "upto")


def mix(sizes: DataFrame, plan: DataFrame, seed: int = 7, refills: int = 0) -> DataFrame:
    """Chosen documents: doc_id, source, tokens, copies (how often each is used).

    ``sizes``: doc_id, source (normalized), tokens. Each source is used in whole epochs as often as
    its budget holds it; the remainder is cut after the last document that fits, and one further document closes
    the gap that the cut leaves as well as one can, if taking it is nearer than leaving it. With ``refills`` the
    gap is first cut again, so often, among the documents that are small enough for it; this favours short ones.
    """
    per = plan.where("budget > 0").select(
        "source", F.ceil(F.sqrt("docs")).cast("long").alias("slices"),
        F.floor(F.try_divide("budget", "available") + 1e-12).cast("long").alias("epochs"), "budget", "available", "max_repeats",
    )
    # one row per source name with a target, and those are bounded by the table of targets
    per = per.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("available")).otherwise(0.0))
    h = F.xxhash64(F.lit(seed), "doc_id")
    # top 31 bits, sign bit flipped so that slices follow the signed order of the hash
    top = F.shiftrightunsigned(h.bitwiseXOR(F.lit(-(2**63))), 33)
    rows = sizes.join(F.broadcast(per.drop("budget", "available", "max_repeats")), "source")
    rows = rows.select("doc_id", "source", "tokens", "epochs", h.alias("h"), F.shiftright(top * F.col("slices"), 31).alias("slice"), F.col("rest").alias("gap"))
    taken = left = None
    for _ in range(1 + refills):
        rows = materialize(prefix_sums(rows))
        fits = F.col("end") <= F.col("gap")
        part = rows.where(fits).select("doc_id", F.lit(1).alias("extra"))
        taken = part if taken is None else taken.unionByName(part)
        used = rows.groupBy("source").agg((F.first("gap") - F.coalesce(F.max(F.when(fits, F.col("end"))), F.lit(0))).alias("left"))
        left = rows.where(~fits).drop("end").join(F.broadcast(used), "source")
        rows = left.where(F.col("tokens") <= F.col("left")).withColumn("gap", F.col("left")).drop("left")
    off = F.abs(F.col("tokens") - F.col("left"))
    last = left.where(off < F.col("left")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "doc_id")).alias("x"))
    taken = taken.unionByName(last.select("x.doc_id", F.lit(1).alias("extra")))
    every = sizes.join(F.broadcast(per.select("source", "epochs")), "source").join(taken, "doc_id", "left")
    copies = F.col("epochs") + F.coalesce("extra", F.lit(0))
    return every.select("doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0")


def sized_sources(documents: DataFrame, **kw) -> DataFrame:
    """Documents that have tokens, with normalized source; a null source is none and has no target."""
    from .tokens import sized

    # written first: a filter on the size would run the tokenizer twice
    rows = materialize(sized(documents, **kw)).where("doc_id is not null and tokens > 0")
    return rows.select("doc_id", key(F.col("source")).alias("source"), "tokens")


def report(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source: target and reached share, tokens available and used, repeats used and most copies."""
    got = chosen.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.count("*").alias("docs_used"), F.max("copies").alias("most_copies")
    )
    rows = plan.join(got, F.coalesce(plan["source"], F.lit("")) == F.coalesce(got["source"], F.lit("")), "left").select(
        plan["source"], "docs", "available", "target_share", "max_repeats", "budget",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("used", "docs_used", "most_copies")],
    )
    whole = rows.agg(F.sum("used").alias("all_used"))
    rows = rows.crossJoin(F.broadcast(whole))  # a single aggregate row
    return rows.select(
        "source", "docs", "docs_used", "available", "used", "target_share",
        (F.col("used") / F.greatest("all_used", F.lit(1))).alias("share"),
        F.coalesce(F.col("used") / F.nullif("available", F.lit(0)), F.lit(0.0)).alias("repeats"), "most_copies", "max_repeats",
    )
