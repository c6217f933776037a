"""Dependencies between rows and expansion along shared entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize


def invisible_closure(invisible: DataFrame, needs: DataFrame) -> DataFrame:
    """All ids that are invisible or depend, at any distance, on an invisible or missing id.

    ``invisible``: (id). ``needs``: (id, needs). Each round joins only the newly found ids with the
    dependencies, and the anti join with all found so far makes cycles end. Found ids are written to
    the shared scratch folder, one piece per round.
    """
    edges = needs.where("id is not null and needs is not null").select("id", "needs").distinct()
    found = front = materialize(invisible.where("id is not null").select("id").distinct())
    while True:  # every round finds new ids, of which there are finitely many
        step = edges.join(front.select(F.col("id").alias("needs")), "needs").select("id").distinct()
        front = materialize(step.join(found, "id", "left_anti"))
        if front.isEmpty():
            return found
        found = found.unionByName(front)


def visible_rows(rows: DataFrame, visible, needs_col: str = "depends_on") -> DataFrame:
    """Rows that satisfy ``visible`` and whose dependencies all do, transitively. A missing dependency hides."""
    needs = rows.select("id", F.explode(needs_col).alias("needs"))
    missing = needs.select(F.col("needs").alias("id")).distinct().join(rows.select("id"), "id", "left_anti")
    hidden = rows.where(~F.coalesce(visible, F.lit(False))).select("id").unionByName(missing)
    return rows.join(invisible_closure(hidden, needs), "id", "left_anti")


def expand_hops(seeds: DataFrame, links: DataFrame, hops: int = 2, base: float = 0.012) -> DataFrame:
    """(query, doc, depth, score) of documents that share an entity with a seed, or with such a document.

    ``seeds``: (query, entity). ``links``: (doc, entity). A document counts at its smallest depth with
    ``base`` / (depth + 1). Queries and entities are joined by hash; each hop reduces to distinct pairs first.
    """
    front = seeds.where("entity is not null").select("query", "entity").distinct()
    known, hits = front, None
    for depth in range(hops):
        found = front.join(links, "entity").select("query", "doc")
        if depth + 1 < hops:  # the last layer is reduced by the final aggregate
            found = found.distinct()
        layer = found.withColumn("depth", F.lit(depth))
        hits = layer if hits is None else hits.unionByName(layer)
        if depth + 1 < hops:
            new = found.join(links, "doc").select("query", "entity").distinct()
            front = new.join(known, ["query", "entity"], "left_anti")
            known = known.unionByName(front)
    hits = hits.groupBy("query", "doc").agg(F.min("depth").alias("depth"))
    return hits.withColumn("score", F.lit(base) / (F.col("depth") + 1))


def bounded(hits: DataFrame, most: int) -> DataFrame:
    """The nearest ``most`` hits of each query (a top-k report, ties by doc)."""
    w = Window.partitionBy("query").orderBy("depth", "doc")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def typed_paths(seeds: DataFrame, edges: DataFrame, hops: int = 2, per_node: int = 8, most: int = 40) -> DataFrame:
    """(query, id, depth, begins, ends, rank): edges on paths from the seeds whose validity windows overlap.

    ``seeds``: (query, node). ``edges``: (id, src, dst, begins, ends) with half-open windows, null meaning open. A path
    holds in the intersection of its windows and is not followed where that is empty; it never returns to a
    node it started from. The bounds (edges per node, hits per query; smallest depth and id first) are part of
    the search. Each hop is one join on the node and one rank-limited window.
    """
    front = seeds.where("node is not null").select("query", "node").distinct()
    known = front
    front = front.select("query", "node", *[F.lit(None).cast(dict(edges.dtypes)[c]).alias(c) for c in ("begins", "ends")])
    w = Window.partitionBy("query", "node").orderBy("id", "begins", "ends")
    hits = None
    for depth in range(hops):
        e = edges.select("id", F.col("src").alias("node"), "dst", F.col("begins").alias("b2"), F.col("ends").alias("e2"))
        step = front.join(e, "node").select(
            "query", "node", "id", "dst", F.greatest("begins", "b2").alias("begins"), F.least("ends", "e2").alias("ends")
        )
        step = step.where("begins is null or ends is null or begins < ends")
        step = step.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_node)
        layer = step.select("query", "id", "begins", "ends", F.lit(depth).alias("depth"))
        hits = layer if hits is None else hits.unionByName(layer)
        reached = step.where("dst is not null").select("query", F.col("dst").alias("node"), "begins", "ends")
        front = reached.join(known, ["query", "node"], "left_anti").distinct()
        known = known.unionByName(front.select("query", "node")).distinct()
    first = hits.groupBy("query", "id").agg(F.min(F.struct("depth", "begins", "ends")).alias("x")).select("query", "id", "x.*")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("depth", "id"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most)
