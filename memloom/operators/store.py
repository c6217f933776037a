"""Table-level operations of a memory store: upsert, delete, dedupe, buffers and entity links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, batch: DataFrame, key: str = "id", order: str = "revision") -> DataFrame:
    """Table and batch merged, the highest ``order`` per key (the batch wins ties)."""
    rows = table.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("_new"))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def delete(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Table without the listed ids."""
    return table.join(ids.select(key).distinct(), key, "left_anti")


def compare_and_set(held: DataFrame, writes: DataFrame) -> DataFrame:
    """(id, accepted, conflicts): optimistic writes of one batch against the revisions that a table holds.

    ``held``: (id, held); a key without a row holds 0. ``writes``: (id, expected). A write that expects the revision its key
    holds is accepted, one if there are several; all others are conflicts and change nothing.
    """
    rows = writes.join(held, "id", "left").withColumn("fits", F.coalesce(F.coalesce("held", F.lit(0)) == F.col("expected"), F.lit(False)))
    per = rows.groupBy("id").agg(F.max(F.col("fits").cast("long")).alias("accepted"), F.count("*").alias("n"))
    return per.select("id", "accepted", (F.col("n") - F.col("accepted")).alias("conflicts"))


def checked_vectors(rows: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector has ``dim`` numbers; any other length stops the job."""
    ok = F.coalesce(F.size("vector") == dim, F.lit(False))
    return rows.where(F.assert_true(ok, F.lit(f"vector length is not {dim}")).isNull())


def page(rows: DataFrame, order: list[Column], size: int) -> DataFrame:
    """First ``size`` rows in ``order`` with the ``total`` that matched."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(size).crossJoin(F.broadcast(total))  # a single row


def first_by_md5(rows: DataFrame, text: Column, order: list[Column]) -> DataFrame:
    """The first row of each exact text."""
    w = Window.partitionBy("text_md5").orderBy(*order)
    return rows.withColumn("text_md5", F.md5(text)).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def newest(rows: DataFrame, scope: str, order: str, n: int = 10) -> DataFrame:
    """The last ``n`` messages of each scope (the buffer keeps no more)."""
    w = Window.partitionBy(scope).orderBy(F.desc(order))
    return rows.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def scope_text(values: dict[str, Column]) -> Column:
    """Session scope k=v&... with keys sorted and %, & and = escaped."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("&"), F.lit("%26")), F.lit("="), F.lit("%3D"))
    return F.concat_ws("&", *[F.concat(F.lit(k + "="), esc(values[k])) for k in sorted(values)])


def link_rows(mentions: DataFrame) -> DataFrame:
    """(entity, type, memory_id) of mentions (memory_id, text, type), texts in lower case with single spaces."""
    tidy = F.regexp_replace(F.lower(F.trim("text")), r"\s+", " ")
    return mentions.where("memory_id is not null").select(tidy.alias("entity"), "type", "memory_id").where("entity <> ''")


def link_entities(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities with the memories that mention them: (entity, type, linked), new ones added.

    ``mentions``: (memory_id, text, type). ``entities``: (entity, type, linked array). Texts compare
    trimmed, in lower case, with single spaces; the alphabetically first type wins for a new entity.
    """
    tidy = F.regexp_replace(F.lower(F.trim("text")), r"\s+", " ")
    new = mentions.where(F.col("memory_id").isNotNull()).select(tidy.alias("entity"), F.col("type").alias("t"), "memory_id").where("entity <> ''")
    old = entities.select("entity", F.col("type").alias("ot"), F.explode_outer("linked").alias("memory_id"))
    rows = new.select("entity", "t", F.lit(None).cast("string").alias("ot"), "memory_id").unionByName(old.select("entity", F.lit(None).cast("string").alias("t"), "ot", "memory_id"))
    return rows.groupBy("entity").agg(
        F.coalesce(F.min("ot"), F.min("t")).alias("type"), F.array_sort(F.collect_set("memory_id")).alias("linked")
    )


def unlink(entities: DataFrame, gone: DataFrame) -> DataFrame:
    """Entities without links to deleted memories (id); an entity with no link left goes too."""
    links = entities.select("entity", "type", F.explode("linked").alias("id"))
    left = links.join(gone.select("id").distinct(), "id", "left_anti")
    return left.groupBy("entity", "type").agg(F.array_sort(F.collect_set("id")).alias("linked"))
