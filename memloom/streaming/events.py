"""Event-time windows and per-key state over streams of observations.

The window functions take a batch or a streaming DataFrame. ``run`` drives a stream to the end of the
data that is there (availableNow) with its checkpoint and output in the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch, table


def source(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table, stored as a folder of files or as one file, as a stream of its files."""
    schema = table(spark, d, name).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    reader = spark.readStream.schema(schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{d}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def timed(df: DataFrame, at: str = "ts", late: str = "1 day") -> DataFrame:
    """With ``at`` as an instant (a zoneless timestamp means UTC) and a watermark on streams."""
    out = df.withColumn(at, F.col(at).cast("timestamp"))
    return out.withWatermark(at, late) if df.isStreaming else out


def windowed(df: DataFrame, at: str, keys: list[str], aggs: list[Column], length: str, slide: str | None = None) -> DataFrame:
    """Tumbling (or with ``slide`` sliding) event-time windows."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return df.groupBy(w, *keys).agg(*aggs).select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), *keys, *[_name(a) for a in aggs])


def sessions(df: DataFrame, at: str, keys: list[str], aggs: list[Column], gap: str) -> DataFrame:
    """Runs of events of a key with less than ``gap`` between them."""
    out = df.groupBy(F.session_window(at, gap), *keys).agg(*aggs)
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), *keys, *[_name(a) for a in aggs])


def _name(c: Column) -> str:
    return c._jc.toString().rsplit(" AS ", 1)[-1].strip("`")


def slot_outcomes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``outcome``: what each observation does to its slot, in arrival order.

    Rows need ``keys``, ts, seq (unique) and value. ``new`` for the first, ``update`` or ``same`` for a later instant, ``same`` or
    ``conflict`` for an equal one, ``late`` for an older or missing one, which changes nothing. The value that holds is the
    first to arrive with the latest instant: a running maximum, so no row waits for others in Python.
    """
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("top", F.max(F.when(F.col("ts").isNotNull(), F.struct("ts", (-F.col("seq")).alias("first"), "value"))).over(w))
    same = F.col("value").eqNullSafe(F.col("top.value"))
    outcome = (
        F.when(F.col("ts").isNull(), "late").when(F.col("top").isNull(), "new")
        .when(F.col("ts") > F.col("top.ts"), F.when(same, "same").otherwise("update"))
        .when(F.col("ts") == F.col("top.ts"), F.when(same, "same").otherwise("conflict")).otherwise("late")
    )
    return rows.withColumn("outcome", outcome).drop("top")


def slot_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """``slot_outcomes`` of a stream that is run to the end of its data: keys, seq, outcome.

    The state is a table with one row per slot (latest instant and the value that holds), rewritten per batch under
    its number, so a repeated batch replaces its own output.
    """

    def step(rows: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        rows = rows.select(*keys, "ts", "seq", "value")
        both = rows if state is None else rows.unionByName(state)
        top = F.max(F.when(F.col("ts").isNotNull(), F.struct("ts", (-F.col("seq")).alias("first"), "value"))).alias("x")
        held = both.groupBy(*keys).agg(top).where("x is not null")
        # a held value counts as having arrived before all rows of later batches
        held = held.select(*keys, "x.ts", F.lit(-1).cast("long").alias("seq"), "x.value")
        return slot_outcomes(both, keys).where("seq >= 0").select(*keys, "seq", "outcome"), held

    return fold(stream.withColumn("seq", F.col("seq").cast("long")), step)


def carried(stream: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows of a stream with ``value`` filled from the last row of the key before that has one, over all batches.

    The state is the last value per key; within a batch rows are filled in ``order``.
    """

    def step(rows: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = rows.withColumn(value, F.last(value, ignorenulls=True).over(w))
        last = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("kept"))
        if state is not None:
            out = out.join(state, keys, "left").withColumn(value, F.coalesce(value, "kept")).drop("kept")
            last = last.join(state.withColumnRenamed("kept", "old"), keys, "full").select(*keys, F.coalesce("kept", "old").alias("kept"))
        return out, last

    return fold(stream, step)


def fold(stream: DataFrame, step) -> DataFrame:
    """Run a stream to the end of its data; ``step`` takes a batch and the state table and gives output and new state.

    Output and state of a batch are written under its number in the shared scratch folder. A batch reads the
    state of the one before, so one that is run again after a failure gives the same files.
    """
    spark = stream.sparkSession
    base = scratch(spark)
    done: dict = {"schema": None, "state": None, "last": None}

    def write(rows: DataFrame, batch: int) -> None:
        state = spark.read.schema(done["state"]).parquet(f"{base}/state/batch={done['last']}") if done["last"] is not None else None
        out, kept = step(rows, state)
        out.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")
        kept.write.mode("overwrite").parquet(f"{base}/state/batch={batch}")
        done.update(schema=out.schema, state=kept.schema, last=batch)

    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(write).start().awaitTermination()
    if done["schema"] is None:
        return step(spark.createDataFrame([], stream.schema), None)[0]
    return spark.read.schema(done["schema"]).parquet(*[f"{base}/out/*"])


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming frame over all data that is there and return what it wrote.

    ``append`` writes Parquet files with the exactly-once file sink. ``complete`` and ``update`` results
    are written per batch; of ``complete`` the last batch is the result.
    """
    spark = stream.sparkSession
    base = scratch(spark)
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).outputMode(mode)
    last = {"batch": None}
    if mode == "append":
        writer.format("parquet").option("path", f"{base}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")
        last["batch"] = batch

    writer.foreachBatch(write).start().awaitTermination()
    if last["batch"] is None:
        return spark.createDataFrame([], stream.schema)
    tail = f"batch={last['batch']}" if mode == "complete" else "*"
    return spark.read.schema(stream.schema).parquet(f"{base}/out/{tail}")
