"""Readers for the engine's tables and the scratch folder that long jobs write to."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_memloom_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="memloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/memloom_package.zip", "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(f.relative_to(package.parent)))
    sc.addPyFile(f"{folder}/memloom_package.zip")
    sc._memloom_shipped = True


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a data folder.

    Instants are compared in UTC throughout, so the session zone is pinned here; zoneless Parquet
    timestamps then mean the same moment as the ISO texts that carry an offset.
    """
    ship(spark)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that costs much per row.

    Input that is already cut finely, as any large table is, stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the one the cluster shares (``spark.checkpoint.dir``); ``clear`` removes it when the program ends.

    Only a local session that names no such folder, as in tests, gets a temporary one; on a cluster that is an error,
    since a folder of one machine would be lost with it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="memloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", "file://" + os.path.abspath(base))
        base = spark.conf.get("spark.checkpoint.dir")
    path = f"{base.rstrip('/')}/memloom-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clear, spark)
    _written.append(path)
    return path


_written: list[str] = []


def clear(spark: SparkSession) -> None:
    """Delete all scratch folders of this program. Results that still read them are lost, so call it last."""
    while _written:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended before: the folder stays for the cluster's own cleaning
            return


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage with a table every executor can reach, so the loss of an executor costs a
    re-read, not the work before it.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, root: str, name: str, make) -> DataFrame:
    """The materialized table that ``make`` builds from a data folder, once per session while the files stay as they are.

    For indexes that many queries share; a changed, added or removed file builds it anew.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    stamp = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))
    at = (spark.sparkContext.applicationId, root, name)
    got = _built.get(at)
    if not got or got[0] != stamp:
        got = _built[at] = (stamp, make())
    return got[1]


_built: dict = {}


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that no later plan reads."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
