"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a folder of our own is made, which is right
    only if all run on one machine; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    where = os.path.realpath(tempfile.mkdtemp(prefix="weightscope-"))
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{where}")
    return f"file://{where}"


_runs: set[str] = set()


def run_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one. It goes when the application ends."""
    where = f"{shared_dir(spark)}/weightscope-{spark.sparkContext.applicationId}"
    if where not in _runs:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _runs.add(where)
    return where


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the run's folder that nothing has used yet."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Bytes of a row group of an intermediate table: what a task holds of it while writing.
ROW_GROUP = 32 << 20


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, so that plans on it stay small and what follows survives
    the loss of any executor without computing ``df`` again.
    """
    path = new_path(df.sparkSession, label)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys that may each have more than one of so many parts of all rows: fewer than that many.
HOT_SHARE = 1000


def join_hot(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row a key and in ``count`` the rows of ``left`` that have it.

    A key with over one in ``HOT_SHARE`` of all rows of ``left`` is joined by
    broadcast, so that its rows stay where they are: there are fewer than
    ``HOT_SHARE`` such keys whatever the data. The rest is shuffled.
    """
    most = right.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0] // HOT_SHARE
    hot = F.broadcast(right.where(F.col(count) > most))
    if not most:
        return left.join(right, key)
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(right.where(F.col(count) <= most), key))


#: Jobs of one scan that run side by side; they wait for each other's planning more than for the cluster.
SIDE_BY_SIDE = 8


def together(*tasks: Callable):
    """Results of functions that start Spark jobs of their own, run side by side, in order."""
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        return [f.result() for f in [pool.submit(t) for t in tasks]]


def all_stored(label: str, dfs: Iterable[DataFrame]) -> list[DataFrame]:
    """``stored`` of several tables at once."""
    return together(*[partial(stored, df, label) for df in dfs])
