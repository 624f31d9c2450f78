"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder takes its place, but on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="meander-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a table that lasts as long as this process: tables are deleted when it ends in good order."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of any store that Spark writes to."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the session may have ended before
            delete(spark, path)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """The table, to be joined by shuffles: compressed files of ids look so small that Spark would send millions of rows
    through the driver to all tasks. Aggregations and projections keep that, unions do not."""
    return df.hint("merge")


def stash_observed(df: DataFrame, name: str, found: dict[str, Column]) -> tuple[DataFrame, dict, str]:
    """stash(), aggregates of what was written, observed by the same job, and the path, for forget().

    A stage that ran again may count rows twice, so numbers say whether something has changed, not how many there are.
    """
    seen = Observation()
    observed = df.observe(seen, *[c.alias(k) for k, c in found.items()])
    spark = df.sparkSession
    path = new_folder(spark, name)
    observed.write.parquet(path)
    return dealt(spark.read.schema(df.schema).parquet(path)), dict(seen.get), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    delete(spark, path)
    if (spark, path) in _made:
        _made.remove((spark, path))
