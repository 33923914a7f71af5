"""Tables kept between the steps of a job, in the folder that all machines share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a new local one, in local mode only."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[[\d*,]+\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs run inside go when each has written its table."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage ends there.

    A lost executor then costs only the tasks of the step at hand. Whoever keeps the folder
    clears it; discard() removes what is known to be of no more use.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffle_cleanup(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.kept_path = path
    return table


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, whatever file system it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Remove kept tables that nothing reads any more; others are left alone."""
    for t in tables:
        if path := getattr(t, "kept_path", None):
            remove(t.sparkSession, path)
