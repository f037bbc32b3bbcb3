"""Tables and folders that a job writes for itself on shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: set[str] = set()


def new_folder(spark: SparkSession, what: str = "stage") -> str:
    """A new folder under spark.checkpoint.dir. In local mode, as in tests, a local one where that is unset; on a cluster
    executors couldn't read it, so there it has to be set. release() removes it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    named = named or "file://" + tempfile.mkdtemp(prefix="spanforge-")
    path = f"{named.rstrip('/')}/spanforge-{what}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def staged(df: DataFrame) -> DataFrame:
    """df, written as Parquet and read again: what went before isn't computed a second time, and lost executors cost a re-read."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Removes what was written, once results aren't needed any more."""
    for path in list(_WRITTEN):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _WRITTEN.discard(path)
