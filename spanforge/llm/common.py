"""What the training-data operators share: reading tables, staging results on shared storage, shipping code."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch sent to Python. Texts may hold a hundred kilobytes each, so batches stay short.
BATCH_ROWS, BATCH_BYTES = 500, 32 << 20
#: Separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches, for the whole session, and makes this package importable on executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root in os.environ.get("PYTHONPATH", "").split(":"):
        return
    context = spark.sparkContext
    if any("spanforge" in x for x in context._python_includes):
        return
    to = os.path.join(tempfile.mkdtemp(), "spanforge.zip")
    with zipfile.ZipFile(to, "w") as z:
        for top, _, names in os.walk(os.path.join(root, "spanforge")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(top, n), os.path.relpath(os.path.join(top, n), root))
    context.addPyFile(to)


#: Folders that operators of this process wrote; release() removes them.
_WRITTEN: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. In local mode, as in tests, a folder of our own where that is unset; on a
    cluster executors couldn't read it, so there it has to be set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spanforge-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, what: str = "stage") -> str:
    path = f"{shared_folder(spark)}/spanforge-{what}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def staged(df: DataFrame) -> tuple[DataFrame, str]:
    """Writes df as Parquet to the shared folder and reads it back: this cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame) -> DataFrame:
    return staged(df)[0]


def release(spark: SparkSession) -> None:
    """Removes all that operators wrote to the shared folder, once their results aren't needed any more."""
    for path in list(_WRITTEN):
        unstage(spark, path)


def unstage(spark: SparkSession, path: str) -> None:
    """Removes what staged() wrote."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _WRITTEN.discard(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Partitions for a shuffle that names its number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trimmed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, which gives the memory that it has freed back to the system at its end: Python workers are kept between tasks."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(it)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null reads as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def batches(rows: Iterable[dict], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    """Dict rows as Arrow batches of bounded length."""
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)
