"""A stream replayed over the events table."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.segments import SESSION
from ..registry import query
from ..sources.staging import new_folder
from ..sources.tables import POINTS, points, table
from . import windows


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("l6_hourly_attempts_stream", "SELECT user_id, us // 3600000000 AS win, count(*) AS n FROM pts GROUP BY ALL", (POINTS,))
def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly counter as a streaming job over all that is there: its complete state, as batch gives it. Executors
    write the state and each batch's table under spark.checkpoint.dir; a batch that runs again overwrites its own."""
    folder = new_folder(spark, "stream")
    counts, last = windows.hourly_attempts(_replayed(spark, sf_dir)), []

    def write(rows: DataFrame, batch: int) -> None:
        path = f"{folder}/table/{batch}"
        rows.write.mode("overwrite").parquet(path)
        last[:] = [path]

    counts.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(*last) if last else spark.createDataFrame([], counts.schema)


@query("s10_gap_sessions_stream", "SELECT user_id, any_value(kind) AS kind, min(us) AS start_us, max(e) AS end_us, count(*) AS n FROM sess GROUP BY user_id, session", (POINTS, SESSION))
def sessions(spark: SparkSession, sf_dir: str, batches: int = 3) -> DataFrame:
    """Gap sessions of all events as a streaming job that is started again for each of `batches` stretches of time as they
    come in, and goes on from its state. A last row of nobody's, a year on, moves the watermark past the last sessions."""
    folder = new_folder(spark, "stream")
    rows = points(spark, sf_dir).withColumn("e", F.col("us") + F.col("v") * 100_000).select("user_id", "kind", F.timestamp_micros("us").alias("ts"), "us", "e")
    low, high = rows.agg(F.min("us"), F.max("us")).first()
    if low is None:
        return rows.select("user_id", "kind", F.col("us").alias("start_us"), F.col("e").alias("end_us"), F.lit(1).cast("long").alias("n"))
    edges = [low + (high - low + 1) * k // batches for k in range(batches + 1)]
    parts = [rows.where((F.col("us") >= a) & (F.col("us") < b)) for a, b in itertools.pairwise(edges)]
    end = high + 365 * 86_400_000_000
    parts.append(spark.createDataFrame([(-1, "end", end, end)], "user_id long, kind string, us long, e long").select("user_id", "kind", F.timestamp_micros("us").alias("ts"), "us", "e"))
    with windows.keyed_state(spark):
        for k, part in enumerate(parts):
            part.write.parquet(f"{folder}/in/{k}")
            stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in/*")
            got = windows.gap_sessions(stream, 3_600_000_000)
            got.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(got.schema).parquet(f"{folder}/out").where("user_id >= 0")
