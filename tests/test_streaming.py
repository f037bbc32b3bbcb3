"""The streaming job: where its table and its state are kept."""

import random
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import functions as F
from spanforge.streaming.queries import hourly
from spanforge.streaming.windows import gap_sessions, keyed_state

SF = "/root/testdata/sf0.001"


def test_table_is_in_files_with_the_state_beside_it(spark):
    before = {t.name for t in spark.catalog.listTables()}
    got = hourly(spark, SF)
    assert {t.name for t in spark.catalog.listTables()} == before
    files = got.inputFiles()
    assert files
    folder = Path(urlparse(files[0]).path).parents[2]
    assert list(folder.glob("state/state/0/*")) and list(folder.glob("state/commits/*"))
    assert sum(r.n for r in got.collect()) == spark.read.parquet(f"{SF}/events.parquet").count()


def test_sessions_of_a_stream_are_those_of_batch(spark, tmp_path):
    """Rows of a user in several files, one micro-batch each; the last session of each user stays open."""
    rng, rows, at = random.Random(9), [], 0
    for k in range(300):
        at += rng.choice([1, 5, 40, 400])
        rows.append((rng.randrange(4), rng.choice("ab"), at, at + rng.choice([0, 3, 30, 60])))
    schema = "user_id long, kind string, us long, e long"
    for k in range(6):
        part = spark.createDataFrame(rows[k * 50 : k * 50 + 50], schema).withColumn("ts", F.timestamp_micros(F.col("us") * 1000))
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(part.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with keyed_state(spark):
        got = gap_sessions(stream, 50, "1 hour")
        got.writeStream.format("memory").queryName("own_sessions").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    want, open_ = [], {}
    for u, kind, us, e in rows:
        s = open_.get(u)
        if s and s[0] == kind and us - s[4] <= 50:
            open_[u] = [kind, s[1], max(s[2], e), s[3] + 1, e]
        else:
            if s:
                want.append((u, *s[:4]))
            open_[u] = [kind, us, e, 1, e]
    assert sorted(tuple(r) for r in spark.table("own_sessions").collect()) == sorted(want)
    spark.sql("DROP VIEW IF EXISTS own_sessions")


def test_users_that_share_a_state_keep_their_own_sessions(spark, tmp_path):
    """Forty users and nobody's rows in three states: one call of Python for a state and micro-batch, not for a user."""
    rng, rows, at = random.Random(3), [], 0
    for _ in range(600):
        at += rng.choice([1, 2, 9])
        rows.append((rng.choice([None, *range(-5, 35)]), rng.choice("aab"), at, at + rng.choice([0, 3, 30, 60])))
    for k in range(3):
        part = spark.createDataFrame(rows[k * 200 : k * 200 + 200], "user_id long, kind string, us long, e long").withColumn("ts", F.timestamp_micros(F.col("us") * 1000))
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(part.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with keyed_state(spark):
        got = gap_sessions(stream, 50, "1 hour", buckets=3)
        q = got.writeStream.format("memory").queryName("shared_sessions").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    want, open_ = [], {}
    for u, kind, us, e in rows:
        s = open_.get(u)
        if s and s[0] == kind and us - s[4] <= 50:
            open_[u] = [kind, s[1], max(s[2], e), s[3] + 1, e]
        else:
            if s:
                want.append((u, *s[:4]))
            open_[u] = [kind, us, e, 1, e]
    assert sorted((tuple(r) for r in spark.table("shared_sessions").collect()), key=str) == sorted(want, key=str)
    spark.sql("DROP VIEW IF EXISTS shared_sessions")
