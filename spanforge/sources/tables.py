"""The driver's tables, and what stands in them for timelines, jobs and words.

The inputs of the operators (recipes, signals, ledgers) aren't among the tables, so queries read stand-ins; each has
the same definition in DataFrame form and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Microseconds for each hundredth of an event's value: durations of hours, so that ranges of a user overlap.
TICK = 10_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, us, kind, v (hundredths of the value)."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", us.alias("us"), F.col("event_type").alias("kind"), F.round(F.col("value") * 100).cast("long").alias("v"))


POINTS = "pts AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type AS kind, CAST(round(value * 100) AS BIGINT) AS v FROM events)"


def ranges(spark: SparkSession, sf_dir: str, kind: str, prefix: str = "") -> DataFrame:
    """user_id, id, start_us, end_us of the events of one kind; prefix goes before all but user_id."""
    p = points(spark, sf_dir).where(F.col("kind") == kind)
    return p.select("user_id", F.col("event_id").alias(f"{prefix}id"), F.col("us").alias(f"{prefix}start_us"), (F.col("us") + F.col("v") * TICK).alias(f"{prefix}end_us"))


def ranges_sql(name: str, kind: str, prefix: str = "") -> str:
    return f"{name} AS (SELECT user_id, event_id AS {prefix}id, us AS {prefix}start_us, us + v * {TICK} AS {prefix}end_us FROM pts WHERE kind = '{kind}')"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, pos, role, text, dur: turns as items of a sequence, a character lasting one unit."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", F.col("turn").alias("pos"), "role", "text", F.char_length("text").cast("long").alias("dur"))


TURNS = "turns AS (SELECT conv_id, turn AS pos, role, text, CAST(length(text) AS BIGINT) AS dur FROM conversations)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs of a usage ledger: id, invite, month, state, reserved_s, actual_s, bytes, created_ms, at (date)."""
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "reserved").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    seconds = F.floor(F.col("o_totalprice") / 100).cast("long")
    at = F.col("o_orderdate").cast("timestamp")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("invite"), F.date_format(at, "yyyy-MM").alias("month"), state.alias("state"), seconds.alias("reserved_s"), (seconds + F.col("o_orderkey") % 200 - 60).alias("actual_s"), (seconds * 700 + F.col("o_orderkey")).alias("bytes"), F.unix_millis(at).alias("created_ms"), F.col("o_orderpriority").alias("priority"))


JOBS = """jobs AS (SELECT o_orderkey AS id, o_custkey AS invite, strftime(o_orderdate, '%Y-%m') AS month,
  CASE o_orderstatus WHEN 'O' THEN 'reserved' WHEN 'P' THEN 'running' ELSE 'completed' END AS state,
  CAST(floor(o_totalprice / 100) AS BIGINT) AS reserved_s, CAST(floor(o_totalprice / 100) AS BIGINT) + o_orderkey % 200 - 60 AS actual_s,
  CAST(floor(o_totalprice / 100) AS BIGINT) * 700 + o_orderkey AS bytes, epoch_ms(o_orderdate) AS created_ms, o_orderpriority AS priority FROM orders)"""


def invites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as invites: invite, label, quota_s, used_s, revoked."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("invite"), F.col("c_name").alias("label"), (20000 + F.col("c_custkey") % 7 * 3000).alias("quota_s"), (F.col("c_custkey") % 5 * 1000).alias("used_s"), (F.col("c_acctbal") < 0).alias("revoked"))


INVITES = "invites AS (SELECT c_custkey AS invite, c_name AS label, 20000 + c_custkey % 7 * 3000 AS quota_s, c_custkey % 5 * 1000 AS used_s, c_acctbal < 0 AS revoked FROM customer)"
