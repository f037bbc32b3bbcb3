"""A usage ledger: reservations, settlement, quotas, rate windows and reports over tables of jobs and invites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import cost_micro
from ..registry import query
from ..sources.tables import INVITES, JOBS, POINTS, invites, jobs, points, table

OPEN = ("reserved", "running")
PRICE = 210_000
HOUR_MS = 3_600_000
NOW_MS = 900_000_000_000
# The longest job, and the age at which a reservation is released.
LONGEST_JOB_S, STALE_MS = 4500, 1_800_000
_OPEN = "state IN ('reserved', 'running')"
_COST = f"CAST((reserved_s * {PRICE} + 3599) // 3600 AS BIGINT)"
_RATE = f"rate AS (SELECT user_id, us // {HOUR_MS * 1000} AS win, count(*) AS n, max(us) // 1000 AS last_ms FROM pts GROUP BY ALL)"


def rate_windows(attempts: DataFrame, who: str, us: str) -> DataFrame:
    """Attempts by who and clock hour: who, win, n, last_ms."""
    win = F.floor(F.col(us) / (HOUR_MS * 1000)).cast("long")
    return attempts.groupBy(who, win.alias("win")).agg(F.count("*").alias("n"), F.floor(F.max(us) / 1000).cast("long").alias("last_ms"))


def early_delete_seconds(reserved_s: Column, size: Column, slack: int = 60) -> Column:
    """What a job that is deleted early is charged: its size at 750 bytes a second, between the reservation and that plus a slack."""
    return F.greatest(reserved_s, F.least(F.ceil(size / 750).cast("long"), reserved_s + slack))


def decided(attempts: DataFrame, ledger: DataFrame, limits: DataFrame, tries: DataFrame, enabled: bool, price: int, cap_micro: int, per_hour: int, now_ms: int) -> DataFrame:
    """id, verdict of attempts (id, invite, month, seconds; each by itself, against the ledger as it is), by the first rule
    that refuses: too many tries of the invite in its hour (tries: invite, n), service off, invite unknown or revoked,
    a job in progress (reservations older than half an hour are released first), too long, minutes of the invite used
    up, monthly cap reached by all invites together, id taken. Facts are aggregated by invite and month before they
    are joined, so nothing is multiplied."""
    live = ledger.withColumn("state", F.when((F.col("state") == "reserved") & (F.col("created_ms") < now_ms - STALE_MS), "failed").otherwise(F.col("state")))
    held = live.where(F.col("state").isin(*OPEN))
    by_invite = held.groupBy("invite").agg(F.count("*").alias("active"), F.sum("reserved_s").alias("held_s"))
    spent = F.when(F.col("state").isin(*OPEN), cost_micro(F.col("reserved_s"), price)).when(F.col("state") == "completed", cost_micro(F.greatest("actual_s", F.lit(0)), price)).otherwise(0)
    by_month = live.groupBy("month").agg(F.sum(spent).alias("spent"))
    known = limits.select("invite", "quota_s", "used_s", "revoked")
    x = attempts.join(tries.select("invite", F.col("n").alias("tries")), "invite", "left").join(known, "invite", "left").join(by_invite, "invite", "left").join(by_month, "month", "left")
    x = x.join(ledger.select("id", F.lit(True).alias("taken")).distinct(), "id", "left")
    zero, seconds = F.lit(0).cast("long"), F.ceil("seconds").cast("long")
    rules = [
        ("rate_limited", F.coalesce("tries", zero) > per_hour),
        ("cloud_off", F.lit(not enabled or cap_micro <= 0)),
        ("invite_invalid", F.coalesce("revoked", F.lit(True))),
        ("job_in_progress", F.coalesce("active", zero) > 0),
        ("too_long", seconds > LONGEST_JOB_S),
        ("invite_minutes_used_up", F.col("used_s") + F.coalesce("held_s", zero) + seconds > F.col("quota_s")),
        ("monthly_cap_reached", F.coalesce("spent", zero) + cost_micro(seconds, price) > cap_micro),
        ("job_id_taken", F.coalesce("taken", F.lit(False))),
    ]
    return x.select("id", F.coalesce(*(F.when(rule, code) for code, rule in rules), F.lit("accepted")).alias("verdict"))


@query("l1_keyed_lookup", "SELECT id, invite, state, reserved_s FROM jobs WHERE id = 77", (JOBS,))
def l1(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).where("id = 77").select("id", "invite", "state", "reserved_s").limit(1)


@query("l2_month_reserved", f"SELECT coalesce(sum({_COST}), 0)::BIGINT AS total FROM jobs WHERE month = '1997-05' AND {_OPEN}", (JOBS,))
def l2(spark: SparkSession, d: str) -> DataFrame:
    own = jobs(spark, d).where((F.col("month") == "1997-05") & F.col("state").isin(*OPEN))
    return own.agg(F.coalesce(F.sum(cost_micro(F.col("reserved_s"), PRICE)), F.lit(0).cast("long")).alias("total"))


@query("l3_invite_reserved", f"SELECT invite, sum(reserved_s)::BIGINT AS reserved_s FROM jobs WHERE {_OPEN} GROUP BY invite", (JOBS,))
def l3(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).where(F.col("state").isin(*OPEN)).groupBy("invite").agg(F.sum("reserved_s").alias("reserved_s"))


@query("l4_active_jobs", f"SELECT count(*) FILTER ({_OPEN}) AS active, count(*) FILTER (state = 'running') AS running FROM jobs", (JOBS,))
def l4(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).agg(F.count_if(F.col("state").isin(*OPEN)).alias("active"), F.count_if(F.col("state") == "running").alias("running"))


@query("l5_stale_reservations", f"SELECT id, CASE WHEN state = 'reserved' AND created_ms < {NOW_MS} - 1800000 THEN 'failed' ELSE state END AS state FROM jobs", (JOBS,))
def l5(spark: SparkSession, d: str) -> DataFrame:
    stale = (F.col("state") == "reserved") & (F.col("created_ms") < NOW_MS - 1_800_000)
    return jobs(spark, d).select("id", F.when(stale, "failed").otherwise(F.col("state")).alias("state"))


@query("l6_hourly_attempts", "SELECT user_id, win, n FROM rate", (POINTS, _RATE))
def l6(spark: SparkSession, d: str) -> DataFrame:
    return rate_windows(points(spark, d), "user_id", "us").select("user_id", "win", "n")


@query("l7_rate_verdict", f"SELECT user_id, win, n > 1 AS limited, CASE WHEN n > 1 THEN CAST(ceil(((win + 1) * {HOUR_MS} - last_ms) / 1000.0) AS BIGINT) END AS retry_s FROM rate", (POINTS, _RATE))
def l7(spark: SparkSession, d: str) -> DataFrame:
    over = F.col("n") > 1
    retry = F.ceil(((F.col("win") + 1) * HOUR_MS - F.col("last_ms")) / 1000).cast("long")
    return rate_windows(points(spark, d), "user_id", "us").select("user_id", "win", over.alias("limited"), F.when(over, retry).alias("retry_s"))


_TRIES = "tries AS (SELECT o_custkey AS invite, count(*) AS n FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1)"
_CHAIN = f"""live AS (SELECT * REPLACE (CASE WHEN state = 'reserved' AND created_ms < {NOW_MS} - 1800000 THEN 'failed' ELSE state END AS state) FROM jobs),
held AS (SELECT invite, count(*) AS active, sum(reserved_s) AS held_s FROM live WHERE {_OPEN} GROUP BY 1),
spent AS (SELECT month, sum(CASE WHEN {_OPEN} THEN {_COST} WHEN state = 'completed' THEN (greatest(actual_s, 0) * {PRICE} + 3599) // 3600 ELSE 0 END) AS spent FROM live GROUP BY 1),
tried AS (SELECT c_custkey * 7 AS id, c_custkey + c_custkey % 20 // 19 * 10000000 AS invite, '199' || c_custkey % 9 || '-0' || (1 + c_custkey % 9) AS month, 200 + c_custkey * 37 % 4600 AS seconds FROM customer)"""


@query("l8_admission_chain", f"""SELECT t.id, CASE WHEN coalesce(r.n, 0) > 4 THEN 'rate_limited' WHEN coalesce(i.revoked, true) THEN 'invite_invalid' WHEN coalesce(h.active, 0) > 0 THEN 'job_in_progress' WHEN seconds > 4500 THEN 'too_long'
WHEN i.used_s + coalesce(h.held_s, 0) + seconds > i.quota_s THEN 'invite_minutes_used_up' WHEN coalesce(s.spent, 0) + (seconds * {PRICE} + 3599) // 3600 > 9000000 THEN 'monthly_cap_reached' WHEN EXISTS (SELECT 1 FROM jobs j WHERE j.id = t.id) THEN 'job_id_taken' ELSE 'accepted' END AS verdict
FROM tried t LEFT JOIN tries r ON t.invite = r.invite LEFT JOIN invites i ON t.invite = i.invite LEFT JOIN held h ON t.invite = h.invite LEFT JOIN spent s ON t.month = s.month""", (JOBS, INVITES, _TRIES, _CHAIN))
def l8_chain(spark: SparkSession, d: str) -> DataFrame:
    """One attempt of each customer, some under invites that aren't known."""
    k = F.col("c_custkey")
    month = F.concat(F.lit("199"), k % 9, F.lit("-0"), 1 + k % 9)
    tried = table(spark, d, "customer").select((k * 7).alias("id"), F.expr("c_custkey + (c_custkey % 20) div 19 * 10000000").alias("invite"), month.alias("month"), (200 + k * 37 % 4600).alias("seconds"))
    tries = jobs(spark, d).where("id % 4 = 0").groupBy("invite").agg(F.count("*").alias("n"))
    return decided(tried, jobs(spark, d), invites(spark, d), tries, True, PRICE, 9_000_000, 4, NOW_MS)


@query("l9_insert_reservation", f"SELECT id, invite, state, reserved_s FROM jobs WHERE {_OPEN} UNION ALL SELECT c_custkey + 1000000, c_custkey, 'reserved', 600 FROM customer", (JOBS,))
def l9(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "customer").select((F.col("c_custkey") + 1_000_000).alias("id"), F.col("c_custkey").alias("invite"), F.lit("reserved").alias("state"), F.lit(600).cast("long").alias("reserved_s"))
    return jobs(spark, d).where(F.col("state").isin(*OPEN)).select("id", "invite", "state", "reserved_s").unionByName(new)


@query("l10_attach", "SELECT id, CASE WHEN state = 'reserved' AND id % 3 = 0 THEN 'running' ELSE state END AS state, state = 'reserved' AND id % 3 = 0 AS written FROM jobs", (JOBS,))
def l10(spark: SparkSession, d: str) -> DataFrame:
    """Every third job gets its transcript: only reserved ones start to run."""
    asked = jobs(spark, d).where("id % 3 = 0").select("id", F.lit(True).alias("asked"))
    got = jobs(spark, d).join(asked, "id", "left").withColumn("written", (F.col("state") == "reserved") & F.coalesce("asked", F.lit(False)))
    return got.select("id", F.when(F.col("written"), "running").otherwise(F.col("state")).alias("state"), "written")


_SETTLED = f"settled AS (SELECT *, CAST((greatest(actual_s, 0) * {PRICE} + 3599) // 3600 AS BIGINT) AS charged FROM jobs WHERE state = 'completed')"


def _settled(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).where("state = 'completed'").withColumn("charged", cost_micro(F.greatest("actual_s", F.lit(0)), PRICE))


@query("l11_settlement", "SELECT month, sum(charged)::BIGINT AS spent_micro, count(*) AS jobs, sum(actual_s)::BIGINT AS seconds FROM settled GROUP BY month", (JOBS, _SETTLED))
def l11(spark: SparkSession, d: str) -> DataFrame:
    return _settled(spark, d).groupBy("month").agg(F.sum("charged").alias("spent_micro"), F.count("*").alias("jobs"), F.sum("actual_s").alias("seconds"))


@query("l12_upsert_by_month", "SELECT month, sum(c)::BIGINT AS spent_micro, sum(n)::BIGINT AS jobs FROM (SELECT month, charged AS c, 1 AS n FROM settled WHERE id % 2 = 0 UNION ALL SELECT month, charged, 1 FROM settled WHERE id % 2 = 1) GROUP BY month", (JOBS, _SETTLED))
def l12(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the even jobs, brought up to date by those of the odd ones."""
    s = _settled(spark, d)
    held, more = (s.where(F.col("id") % 2 == k).groupBy("month").agg(F.sum("charged").alias("spent_micro"), F.count("*").alias("jobs")) for k in (0, 1))
    return held.unionByName(more).groupBy("month").agg(F.sum("spent_micro").alias("spent_micro"), F.sum("jobs").alias("jobs"))


@query("l13_early_delete", "SELECT id, greatest(reserved_s, least(CAST(ceil(bytes / 750.0) AS BIGINT), reserved_s + 60)) AS seconds FROM jobs", (JOBS,))
def l13(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).select("id", early_delete_seconds(F.col("reserved_s"), F.col("bytes")).alias("seconds"))


@query("l14_overruns", "SELECT id, invite FROM jobs WHERE state = 'completed' AND actual_s > reserved_s * 1.02 + 3", (JOBS,))
def l14(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).where("state = 'completed' AND actual_s > reserved_s * 1.02 + 3").select("id", "invite")


@query("l15_quota_left", f"""SELECT i.invite, greatest(0, least(i.quota_s - i.used_s - coalesce(r.s, 0), 9000)) AS left_s
FROM invites i LEFT JOIN (SELECT invite, sum(reserved_s)::BIGINT AS s FROM jobs WHERE {_OPEN} GROUP BY 1) r ON i.invite = r.invite WHERE NOT i.revoked""", (JOBS, INVITES))
def l15(spark: SparkSession, d: str) -> DataFrame:
    got = invites(spark, d).where("NOT revoked").join(l3(spark, d), "invite", "left")
    left = F.col("quota_s") - F.col("used_s") - F.coalesce("reserved_s", F.lit(0))
    return got.select("invite", F.greatest(F.lit(0).cast("long"), F.least(left, F.lit(9000).cast("long"))).alias("left_s"))


@query("l16_prefix_revoke", "SELECT invite, revoked OR starts_with(label, 'Customer#0000001') AS revoked FROM invites", (INVITES,))
def l16(spark: SparkSession, d: str) -> DataFrame:
    return invites(spark, d).select("invite", (F.col("revoked") | F.startswith("label", F.lit("Customer#0000001"))).alias("revoked"))


@query("l17_last_value", "SELECT user_id, max_by(kind, (us, event_id)) AS value FROM pts GROUP BY user_id", (POINTS,))
def l17(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).groupBy("user_id").agg(F.max_by("kind", F.struct("us", "event_id")).alias("value"))


@query("l18_spend_report", "SELECT month, round(spent / 1000000.0, 4)::DOUBLE AS usd, jobs, seconds // 60 AS minutes FROM (SELECT month, sum(charged)::BIGINT AS spent, count(*) AS jobs, sum(actual_s)::BIGINT AS seconds FROM settled GROUP BY month ORDER BY month DESC LIMIT 12)", (JOBS, _SETTLED))
def l18(spark: SparkSession, d: str) -> DataFrame:
    last = l11(spark, d).orderBy(F.col("month").desc()).limit(12)
    return last.select("month", F.round(F.col("spent_micro") / 1000000.0, 4).alias("usd"), "jobs", F.floor(F.col("seconds") / 60).cast("long").alias("minutes"))


@query("l19_invite_report", "SELECT invite, substr(label, 1, 12) AS short, CASE WHEN revoked THEN 'by hand' END AS reason FROM invites", (INVITES,))
def l19(spark: SparkSession, d: str) -> DataFrame:
    return invites(spark, d).select("invite", F.substring("label", 1, 12).alias("short"), F.when(F.col("revoked"), "by hand").alias("reason")).orderBy("invite")


@query("l20_retention", f"SELECT id FROM jobs WHERE NOT (created_ms < {NOW_MS} - 7776000000 AND (state = 'completed' OR id % 2 = 0))", (JOBS,))
def l20(spark: SparkSession, d: str) -> DataFrame:
    gone = (F.col("created_ms") < NOW_MS - 7_776_000_000) & ((F.col("state") == "completed") | (F.col("id") % 2 == 0))
    return jobs(spark, d).where(~gone).select("id")


@query("l21_work_queue", f"SELECT id, state FROM jobs WHERE ({_OPEN} AND created_ms < {NOW_MS}) OR bytes > 3400000 ORDER BY created_ms, id LIMIT 20", (JOBS,))
def l21(spark: SparkSession, d: str) -> DataFrame:
    due = (F.col("state").isin(*OPEN) & (F.col("created_ms") < NOW_MS)) | (F.col("bytes") > 3_400_000)
    return jobs(spark, d).where(due).orderBy("created_ms", "id").limit(20).select("id", "state")


@query("l22_pending", f"SELECT count(*) FILTER ({_OPEN}) + count(*) FILTER (state = 'completed' AND id % 10 = 0) AS pending FROM jobs", (JOBS,))
def l22(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).agg((F.count_if(F.col("state").isin(*OPEN)) + F.count_if((F.col("state") == "completed") & (F.col("id") % 10 == 0))).alias("pending"))


@query("l23_cost", f"SELECT id, {_COST} AS micro FROM jobs", (JOBS,))
def l23(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).select("id", cost_micro(F.col("reserved_s"), PRICE).alias("micro"))


@query("l24_rate_card", """SELECT invite, round(max(p) + CASE WHEN bool_or(priority LIKE '1%') THEN 0.1 ELSE 0 END, 6)::DOUBLE AS usd_per_hour
FROM (SELECT invite, priority, CASE state WHEN 'reserved' THEN 0.12 WHEN 'running' THEN 0.27 ELSE 0.15 END AS p FROM jobs) GROUP BY invite""", (JOBS,))
def l24(spark: SparkSession, d: str) -> DataFrame:
    """The dearest model that an invite uses, plus add-ons; the price table is joined by name."""
    prices = spark.createDataFrame([("reserved", 0.12), ("running", 0.27), ("completed", 0.15)], "state string, p double")
    extra = F.when(F.bool_or(F.col("priority").startswith("1")), 0.1).otherwise(0.0)
    return jobs(spark, d).join(F.broadcast(prices), "state").groupBy("invite").agg(F.round(F.max("p") + extra, 6).alias("usd_per_hour"))


@query("l25_run_totals", "SELECT count(*) AS files, sum(reserved_s)::BIGINT AS seconds, count(*) FILTER (state = 'completed') AS done, count(*) FILTER (actual_s > reserved_s) AS longer FROM jobs", (JOBS,))
def l25(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).agg(F.count("*").alias("files"), F.sum("reserved_s").alias("seconds"), F.count_if(F.col("state") == "completed").alias("done"), F.count_if(F.col("actual_s") > F.col("reserved_s")).alias("longer"))


@query("l26_minutes_verdict", "SELECT j.id, CASE WHEN i.revoked THEN 'off' WHEN j.reserved_s > 4500 THEN 'too_long' WHEN j.reserved_s > i.quota_s - i.used_s - 15000 THEN 'not_enough' ELSE 'fits' END AS verdict FROM jobs j JOIN invites i ON j.invite = i.invite", (JOBS, INVITES))
def l26(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("reserved_s")
    verdict = F.when(F.col("revoked"), "off").when(s > 4500, "too_long").when(s > F.col("quota_s") - F.col("used_s") - 15000, "not_enough").otherwise("fits")
    return jobs(spark, d).join(invites(spark, d), "invite").select("id", verdict.alias("verdict"))


@query("l27_failure_class", """SELECT id, coalesce(CASE priority WHEN '1-URGENT' THEN 'limit' WHEN '2-HIGH' THEN 'credit' END, CASE WHEN state = 'completed' THEN 'unknown' ELSE 'retry' END) AS failure FROM jobs""", (JOBS,))
def l27(spark: SparkSession, d: str) -> DataFrame:
    """The class of a code by table, else of the state."""
    codes = spark.createDataFrame([("1-URGENT", "limit"), ("2-HIGH", "credit")], "priority string, failure string")
    other = F.when(F.col("state") == "completed", "unknown").otherwise("retry")
    return jobs(spark, d).join(F.broadcast(codes), "priority", "left").select("id", F.coalesce("failure", other).alias("failure"))
