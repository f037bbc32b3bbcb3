"""A log of attempts replayed against a usage ledger: every rule, also those that invites share."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import cost_micro
from ..registry import query
from ..sources.staging import staged
from ..sources.tables import invites, jobs
from .folds import folded
from .ledger import HOUR_MS, LONGEST_JOB_S, PRICE, STALE_MS

#: What a refusal by one of the rules that invites share is called; an invite's own rules come before them.
CAP, TAKEN = "monthly_cap_reached", "job_id_taken"


def _own_rules(used: tuple, row: tuple) -> tuple[tuple, str]:
    """An invite's rules for one attempt. The state: seconds used so far; when the job in progress frees the invite, and the
    seconds it is charged then. An attempt that a shared rule refused takes nothing."""
    seconds_used, free_at, charge = used
    at, seconds, early, quota, shared, frees, actual = row
    if early:
        return used, early
    if free_at is not None and free_at <= at:
        seconds_used, free_at, charge = seconds_used + charge, None, 0
    if free_at is not None:
        verdict = "job_in_progress"
    elif seconds > LONGEST_JOB_S:
        verdict = "too_long"
    elif seconds_used + seconds > quota:
        verdict = "invite_minutes_used_up"
    else:
        verdict = shared or "accepted"
        if not shared:
            free_at, charge = frees, actual
    return (seconds_used, free_at, charge), verdict


def replayed(attempts: DataFrame, limits: DataFrame, spent: DataFrame, ids: DataFrame, price: int, cap_micro: int, per_hour: int, enabled: bool = True, rounds: int = 1000) -> DataFrame:
    """n, verdict of each attempt of a log, each decided against what the ones before it left, in order of at_ms and n.

    attempts: n (a number of its own), id (the job's name), who, invite, at_ms, seconds, end_ms and actual_s (when the job
    ends if it is admitted, and the seconds it is charged then; end_ms null: nobody takes it up, so its reservation is
    released when it is half an hour old). limits: invite, quota_s, used_s, revoked. spent: month, micro, ids: id, of the
    ledger before the log. The rules, the first that refuses telling: attempts of `who` in the hour over per_hour (all
    count), service off, invite unknown or revoked, a job in progress, too long, minutes of the invite used up, cap of the
    month over all invites (open reservations count in full), id taken by any job before. Rounds up of seconds and costs
    are the ledger's. An empty log gives no rows; a null end, quota or who is as said, or a group like any other.

    Rules of one invite are a fold over its attempts. The shared ones depend on all invites in time order, so they are
    found by going round: fold the invites with the refusals known so far; take the attempts that got as far as the cap,
    and fold the months over them (a sum and the open reservations, of months only that could reach their cap at all);
    let the first job of a name have it; till the refusals are the same again. What precedes the first wrong refusal is
    right, so each round makes at least the next one right, and in practice nearly all. Attempts stream through both
    folds: no task holds an invite's or a month's.
    """
    x = attempts.withColumn("seconds", F.ceil("seconds").cast("long")).withColumn("month", F.date_format(F.timestamp_millis("at_ms"), "yyyy-MM"))
    count = F.row_number().over(Window.partitionBy("who", F.floor(F.col("at_ms") / HOUR_MS)).orderBy("at_ms", "n"))
    known = limits.dropDuplicates(["invite"]).select("invite", F.coalesce("quota_s", F.lit(0)).cast("long").alias("quota_s"), F.coalesce("used_s", F.lit(0)).cast("long").alias("used_s"), F.coalesce("revoked", F.lit(False)).alias("revoked"), F.lit(True).alias("known"))
    x = x.withColumn("_count", count).join(known, "invite", "left")
    off = not enabled or cap_micro <= 0
    early = F.when(F.col("_count") > per_hour, "rate_limited").when(F.lit(off), "cloud_off").when(F.col("known").isNull() | F.col("revoked"), "invite_invalid")
    free = F.when(F.col("end_ms").isNull(), F.col("at_ms") + STALE_MS + 1).otherwise(F.col("end_ms"))
    charged = F.when(F.col("end_ms").isNull(), F.lit(0)).otherwise(F.greatest(F.coalesce("actual_s", F.lit(0)), F.lit(0))).cast("long")
    x = x.select("n", "id", "invite", "at_ms", "seconds", "month", early.alias("early"), (F.col("quota_s") - F.col("used_s")).alias("left_s"), free.alias("frees_ms"), charged.alias("charged_s"))
    x = x.withColumn("cost", cost_micro(F.col("seconds"), price)).withColumn("charge", cost_micro(F.col("charged_s"), price))
    x = staged(x.join(ids.select("id", F.lit(True).alias("had")).distinct(), "id", "left"))
    before = spent.groupBy("month").agg(F.sum("micro").alias("micro"))
    shared = x.select("n", F.lit(None).cast("string").alias("shared")).limit(0)

    def month_step(state: tuple, row: tuple) -> tuple:
        total, ends = state
        at, cost, charge, frees, base, taken = row
        while ends and ends[0][0] <= at:
            total += heapq.heappop(ends)[1]
        if base + total + cost > cap_micro:
            return (total, ends), CAP
        if not taken:
            total += cost
            heapq.heappush(ends, (frees, charge - cost))
        return (total, ends), None

    for _ in range(rounds):
        mine = x.join(shared, "n", "left")
        reads = ["at_ms", "seconds", "early", "left_s", "shared", "frees_ms", "charged_s"]
        told = staged(folded(mine, ["invite"], ["at_ms", "n"], lambda: (0, None, 0), _own_rules, reads, "verdict", "string"))
        far = told.where(F.col("verdict").isin("accepted", CAP, TAKEN)).drop("verdict")
        # sums of reservations and charges bound a month from above: below the cap nothing can be refused by it
        full = far.groupBy("month").agg(F.sum(F.col("cost") + F.col("charge")).alias("most")).join(before, "month", "left")
        full = full.where(F.col("most") + F.coalesce("micro", F.lit(0)) > cap_micro).select("month", F.coalesce("micro", F.lit(0)).cast("long").alias("base"))
        contested = far.join(full, "month").withColumn("taken", F.coalesce(F.col("shared") == TAKEN, F.lit(False)))
        capped = folded(contested, ["month"], ["at_ms", "n"], lambda: (0, []), month_step, ["at_ms", "cost", "charge", "frees_ms", "base", "taken"], "capped", "string").where("capped IS NOT NULL").select("n", "capped")
        open_ = far.drop("shared").join(staged(capped), "n", "left")
        first = F.row_number().over(Window.partitionBy("id", F.when(F.col("id").isNull(), F.col("n"))).orderBy(F.col("capped").isNotNull(), "at_ms", "n"))
        taken = F.coalesce("had", F.lit(False)) | (F.col("id").isNotNull() & (first > 1))
        now = staged(open_.select("n", F.coalesce("capped", F.when(taken, TAKEN)).alias("shared")).where("shared IS NOT NULL"))
        changed = now.join(shared.withColumnRenamed("shared", "was"), "n", "full").where(~F.col("shared").eqNullSafe(F.col("was")))
        if changed.isEmpty():
            return told.select("n", "verdict")
        shared = now
    raise RuntimeError(f"verdicts didn't settle in {rounds} rounds")


@query("l8_admission_replay")
def l8_replay(spark: SparkSession, d: str) -> DataFrame:
    """All orders as attempts: jobs of their invite that run for their seconds, one in seven of them taken up by nobody;
    some names come twice. A log of many months, most of which reach their cap."""
    j = jobs(spark, d)
    log = j.select(F.col("id").alias("n"), (F.col("id") - F.col("id") % 40 + F.greatest(F.lit(3), F.col("id") % 40)).alias("id"), (F.col("invite") % 50).alias("who"), "invite", (F.col("created_ms") + F.col("id") % 86_400_000).alias("at_ms"), (F.col("reserved_s") * 2).alias("seconds"), F.when(F.col("id") % 7 > 0, F.col("created_ms") + F.col("id") % 86_400_000 + F.col("reserved_s") * 2000).alias("end_ms"), (F.col("actual_s") * 2).alias("actual_s"))
    months = j.select("month").distinct().select("month", F.lit(1_000_000).cast("long").alias("micro"))
    return replayed(log, invites(spark, d).withColumn("quota_s", F.lit(40_000)), months, log.where("n % 97 = 0").select((F.col("n") + 1).alias("id")), PRICE, 9_000_000 + PRICE * 20, 3)
