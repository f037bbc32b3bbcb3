"""The replay of a log against deciding it attempt by attempt."""

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F
from spanforge.operators.ledger import HOUR_MS, LONGEST_JOB_S, STALE_MS
from spanforge.operators.replay import replayed

LOG = "n long, id string, who string, invite string, at_ms long, seconds double, end_ms long, actual_s long"
PRICE, CAP = 3600, 9000  # one micro a second


def one_by_one(log, limits, spent, ids, per_hour):
    """A ledger that is asked attempt after attempt."""
    jobs, tries, names = [], {}, set(ids)
    used = {i: u for i, _, u, _ in limits}
    rules = {i: (q, r) for i, q, _, r in limits}
    charged, out = dict(spent), {}
    for n, name, who, invite, at, seconds, end, actual in sorted(log, key=lambda a: (a[4], a[0])):
        for j in jobs:  # what ended or got too old by now
            if j["open"] and (j["end"] is not None and j["end"] <= at or j["end"] is None and j["at"] < at - STALE_MS):
                j["open"] = False
                if j["end"] is not None:
                    used[j["invite"]] += j["actual"]
                    charged[j["month"]] = charged.get(j["month"], 0) + j["actual"]
        hour = (who, at // HOUR_MS)
        tries[hour] = tries.get(hour, 0) + 1
        month, s = datetime.fromtimestamp(at / 1000, UTC).strftime("%Y-%m"), -int(-seconds // 1)
        held = sum(j["s"] for j in jobs if j["open"] and j["month"] == month)
        if tries[hour] > per_hour:
            out[n] = "rate_limited"
        elif invite not in rules or rules[invite][1]:
            out[n] = "invite_invalid"
        elif any(j["open"] and j["invite"] == invite for j in jobs):
            out[n] = "job_in_progress"
        elif s > LONGEST_JOB_S:
            out[n] = "too_long"
        elif used[invite] + s > rules[invite][0]:
            out[n] = "invite_minutes_used_up"
        elif charged.get(month, 0) + held + s > CAP:
            out[n] = "monthly_cap_reached"
        elif name is not None and name in names:
            out[n] = "job_id_taken"
        else:
            out[n] = "accepted"
            names.add(name)
            jobs.append({"open": True, "invite": invite, "at": at, "s": s, "end": end, "actual": max(0, actual), "month": month})
    return out


def random_log(seed, n):
    rng = random.Random(seed)
    start = 1_700_000_000_000
    log, hours = [], [rng.randrange(90 * 24) for _ in range(n // 4)]
    for k in range(n):
        at = start + rng.choice(hours) * HOUR_MS + rng.choice([0, 0, 1, 1000, STALE_MS, STALE_MS + 1, rng.randrange(HOUR_MS)])
        end = rng.choice([None, at + rng.choice([0, 1000, 100_000, 5 * HOUR_MS, 900 * HOUR_MS])])
        log.append((k * 3 % n if n % 3 else k, rng.choice([None, f"j{rng.randrange(n // 4)}"]), f"w{rng.randrange(3)}", f"i{rng.randrange(n // 12 + 2)}", at, rng.choice([60.0, 119.2, 300.0, 900.0, 4500.0, 4500.5]), end, rng.choice([-5, 30, 200, 800, 1500])))
    limits = [(f"i{k}", rng.choice([500, 4000, 100_000]), rng.choice([0, 100]), rng.random() < 0.1) for k in range(n // 12 + 1)]
    return log, limits


@pytest.mark.parametrize("seed,n", [(1, 40), (2, 400), (3, 1001)])
def test_replay(spark, seed, n):
    log, limits = random_log(seed, n)
    spent, ids = [("2023-11", 100), ("2023-12", 500), ("2023-12", 40)], ["j1", "j2", "j3"]
    want = one_by_one(log, limits, {"2023-11": 100, "2023-12": 540}, ids, 3)
    got = replayed(spark.createDataFrame(log, LOG).repartition(4), spark.createDataFrame(limits, "invite string, quota_s long, used_s long, revoked boolean"), spark.createDataFrame(spent, "month string, micro long"), spark.createDataFrame([(i,) for i in ids], "id string"), PRICE, CAP, 3)
    assert {r.n: r.verdict for r in got.collect()} == want
    if n > 100:
        assert set(want.values()) == {"accepted", "rate_limited", "invite_invalid", "job_in_progress", "too_long", "invite_minutes_used_up", "monthly_cap_reached", "job_id_taken"}


def test_replay_off_and_empty(spark):
    log, limits = random_log(4, 20)
    frames = spark.createDataFrame(limits, "invite string, quota_s long, used_s long, revoked boolean"), spark.createDataFrame([], "month string, micro long"), spark.createDataFrame([], "id string")
    rows = spark.createDataFrame(log, LOG)
    assert {r.verdict for r in replayed(rows, *frames, PRICE, CAP, 100, enabled=False).collect()} == {"cloud_off"}
    assert replayed(rows.limit(0), *frames, PRICE, CAP, 3).count() == 0
    assert replayed(rows.where(F.col("n") < 0), *frames, PRICE, 0, 3).count() == 0
