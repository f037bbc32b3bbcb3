"""Dynamics against a loop over the samples, whatever the chunks."""

import math
import random

import numpy as np
import pytest
from spanforge.operators import dynamics as D

SOUND = "g int, n long, l double, r double"


def sounds(seed):
    rng, out = random.Random(seed), {}
    for g, length in enumerate([1, 7, 90, 300]):
        level, rows = 0.05, []
        for _ in range(length):
            level = min(1.6, max(0.0, level * rng.choice([0.5, 1, 1, 1, 2.5]) + rng.choice([0, 0.01])))
            rows.append((rng.uniform(-level, level), rng.uniform(-level, level)))
        out[g] = np.array(rows).T
    out[4] = np.zeros((2, 40))
    return out


def frame(spark, x):
    rows = [(g, n, float(s[0, n]), float(s[1, n])) for g, s in x.items() for n in range(s.shape[1])]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SOUND).repartition(3)


def collected(df):
    out = {}
    for r in df.orderBy("g", "n").collect():
        out.setdefault(r.g, []).append((r.n, r.gain, r.l, r.r))
    return out


@pytest.mark.parametrize("size", [1, 5, 64, 1000])
def test_compressor(spark, size):
    x, rate = sounds(2), 500.0
    got = collected(D.compressed(frame(spark, x), ["g"], "n", ["l", "r"], rate, size))
    up, down = 1 - math.exp(-1 / (0.005 * rate)), 1 - math.exp(-1 / (0.12 * rate))
    reduced = 0
    for g, s in x.items():
        e = 0.0
        assert [r[0] for r in got[g]] == list(range(s.shape[1]))
        for (_, gain, left, right), (a, b) in zip(got[g], s.T, strict=True):
            p = (a * a + b * b) / 2
            e += (up if p > e else down) * (p - e)
            over = (10 * math.log10(e) if e > 1e-12 else -120) + 18
            db = 0 if over <= -3 else -over / 2 if over >= 3 else -((over + 3) ** 2) / 24
            reduced += db < 0
            assert abs(gain - 10 ** (db / 20)) < 1e-9 and abs(left - a * gain) < 1e-12 and abs(right - b * gain) < 1e-12
    assert reduced > 50


def test_follower_is_the_loop_for_any_first_value():
    rng = np.random.default_rng(4)
    for _ in range(30):
        power = rng.random(rng.integers(1, 60)) ** 3
        start, factor, add = D.follower(power, 0.3, 0.02)
        assert len(start) <= len(power) + 1 and (np.diff(start) >= -1e-12).all()
        for e0 in [0.0, 1e-9, *rng.random(20) * 2, 50.0]:
            e = e0
            for p in power:
                e += (0.3 if p > e else 0.02) * (p - e)
            k = np.searchsorted(start, e0, "right") - 1
            assert abs(factor[k] * e0 + add[k] - e) < 1e-9


@pytest.mark.parametrize("size", [1, 9, 64, 1000])
def test_limiter(spark, size):
    x, rate = sounds(3), 1000.0
    got = collected(D.limited(frame(spark, x), ["g"], "n", ["l", "r"], rate, size))
    ahead, keep, top = 5, math.exp(-1 / (0.06 * rate)), 10 ** (-2 / 20)
    taps = np.array([t for p in D.PHASES for t in (p, p[::-1])])
    lowest = 1.0
    for g, s in x.items():
        n = s.shape[1]
        padded = np.concatenate([np.zeros((2, 40)), s, np.zeros((2, 40))], 1)
        need = {}
        for k in range(n + ahead):
            last = padded[:, k + 40 + 6 - 11 : k + 40 + 6 + 1][:, ::-1]
            peak = np.abs(last @ taps.T).max()
            need[k] = min(1.0, top / peak) if peak > 0 else 1.0
        gain = 1.0
        for k in range(-ahead, n):
            least = [min([need[i] for i in range(max(0, j), j + ahead + 1) if i in need], default=1.0) for j in range(k - ahead, k + 1)]
            gain = min(sum(least) / len(least), 1 - (1 - gain) * keep)
            if k >= 0:
                row = got[g][k]
                assert row[0] == k and abs(row[1] - gain) < 1e-9 and abs(row[2] - s[0, k] * gain) < 1e-9 and abs(row[3] - s[1, k] * gain) < 1e-9
                lowest = min(lowest, gain)
    assert lowest < 0.8


def test_empty_and_null(spark):
    none = spark.createDataFrame([], SOUND)
    assert D.compressed(none, ["g"], "n", ["l", "r"], 500.0).count() == 0 and D.limited(none, ["g"], "n", ["l", "r"], 500.0).count() == 0
    quiet = spark.createDataFrame([(1, 0, None, None), (1, 1, None, 0.1)], SOUND)
    for f in (D.compressed, D.limited):
        assert [(r.gain, r.l) for r in f(quiet, ["g"], "n", ["l", "r"], 500.0).orderBy("n").collect()] == [(1.0, 0.0)] * 2
