"""Resampling and mixing against direct sums."""

import math
import random

import pytest
from pyspark.sql import functions as F
from spanforge.operators import mixing as M


@pytest.mark.parametrize("into,out,size", [(3, 2, 5), (2, 3, 64), (441, 160, 1000), (5, 5, 7)])
def test_resampled(spark, into, out, size):
    rng = random.Random(into)
    x = {g: [rng.uniform(-1, 1) for _ in range(n)] for g, n in enumerate([1, 2, 40, 200])}
    rows = [(g, k, v) for g, s in x.items() for k, v in enumerate(s)]
    got = {}
    for r in M.resampled(spark.createDataFrame(rows, "g int, k int, v double").repartition(3), ["g"], "k", "v", into, out, size).orderBy("g", "n").collect():
        got.setdefault(r.g, []).append(r.v)
    step, phases = M.ratio(into, out)
    cut = 0.5 * 0.92 * min(1, out / into)
    half = math.ceil(16 / (2 * cut))
    i0 = lambda z: sum((z / 2) ** (2 * m) / math.factorial(m) ** 2 for m in range(40))

    def weight(t):
        s = 1.0 if abs(t) < 1e-12 else math.sin(2 * math.pi * cut * t) / (2 * math.pi * cut * t)
        return s * (i0(8 * math.sqrt(1 - (t / (half + 1)) ** 2)) / i0(8) if abs(t) < half + 1 else 0)

    for g, s in x.items():
        length = math.floor(len(s) * out / into + 0.5)
        assert len(got.get(g, [])) == length
        for n in range(length):
            centre, part = n * step // phases, n * step % phases / phases
            ws = [weight(j - part) for j in range(-half, half + 1)]
            want = sum(w * s[centre + j] for w, j in zip(ws, range(-half, half + 1), strict=True) if 0 <= centre + j < len(s)) / sum(ws)
            assert abs(got[g][n] - want) < 1e-9


def test_steady_levels_and_tones_stay(spark):
    rows = [(0, k, 0.5) for k in range(600)] + [(1, k, math.sin(2 * math.pi * k * 5 / 300)) for k in range(600)]
    for r in M.resampled(spark.createDataFrame(rows, "g int, k int, v double"), ["g"], "k", "v", 300, 200).where("n BETWEEN 60 AND 340").collect():
        assert abs(r.v - (0.5 if r.g == 0 else math.sin(2 * math.pi * r.n * 5 / 200))) < 1e-3


def test_mixed_and_downmixed(spark):
    rng = random.Random(6)
    sounds = {(g, s): [rng.uniform(-1, 1) for _ in range(rng.randrange(1, 30))] for g in range(3) for s in range(3)}
    place = {k: (rng.choice([-3.5, 0.0, 4.25]), rng.choice([0.5, 1.0, 1.5]), rng.choice([0.0, 0.7, 2.0])) for k in sounds}
    clock = spark.createDataFrame([(g, n) for g in range(3) for n in range(25)], "g int, n long")
    streams = spark.createDataFrame([(*k, *v) for k, v in place.items()], "g int, stream int, first double, step double, gain double")
    samples = spark.createDataFrame([(*k, i, v) for k, s in sounds.items() for i, v in enumerate(s)], "g int, stream int, k long, x double")
    for r in M.mixed(clock, streams, samples, ["g"], F.col("gain")).collect():
        total = 0.0
        for s in range(3):
            first, step, gain = place[r.g, s]
            at = first + r.n * step
            k, own = math.floor(at), sounds[r.g, s]
            read = lambda i, own=own: own[i] if 0 <= i < len(own) else 0.0
            total += gain * (read(k) * (1 - (at - k)) + read(k + 1) * (at - k))
        assert abs(r.x - max(-1, min(1, total))) < 1e-12
    assert [r.x for r in M.downmixed(spark.createDataFrame([(0.5, None), (1.0, 0.0)], "l double, r double"), ["l", "r"]).collect()] == [0.25, 0.5]


def test_envelope(spark):
    at = [-1, 0, 5, 10, 50, 95, 99, 100]
    df = spark.createDataFrame([(a,) for a in at], "us long")
    got = [r.g for r in df.select(M.envelope(F.col("us"), F.lit(0), F.lit(100), F.lit(10), F.lit(10), F.lit(2.0)).alias("g")).collect()]
    assert got == [0.0, 0.0, 1.0, 2.0, 2.0, 1.0, 0.2, 0.0]
    assert df.select(M.envelope(F.col("us"), F.lit(0), F.lit(100), F.lit(0), F.lit(0), F.lit(1.0)).alias("g")).agg(F.sum("g")).first()[0] == 6.0
