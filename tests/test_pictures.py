"""Pictures against pixel by pixel work."""

import random

import pytest
from pyspark.sql import functions as F
from spanforge.operators import pictures as P


def light_bin(r, g, b):
    lin = [c / 255 / 12.92 if c / 255 <= 0.04045 else ((c / 255 + 0.055) / 1.055) ** 2.4 for c in (r, g, b)]
    x = 0.2126 * lin[0] + 0.7152 * lin[1] + 0.0722 * lin[2]
    return int((x * 12.92 if x <= 0.0031308 else 1.055 * x ** (1 / 2.4) - 0.055) * 255 + 0.5), lin


def by_hand(px):
    bins = [light_bin(*p) for p in px]
    n, ordered = len(px), sorted(b for b, _ in bins)
    pct = lambda s: next(b for k, b in enumerate(ordered, 1) if k >= s * n)
    flat = max(sum(s <= b <= s + 2 for b, _ in bins) for s in range(3, 251))
    out = [pct(0.005) / 255, pct(0.5) / 255, pct(0.995) / 255, sum(max(p) <= 1 for p in px) / n, sum(max(p) >= 254 for p in px) / n, flat / n]
    usable = [(p, b, lin) for p, (b, lin) in zip(px, bins, strict=True) if max(p) < 250]
    mid = [(p, lin) for p, b, lin in usable if 38 <= b <= 217]
    out.append(sum((max(p) - min(p)) / max(p) for p, _ in mid) / len(mid) if mid else 0.0)
    for own in ([lin for _, lin in mid], [lin for _, b, lin in usable if b >= max(64, pct(0.95))]):
        s = [sum(x[c] for x in own) for c in range(3)]
        whole = 0.2126 * s[0] + 0.7152 * s[1] + 0.0722 * s[2]
        out += [x / whole for x in s] if len(own) >= n * 0.01 and whole > 0 else [None] * 3
    return out


def test_tones(spark):
    rng, rows, want = random.Random(2), [], {}
    for g in range(14):
        low, high = rng.choice([(0, 255), (0, 3), (250, 255), (60, 70), (0, 255)])
        px = [tuple(rng.randint(low, high) for _ in range(3)) for _ in range(rng.choice([1, 5, 300]))]
        if g == 5:
            px = [(0, 1, 5)] * 3 + [(255, 255, 255)]
        rows += [(g, *p) for p in px]
        want[g] = by_hand(px)
    df = spark.createDataFrame([*rows, (0, None, 1, 2)], "g int, r int, g_ int, b int").withColumnRenamed("g", "pic").withColumnRenamed("g_", "g")
    for r in P.tones(df, ["pic"]).collect():
        got = list(r)[1:]
        assert [x is None for x in got] == [x is None for x in want[r.pic]], r.pic
        assert all(abs(x - y) < 1e-9 for x, y in zip(got, want.pop(r.pic), strict=True) if x is not None)
    assert not want


def test_nearest_colours_and_masking(spark):
    rng = random.Random(3)
    palette = [tuple(rng.randrange(256) for _ in range(3)) for _ in range(20)] + [(9, 9, 9), (9, 9, 9)]
    rows = [(1, f, p, *rng.choice([palette[rng.randrange(22)], tuple(rng.randrange(256) for _ in range(3)), (9, 9, 9)])) for f in range(20) for p in range(15)]
    df = spark.createDataFrame([*rows, (1, 99, 0, None, 1, 1)], "s int, frame int, pixel int, r int, g int, b int")
    got = P.unchanged_masked(P.nearest_colours(df, palette, 4), ["s"], "frame", "pixel", 4).where("frame < 99")
    shown: dict = {}
    for r in got.orderBy("frame", "pixel").collect():
        want = min((k for k in range(22) if k != 4), key=lambda k: (2 * (palette[k][0] - r.r) ** 2 + 4 * (palette[k][1] - r.g) ** 2 + 3 * (palette[k][2] - r.b) ** 2, k))
        assert r["index"] == want and r.drawn == (4 if shown.get(r.pixel) == want else want)
        shown[r.pixel] = want
    for bad in ([], [(0, 0, 0)] * 257):
        with pytest.raises(ValueError):
            P.nearest_colours(df, bad)


def test_refined(spark):
    rng, rows, first, want = random.Random(4), [], [], {}
    for g in range(6):
        value, values = 0.0, {}
        for k in range(70):
            value += rng.choice([0, 0, 0, 1, -1, 12])
            if rng.random() < 0.9 or k % 20 == 0:
                values[k] = value
        rows += [(g, k, v) for k, v in values.items()]
        points = [k for k in range(0, 70, 20)]
        first += [(g, k) for k in points]
        skip: set = set()
        for _ in range(5):
            while True:
                pairs = [(abs(values[a] - values[b]), -a, a + (b - a) // 2) for a, b in zip(points, points[1:], strict=False) if b - a >= 2 and a + (b - a) // 2 not in skip]
                pairs = [p for p in pairs if p[0] > 3]
                if not pairs or max(pairs)[2] in values:
                    break
                skip.add(max(pairs)[2])
            if not pairs:
                break
            points = sorted([*points, max(pairs)[2]])
        want[g] = points
    got = {}
    frames = spark.createDataFrame(rows, "g int, frame int, value double")
    for r in P.refined(frames, spark.createDataFrame(first, "g int, frame int"), ["g"], F.abs(F.col("a") - F.col("b")), 3.0, 5).orderBy("g", "frame").collect():
        got.setdefault(r.g, []).append(r.frame)
    assert got == want
