"""Rules that SQL doesn't cover, each worked out in another way on random input."""

import random

from spanforge.operators import intervals as I
from spanforge.operators.evaluation import error_rates
from spanforge.operators.segments import silences
from spanforge.operators.textsearch import aligned_distance


def fewest(a, b):
    """Fewest edits, tried out one by one from the front."""
    if not a or not b:
        return len(a) + len(b)
    ways = [fewest(a[1:], b) + 1, fewest(a, b[1:]) + 1, fewest(a[1:], b[1:]) + (a[0] != b[0])]
    if len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0]:
        ways.append(fewest(a[2:], b[2:]) + 1)
    return min(ways)


def test_aligned_distance():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(7))) for _ in range(2))
        for limit in (1, 2, 3):
            assert aligned_distance(a, b, limit) == min(fewest(a, b), limit + 1), (a, b, limit)


def test_admission_by_all_that_was_accepted(spark):
    rng, rows, want = random.Random(2), [], {}
    for g in range(20):
        own = [(g, g * 100 + k, s, s + rng.randrange(0, 12)) for k in range(rng.randrange(1, 30)) for s in [rng.randrange(60)]]
        taken = []
        for _, i, s, e in sorted(own, key=lambda r: (r[2], r[1])):
            code = "too_short" if e - s < 4 else "overlap" if any(s < f and a <= s for a, f in taken) else "limit" if len(taken) == 5 else "accepted"
            want[i] = code
            taken += [(s, e)] * (code == "accepted")
        rows += own
    rng.shuffle(rows)
    got = {r.id: r.verdict for r in I.accepted_in_order(spark.createDataFrame(rows, "g int, id long, start_us long, end_us long").repartition(4), ["g"], 5, 4).collect()}
    assert got == want and set(want.values()) == {"too_short", "overlap", "limit", "accepted"}


def test_rates_are_ratios_of_sums(spark):
    rng, rows = random.Random(3), [("none", 0, 0, 0, 2, 0)]
    for role in ("a", "b"):
        for _ in range(40):
            sub, dele, hit = rng.randrange(4), rng.randrange(4), rng.randrange(9)
            rows.append((role, sub + dele + hit, sub, dele, rng.randrange(5), hit))
    got = {r.role: (r.n, r.wer, r.hits) for r in error_rates(spark.createDataFrame(rows, "role string, n_ref int, sub int, del int, ins int, hit int"), ["role"]).collect()}
    for role in ("a", "b"):
        own = [r for r in rows if r[0] == role]
        words = sum(r[1] for r in own)
        assert got[role] == (40, round(sum(sum(r[2:5]) for r in own) / words, 9), round(sum(r[5] for r in own) / words, 9))
    assert got["none"] == (1, None, None)


def frames_removed(db, least, keep, blip, least_removal):
    """Frame by frame: what a series' status is, and which frames its pauses hold."""
    n, ordered = len(db), sorted(db)
    at = lambda p, xs: sorted(xs)[int((len(xs) - 1) * p + 0.5)]
    low, loud = at(0.1, ordered), at(0.95, ordered)
    threshold = min(max(low + min(20.0, max(6.0, (loud - low) * 0.3)), loud - 40), loud - 6)
    quiet = [x < threshold for x in db]
    reach = lambda k, q: (max([j + 1 for j in range(k) if q[j] != q[k]], default=0), min([j for j in range(k, n) if q[j] != q[k]], default=n))
    filled = list(quiet)
    for k in range(n):
        a, z = reach(k, quiet)
        if not quiet[k] and a > 0 and z < n and z - a <= blip and max(db[a:z]) < loud - 25:
            filled[k] = True
    pauses = set()
    for k in range(n):
        a, z = reach(k, filled)
        s, e = (a if a == 0 else a + keep), (z if z == n else z - keep)
        if filled[k] and z - a >= least and e - s >= least_removal:
            pauses.add((s, e))
    heard = [[x for x in db[s:e] if x > -100] for s, e in pauses]
    wild = any(len(h) >= 10 and at(0.9, h) - at(0.1, h) > 10 for h in heard)
    if n < least:
        return "too_short", set()
    if loud - low < 6 or wild:
        return "low_contrast", set()
    return ("ok", pauses) if pauses else ("none", set())


def test_silences_frame_by_frame(spark):
    rng, rows, want = random.Random(7), [], {}
    for g in range(40):
        db, kind = [], g % 4
        while len(db) < rng.choice([5, 60, 140]):
            level = rng.choice([-20, -22, -70, -72, -60] if kind != 3 else [-30, -31, -29])
            db += [level + rng.uniform(-1, 1) * (14 if kind == 2 and level < -40 else 1) for _ in range(rng.choice([2, 5, 7, 20, 40]))]
        rows += [(g, k, float(x)) for k, x in enumerate(db)]
        want[g] = frames_removed(db, 12, 3, 6, 2)
    rng.shuffle(rows)
    got = {}
    for r in silences(spark.createDataFrame(rows, "series int, frame int, db double").repartition(4), 12, 3).collect():
        status, found = got.setdefault(r.series, (r.status, set()))
        if r.start is not None:
            found.add((r.start, r.stop))
    assert got == want and {s for s, _ in want.values()} >= {"ok", "low_contrast", "too_short"}
