"""Edit logs against lists and stacks that are really edited."""

import random

from spanforge.operators import edits as E


def test_keys_between():
    rng, keys = random.Random(1), []
    for _ in range(400):
        k = rng.choice([0, len(keys), rng.randrange(len(keys) + 1)])
        keys.insert(k, E.between(keys[k - 1] if k else "", keys[k] if k < len(keys) else ""))
    assert keys == sorted(set(keys)) and not any(k.endswith("0") for k in keys)
    a, b = "", "i"
    for _ in range(60):
        b = E.between(a, b)
        assert a < b


def random_log(rng, n):
    log, sizes = [], rng.choice([[-1, 0, 99_999, 100_000, 800_000_000, 3_000_000_000], [100_000, 200_000, 0]])
    for k in range(n):
        op = rng.choice(["add", "add", "add", "add", "remove", "move_to", "move_by", "update", "update"])
        clip = f"c{k}" if op == "add" else f"c{rng.randrange(max(1, k))}"
        a = rng.choice([-2, -1, 0, 1, 2, 5, 30]) if op.startswith("move") else rng.choice([-5, 0, 100_000, 5_000_000])
        log.append((k, op, clip, a, a + rng.choice(sizes)))
    return log


def by_hand(log, source):
    have, verdicts = [], []
    for _, op, clip, a, b in log:
        found = next((c for c in have if c[0] == clip), None)
        before = [list(c) for c in have]
        total = sum(z - y for _, y, z in have)
        code = None
        if op in ("add", "update"):
            if b <= a:
                code = "range_reversed"
            elif a < 0 or b > source:
                code = "range_out_of_source"
            elif b - a < 100_000:
                code = "clip_too_short"
            elif op == "add":
                code = "clip_limit_exceeded" if len(have) >= 20 else "timeline_duration_exceeds_policy" if total + b - a > 14_400_000_000 else None
                if not code:
                    have.append([clip, a, b])
            elif found is None:
                code = "no_source"
            elif total - (found[2] - found[1]) + b - a > 14_400_000_000:
                code = "timeline_duration_exceeds_policy"
            else:
                found[1:] = [a, b]
            verdicts.append(code or "ok")
            continue
        if found and op == "remove":
            have.remove(found)
        elif found:
            at = have.index(found)
            to = at + a if op == "move_by" else min(max(a, 0), len(have) - 1)
            if 0 <= to < len(have):
                have.insert(to, have.pop(at))
        verdicts.append("ok" if have != before else "unchanged")
    return have, verdicts


def test_lists(spark):
    rng, rows, want, verdicts = random.Random(7), [], {}, {}
    for g in range(25):
        log = random_log(rng, rng.randrange(1, 140))
        rows += [(g, *r, 4_000_000_000) for r in log]
        want[g], codes = by_hand(log, 4_000_000_000)
        verdicts |= {(g, k): c for k, c in enumerate(codes)}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, n int, op string, clip string, a long, b long, source_us long").repartition(4)
    assert {(r.g, r.n): r.verdict for r in E.edited(df, ["g"]).collect()} == verdicts
    assert set(verdicts.values()) == {"ok", "unchanged", "range_reversed", "range_out_of_source", "clip_too_short", "clip_limit_exceeded", "timeline_duration_exceeds_policy", "no_source"}
    got = {g: [] for g in want}
    for r in E.lists(df, ["g"]).orderBy("g", "place").collect():
        got[r.g].append([r.clip, r.a, r.b])
        assert r.place == len(got[r.g]) - 1
    assert got == want
    assert E.lists(df.limit(0), ["g"]).count() == 0


def test_histories(spark):
    rng, rows, want = random.Random(8), [], {}
    for g in range(30):
        past, present, future = [], None, []
        for n in range(rng.randrange(1, 120)):
            op = rng.choice(["commit", "commit", "replace", "undo", "undo", "redo"])
            if op == "commit":
                past, present, future = [*past, present][-6:], n, []
            elif op == "replace":
                present = n
            elif op == "undo" and past:
                future.insert(0, present)
                present = past.pop()
            elif op == "redo" and future:
                past.append(present)
                present = future.pop(0)
            rows.append((g, n, op, n))
            want[g, n] = present
    rng.shuffle(rows)
    got = {(r.g, r.n): r.present for r in E.histories(spark.createDataFrame(rows, "g int, n int, op string, value int").repartition(4), ["g"], steps=6).collect()}
    assert got == want
