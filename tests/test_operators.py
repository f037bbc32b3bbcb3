"""Operators against brute force on small random inputs, and rules at their edges."""

import itertools
import json
import random
import time

import numpy as np
import pytest
from spanforge.functions.numeric import fnv1a, half_up
from spanforge.operators import intervals as I
from spanforge.operators import cues
from spanforge.operators.documents import migrated, validated
from spanforge.operators.evaluation import alignment, judged
from spanforge.operators.segments import gap_sessions, silences, speech_spans, split_at_quietest
from spanforge.operators.signal import filtered, k_filter, within_rate
from spanforge.plans.compilers import container_bytes, longest_seconds, retried
from spanforge.operators.textsearch import aligned_distance, parsed_timestamp, subtitles, wrapped
from pyspark.sql import functions as F

RANGE = "g int, id long, start_us long, end_us long"


def ranges(seed, n=40):
    rng = random.Random(seed)
    return [(rng.randrange(3), k, a, a + rng.randrange(0, 12)) for k in range(n) for a in [rng.randrange(60)]]


@pytest.mark.parametrize("seed", [1, 2])
def test_subtract_and_coalesce(spark, seed):
    a = [r for r in ranges(seed) if r[2] < r[3]]
    b = [r for r in ranges(seed + 10, 15) if r[2] < r[3]]
    left, right = spark.createDataFrame(a, RANGE), spark.createDataFrame(b, "g int, b_id long, b_start_us long, b_end_us long")
    got = {}
    for r in I.subtract(left, right, ["g"]).collect():
        got.setdefault(r.id, []).append((r.start_us, r.end_us))
    for g, i, s, e in a:
        free = [p for p in range(s, e) if not any(h == g and x <= p < y for h, _, x, y in b)]
        assert [p for x, y in sorted(got.get(i, [])) for p in range(x, y)] == free
        assert all(y < z for (_, y), (z, _) in zip(sorted(got.get(i, [])), sorted(got.get(i, []))[1:]))
    for g in range(3):
        points = sorted({p for h, _, s, e in a if h == g for p in range(s, e)})
        merged = sorted((r.start_us, r.end_us) for r in I.coalesce_ranges(left.where(F.col("g") == g), ["g"]).collect())
        assert [p for x, y in merged for p in range(x, y)] == points


def test_half_open_edges(spark):
    t = spark.createDataFrame([(0, 1, 0, 10), (0, 2, 10, 20)], RANGE)
    p = spark.createDataFrame([(0, 10), (0, 20), (0, -1)], "g int, p long")
    assert [(r.p, r.id) for r in I.locate(p, t, ["g"]).collect()] == [(10, 2)]
    assert I.first_overlapping(t, ["g"]).where("other is not null").count() == 0


def test_as_of_takes_equal_times(spark):
    rows = spark.createDataFrame([(0, 5, 1), (0, 5, 2), (0, 9, 3)], "g int, t long, v long")
    probes = spark.createDataFrame([(0, 4), (0, 5), (0, 8), (0, 9)], "g int, p long")
    got = {r.p: r.v for r in I.as_of(probes, rows, ["g"], "p", "t", ["v"]).collect()}
    assert got == {4: None, 5: 2, 8: 2, 9: 3}


def test_ordered_admission_and_limit(spark):
    t = spark.createDataFrame([(0, 1, 0, 10), (0, 2, 5, 12), (0, 3, 11, 20), (0, 4, 20, 21), (0, 5, 30, 40), (0, 6, 50, 60)], RANGE)
    got = {r.id: r.verdict for r in I.accepted_in_order(t, ["g"], 3, 5).collect()}
    assert got == {1: "accepted", 2: "overlap", 3: "accepted", 4: "too_short", 5: "accepted", 6: "limit"}
    assert I.cut_out(I.cut_out([(0, 100)], 10, 20), 15, 120) == [(0, 10)] and I.cut_out([(0, 9)], 5, 5) == [(0, 9)]
    cuts = spark.createDataFrame([(0, 1, 7, 2, 4), (0, 1, 8, 5, 9)], "g int, id long, b_id long, b_start_us long, b_end_us long")
    clips = spark.createDataFrame([(0, 1, 0, 10)], RANGE)
    assert {r.b_id: r.taken for r in I.within_limit(clips, cuts, ["g"], 2, 1).collect()} == {8: True, 7: False}


def test_rounding_and_hash(spark):
    r = spark.range(1).select(half_up(F.lit(-2.5)).alias("a"), half_up(F.lit(2.5)).alias("b"), fnv1a(F.lit("a")).alias("c"), fnv1a(F.lit("")).alias("d")).first()
    assert tuple(r) == (-2, 3, "e40c292c", "811c9dc5")


def test_silences(spark):
    def series(name, spec):
        return [(name, k, db) for k, db in enumerate(x for db, n in spec for x in [float(db)] * n)]

    rows = series("pause", [(-20, 60), (-70, 50), (-20, 60)]) + series("flat", [(-20, 100)]) + series("short", [(-20, 3)]) + series("edge", [(-70, 40), (-20, 100)])
    got = {}
    for r in silences(spark.createDataFrame(rows, "series string, frame int, db double"), 20, 5).collect():
        got.setdefault(r.series, []).append((r.status, r.start, r.stop))
    assert got == {"pause": [("ok", 65, 105)], "flat": [("low_contrast", None, None)], "short": [("too_short", None, None)], "edge": [("ok", 0, 35)]}


def spans_by_definition(p, on, off, speech, silence, pad):
    """Frames that are on belong to one span unless quiet frames between two neighbours of them reach over `silence`; a span
    lasts to the first quiet frame behind it. What is within pad of a span that is long enough is speech."""
    loud = [k for k, x in enumerate(p) if x >= on]
    quiet = lambda i, j: [k for k in range(i + 1, j) if p[k] < off]
    parted = {(i, j) for i, j in itertools.pairwise(loud) for q in [quiet(i, j)] if q and q[-1] - q[0] + 1 >= silence}
    may = {(i, j) for i in loud for j in loud if i <= j and not any(i <= a and b <= j for a, b in parted)}
    maximal = [(i, j) for i, j in may if not any((a, b) != (i, j) and a <= i and j <= b for a, b in may)]
    ends = {(i, j): min([k for k in quiet(j, len(p))], default=len(p)) for i, j in maximal}
    half = set()  # halves of frames that are speech
    for (i, _), z in ends.items():
        if z - i >= speech:
            half |= set(range(max(0, 2 * (i - pad)), min(2 * len(p), 2 * (z + pad))))
    edges = sorted(h for h in half if h - 1 not in half), sorted(h + 1 for h in half if h + 1 not in half)
    return [(a / 2, z / 2) for a, z in zip(*edges, strict=True)]


def test_speech_spans_match_their_definition(spark):
    rng, rows, want = random.Random(5), [], {}
    for g in range(60):
        p, x = [], rng.random()
        for _ in range(rng.randrange(1, 120)):
            x = min(1.0, max(0.0, x + rng.choice([-0.3, -0.1, 0.1, 0.3])))
            p.append(x)
        rows += [(g, k, x) for k, x in enumerate(p)]
        want[g] = spans_by_definition(p, 0.5, 0.35, 3, 2, 1)
    got = {g: [] for g in want}
    for r in speech_spans(spark.createDataFrame(rows, "g int, frame int, p double"), "g", 1.0, speech_s=3, silence_s=2, pad_s=1).orderBy("g", "start_s").collect():
        got[r.g].append((r.start_s, r.end_s))
    assert got == want and sum(map(len, want.values())) > 60


def test_splits_at_the_quietest_frame(spark):
    rng, rows, want = random.Random(6), [], {}
    for g in range(20):
        db = [rng.randrange(30) for _ in range(rng.randrange(1, 200))]
        rows += [(g, k, float(x)) for k, x in enumerate(db)]
        cuts, a = [], 0
        while len(db) - a > 20:
            cut = min(range(a + 10, a + 20), key=lambda k: (db[k], k))
            cuts.append((a, cut))
            a = cut
        want[g] = [*cuts, (a, len(db))]
    got = {g: [] for g in want}
    for r in split_at_quietest(spark.createDataFrame(rows, "g long, frame int, db double").repartition(5), "g", 1.0, 20.0).orderBy("g", "start_s").collect():
        got[r.g].append((r.start_s, r.end_s))
    assert got == want


def test_gap_sessions_need_more_than_the_gap(spark):
    rows = spark.createDataFrame([(0, "a", 0, 5), (0, "a", 15, 20), (0, "a", 31, 32), (0, "b", 32, 33)], "g int, k string, s long, e long")
    assert [r.session for r in gap_sessions(rows, ["g"], "k", "s", "e", 10).orderBy("s").collect()] == [1, 1, 2, 3]


def brute_rate(ticks, rate, slack):
    return any(j - i > rate * (ticks[j] - ticks[i] + slack) + 1 for j in range(len(ticks)) for i in range(j) if ticks[j] - ticks[i] <= 1 + slack)


def test_rate_bound_against_brute_force(spark):
    rng, rows, want = random.Random(4), [], {}
    for g in range(30):
        t = sorted(rng.sample(range(3000), rng.randrange(2, 60)))
        rows += [(g, k, x) for k, x in enumerate(t)]
        s = [x / 1000 for x in t]
        mean = (len(t) - 1) / (s[-1] - s[0]) > 20 * 1.01
        want[g] = "fps" if mean or brute_rate(s, 20, 1e-6 + 2 / 1000) else "ok"
    got = {r.g: r.verdict for r in within_rate(spark.createDataFrame(rows, "g int, event_id long, us long"), ["g"], "us", 20.0, 1000).collect()}
    assert got == want


def test_filter_against_its_impulse_response(spark):
    (b, a), _ = k_filter(48_000)
    # the coefficients that the recommendation prints for 48 kHz
    assert np.allclose(b, (1.53512485958697, -2.69169618940638, 1.19839281085285)) and np.allclose(a, (-1.69065929318241, 0.73248077421585))
    stages, n = k_filter(8_000), 400
    rng = np.random.default_rng(3)
    x = {g: rng.normal(size=n) for g in range(3)}
    h = np.zeros(n)
    h[0] = 1.0
    for b, a in stages:
        y = np.zeros(n)
        for i in range(n):
            y[i] = sum(b[k] * h[i - k] for k in range(3) if i >= k) - sum(a[k - 1] * y[i - k] for k in (1, 2) if i >= k)
        h = y
    rows = [(g, k, float(v)) for g, xs in x.items() for k, v in enumerate(xs)]
    rng.shuffle(rows)
    got = {(r.g, r.n): r.y for r in filtered(spark.createDataFrame([(int(g), int(k), v) for g, k, v in rows], "g int, n int, x double"), ["g"], "n", "x", stages).collect()}
    for g, xs in x.items():
        assert np.allclose([got[g, k] for k in range(n)], np.convolve(xs, h)[:n])


def brute_alignment(r, h):
    d = [[i + j if not i * j else 0 for j in range(len(h) + 1)] for i in range(len(r) + 1)]
    for i in range(1, len(r) + 1):
        for j in range(1, len(h) + 1):
            d[i][j] = min(d[i - 1][j - 1] + (r[i - 1] != h[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    return d[-1][-1]


def test_alignment():
    rng = random.Random(2)
    for _ in range(200):
        r, h = ([rng.choice("abc") for _ in range(rng.randrange(8))] for _ in range(2))
        sub, dele, ins, hit = alignment(r, h)
        assert sub + dele + ins == brute_alignment(r, h) and sub + dele + hit == len(r) and sub + ins + hit == len(h)


def test_aligned_distance():
    assert aligned_distance("tarml", "tarlm") == 1
    assert aligned_distance("ca", "abc") == 3
    assert aligned_distance("abc", "abcdef") == 3
    assert aligned_distance("", "a") == 1


def test_subtitles(spark):
    text = "1\n00:00:01,000 --> 00:00:02,500\n<i>a &amp; b</i>\nc\n\n2\nno time\n\n00:00:03.000 --> 00:00:02.000\nx\n\n4\n00:00:05,000 --> 00:00:06,000\n"
    got = sorted(map(tuple, subtitles(spark.createDataFrame([(1, text)], "f int, text string"), ["f"]).select("block", "start_ms", "end_ms", "cue", "problem").collect()))
    assert got == [(0, 1000, 2500, "a & b\nc", None), (1, None, None, None, "bad_timing"), (2, None, None, None, "bad_timing"), (3, None, None, None, "no_text")]
    r = spark.createDataFrame([("01:02:03,004",), ("02:03.004",), ("2:3",)], "t string").select(parsed_timestamp(F.col("t")).alias("ms")).collect()
    assert [x.ms for x in r] == [3723004, 123004, None]


def recipe(**more):
    base = {"schemaVersion": 6, "projectId": "p", "revision": 1, "assets": [{"assetId": "v", "kind": "video", "durationUs": 10**7}, {"assetId": "s", "kind": "audio", "durationUs": 10**6}], "clips": [{"clipId": "c", "assetId": "v", "sourceInUs": 0, "sourceOutUs": 10**6}], "captionTracks": []}
    return json.dumps({k: v for k, v in (base | more).items() if v != "gone"})


def clip(**more):
    return {"clipId": "c", "assetId": "v", "sourceInUs": 0, "sourceOutUs": 10**6} | more


def test_each_rule_is_found(spark):
    cue = {"cueId": "q", "startUs": 0, "endUs": 10**6, "text": "x"}
    track = {"trackId": "t", "origin": "manual", "timeBase": "output", "language": "tr", "style": {"preset": "box", "position": "top", "size": "large"}, "cues": [cue]}
    spoken = track | {"origin": "transcript", "timeBase": "source", "assetId": "v", "language": "en-GB"}
    export = {"container": "mp4", "videoCodec": "h264", "audioCodec": "aac", "colorMode": "sdr_rec709", "shortEdge": 720, "fpsNum": 30, "fpsDen": 1, "audioSampleRate": 48000}
    music = {"assetId": "s", "sourceInUs": 0, "sourceOutUs": 10**6, "timelineStartUs": 0, "gainDb": 0.0, "fadeInUs": 0, "fadeOutUs": 0}
    cases = [
        (recipe(), set()), ("nonsense", {"not_an_object"}), (recipe(schemaVersion=5, revision=-1), {"schema_version_unsupported"}), (recipe(odd=1), {"unknown_field"}), (recipe(projectId="gone"), {"missing_field"}),
        (recipe(projectId="a b"), {"id_invalid"}), (recipe(revision=-1), {"revision_invalid"}), (recipe(clips=[]), {"clips_empty"}), (recipe(clips=[clip(clipId=f"c{k}") for k in range(21)]), {"clip_limit_exceeded"}),
        (recipe(clips=[clip(), clip()]), {"id_duplicate"}), (recipe(clips=[clip(sourceInUs=5, sourceOutUs=5)]), {"range_reversed"}), (recipe(clips=[clip(sourceOutUs=99_999)]), {"clip_too_short"}), (recipe(clips=[clip(sourceOutUs=10**7 + 1)]), {"range_out_of_source"}),
        (recipe(clips=[clip(assetId="z")]), {"asset_unknown"}), (recipe(clips=[clip(assetId="s")]), {"asset_kind_mismatch"}), (recipe(clips=[clip(sourceGainDb=13)]), {"gain_out_of_range"}),
        (recipe(clips=[clip(view={"x": 0.5, "y": 0, "width": 0.6, "height": 1, "fit": "cover"})]), {"view_out_of_bounds"}), (recipe(clips=[clip(view={"x": 0, "y": 0, "width": 0, "height": 1, "fit": "cover"})]), {"view_size_invalid"}),
        (recipe(music=None), {"music_null"}), (recipe(music=music), set()), (recipe(music=music | {"assetId": "v"}), {"asset_kind_mismatch"}), (recipe(music=music | {"timelineStartUs": 10**6}), {"music_start_after_output"}), (recipe(music=music | {"fadeInUs": -1}), {"fade_negative"}),
        (recipe(music=music | {"fadeOutUs": 10**6 + 1}), {"fade_exceeds_selection"}), (recipe(captionTracks=[track | {"cues": [cue]}]), set()), (recipe(captionTracks=[track | {"cues": [cue, cue | {"cueId": "r", "startUs": 10**6 - 1, "endUs": 2 * 10**6}]}]), {"caption_cue_overlap"}),
        (recipe(captionTracks=[track | {"cues": [cue, cue | {"startUs": 10**6, "endUs": 2 * 10**6}]}]), {"caption_id_duplicate"}), (recipe(captionTracks=[track | {"cues": [cue | {"text": " "}]}]), {"caption_text_invalid"}), (recipe(captionTracks=[track | {"cues": [cue | {"endUs": 5}]}]), {"caption_cue_too_short"}),
        (recipe(captionTracks=[track | {"trackId": f"t{k}", "cues": []} for k in range(9)]), {"caption_track_limit_exceeded"}), (recipe(assets=[{"assetId": "v", "kind": "video", "durationUs": 10**7}] * 2), {"asset_id_duplicate"}), (recipe(assets=[{"assetId": "v", "kind": "video", "durationUs": 10**7, "displayWidth": 0, "displayHeight": 4}]), {"asset_dimension_invalid"}),
        (recipe(assets=[{"assetId": "v", "kind": "video", "durationUs": 4 * 10**9}]), {"source_duration_exceeds_policy"}), (recipe(clips=[clip(sourceOutUs=-5), clip(clipId="d")], odd=1), {"time_not_safe_integer", "unknown_field"}),
        (recipe(canvas={"aspect": "9:16", "background": "#00aAfF"}, export=export, enhance={"strength": "auto"}, soundFix={"targetLufs": -16}, captionTracks=[spoken | {"unclear": [{"startUs": 0, "endUs": 5}], "cues": [cue | {"speaker": 20}]}]), set()),
        (recipe(canvas={"aspect": "4:3", "background": "#000000"}), {"aspect_invalid"}), (recipe(canvas={"aspect": "1:1", "background": "black"}), {"color_invalid"}), (recipe(export=export | {"container": "webm"}), {"export_spec_invalid"}), (recipe(export=export | {"fpsNum": 29.97}), {"export_spec_invalid"}), (recipe(export=export | {"fpsDen": 0}), {"export_spec_invalid"}),
        (recipe(enhance={"strength": "max"}), {"enhance_invalid"}), (recipe(soundFix={"targetLufs": -14}), {"sound_fix_invalid"}), (recipe(clips=[clip(view={"x": 0, "y": 0, "width": 1, "height": 1, "fit": "fill"})]), {"fit_invalid"}), (recipe(clips=[clip(sourceInUs=1.5)]), {"time_not_safe_integer"}), (recipe(clips=[clip(sourceOutUs=2**53)]), {"time_not_safe_integer", "range_out_of_source", "timeline_duration_exceeds_policy"}),
        (recipe(music=music | {"timelineStartUs": -1}), {"time_not_safe_integer"}), (recipe(captionTracks=[track | {"cues": [cue | {"startUs": -1}]}]), {"time_not_safe_integer"}), (recipe(captionTracks=[track | {"origin": "guess"}]), {"caption_track_invalid"}), (recipe(captionTracks=[track | {"language": "Turkish"}]), {"caption_track_invalid"}), (recipe(captionTracks=[track | {"assetId": "v"}]), {"caption_track_invalid"}),
        (recipe(captionTracks=[track | {"unclear": []}]), {"caption_track_invalid"}), (recipe(captionTracks=[track | {"cues": [cue | {"speaker": 1}]}]), {"caption_track_invalid"}), (recipe(captionTracks=[track | {"style": {"preset": "glow", "position": "top", "size": "large"}}]), {"caption_style_invalid"}), (recipe(captionTracks=[spoken | {"cues": [cue | {"speaker": 21}]}]), {"caption_speaker_invalid"}), (recipe(captionTracks=[spoken | {"cues": [cue | {"speaker": "A"}]}]), {"caption_speaker_invalid"}),
        (recipe(captionTracks=[spoken | {"assetId": "s"}]), {"asset_kind_mismatch"}), (recipe(captionTracks=[spoken | {"assetId": "z"}]), {"asset_unknown"}), (recipe(captionTracks=[spoken | {"unclear": [{"startUs": 9, "endUs": 5}]}]), {"range_reversed"}), (recipe(captionTracks=[spoken | {"unclear": [{"startUs": 9, "endUs": 10**7 + 1}]}]), {"range_out_of_source"}),
    ]
    got = {k: set() for k in range(len(cases))}
    for r in validated(spark.createDataFrame([(k, j) for k, (j, _) in enumerate(cases)], "id int, json string")).collect():
        got[r.id].add(r.code)
    assert [got[k] for k in range(len(cases))] == [w for _, w in cases]


def test_migration_touches_the_document_itself_only(spark):
    inner = {"schemaVersion": 2, "revision": 1, "clips": [{"schemaVersion": 3}], "captionTracks": [], "note": 'a "schemaVersion":4'}
    spoken = {"captionTracks": [{"cues": [{"speaker": "A"}]}]}
    docs = [inner, {"schemaVersion": 1}, {"schemaVersion": 1, "captionTracks": []}, {"schemaVersion": 5, "soundFix": {}}, {"schemaVersion": 4} | spoken, {"schemaVersion": 5} | spoken, {"schemaVersion": 3, "enhance": {}}, {"schemaVersion": 4, "enhance": {}}, {"schemaVersion": 7}, [1], "text"]
    want = [inner | {"schemaVersion": 6}, {"schemaVersion": 6, "captionTracks": []}, docs[2], docs[3], docs[4], {"schemaVersion": 6} | spoken, docs[6], {"schemaVersion": 6, "enhance": {}}, *docs[8:]]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)] + [(99, "nonsense")], "id int, json string")
    got = {r.id: r.json for r in migrated(df).collect()}
    assert got.pop(99) == "nonsense" and [json.loads(got[k]) for k in range(len(docs))] == want


def test_budgets_take_the_exact_id_first(spark):
    m = spark.createDataFrame([("a.b", 5.0), ("a.c", 5.0), ("z", 1.0), ("a.d", None)], "id string, value double")
    b = spark.createDataFrame([(0, "a.*", 0.0, 1.0), (1, "a.b", 0.0, 9.0)], "place int, pattern string, low double, high double")
    assert {r.id: r.verdict for r in judged(m, b).collect()} == {"a.b": "ok", "a.c": "over", "z": "info", "a.d": "unmeasured"}


def brute_segmentation(words):
    n, best = len(words), (float("inf"), None)
    for mask in range(1 << (n - 1)):
        ends = [k + 1 for k in range(n - 1) if mask >> k & 1] + [n]
        c = sum(cues.cost_of(words[i:j], j == n) for i, j in zip([0, *ends], ends))
        best = min(best, (round(c, 9), ends), key=lambda x: x[0])
    return best[0]


def test_captions_have_the_least_cost():
    rng = random.Random(7)
    for _ in range(60):
        at, words = 0, []
        for _ in range(rng.randrange(1, 11)):
            at += rng.choice([0, 10_000, 300_000, 600_000])
            w = "".join(rng.choice("xyzv") for _ in range(rng.randrange(1, 14))) + rng.choice(["", "", ",", ".", "?"])
            words.append((at, at + len(w) * 60_000, w))
            at = words[-1][1]
        ends = cues.segmentation(words)
        assert round(sum(cues.cost_of(words[i:j], j == len(words)) for i, j in zip([0, *ends], ends)), 9) == brute_segmentation(words)
    assert cues.segmentation([]) == []


def old_segmentation(words):
    """Straight from cost_of."""
    best, back = [0.0], [0]
    for j in range(1, len(words) + 1):
        least, at = float("inf"), j - 1
        for i in range(j - 1, -1, -1):
            c = cues.cost_of(words[i:j], j == len(words))
            if c == float("inf"):
                break
            if best[i] + c < least - 1e-12:
                least, at = best[i] + c, i
        best.append(least)
        back.append(at)
    out, j = [], len(words)
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def test_captions_of_long_segments_break_where_their_costs_say():
    """Segments of every kind of word as by cost_of, and work that doesn't grow with the words of a caption."""
    rng = random.Random(12)
    for _ in range(40):
        at, words = 0, []
        for _ in range(rng.randrange(1, 120)):
            at += rng.choice([0, 0, 0, 10_000, 300_000, 499_999, 500_000])
            w = "v" * rng.choice([0, 1, 1, 2, 5, 9, 20, 31, 32, 33, 70]) + rng.choice(["", "", ",", ".", "?"])
            words.append((at, at + rng.choice([0, len(w) * 60_000, 2_000_000]), w))
            at = rng.choice([at, words[-1][1]])
        assert cues.segmentation(words) == old_segmentation(words)
    words = [(k * 60_000, k * 60_000 + 60_000, "v") for k in range(20_000)]
    began = time.process_time()
    cues.segmentation(words[:2_000])
    few = time.process_time() - began
    began = time.process_time()
    old_segmentation(words[:2_000])
    assert few * 4 < time.process_time() - began
    assert cues.segmentation(words)[-1] == 20_000


def test_captions_keep_words_and_their_room(spark):
    rows = [(g, s, k, (s * 40 + k) * 300_000, (s * 40 + k) * 300_000 + 250_000, w, 99_000_000) for g in range(2) for s in range(2) for k, w in enumerate("zorb velt. quan dripple, mox yarrowin tesk fulm grandivor? ulp".split())]
    got = cues.segmented(spark.createDataFrame(rows, "g int, s int, place int, start_us long, stop_us long, word string, end long"), ["g"], "s", "end").orderBy("g", "s", "n").collect()
    for g in range(2):
        own = [r for r in got if r.g == g]
        assert " ".join(r.text.replace("\n", " ") for r in own) == " ".join(w for h, _, _, _, _, w, _ in rows if h == g)
        assert all(a.end_us <= b.start_us for a, b in zip(own, own[1:])) and all(len(x) <= cues.LINE for r in own for x in r.text.split("\n"))


def test_ranges_meet_alike_whatever_the_bins(spark):
    a = spark.createDataFrame(ranges(21), RANGE)
    b = spark.createDataFrame(ranges(22), "g int, b_id long, b_start_us long, b_end_us long")
    want = sorted((x[1], y[1]) for x in ranges(21) for y in ranges(22) if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    for bin_us in (1, 5, 1000):
        assert sorted((r.id, r.b_id) for r in I.intersect(a, b, ["g"], bin_us=bin_us).collect()) == want


def test_wrapped_lines(spark):
    rng = random.Random(3)
    texts = [" ".join("v" * rng.randrange(1, 14) for _ in range(rng.randrange(30))) + rng.choice(["", "  ", "\n"]) for _ in range(40)] + ["", "w" * 50]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string").select("id", wrapped(F.col("text"), 20).alias("lines")).collect()
    for r in got:
        out = []
        for w in texts[r.id].split():
            if out and len(out[-1]) + 1 + len(w) <= 20:
                out[-1] += " " + w
            else:
                out.append(w)
        assert r.lines == out


def test_removals_within_a_limit_against_brute_force(spark):
    rng = random.Random(14)
    clips = [(g, i, i * 100, i * 100 + rng.randrange(20, 100)) for g in range(6) for i in range(4)]
    cuts = [(g, i, 50 * g + k, a, a + rng.randrange(0, 30)) for g in range(6) for k in range(40) for i in [rng.randrange(5)] for a in [i * 100 + rng.randrange(-5, 95)]]
    want = {}
    for g in range(6):
        chosen = {c[1]: [] for c in clips if c[0] == g}

        def pieces():
            n = 0
            for _, i, s, e in (c for c in clips if c[0] == g):
                run = 0
                for p in range(s, e + 1):
                    if p < e and not any(a <= p < b for a, b in chosen[i]):
                        run += 1
                    else:
                        n += run >= 4 or not chosen[i]
                        run = 0
            return n

        for _, i, k, a, b in sorted((c for c in cuts if c[0] == g), key=lambda c: (c[3] - c[4], c[3], c[2], c[1])):
            fits = i in chosen
            if fits:
                chosen[i].append((a, b))
                fits = pieces() <= 7
                if not fits:
                    chosen[i].pop()
            want[g, i, k] = fits
    got = I.within_limit(spark.createDataFrame(clips, RANGE), spark.createDataFrame(cuts, "g int, id long, b_id long, b_start_us long, b_end_us long"), ["g"], 7, 4)
    assert {(r.g, r.id, r.b_id): r.taken for r in got.collect()} == want and len(set(want.values())) == 2


def test_file_sizes_by_hand(spark):
    one = spark.range(1)
    r = one.select(container_bytes(F.lit(60.0), 30, 48_000).alias("a"), container_bytes(F.lit(60.0), 30, None).alias("b"), container_bytes(F.lit(0.0), 30, 48_000).alias("c"), longest_seconds(F.lit(10_000_000), 564_000.0, 30, 48_000).alias("d"), longest_seconds(F.lit(50_000), 564_000.0, 30, 48_000).alias("e")).first()
    # 1800 frames of 5 bytes; 2813 + 3 packets of 4
    assert (r.a, r.b, r.c) == (1500 + 9000 + 11264, 1500 + 9000, 1500 + 12)
    size = lambda t: -(-t * 564_000 // 8) + 1500 + t * 30 * 5 + (-(-t * 48_000 // 1024) + 3) * 4
    assert size(r.d) <= 9_900_000 < size(r.d + 1) and r.e is None


def test_retries_by_hand(spark):
    rungs = spark.createDataFrame([(1080, 2_000_000, "hardware", 900_000, 9_000_000), (720, 1_000_000, "hardware", 500_000, 5_000_000), (540, 500_000, "software", 300_000, 3_000_000), (360, 200_000, "software", 200_000, 150_000)], "edge int, pixels int, kind string, least int, normal int")
    rows = [
        (1, 1080, 2_000_000, 1, 10.0, 3_000_000, 2_900_000, 2_500_000),  # it fits
        (2, 1080, 2_000_000, 1, 10.0, 2_500_000, 2_800_000, 2_600_000),  # slightly over: 2,225,000 of 2,600,000 bytes
        (3, 1080, 1_000_000, 1, 10.0, 1_000_000, 1_300_000, 1_250_000),  # the rate would be below the size's least
        (4, 1080, 1_000_000, 1, 10.0, 1_000_000, 2_100_000, 2_000_000),  # saturated: by pixels 540 fits, 720 doesn't
        (5, 360, 300_000, 2, 10.0, 200_000, 520_000, 500_000),  # the smallest, saturated: nothing left
        (6, 360, 150_000, 2, 10.0, 190_000, 210_000, 200_000),  # the smallest, slightly over: under its least rate
        (7, 1080, 2_000_000, 3, 10.0, 2_500_000, 2_800_000, 2_600_000),  # all attempts used
        (8, 1080, 1_000_000, 1, 10.0, 300_000, 2_700_000, 2_600_000),  # saturated, and no size fits: the smallest
        (9, 1080, 1_000_000, 1, 10.0, 1_000, 2_700_000, 2_600_000),  # nothing left for the picture
        (10, 720, 600_000, 1, 10.0, 600_000, 760_000, 750_000),  # the next size is made in software
        (11, 1080, 0, 1, 10.0, 2_500_000, 2_800_000, 2_600_000),  # nothing was asked: its ratio says nothing
    ]
    made = spark.createDataFrame(rows, "id int, edge int, rate int, attempt int, seconds double, target int, file_bytes int, video_bytes int")
    got = {r.id: (r.edge, r.kind, r.rate, r.planned_bytes, r.attempt) for r in retried(made, rungs, ["id"]).collect()}
    assert got[2] == (1080, "hardware", int(2_225_000 * 0.8 / 1.04), 2_425_000, 2)
    assert got[3] == (720, "hardware", int(920_000 * 0.8 / 1.1), 886_363, 2)
    assert got[4] == (540, "software", int(870_000 * 0.8 / 1.3), 769_230, 2)
    assert got[6] == (360, "software", int((190_000 * 0.94 - 10_000) * 0.8 / (200_000 / 187_500)), 190_000, 3)
    assert got[8] == (360, "software", int((300_000 * 0.97 - 100_000) * 0.8 / 1.3), 246_923, 2)
    assert got[10] == (540, "software", int(572_000 * 0.8 / 1.02), 570_784, 2)
    assert got[11][:2] == (720, "hardware")
    assert set(got) == {2, 3, 4, 6, 8, 10, 11}


def test_notes_are_split_where_clips_meet_and_rejoined(spark):
    # two clips that follow each other in the source as well, then one from elsewhere
    clips = spark.createDataFrame([(0, 0, 10, 100), (0, 10, 20, 110), (0, 20, 30, 500)], "g int, c_start_us long, c_end_us long, c_source_us long")
    notes = spark.createDataFrame([(0, 1, 5, 15), (0, 2, 8, 25), (0, 3, 40, 50), (0, 4, 20, 30)], "g int, id long, start_us long, end_us long")
    for bin_us in (3, 1000):
        got = sorted((r.id, r.piece, r.start_us, r.end_us) for r in I.reanchored(notes, clips, ["g"], bin_us).collect())
        assert got == [(1, 0, 105, 115), (2, 0, 108, 120), (2, 1, 500, 505), (4, 0, 500, 510)]
