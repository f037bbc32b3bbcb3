"""Dynamics of sound: a compressor and a look-ahead limiter, whose gains depend on all samples before.

A series is cut into chunks. What a chunk does to the state that it gets is a function that needs none of the other
chunks; a short pass over these functions gives each chunk its state, and the chunks are then worked out side by side.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.staging import staged
from ..sources.tables import POINTS, points
from .folds import folded
from .signal import PHASES

# Level in dB from which a sound is compressed, by what ratio, over what knee, seconds of attack and release;
# the limiter's seconds of look-ahead and release, and its ceiling in dB.
THRESHOLD_DB, RATIO, KNEE_DB, ATTACK_S, RELEASE_S = -18.0, 2.0, 6.0, 0.005, 0.12
LOOKAHEAD_S, LIMIT_RELEASE_S, CEILING_DB = 0.005, 0.06, -2.0
#: Samples of a chunk. Samples that the interpolation of peaks looks back and ahead.
CHUNK, BACK, AHEAD = 4096, 5, 6


def _chunks(samples: DataFrame, by: list[str], order: str, values: list[str], size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Rows for applyInArrow: by, chunk, n, values; a chunk also gets the samples up to `before` it and `after` it."""
    n = F.col(order)
    into = F.sequence(F.greatest(F.lit(0), F.floor((n - after) / size).cast("long")), F.floor((n + before) / size).cast("long"))
    return samples.select(*by, n.cast("long").alias("n"), *(F.col(v).cast("double").alias(v) for v in values), F.explode(into).alias("chunk"))


def curve(level: np.ndarray) -> np.ndarray:
    """Gain in dB by level in dB: none up to half a knee below the threshold, a parabola within the knee, then a line."""
    over = level - THRESHOLD_DB
    slope = 1 / RATIO - 1
    inside = np.clip(over + KNEE_DB / 2, 0, KNEE_DB)
    return slope * (inside * inside / (2 * KNEE_DB) + np.maximum(0, over - KNEE_DB / 2))


def follower(power: np.ndarray, attack: float, release: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What an envelope becomes over these samples, as pieces (from where, factor, addend) of a function of its first value.

    One step is the larger of two rising lines that meet at the sample's power, so all steps together are a rising convex
    function of straight pieces; a step adds one place where the pieces part: where the function so far is that power."""
    start, factor, add = np.zeros(1), np.ones(1), np.zeros(1)
    for p in power.tolist():
        k = int(np.searchsorted(start * factor + add, p, "right")) - 1  # the piece that reaches p, if the first one begins below it
        if k >= 0:
            at = max(start[k], (p - add[k]) / factor[k]) if factor[k] > 0 else start[k]
            start = np.concatenate([start[: k + 1], [at], start[k + 1 :]])
            factor, add = np.insert(factor, k + 1, factor[k]), np.insert(add, k + 1, add[k])
        rate = np.where(np.arange(len(start)) <= k, attack, release)
        factor, add = factor * (1 - rate), add * (1 - rate) + rate * p
    return start, factor, add


def compressed(samples: DataFrame, by: list[str], order: str, values: list[str], rate: float, size: int = CHUNK) -> DataFrame:
    """by, n, gain, and each of values (channels, from -1 to 1) times gain: feed-forward compression with one gain for all
    channels, by an envelope of their mean square that rises and falls at different rates.

    samples: by, order (whole numbers from 0 without gaps), values; null counts as silence. Any size gives the same but for rounding."""
    attack, release = (1 - math.exp(-1 / (s * rate)) for s in (ATTACK_S, RELEASE_S))
    keys = [*by, "chunk"]

    def power_of(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        t = t.sort_by("n")
        x = np.stack([np.nan_to_num(t.column(v).to_numpy(zero_copy_only=False).astype(float)) for v in values])
        return t, x, (x * x).mean(0)

    def function(t: pa.Table) -> pa.Table:
        t, _, power = power_of(t)
        start, factor, add = follower(power, attack, release)
        return pa.table({**{k: t.column(k).slice(0, 1) for k in keys}, "start": [start.tolist()], "factor": [factor.tolist()], "add": [add.tolist()]})

    x = _chunks(samples, by, order, values, size)
    kinds = {c: x.schema[c].dataType.simpleString() for c in keys}
    schema = ", ".join(f"{c} {t}" for c, t in kinds.items())
    functions = x.groupBy(*keys).applyInArrow(function, f"{schema}, start array<double>, factor array<double>, add array<double>")

    def step(envelope: float, row: tuple) -> tuple[float, float]:
        start, factor, add = row
        k = int(np.searchsorted(start, envelope, "right")) - 1
        return factor[k] * envelope + add[k], envelope

    first = staged(folded(functions, by, ["chunk"], float, step, ["start", "factor", "add"], "envelope", "double").select(*keys, "envelope"))
    fields = f"{', '.join(f'{c} {kinds[c]}' for c in by)}, n long, gain double, {', '.join(f'{v} double' for v in values)}"

    def apply(t: pa.Table, state: pa.Table) -> pa.Table:
        t, x, power = power_of(t)
        envelope, out = state.column("envelope")[0].as_py(), np.empty(len(power))
        for i, p in enumerate(power.tolist()):
            envelope += (attack if p > envelope else release) * (p - envelope)
            out[i] = envelope
        level = np.where(out > 1e-12, 10 * np.log10(np.maximum(out, 1e-12)), -120.0)
        gain = 10 ** (curve(level) / 20)
        return pa.table({**{k: t.column(k) for k in by}, "n": t.column("n"), "gain": gain, **dict(zip(values, x * gain, strict=True))})

    return x.groupBy(*keys).cogroup(first.groupBy(*keys)).applyInArrow(apply, fields)


def peaks(x: np.ndarray) -> np.ndarray:
    """The largest magnitude at and between each of the samples (channels x samples, with BACK before and AHEAD after)."""
    taps = np.array([t for p in PHASES for t in (p, p[::-1])])
    seen = np.lib.stride_tricks.sliding_window_view(x, BACK + AHEAD + 1, axis=1)[:, :, ::-1]
    return np.abs(np.einsum("ctk,pk->cpt", seen, taps)).max((0, 1))


def limited(samples: DataFrame, by: list[str], order: str, values: list[str], rate: float, size: int = CHUNK) -> DataFrame:
    """by, n, gain, and each of values times gain: no peak, also between samples, is over the ceiling.

    What each sample's peak needs is the ceiling over it. The least of these over the look-ahead, averaged over as many
    samples before, is what the gain may be at most; it comes back to 1 slowly. So the reduction (1 less the gain) is the
    greatest of those needed so far, each faded by the time since: a running maximum, of which a chunk takes over one
    number from the chunk before. Chunks get the samples around them that windows reach."""
    ahead = max(1, round(LOOKAHEAD_S * rate))
    keep, ceiling = math.exp(-1 / (LIMIT_RELEASE_S * rate)), 10 ** (CEILING_DB / 20)
    keys = [*by, "chunk"]
    x = _chunks(samples.join(samples.groupBy(*by).agg(F.max(order).alias("_last")), by), by, order, [*values, "_last"], size, ahead + BACK, ahead + AHEAD)  # the first chunk begins `ahead` before the sound
    kinds = {c: x.schema[c].dataType.simpleString() for c in keys}

    def needed(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, int]:
        chunk, last = t.column("chunk")[0].as_py(), int(t.column("_last")[0].as_py())
        low, high = (chunk * size if chunk else -ahead), min((chunk + 1) * size, last + 1)
        if high <= low:
            return t.slice(0, 0), np.zeros(0), np.zeros((len(values), 0)), low
        a = low - ahead
        sound = np.zeros((len(values), high + ahead + AHEAD - (a - BACK)))
        n = t.column("n").to_numpy()
        own = (n >= a - BACK) & (n < high + ahead + AHEAD)
        for c, v in enumerate(values):
            sound[c, n[own] - (a - BACK)] = np.nan_to_num(t.column(v).to_numpy(zero_copy_only=False).astype(float))[own]
        top = peaks(sound)  # of the samples from a to high + ahead
        gain = np.where(top > ceiling, ceiling / np.maximum(top, 1e-300), 1.0)
        gain[np.arange(a, high + ahead) < 0] = 1.0
        least = np.lib.stride_tricks.sliding_window_view(gain, ahead + 1).min(1)
        mean = np.lib.stride_tricks.sliding_window_view(least, ahead + 1).mean(1)
        return t, 1 - mean, sound[:, low - (a - BACK) : high - (a - BACK)], low

    def faded(need: np.ndarray, before: float) -> np.ndarray:
        out = np.empty(len(need))
        for i, d in enumerate(need.tolist()):
            before = max(d, before * keep)
            out[i] = before
        return out

    def function(t: pa.Table) -> pa.Table:
        _, need, _, _ = needed(t)
        after = float(faded(need, 0.0)[-1]) if len(need) else 0.0
        return pa.table({**{k: t.column(k).slice(0, 1) for k in keys}, "after": [after], "length": pa.array([len(need)], pa.int64())})

    schema = ", ".join(f"{c} {t}" for c, t in kinds.items())
    functions = x.groupBy(*keys).applyInArrow(function, f"{schema}, after double, length long")
    first = staged(folded(functions, by, ["chunk"], float, lambda s, r: (max(r[0], s * keep ** r[1]), s), ["after", "length"], "reduction", "double").select(*keys, "reduction"))
    fields = f"{', '.join(f'{c} {kinds[c]}' for c in by)}, n long, gain double, {', '.join(f'{v} double' for v in values)}"

    def apply(t: pa.Table, state: pa.Table) -> pa.Table:
        t, need, sound, low = needed(t)
        n = np.arange(low, low + len(need))
        gain = 1 - faded(need, state.column("reduction")[0].as_py() if state.num_rows else 0.0)
        own = n >= 0
        head = {k: pa.array([t.column(k)[0].as_py()] * int(own.sum()), t.schema.field(k).type) if t.num_rows else pa.array([], t.schema.field(k).type) for k in by}
        return pa.table({**head, "n": n[own].astype(np.int64), "gain": gain[own], **{v: sound[c][own] * gain[own] for c, v in enumerate(values)}})

    return x.groupBy(*keys).cogroup(first.groupBy(*keys)).applyInArrow(apply, fields)


#: Samples a second of the queries' series, and of a chunk of theirs.
RATE, SMALL = 1000.0, 24


def sound(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user in time order as a sound of one channel."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")) - 1
    wave = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1) * F.least(F.lit(2.0), F.col("v") / 9000.0)
    return points(spark, d).select(F.col("user_id").alias("series"), n.alias("n"), wave.alias("x"))


_SOUND = "sound AS (SELECT user_id AS series, (row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1)::INTEGER AS n, (CASE event_id % 2 WHEN 0 THEN 1 ELSE -1 END * least(2.0::DOUBLE, v / 9000.0::DOUBLE)) AS x FROM pts)"
_A, _R = (1 - math.exp(-1 / (s * RATE)) for s in (ATTACK_S, RELEASE_S))
_ENVELOPE = f"""env AS (SELECT series, n, {_A} * x * x AS e FROM sound WHERE n = 0
  UNION ALL SELECT s.series, s.n, e + CASE WHEN x * x > e THEN {_A} ELSE {_R} END * (x * x - e) FROM env JOIN sound s ON s.series = env.series AND s.n = env.n + 1)"""


@query("d24_compressor", f"""WITH RECURSIVE pts AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type AS kind, CAST(round(value * 100) AS BIGINT) AS v FROM events), {_SOUND}, {_ENVELOPE},
lev AS (SELECT series, n, CASE WHEN e > 1e-12 THEN 10 * log10(e) ELSE -120.0 END + 18 AS o FROM env)
SELECT series, n::BIGINT AS n, round(power(10, CASE WHEN o <= -3 THEN 0 WHEN o >= 3 THEN -0.5 * o ELSE -0.5 * (o + 3) * (o + 3) / 12 END / 20), 7) AS gain FROM lev""")
def d24_compressor(spark: SparkSession, d: str) -> DataFrame:
    return compressed(sound(spark, d), ["series"], "n", ["x"], RATE, SMALL).select("series", "n", F.round("gain", 7).alias("gain"))


_L, _KEEP, _TOP = max(1, round(LOOKAHEAD_S * RATE)), math.exp(-1 / (LIMIT_RELEASE_S * RATE)), 10 ** (CEILING_DB / 20)
_FIR = ", ".join("abs(" + " + ".join(f"{c} * coalesce(lag(x, {k}) OVER w, 0)" if k else f"{c} * x" for k, c in enumerate(p)) + ")" for q in PHASES for p in (q, q[::-1]))


@query("d24_limiter", f"""WITH pts AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type AS kind, CAST(round(value * 100) AS BIGINT) AS v FROM events), {_SOUND},
ext AS (SELECT g.series, g.n, coalesce(s.x, 0) AS x FROM (SELECT series, unnest(range({-2 * _L}, max(n) + {_L + AHEAD + 1})) AS n FROM sound GROUP BY series) g LEFT JOIN sound s USING (series, n)),
pk AS (SELECT series, n - {AHEAD} AS n, greatest({_FIR}) AS p FROM ext WINDOW w AS (PARTITION BY series ORDER BY n)),
req AS (SELECT series, n, CASE WHEN n >= 0 AND p > {_TOP} THEN {_TOP} / p ELSE 1 END AS g FROM pk),
lst AS (SELECT series, n, min(g) OVER (PARTITION BY series ORDER BY n ROWS BETWEEN CURRENT ROW AND {_L} FOLLOWING) AS g FROM req),
avgs AS (SELECT series, n, 1 - avg(g) OVER (PARTITION BY series ORDER BY n ROWS BETWEEN {_L} PRECEDING AND CURRENT ROW) AS d FROM lst),
run AS (SELECT series, n, max(CASE WHEN d > 1e-15 THEN ln(d) - n * ({math.log(_KEEP)}) END) OVER (PARTITION BY series ORDER BY n) AS m FROM avgs WHERE n >= {-_L})
SELECT r.series, r.n::BIGINT AS n, round(1 - coalesce(exp(m + r.n * ({math.log(_KEEP)})), 0), 7) AS gain FROM run r JOIN sound s ON s.series = r.series AND s.n = r.n""")
def d24_limiter(spark: SparkSession, d: str) -> DataFrame:
    return limited(sound(spark, d), ["series"], "n", ["x"], RATE, SMALL).select("series", "n", F.round("gain", 7).alias("gain"))
