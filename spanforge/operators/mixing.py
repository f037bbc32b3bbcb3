"""Sounds on one clock: resampling at a rational rate, averaging of channels, fades, and sums of streams."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import POINTS, points
from .dynamics import _SOUND, sound

# Fixed values of the low pass: shape of its Kaiser window, zero crossings on each side, where its band ends below half of the
# lower rate; phases beyond which a ratio is rounded.
BETA, CROSSINGS, BAND, PHASES = 8.0, 16, 0.92, 1024
#: Samples of a chunk of output.
CHUNK = 4096


def ratio(into: int, out: int) -> tuple[int, int]:
    """(step, phases): an output sample is step / phases input samples on from the one before."""
    common = math.gcd(into, out)
    step, phases = into // common, out // common
    return (step, phases) if phases <= PHASES else (math.floor(step * PHASES / phases + 0.5), PHASES)


def low_pass(into: int, out: int) -> np.ndarray:
    """Taps by phase: a windowed sinc below the lower half rate, of unit gain for a steady level. Odd in number, the middle one
    at the input sample at or before the output."""
    _, phases = ratio(into, out)
    cut = 0.5 * BAND * min(1.0, out / into)
    half = math.ceil(CROSSINGS / (2 * cut))
    t = np.arange(-half, half + 1)[None] - np.arange(phases)[:, None] / phases
    taps = 2 * cut * np.sinc(2 * cut * t) * np.where(np.abs(t) < half + 1, np.i0(BETA * np.sqrt(np.maximum(0, 1 - (t / (half + 1)) ** 2))) / np.i0(BETA), 0)
    return taps / taps.sum(1, keepdims=True)


def downmixed(samples: DataFrame, channels: list[str], name: str = "x") -> DataFrame:
    """samples with the mean of their channels; null counts as silence."""
    return samples.withColumn(name, sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in channels), F.lit(0.0)) / len(channels))


def resampled(samples: DataFrame, by: list[str], order: str, value: str, into: int, out: int, size: int = CHUNK) -> DataFrame:
    """by, n, value: sounds of `into` samples a second at `out` a second, round(samples * out / into) of them.

    Output samples are dealt in chunks of `size`; an input sample goes to the chunks whose filters reach it, so chunks are
    worked out side by side, each as one product of windows of samples with the taps of their phases. What lies beyond a
    sound, and a null, is silence. An empty table gives no rows."""
    step, phases = ratio(into, out)
    taps = low_pass(into, out)
    half, keys = taps.shape[1] // 2, [*by, "chunk"]
    n = F.col(order)
    chunk = lambda i: F.greatest(F.lit(0), F.floor(i * phases / step / size)).cast("long")
    x = samples.join(samples.groupBy(*by).agg(F.floor((F.max(order) + 1) * out / into + 0.5).cast("long").alias("_length")), by)
    x = x.select(*by, n.cast("long").alias("n"), F.col(value).cast("double").alias("x"), "_length", F.explode(F.sequence(chunk(n - half - 1), chunk(n + half + 1))).alias("chunk"))
    kinds = {c: x.schema[c].dataType.simpleString() for c in by}

    def work(t: pa.Table) -> pa.Table:
        c, length = t.column("chunk")[0].as_py(), t.column("_length")[0].as_py()
        k = np.arange(c * size, max(c * size, min((c + 1) * size, length)))
        centre, phase = k * step // phases, k * step % phases
        low = int(centre[0]) - half if len(k) else 0
        heard = np.zeros(int(centre[-1]) + half + 1 - low if len(k) else 0)
        at = t.column("n").to_numpy() - low
        own = (at >= 0) & (at < len(heard))
        heard[at[own]] = np.nan_to_num(t.column("x").to_numpy(zero_copy_only=False).astype(float))[own]
        y = np.einsum("ij,ij->i", heard[(centre - half - low)[:, None] + np.arange(2 * half + 1)], taps[phase]) if len(k) else np.zeros(0)
        head = {c: pa.array([t.column(c)[0].as_py()] * len(k), t.schema.field(c).type) for c in by}
        return pa.table({**head, "n": k.astype(np.int64), value: y})

    return x.groupBy(*keys).applyInArrow(work, f"{', '.join(f'{c} {k}' for c, k in kinds.items())}, n long, {value} double")


def envelope(us: Column, start_us: Column, length_us: Column, fade_in_us: Column, fade_out_us: Column, gain: Column) -> Column:
    """The gain of a track at an instant: none before its start and from its end on, rising and falling in a line at its edges."""
    at = us - start_us
    rise = F.when(fade_in_us > 0, at / fade_in_us).otherwise(1.0)
    fall = F.when(fade_out_us > 0, (length_us - at) / fade_out_us).otherwise(1.0)
    return F.when((at >= 0) & (at < length_us), gain * F.greatest(F.lit(0.0), F.least(F.lit(1.0), rise, fall))).otherwise(0.0)


def mixed(clock: DataFrame, streams: DataFrame, samples: DataFrame, by: list[str], gain: Column) -> DataFrame:
    """by, n, x: the sum of the streams at each output sample of a clock (by, n), between -1 and 1.

    streams: by, stream, first and step (the place in its samples of output 0, and how far each output moves on), and what
    gain reads; samples: by, stream, k, x. A place between two samples is read on the line between them; beyond the
    samples is silence. An output meets the two samples that it needs by equality, and streams of an output add up by
    partial sums. An output that no stream reaches is 0."""
    at = F.col("first") + F.col("n") * F.col("step")
    placed = clock.join(streams, by).withColumn("_g", gain).where("_g <> 0").withColumn("_at", at).withColumn("_k", F.floor("_at").cast("long"))
    two = placed.select(*by, "n", "stream", F.explode(F.array(F.struct(F.col("_k").alias("k"), (F.col("_g") * (1 - (F.col("_at") - F.col("_k")))).alias("w")), F.struct((F.col("_k") + 1).alias("k"), (F.col("_g") * (F.col("_at") - F.col("_k"))).alias("w")))).alias("e")).select(*by, "n", "stream", "e.k", "e.w")
    heard = two.join(samples.select(*by, "stream", F.col("k").cast("long").alias("k"), "x"), [*by, "stream", "k"]).groupBy(*by, "n").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    return clock.select(*by, "n").join(heard, [*by, "n"], "left").select(*by, "n", F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.coalesce("x", F.lit(0.0)))).alias("x"))


_TAPS = ", ".join(f"({p}, {j - low_pass(3, 2).shape[1] // 2}, {t!r})" for p, row in enumerate(low_pass(3, 2).tolist()) for j, t in enumerate(row))


@query("d11_resampled", f"""SELECT o.series, o.n, round(sum(t * coalesce(s.x, 0)), 7) AS x FROM (SELECT series, unnest(range(floor((max(n) + 1) * 2 / 3.0 + 0.5)::BIGINT)) AS n FROM sound GROUP BY series) o
JOIN (VALUES {_TAPS}) AS f(p, j, t) ON p = o.n * 3 % 2 LEFT JOIN sound s ON s.series = o.series AND s.n = o.n * 3 // 2 + j GROUP BY o.series, o.n""", (POINTS, _SOUND))
def d11_resampled(spark: SparkSession, d: str) -> DataFrame:
    """Sounds of users at two thirds of their rate."""
    return resampled(sound(spark, d), ["series"], "n", "x", 3, 2, 16).select("series", "n", F.round("x", 7).alias("x"))


_TRACKS = """tracks AS (SELECT DISTINCT user_id AS series, s AS stream, s * 2.5::DOUBLE AS first, CASE s WHEN 0 THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END AS step, user_id % 5 * 1000000 AS start_us, 30000000 AS length_us, 4000000 * s AS fade_in_us, 9000000 AS fade_out_us, 0.8::DOUBLE AS gain FROM pts, (VALUES (0), (1)) AS v(s)),
put AS (SELECT c.series, c.n, t.first + c.n * t.step AS at, c.n * 1000000 - start_us AS o, t.* EXCLUDE (series) FROM sound c JOIN tracks t USING (series)),
amp AS (SELECT *, CASE WHEN o >= 0 AND o < length_us THEN gain * greatest(0, least(1, CASE WHEN fade_in_us > 0 THEN o / fade_in_us::DOUBLE ELSE 1 END, (length_us - o) / fade_out_us::DOUBLE)) ELSE 0 END AS g FROM put)"""


@query("d11_mixed", """SELECT a.series, a.n::BIGINT AS n, round(least(1, greatest(-1, sum(g * (coalesce(l.x, 0) * (1 - (a.at - floor(a.at))) + coalesce(r.x, 0) * (a.at - floor(a.at)))))), 7)::DOUBLE AS x FROM amp a
LEFT JOIN sound l ON l.series = a.series AND l.n = floor(a.at) LEFT JOIN sound r ON r.series = a.series AND r.n = floor(a.at) + 1 GROUP BY a.series, a.n""", (POINTS, _SOUND, _TRACKS))
def d11_mixed(spark: SparkSession, d: str) -> DataFrame:
    """Each user's sound, and over it the same from a later place at three quarters of the speed, both faded."""
    s = sound(spark, d)
    one = points(spark, d).select(F.col("user_id").alias("series")).distinct().withColumn("stream", F.explode(F.array(F.lit(0), F.lit(1))))
    k = F.col("stream")
    streams = one.select("series", "stream", (k * 2.5).alias("first"), F.when(k == 0, 1.0).otherwise(0.75).alias("step"), (F.col("series") % 5 * 1_000_000).alias("start_us"), F.lit(30_000_000).alias("length_us"), (k * 4_000_000).alias("fade_in_us"), F.lit(9_000_000).alias("fade_out_us"), F.lit(0.8).alias("gain"))
    samples = s.join(streams.select("series", "stream"), "series").select("series", "stream", F.col("n").alias("k"), "x")
    gain = envelope(F.col("n") * 1_000_000, F.col("start_us"), F.col("length_us"), F.col("fade_in_us"), F.col("fade_out_us"), F.col("gain"))
    got = mixed(s.select("series", F.col("n").cast("long").alias("n")), streams, samples, ["series"], gain)
    return got.select("series", "n", F.round("x", 7).alias("x"))
