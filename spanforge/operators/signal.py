"""Windowed aggregation of signals: framing, gated loudness, sliding choices, rate bounds, interpolation."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import decibels
from ..registry import query
from ..sources.tables import POINTS, points
from .folds import folded
from .segments import rank_percentiles

DAY = 86_400_000_000
OFFSET = -0.691
#: Samples of a marker that is looked for.
MARKER = 100_000


def framed(samples: DataFrame, by: list[str], time: str, value: str, step: int, floor: float = -120.0) -> DataFrame:
    """by, frame, db: mean square of each frame of a fixed grid in decibels; a frame without samples has the floor.

    The grid spans each group's first to last sample; samples are summed by frame before the join with the grid."""
    frame = F.floor(F.col(time) / step).cast("long")
    power = samples.groupBy(*by, frame.alias("frame")).agg(F.avg(F.col(value) * F.col(value)).alias("power"))
    spine = power.groupBy(*by).agg(F.min("frame").alias("a"), F.max("frame").alias("z")).select(*by, F.explode(F.sequence("a", "z")).alias("frame"))
    db = F.when(F.col("power") > 0, F.greatest(F.lit(floor), 10 * F.log10("power"))).otherwise(F.lit(floor))
    return spine.join(power, [*by, "frame"], "left").select(*by, "frame", db.alias("db"))


def sliding(parts: DataFrame, by: list[str], order: str, value: str, n: int) -> DataFrame:
    """Means over n consecutive parts, complete windows only: by, order (of the first part), mean."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(0, n - 1)
    return parts.select(*by, order, F.avg(value).over(w).alias("mean"), F.count(value).over(w).alias("_n")).where(F.col("_n") == n).drop("_n")


def _energy(lufs: float | Column) -> Column:
    return F.pow(F.lit(10.0), ((F.lit(lufs) if isinstance(lufs, float) else lufs) - OFFSET) / 10)


def integrated(parts: DataFrame, by: list[str], absolute: float = -70.0, relative: float = -10.0, n: int = 4) -> DataFrame:
    """by, lufs: loudness of blocks of n parts above an absolute gate and then one relative to their mean; minus
    infinity where nothing passes."""
    blocks = sliding(parts, by, "part", "energy", n)
    loud = blocks.where(F.col("mean") > _energy(absolute))
    gate = loud.groupBy(*by).agg(_energy(decibels(F.avg("mean"), OFFSET) + relative).alias("gate"))
    gated = loud.join(gate, by).where(F.col("mean") > F.col("gate")).groupBy(*by).agg(decibels(F.avg("mean"), OFFSET).alias("lufs"))
    return parts.select(*by).distinct().join(gated, by, "left").select(*by, F.coalesce("lufs", F.lit(float("-inf"))).alias("lufs"))


def loudness_range(parts: DataFrame, by: list[str], absolute: float = -70.0, n: int = 30) -> DataFrame:
    """by, lra: 95th less 10th percentile, interpolated, of the sliding loudness above the gates; 0 with fewer than two values."""
    loud = sliding(parts, by, "part", "energy", n).where(F.col("mean") > _energy(absolute))
    gate = loud.groupBy(*by).agg((decibels(F.avg("mean"), OFFSET) - 20).alias("gate"))
    level = loud.join(gate, by).withColumn("l", decibels(F.col("mean"), OFFSET)).where("l > gate")
    spread = level.groupBy(*by).agg((F.percentile("l", F.lit(0.95)) - F.percentile("l", F.lit(0.1))).alias("lra"), F.count("*").alias("n"))
    return parts.select(*by).distinct().join(spread, by, "left").select(*by, F.when(F.col("n") >= 2, F.greatest(F.lit(0.0), "lra")).otherwise(0.0).alias("lra"))


def best_stretch(parts: DataFrame, by: list[str], n: int, sounding: Column, share: float = 0.4) -> DataFrame:
    """by, start: the quietest stretch of n parts of which enough sound, else the loudest; the first of equals."""
    w = Window.partitionBy(*by).orderBy("part").rowsBetween(0, n - 1)
    s = parts.select(*by, "part", F.sum("energy").over(w).alias("e"), F.sum(sounding.cast("int")).over(w).alias("c"), F.count("*").over(w).alias("k")).where(F.col("k") == n)
    fine = F.when(F.col("c") >= n * share, F.struct("e", "part"))
    got = s.groupBy(*by).agg(F.min(fine).alias("quiet"), F.min(F.struct((-F.col("e")).alias("e"), "part")).alias("loud"))
    return got.select(*by, F.coalesce("quiet.part", "loud.part").alias("start"))


def within_rate(ticks: DataFrame, by: list[str], time: str, per_second: float, resolution: int) -> DataFrame:
    """by, verdict: timing where ticks don't rise, fps where the mean rate or that of any stretch of a second is too high, else ok.

    Ticks of one stretch are at most a second apart, so each tick meets those within a second before it only: a
    window over a range of time counts them, and the tightest stretch is found from its first tick."""
    w = Window.partitionBy(*by).orderBy("nth")
    x = ticks.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("event_id")))
    x = x.withColumn("step", F.col(time) - F.lag(time).over(w))
    slack = 1e-6 + 2 / resolution
    near = Window.partitionBy(*by).orderBy(time).rangeBetween(-int((1 + slack) * resolution), 0)
    # j - i > rate (t_j - t_i + slack) + 1 for some i: the greatest of rate t_i - i in reach decides
    key = F.lit(per_second) * F.col(time) / resolution - F.col("nth")
    x = x.withColumn("key", key).withColumn("over", F.max("key").over(near) - F.col("key") > per_second * slack + 1 + 1e-9)
    got = x.groupBy(*by).agg(F.min("step").alias("least"), F.bool_or("over").alias("over"), F.count("*").alias("n"), ((F.max(time) - F.min(time)) / resolution).alias("span"))
    mean = (F.col("n") > 1) & ((F.col("n") - 1) / F.greatest("span", F.lit(1e-12)) > per_second * 1.01)
    return got.select(*by, F.when(F.col("least") <= 0, "timing").when(mean | F.col("over"), "fps").otherwise("ok").alias("verdict"))


def interpolated(grid: DataFrame, knots: DataFrame, by: list[str], at: str = "x") -> DataFrame:
    """Adds y to each grid row: linear between the knots (by, x, y) around it, held flat outside."""
    k = knots.select(*by, F.col("x").alias("_x"), F.struct("x", "y").alias("_k"), F.lit(0).alias("_grid"))
    g = grid.select(*by, F.col(at).alias("_x"), F.lit(None).cast(k.schema["_k"].dataType).alias("_k"), F.lit(1).alias("_grid"))
    w = Window.partitionBy(*by).orderBy("_x", "_grid")
    both = k.unionByName(g)
    both = both.withColumn("a", F.last("_k", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.first("_k", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    part = F.coalesce(F.try_divide(F.col("_x") - F.col("a.x"), F.col("b.x") - F.col("a.x")), F.lit(0.0))
    y = F.coalesce(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("a.y") + (F.col("b.y") - F.col("a.y")) * part), F.col("a.y"), F.col("b.y"))
    return both.where("_grid = 1").select(*by, F.col("_x").alias(at), y.alias("y"))


# Fixed values of ITU-R BS.1770-4, Annex 1, as an analogue prototype: the shelf's frequency, gain in dB, quality and the
# power of its gain at the band's edge; the high pass's frequency and quality.
SHELF_HZ, SHELF_DB, SHELF_Q, SHELF_EDGE = 1681.974450955533, 3.999843853973347, 0.7071752369554196, 0.4996667741545416
PASS_HZ, PASS_Q = 38.13547087602444, 0.5003270373238773


def k_filter(rate: float) -> list[tuple[tuple[float, float, float], tuple[float, float]]]:
    """(feed-forward, feedback) coefficients of the two stages of the K filter at a sample rate, by the bilinear transform."""

    def stage(hz: float, q: float, low: float, band: float, high: float) -> tuple:
        w = math.tan(math.pi * hz / rate)
        top, bottom = (high + band * w / q + low * w * w), 1 + w / q + w * w
        ahead = (top / bottom, 2 * (low * w * w - high) / bottom, (high - band * w / q + low * w * w) / bottom)
        return ahead, (2 * (w * w - 1) / bottom, (1 - w / q + w * w) / bottom)

    gain = 10 ** (SHELF_DB / 20)
    shelf, (_, back) = stage(SHELF_HZ, SHELF_Q, 1.0, gain**SHELF_EDGE, gain), stage(PASS_HZ, PASS_Q, 0.0, 0.0, 1.0)
    return [shelf, ((1.0, -2.0, 1.0), back)]


def filtered(samples: DataFrame, by: list[str], order: str, value: str, stages: list) -> DataFrame:
    """samples with y: their value after recursive filters of second order, one after another. A filter's state is two
    numbers a stage, so a series goes through in one fold whatever its length; series are independent."""

    def step(state: list, row: tuple) -> tuple:
        x, after = row[0], []
        for (b0, b1, b2), (a1, a2), (s, t) in ((b, a, st) for (b, a), st in zip(stages, state, strict=True)):
            y = b0 * x + s
            after.append((b1 * x - a1 * y + t, b2 * x - a2 * y))
            x = y
        return after, x

    return folded(samples, by, [order], lambda: [(0.0, 0.0)] * len(stages), step, [value], "y", "double")


def smoothed(rows: DataFrame, by: list[str], at: str, value: str, reach: int, alike: float, most: float) -> DataFrame:
    """by, at, steady, smooth: the middle of each value and its two neighbours, and the mean of the steady values around,
    weighted by the stretch each stands for (half of the way to its neighbours on each side, half a unit at least) and by
    a bell over time (reach) and over likeness of the values (alike); no further than `most` from the steady value.

    Rows meet by bins of time of three reaches, and only those within that."""
    order = Window.partitionBy(*by).orderBy(at)
    a, b, c = F.lag(value).over(order), F.col(value), F.lead(value).over(order)
    middle = F.when(a.isNotNull() & c.isNotNull(), a + b + c - F.greatest(a, b, c) - F.least(a, b, c)).otherwise(b)
    span = F.greatest(F.lit(0.5), (F.coalesce(F.lead(at).over(order), F.col(at)) - F.coalesce(F.lag(at).over(order), F.col(at))) / 2)
    x = rows.select(*by, at, value, middle.alias("steady"), span.alias("span"))
    bin_of = F.floor(F.col(at) / (3 * reach)).cast("long")
    left = x.select(*by, at, value, "steady", F.explode(F.array(bin_of - 1, bin_of, bin_of + 1)).alias("_bin"))
    right = x.select(*by, F.col(at).alias("_at"), F.col(value).alias("_v"), F.col("steady").alias("_steady"), "span", bin_of.alias("_bin"))
    time, look = (F.col("_at") - F.col(at)) / reach, (F.col("_v") - F.col(value)) / alike
    weight = F.col("span") * F.exp(-0.5 * (time * time + look * look))
    near = left.join(right, [*by, "_bin"]).where(F.abs(F.col("_at") - F.col(at)) <= 3 * reach)
    got = near.groupBy(*by, at).agg(F.first("steady").alias("steady"), (F.sum(weight * F.col("_steady")) / F.sum(weight)).alias("mean"))
    return got.select(*by, at, "steady", F.least(F.col("steady") + most, F.greatest(F.col("steady") - most, F.col("mean"))).alias("smooth"))


def best_lag(samples: DataFrame, marker: DataFrame, by: list[str], least: int, most: int, at: int = 0) -> DataFrame:
    """by, lag, correlation: how much later than `at` the marker (k, m) is found in a series (by, n, x), by normalised
    cross-correlation over the lags from least to most; the first of equals. Samples beyond the series count as silence, and a
    lag that would begin before it isn't looked at. The marker is a short fixed table, broadcast up to MARKER rows: a sample
    meets by equality the places of the marker that some lag brings to it."""
    if marker.count() > MARKER:
        raise ValueError("the marker is too long to broadcast")
    own, last = marker.agg(F.sum(F.col("m") * F.col("m")), F.max("k")).first()
    low, high = F.greatest(F.lit(0), F.col("n") - at - most), F.least(F.lit(last or 0), F.col("n") - at - least, F.col("n"))
    met = samples.select(*by, "n", "x", low.alias("low"), high.alias("high")).where("low <= high").withColumn("k", F.explode(F.sequence("low", "high")))
    met = met.join(F.broadcast(marker), "k").withColumn("lag", F.col("n") - F.col("k") - at)
    sums = met.groupBy(*by, "lag").agg(F.sum(F.col("m") * F.col("x")).alias("dot"), F.sum(F.col("x") * F.col("x")).alias("energy"))
    scored = sums.withColumn("correlation", F.when(F.col("energy") > 0, F.col("dot") / F.sqrt(F.lit(float(own or 0.0)) * F.col("energy"))).otherwise(0.0))
    return scored.groupBy(*by).agg(F.max(F.struct("correlation", (-F.col("lag")).alias("_l"))).alias("b")).select(*by, (-F.col("b._l")).cast("int").alias("lag"), F.col("b.correlation").alias("correlation"))


# How alike a marker has to come back, and how far apart the delays of two markers may be.
ALIKE, APART = 0.9, 1


def delays(samples: DataFrame, marker: DataFrame, by: list[str], places: list[int], least: int, most: int) -> DataFrame:
    """by, delay, correlation, refusal of each series into which the marker was put at `places`: the delay of the first one and
    the least likeness; marker_not_found where one of them doesn't come back alike enough, delay_inconsistent where their
    delays differ. A series without samples gives no row."""
    found = reduce(DataFrame.unionByName, (best_lag(samples, marker, by, least, most, at).withColumn("place", F.lit(k)) for k, at in enumerate(places)))
    all_ = samples.select(*by).distinct().crossJoin(F.broadcast(samples.sparkSession.range(len(places)).select(F.col("id").cast("int").alias("place"))))
    got = all_.join(found, [*by, "place"], "left").groupBy(*by).agg(F.min(F.coalesce("correlation", F.lit(-1.0))).alias("correlation"), (F.max("lag") - F.min("lag")).alias("apart"), F.min_by("lag", "place").alias("delay"))
    refusal = F.when(F.col("correlation") < ALIKE, "marker_not_found").when(F.col("apart") > APART, "delay_inconsistent")
    return got.select(*by, F.when(refusal.isNull(), F.col("delay")).alias("delay"), "correlation", refusal.alias("refusal"))


# Two of the four phases of the interpolation filter of ITU-R BS.1770-4, Annex 2; the others mirror them.
PHASES = [
    [0.001708984375, 0.010986328125, -0.0196533203125, 0.033203125, -0.0594482421875, 0.1373291015625, 0.97216796875, -0.102294921875, 0.047607421875, -0.026611328125, 0.014892578125, -0.00830078125],
    [-0.0291748046875, 0.029296875, -0.0517578125, 0.089111328125, -0.16650390625, 0.465087890625, 0.77978515625, -0.2003173828125, 0.1015625, -0.0582275390625, 0.0330810546875, -0.0189208984375],
]


def true_peak(samples: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """by, peak: the largest magnitude of a signal and its values a quarter, half and three quarters on. Each is a sum over
    the last twelve samples, so a window does it; what is before the first sample counts as 0."""
    w = Window.partitionBy(*by).orderBy(order)
    lags = [F.coalesce(F.lag(value, k).over(w), F.lit(0.0)) if k else F.col(value) for k in range(12)]
    rows = samples.select(*by, F.array(*lags).alias("last"))
    sums = [F.abs(sum((F.get("last", F.lit(k)) * c for k, c in enumerate(phase) if c), F.lit(0.0))) for p in PHASES for phase in (p, p[::-1])]
    return rows.groupBy(*by).agg(F.max(F.greatest(*sums)).alias("peak"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Events in time order as 100 ms energies: series (user_id), part, energy. A series is a recording of one user."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")) - 1
    return points(spark, d).select(F.col("user_id").alias("series"), nth.alias("part"), (F.col("v") / 1_000_000.0).alias("energy"))


PARTS = "parts AS (SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id)::INTEGER - 1 AS part, v / 1000000.0::DOUBLE AS energy FROM pts)"
_ABS = "power(10, (-70.0 + 0.691) / 10)"
_BLOCKS = "blocks AS (SELECT series, part, m FROM (SELECT series, part, avg(energy) OVER w AS m, count(*) OVER w AS n FROM parts WINDOW w AS (PARTITION BY series ORDER BY part ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) WHERE n = 4)"
_SHORT = "short AS (SELECT series, part, m FROM (SELECT series, part, avg(energy) OVER w AS m, count(*) OVER w AS n FROM parts WINDOW w AS (PARTITION BY series ORDER BY part ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)) WHERE n = 30)"


@query("d1_framed_levels", f"""SELECT s.kind, s.frame, round(CASE WHEN p.power > 0 THEN greatest(-120.0, 10 * log10(p.power)) ELSE -120.0 END, 6)::DOUBLE AS db
FROM (SELECT kind, unnest(range(lo, hi + 1)) AS frame FROM (SELECT kind, min(us // {DAY // 48}) AS lo, max(us // {DAY // 48}) AS hi FROM pts GROUP BY kind)) s
LEFT JOIN (SELECT kind, us // {DAY // 48} AS frame, avg((v / 1000.0) * (v / 1000.0)) AS power FROM pts GROUP BY ALL) p ON s.kind = p.kind AND s.frame = p.frame""", (POINTS,))
def d1(spark: SparkSession, d: str) -> DataFrame:
    rows = points(spark, d).select("kind", "us", (F.col("v") / 1000.0).alias("x"))
    return framed(rows, ["kind"], "us", "x", DAY // 48).select("kind", "frame", F.round("db", 6).alias("db"))


_STAGES = [(*b, *a) for b, a in k_filter(48_000)]
_Y1 = f"({_STAGES[0][0]!r} * p.energy + f.s1)"
_Y2 = f"({_STAGES[1][0]!r} * {_Y1} + f.s2)"
_AFTER = ", ".join(f"{b1!r} * {x} - {a1!r} * {y} + f.t{k}, {b2!r} * {x} - {a2!r} * {y}" for k, ((_, b1, b2, a1, a2), x, y) in enumerate(zip(_STAGES, ("p.energy", _Y1), (_Y1, _Y2), strict=True), 1))


@query("d3_weighted_energy", f"""WITH RECURSIVE {POINTS}, {PARTS}, f AS (SELECT series, -1 AS part, 0.0::DOUBLE AS y, 0.0::DOUBLE AS s1, 0.0::DOUBLE AS t1, 0.0::DOUBLE AS s2, 0.0::DOUBLE AS t2 FROM (SELECT DISTINCT series FROM parts)
  UNION ALL SELECT p.series, p.part, {_Y2}, {_AFTER} FROM f JOIN parts p ON p.series = f.series AND p.part = f.part + 1)
SELECT series, round(sum(y * y), 9) AS energy FROM f WHERE part >= 0 GROUP BY series""")
def d3(spark: SparkSession, d: str) -> DataFrame:
    """Energy of each series after the K filter, its parts standing for samples at 48 kHz."""
    y = filtered(parts(spark, d), ["series"], "part", "energy", k_filter(48_000))
    return y.groupBy("series").agg(F.round(F.sum(F.col("y") * F.col("y")), 9).alias("energy"))


@query("d4_integrated_loudness", f"""SELECT series, round(-0.691 + 10 * log10(avg(m)), 6)::DOUBLE AS lufs FROM (SELECT b.series, m, power(10, (-0.691 + 10 * log10(avg(m) OVER (PARTITION BY b.series)) - 10 + 0.691) / 10) AS gate FROM blocks b WHERE m > {_ABS}) WHERE m > gate GROUP BY series""", (POINTS, PARTS, _BLOCKS))
def d4(spark: SparkSession, d: str) -> DataFrame:
    return integrated(parts(spark, d), ["series"]).select("series", F.round("lufs", 6).alias("lufs"))


@query("d5_loudness_range", f"""SELECT series, round(quantile_cont(l, 0.95) - quantile_cont(l, 0.1), 6)::DOUBLE AS lra FROM (SELECT series, -0.691 + 10 * log10(m) AS l, -0.691 + 10 * log10(avg(m) OVER (PARTITION BY series)) - 20 AS gate FROM short WHERE m > {_ABS}) WHERE l > gate GROUP BY series""", (POINTS, PARTS, _SHORT))
def d5(spark: SparkSession, d: str) -> DataFrame:
    return loudness_range(parts(spark, d), ["series"]).select("series", F.round("lra", 6).alias("lra"))


def _peak_sql() -> str:
    lag = lambda k: f"coalesce(lag(energy, {k}) OVER (PARTITION BY series ORDER BY part), 0)" if k else "energy"
    sums = ["abs(" + " + ".join(f"({c!r}) * x{k}" for k, c in enumerate(phase)) + ")" for p in PHASES for phase in (p, p[::-1])]
    return f"SELECT series, round(max(greatest({', '.join(sums)})), 9)::DOUBLE AS peak FROM (SELECT series, {', '.join(f'{lag(k)} AS x{k}' for k in range(12))} FROM parts) GROUP BY series"


@query("d6_true_peak", _peak_sql(), (POINTS, PARTS))
def d6(spark: SparkSession, d: str) -> DataFrame:
    return true_peak(parts(spark, d), ["series"], "part", "energy").select("series", F.round("peak", 9).alias("peak"))


@query("d7_level_words", "SELECT event_id, CASE WHEN x < -30 THEN 'very_quiet' WHEN x < -20 THEN 'quiet' WHEN x <= -12 THEN 'fine' ELSE 'loud' END AS word, round(least(20.0, greatest(-12.0, -16 - x)), 6)::DOUBLE AS gain_db FROM (SELECT event_id, (v % 6000) / 100.0 - 60 AS x FROM pts)", (POINTS,))
def d7(spark: SparkSession, d: str) -> DataFrame:
    x = (F.col("v") % 6000) / 100.0 - 60
    word = F.when(x < -30, "very_quiet").when(x < -20, "quiet").when(x <= -12, "fine").otherwise("loud")
    return points(spark, d).select("event_id", word.alias("word"), F.round(F.least(F.lit(20.0), F.greatest(F.lit(-12.0), -16 - x)), 6).alias("gain_db"))


@query("d8_full_scale_share", "SELECT kind, round(avg(CASE WHEN abs(v / 10000.0) >= 0.95 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS share FROM pts GROUP BY kind", (POINTS,))
def d8(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).groupBy("kind").agg(F.round(F.avg(F.when(F.abs(F.col("v") / 10000.0) >= 0.95, 1.0).otherwise(0.0)), 9).alias("share"))


@query("d9_best_stretch", """SELECT series, coalesce(min_by(part, (e, part)) FILTER (c >= 20), min_by(part, (-e, part))) AS start FROM (
  SELECT series, part, sum(v) OVER w AS e, sum(CASE WHEN v > 4000 THEN 1 ELSE 0 END) OVER w AS c, count(*) OVER w AS k FROM (SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id)::INTEGER - 1 AS part, v FROM pts) WINDOW w AS (PARTITION BY series ORDER BY part ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) WHERE k = 50 GROUP BY series""", (POINTS,))
def d9(spark: SparkSession, d: str) -> DataFrame:
    p = parts(spark, d).select("series", "part", F.round(F.col("energy") * 1_000_000).cast("long").alias("energy"))
    return best_stretch(p, ["series"], 50, F.col("energy") > 4000)


@query("d10_held_gain", "SELECT series, part, round(least(4.0, 0.01 / greatest(max(energy) OVER (PARTITION BY series ORDER BY part ROWS BETWEEN 10 PRECEDING AND 5 FOLLOWING), 0.000001)), 6)::DOUBLE AS gain FROM parts", (POINTS, PARTS))
def d10(spark: SparkSession, d: str) -> DataFrame:
    """A gain that suits the loudest of the ten parts before and five after each part."""
    peak = F.max("energy").over(Window.partitionBy("series").orderBy("part").rowsBetween(-10, 5))
    return parts(spark, d).select("series", "part", F.round(F.least(F.lit(4.0), 0.01 / F.greatest(peak, F.lit(0.000001))), 6).alias("gain"))


_WITHIN, _OVER = int((1 + 1e-6 + 2 / 3_600_000_000) * 3_600_000_000), 0.2 * (1e-6 + 2 / 3_600_000_000) + 1 + 1e-9
_TICKS = """nth AS (SELECT user_id, us, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM pts),
tick AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY nth) AS step, 0.2::DOUBLE * us / 3600000000 - nth AS key FROM nth),
span AS (SELECT user_id, min(step) AS least_step, count(*) AS n, (max(us) - min(us)) / 3600000000.0::DOUBLE AS span FROM tick GROUP BY user_id)"""


@query("d12_rate_bound", f"""SELECT user_id, CASE WHEN least_step <= 0 THEN 'timing' WHEN n > 1 AND (n - 1) / greatest(span, 1e-12::DOUBLE) > 0.2::DOUBLE * 1.01::DOUBLE
  OR user_id IN (SELECT a.user_id FROM tick a JOIN tick b ON a.user_id = b.user_id AND b.us BETWEEN a.us - {_WITHIN} AND a.us AND b.key - a.key > {_OVER!r}) THEN 'fps' ELSE 'ok' END AS verdict FROM span""", (POINTS, _TICKS))
def d12(spark: SparkSession, d: str) -> DataFrame:
    """Whether each user's events come at up to one in six hours, an hour of theirs standing for a second."""
    return within_rate(points(spark, d).select("user_id", "event_id", "us"), ["user_id"], "us", 0.2, 3_600_000_000)


@query("d13_cut_candidates", """SELECT user_id, event_id FROM (SELECT user_id, event_id, kind, max(x) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, min(x) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
FROM (SELECT *, us - v * 1000000 AS x FROM pts) WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)) WHERE kind IN ('view', 'click') AND (before IS NULL OR before < after)""".replace("OVER (w ROWS", "OVER (PARTITION BY user_id ORDER BY us, event_id ROWS").replace(" WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)", ""), (POINTS,))
def d13(spark: SparkSession, d: str) -> DataFrame:
    """Views and clicks where all before is shown before all that follows, the shown time being earlier by the value."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    x = points(spark, d).withColumn("x", F.col("us") - F.col("v") * 1_000_000)
    x = x.withColumn("before", F.max("x").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.min("x").over(w.rowsBetween(0, Window.unboundedFollowing)))
    return x.where("kind IN ('view', 'click') AND (before IS NULL OR before < after)").select("user_id", "event_id")


@query("d14_head_copy_tail", """SELECT p.user_id, min(us) AS head_us, c.a AS copy_us, c.z AS tail_us, max(us) AS end_us FROM pts p JOIN (SELECT user_id, min(us) AS a, max(us) AS z FROM pts WHERE kind = 'view' GROUP BY 1 HAVING count(*) >= 2) c ON p.user_id = c.user_id GROUP BY ALL""", (POINTS,))
def d14(spark: SparkSession, d: str) -> DataFrame:
    """A user's time split at the first and last place where a copy may begin."""
    p = points(spark, d)
    c = p.where("kind = 'view'").groupBy("user_id").agg(F.min("us").alias("copy_us"), F.max("us").alias("tail_us"), F.count("*").alias("n")).where("n >= 2").drop("n")
    return p.groupBy("user_id").agg(F.min("us").alias("head_us"), F.max("us").alias("end_us")).join(c, "user_id")


@query("d16_typical_values", """SELECT user_id, max(v) FILTER (r = floor((n - 1) * 0.5 + 0.5)) AS middle FROM (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM pts) GROUP BY user_id""", (POINTS,))
def d16(spark: SparkSession, d: str) -> DataFrame:
    return rank_percentiles(points(spark, d), ["user_id"], "v", {"middle": 0.5})


@query("d17_even_samples", "SELECT user_id, lo + k * (hi - lo) // 8 AS at_us FROM (SELECT user_id, min(us) AS lo, max(us) AS hi FROM pts GROUP BY 1), (SELECT unnest(range(8)) AS k)", (POINTS,))
def d17(spark: SparkSession, d: str) -> DataFrame:
    e = points(spark, d).groupBy("user_id").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    k = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")
    return e.select("user_id", "lo", "hi", k).select("user_id", F.expr("lo + (k * (hi - lo)) div 8").alias("at_us"))


@query("d20_median_of_three", "SELECT user_id, event_id, a + b + c - greatest(a, b, c) - least(a, b, c) AS middle FROM (SELECT user_id, event_id, v AS b, coalesce(lag(v) OVER w, v) AS a, coalesce(lead(v) OVER w, v) AS c FROM pts WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))", (POINTS,))
def d20(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    x = points(spark, d).select("user_id", "event_id", F.col("v").alias("b"), F.coalesce(F.lag("v").over(w), "v").alias("a"), F.coalesce(F.lead("v").over(w), "v").alias("c"))
    return x.select("user_id", "event_id", (F.col("a") + F.col("b") + F.col("c") - F.greatest("a", "b", "c") - F.least("a", "b", "c")).alias("middle"))


_SMOOTH = f"""near3 AS (SELECT user_id, us // 3600000000 AS h, max(v)::DOUBLE AS v FROM pts GROUP BY ALL),
steady AS (SELECT user_id, h, v, CASE WHEN lag(v) OVER w IS NULL OR lead(v) OVER w IS NULL THEN v ELSE lag(v) OVER w + v + lead(v) OVER w - greatest(lag(v) OVER w, v, lead(v) OVER w) - least(lag(v) OVER w, v, lead(v) OVER w) END AS steady,
  greatest(0.5, (coalesce(lead(h) OVER w, h) - coalesce(lag(h) OVER w, h)) / 2.0::DOUBLE) AS span FROM near3 WINDOW w AS (PARTITION BY user_id ORDER BY h)),
mean AS (SELECT a.user_id, a.h, a.steady, sum(b.span * exp(-0.5 * (((b.h - a.h) / 24.0::DOUBLE) ** 2 + ((b.v - a.v) / 2000.0::DOUBLE) ** 2)) * b.steady) / sum(b.span * exp(-0.5 * (((b.h - a.h) / 24.0::DOUBLE) ** 2 + ((b.v - a.v) / 2000.0::DOUBLE) ** 2))) AS m
  FROM steady a JOIN steady b ON a.user_id = b.user_id AND abs(b.h - a.h) <= 72 GROUP BY ALL)"""


@query("d20_kernel_average", "SELECT user_id, h, round(steady, 6) AS steady, round(least(steady + 500, greatest(steady - 500, m)), 6) AS smooth FROM mean", (POINTS, _SMOOTH))
def d20_smooth(spark: SparkSession, d: str) -> DataFrame:
    """The greatest value of each user's hours, smoothed over a day."""
    rows = points(spark, d).groupBy("user_id", F.floor(F.col("us") / 3_600_000_000).cast("long").alias("h")).agg(F.max("v").cast("double").alias("v"))
    return smoothed(rows, ["user_id"], "h", "v", 24, 2000.0, 500.0).select("user_id", "h", F.round("steady", 6).alias("steady"), F.round("smooth", 6).alias("smooth"))


@query("d21_interpolated", f"""SELECT g.user_id, g.x, round(CASE WHEN a.x IS NULL THEN b.y WHEN b.x IS NULL OR a.x = b.x THEN a.y ELSE a.y + (b.y - a.y) * ((g.x - a.x)::DOUBLE / (b.x - a.x)) END, 6)::DOUBLE AS y
FROM (SELECT user_id, unnest(range(lo, hi + 1, {DAY})) AS x FROM (SELECT user_id, min(us) AS lo, max(us) AS hi FROM pts GROUP BY 1)) g
LEFT JOIN LATERAL (SELECT us AS x, v AS y FROM pts p WHERE p.user_id = g.user_id AND kind = 'view' AND us <= g.x ORDER BY us DESC LIMIT 1) a ON true
LEFT JOIN LATERAL (SELECT us AS x, v AS y FROM pts p WHERE p.user_id = g.user_id AND kind = 'view' AND us >= g.x ORDER BY us LIMIT 1) b ON true""", (POINTS,))
def d21(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    grid = p.groupBy("user_id").agg(F.min("us").alias("a"), F.max("us").alias("z")).select("user_id", F.explode(F.sequence("a", "z", F.lit(DAY))).alias("x"))
    knots = p.where("kind = 'view'").select("user_id", F.col("us").alias("x"), F.col("v").cast("double").alias("y"))
    return interpolated(grid, knots, ["user_id"]).select("user_id", "x", F.round("y", 6).alias("y"))


@query("d23_grid_parts", f"SELECT user_id, beg AS start_us, least(beg + {7 * DAY}, hi) AS end_us FROM (SELECT user_id, hi, unnest(range(lo, hi, {7 * DAY})) AS beg FROM (SELECT user_id, min(us) AS lo, max(us) AS hi FROM pts GROUP BY 1))", (POINTS,))
def d23(spark: SparkSession, d: str) -> DataFrame:
    e = points(spark, d).groupBy("user_id").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    at = e.select("user_id", "hi", F.explode(F.sequence("lo", "hi", F.lit(7 * DAY))).alias("at")).where("at < hi")
    return at.select("user_id", F.col("at").alias("start_us"), F.least(F.col("at") + 7 * DAY, "hi").alias("end_us"))


_LAG = """marker AS (SELECT k, ((k * 7) % 5 - 2)::DOUBLE AS m FROM (SELECT unnest(range(12)) AS k)),
lags AS (SELECT p.series, p.part - m.k AS lag, sum(m * (energy - 0.005)) AS dot, sum((energy - 0.005) * (energy - 0.005)) AS e FROM parts p JOIN marker m ON p.part BETWEEN m.k AND m.k + 20 GROUP BY ALL),
corr AS (SELECT series, lag, CASE WHEN e > 0 THEN dot / sqrt((SELECT sum(m * m) FROM marker) * e) ELSE 0 END AS c FROM lags)"""


_TWO = """chirp AS (SELECT k, sin(k * k / 3.0::DOUBLE) AS m FROM (SELECT unnest(range(9)) AS k)),
rec AS (SELECT user_id AS series, unnest(range(60)) AS n, user_id % 7 AS d, user_id % 11 = 0 AS late, user_id % 13 = 0 AS noisy FROM (SELECT DISTINCT user_id FROM pts)),
snd AS (SELECT r.series, r.n, coalesce(a.m, 0) + coalesce(b.m, 0) + CASE WHEN noisy THEN ((r.n * 37) % 11 - 5) / 4.0::DOUBLE ELSE 0 END AS x FROM rec r LEFT JOIN chirp a ON r.n = a.k + 5 + d LEFT JOIN chirp b ON r.n = b.k + 30 + d + CASE WHEN late THEN 4 ELSE 0 END),
fit2 AS (SELECT series, pl, n - k - pl AS lag, sum(m * x) AS dot, sum(x * x) AS e FROM snd, chirp, (VALUES (5), (30)) AS p(pl) WHERE n - k - pl BETWEEN -3 AND 14 AND n >= k GROUP BY ALL),
best2 AS (SELECT series, pl, max_by(lag, (c, -lag)) AS lag, max(c) AS c FROM (SELECT series, pl, lag, CASE WHEN e > 0 THEN dot / sqrt((SELECT sum(m * m) FROM chirp) * e) ELSE 0 END AS c FROM fit2) GROUP BY series, pl),
both2 AS (SELECT series, min(c) AS c, max(lag) - min(lag) AS apart, min_by(lag, pl) AS lag FROM best2 GROUP BY series)"""


@query("d22_marker_delay", "SELECT series, CASE WHEN c >= 0.9 AND apart <= 1 THEN lag END::INTEGER AS delay, round(c, 7) AS correlation, CASE WHEN c < 0.9 THEN 'marker_not_found' WHEN apart > 1 THEN 'delay_inconsistent' END AS refusal FROM both2", (POINTS, _TWO))
def d22_delay(spark: SparkSession, d: str) -> DataFrame:
    """Two markers in a recording of each user, which comes back later by the user's number; some recordings stretch, some are noisy."""
    marker = spark.range(9).select(F.col("id").cast("int").alias("k"), F.sin(F.col("id") * F.col("id") / 3.0).alias("m"))
    u = points(spark, d).select("user_id").distinct().select(F.col("user_id").alias("series"), F.explode(F.sequence(F.lit(0), F.lit(59))).alias("n"))
    late, delay = F.when(F.col("series") % 11 == 0, 4).otherwise(0), F.col("series") % 7
    chirp = lambda at: F.when(at.between(0, 8), F.sin(at * at / 3.0)).otherwise(0.0)
    noise = F.when(F.col("series") % 13 == 0, ((F.col("n") * 37) % 11 - 5) / 4.0).otherwise(0.0)
    rows = u.select("series", "n", (chirp(F.col("n") - 5 - delay) + chirp(F.col("n") - 30 - delay - late) + noise).alias("x"))
    return delays(rows, marker, ["series"], [5, 30], -3, 14).select("series", "delay", F.round("correlation", 7).alias("correlation"), "refusal")


@query("d22_best_lag", "SELECT series, max_by(lag, (c, -lag))::INTEGER AS lag, round(max(c), 9) AS correlation FROM corr GROUP BY series", (POINTS, PARTS, _LAG))
def d22(spark: SparkSession, d: str) -> DataFrame:
    """Where a marker of twelve parts fits best in the first parts of each series."""
    marker = spark.range(12).select(F.col("id").cast("int").alias("k"), ((F.col("id") * 7) % 5 - 2).cast("double").alias("m"))
    rows = parts(spark, d).select("series", F.col("part").alias("n"), (F.col("energy") - 0.005).alias("x"))
    return best_lag(rows, marker, ["series"], 0, 20).select("series", "lag", F.round("correlation", 9).alias("correlation"))
