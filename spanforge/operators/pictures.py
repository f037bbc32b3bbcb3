"""Pictures as rows of pixels: tone statistics from histograms, nearest colours of a palette, frames worth a closer look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.staging import staged
from ..sources.tables import POINTS, points

# Weights of light (ITU-R BT.709), shares of the percentiles, values from which a pixel counts as clipped, bins of
# middle and bright pixels, the greatest channel of those, the share of pixels that a balance needs, bins of flat areas.
LIGHT, LOW, HIGH, BRIGHT = (0.2126, 0.7152, 0.0722), 0.005, 0.995, 0.95
CLIPPED_LOW, CLIPPED_HIGH, MIDDLE, BRIGHT_BIN, TOP, LEAST_SHARE, FLAT = 1, 254, (38, 217), 64, 250, 0.01, (3, 252)
#: Weights of red, green and blue in the distance of colours; colours that a palette may have.
WEIGHTS, COLOURS = (2, 4, 3), 256


def decoded(c: Column) -> Column:
    """Linear light of an 8-bit sRGB value."""
    x = c / 255.0
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def coded(light: Column) -> Column:
    return F.when(light <= 0.0031308, light * 12.92).otherwise(1.055 * F.pow(light, F.lit(1 / 2.4)) - 0.055)


def tones(pixels: DataFrame, by: list[str]) -> DataFrame:
    """by, low, median, high (0 to 1), clipped_low, clipped_high, flat, saturation, and grey and white (each red, green and blue in
    parts of their light; null where too few pixels count) of pictures, from pixels (by, r, g, b of 0 to 255).

    All of it comes from one histogram of 256 bins of light with sums by bin, so a picture's pixels meet by partial sums
    however many there are, and a null pixel counts for nothing."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    light = sum((w * decoded(c) for w, c in zip(LIGHT, (r, g, b), strict=True)), F.lit(0.0))
    top, least = F.greatest(r, g, b), F.least(r, g, b)
    counts = F.when(top < TOP, 1).otherwise(0)
    x = pixels.where("r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL").select(*by, F.floor(coded(light) * 255 + 0.5).cast("int").alias("bin"), counts.alias("m"), *((decoded(c) * counts).alias(n) for c, n in ((r, "sr"), (g, "sg"), (b, "sb"))), F.when((top > 0) & (top < TOP), (top - least) / top).otherwise(0.0).alias("sat"), (top <= CLIPPED_LOW).cast("int").alias("cl"), (top >= CLIPPED_HIGH).cast("int").alias("ch"))
    h = x.groupBy(*by, "bin").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("m", "sr", "sg", "sb", "sat", "cl", "ch")))
    order = Window.partitionBy(*by).orderBy("bin")
    h = h.withColumn("seen", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    at = lambda share: F.min(F.when(F.col("seen") >= share * F.col("total"), F.col("bin"))).over(Window.partitionBy(*by))
    inner = F.when(F.col("bin").between(*FLAT), F.col("n")).otherwise(0)
    h = h.withColumn("bright", at(BRIGHT)).withColumn("near", F.sum(inner).over(order.rangeBetween(-2, 0)))
    mid, white = F.col("bin").between(*MIDDLE), F.col("bin") >= F.greatest("bright", F.lit(BRIGHT_BIN))
    own = lambda c, where: F.sum(F.when(where, F.col(c)).otherwise(0))
    share = lambda p: F.min(F.when(F.col("seen") >= p * F.col("total"), F.col("bin"))) / 255.0
    got = h.groupBy(*by).agg(share(LOW).alias("low"), share(0.5).alias("median"), share(HIGH).alias("high"), *((F.sum(c) / F.sum("n")).alias(n) for c, n in (("cl", "clipped_low"), ("ch", "clipped_high"))), (F.max(F.when(F.col("bin").between(*FLAT), F.col("near")).otherwise(0)) / F.sum("n")).alias("flat"), F.sum("n").alias("total"), *(own(c, w).alias(f"{p}_{c}") for p, w in (("mid", mid), ("white", white)) for c in ("m", "sr", "sg", "sb")), own("sat", mid).alias("sat"))

    def balance(p: str) -> list[Column]:
        whole = sum((w * F.col(f"{p}_{c}") for w, c in zip(LIGHT, ("sr", "sg", "sb"), strict=True)), F.lit(0.0))
        enough = (F.col(f"{p}_m") >= F.col("total") * LEAST_SHARE) & (whole > 0)
        return [F.when(enough, F.col(f"{p}_{c}") / whole).alias(f"{'grey' if p == 'mid' else 'white'}_{c[1]}") for c in ("sr", "sg", "sb")]

    saturation = F.when(F.col("mid_m") > 0, F.col("sat") / F.col("mid_m")).otherwise(0.0)
    return got.select(*by, "low", "median", "high", "clipped_low", "clipped_high", "flat", saturation.alias("saturation"), *balance("mid"), *balance("white"))


def nearest_colours(pixels: DataFrame, palette: list[tuple[int, int, int]], skip: int = -1) -> DataFrame:
    """pixels (r, g, b among others) with index: the palette's colour nearest by weighted squares, the first of equals; the colour
    numbered skip is never taken. Each different colour is looked up once, in an array that stands in the plan."""
    if not 0 < len(palette) - (0 <= skip < len(palette)) or len(palette) > COLOURS:
        raise ValueError("a palette has 1 to 256 colours")
    book = F.array(*(F.struct(F.lit(k).alias("i"), *(F.lit(v).alias(n) for v, n in zip(c, "rgb", strict=True))) for k, c in enumerate(palette) if k != skip))
    apart = lambda p: sum((w * (p[n] - F.col(n)) * (p[n] - F.col(n)) for w, n in zip(WEIGHTS, "rgb", strict=True)), F.lit(0))
    best = F.array_min(F.transform(book, lambda p: F.struct(apart(p).alias("d"), p["i"].alias("i"))))["i"]
    known = pixels.where("r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL").select("r", "g", "b").distinct().withColumn("index", best)
    return pixels.join(known, ["r", "g", "b"], "left")


def unchanged_masked(indexed: DataFrame, by: list[str], frame: str, pixel: str, transparent: int) -> DataFrame:
    """indexed (by, frame, pixel, index) with drawn: the index, or transparent where the picture before shows the same there."""
    before = F.lag("index").over(Window.partitionBy(*by, pixel).orderBy(frame))
    return indexed.withColumn("drawn", F.when(before == F.col("index"), transparent).otherwise(F.col("index")))


def refined(frames: DataFrame, chosen: DataFrame, by: list[str], apart: Column, limit: float, rounds: int) -> DataFrame:
    """by, frame, value of the frames to look at: those chosen (by, frame), and up to `rounds` more of each series.

    frames: by, frame, value. Each round looks at the frame in the middle of the two neighbours that differ most (apart, of
    columns a and b), if by more than limit and with a frame between; the first pair of equals. Middles that aren't among
    frames can't be looked at and are passed over. A round is one window over the few frames chosen so far and one join
    with all of them for every series at once; they end when no series has more, after `rounds` at most."""
    now = staged(chosen.select(*by, "frame").distinct().join(frames, [*by, "frame"]).select(*by, "frame", "value"))
    tried = now.select(*by, "frame").limit(0)
    order = Window.partitionBy(*by).orderBy("frame")
    for _ in range(rounds):
        gaps = now.select(*by, F.col("frame").alias("left"), F.col("value").alias("a"), F.lead("frame").over(order).alias("right"), F.lead("value").over(order).alias("b")).where("right - left >= 2")
        gaps = gaps.withColumn("frame", F.col("left") + F.floor((F.col("right") - F.col("left")) / 2).cast("int")).withColumn("d", apart).where(F.col("d") > limit)
        while True:
            left = gaps.join(tried, [*by, "frame"], "left_anti")
            best = left.groupBy(*by).agg(F.max(F.struct("d", (-F.col("left")).alias("_l"), "frame")).alias("m")).select(*by, "m.frame")
            more = staged(best.join(frames, [*by, "frame"], "left").select(*by, "frame", "value"))
            missing = more.where("value IS NULL").select(*by, "frame")
            tried = staged(tried.unionByName(missing))
            if missing.isEmpty():
                break
        more = more.where("value IS NOT NULL")
        if more.isEmpty():
            break
        now = staged(now.unionByName(more))
    return now


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Events as pixels of a picture of each user: series, frame (of 40 pixels), pixel, r, g, b."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")) - 1
    p = points(spark, d).select("user_id", "event_id", "v", nth.alias("nth"))
    return p.select(F.col("user_id").alias("series"), F.floor(F.col("nth") / 8).cast("int").alias("frame"), (F.col("nth") % 8).alias("pixel"), (F.col("v") % 256).cast("int").alias("r"), (F.floor(F.col("v") / 7) % 256).cast("int").alias("g"), (F.col("event_id") * 37 % 256).cast("int").alias("b"))


_PIXELS = "pix AS (SELECT user_id AS series, (nth // 8)::INTEGER AS frame, (nth % 8)::INTEGER AS pixel, (v % 256)::INTEGER AS r, (v // 7 % 256)::INTEGER AS g, (event_id * 37 % 256)::INTEGER AS b FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS nth FROM pts))"
_DEC = "(CASE WHEN {0} / 255.0::DOUBLE <= 0.04045 THEN {0} / 255.0::DOUBLE / 12.92 ELSE power(({0} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"
_TONES = f"""lit AS (SELECT series, r, g, b, {_DEC.format("r")} AS dr, {_DEC.format("g")} AS dg, {_DEC.format("b")} AS db, greatest(r, g, b) AS top FROM pix),
bins AS (SELECT *, CAST(floor((CASE WHEN l <= 0.0031308 THEN l * 12.92 ELSE 1.055 * power(l, 1 / 2.4::DOUBLE) - 0.055 END) * 255 + 0.5) AS INTEGER) AS bin FROM (SELECT *, 0.2126 * dr + 0.7152 * dg + 0.0722 * db AS l FROM lit)),
cum AS (SELECT *, sum(n) OVER (PARTITION BY series ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY series) AS total FROM (SELECT series, bin, count(*) AS n FROM bins GROUP BY ALL)),
pct AS (SELECT series, any_value(total) AS total, min(bin) FILTER (seen >= 0.005 * total) AS lo, min(bin) FILTER (seen >= 0.5 * total) AS md, min(bin) FILTER (seen >= 0.995 * total) AS hi, min(bin) FILTER (seen >= 0.95 * total) AS br FROM cum GROUP BY series),
flt AS (SELECT series, max(f) AS f FROM (SELECT s.series, s.st, sum(c.n) AS f FROM (SELECT series, unnest(range(3, 251)) AS st FROM pct) s JOIN cum c ON c.series = s.series AND c.bin BETWEEN s.st AND s.st + 2 GROUP BY ALL) GROUP BY series),
agg AS (SELECT b.series, sum((top <= 1)::INTEGER) AS cl, sum((top >= 254)::INTEGER) AS ch, count(*) FILTER (mid) AS mm, sum(dr) FILTER (mid) AS mr, sum(dg) FILTER (mid) AS mg, sum(db) FILTER (mid) AS mb, sum((top - least(r, g, b)) / top::DOUBLE) FILTER (mid) AS sat, count(*) FILTER (wht) AS wm, sum(dr) FILTER (wht) AS wr, sum(dg) FILTER (wht) AS wg, sum(db) FILTER (wht) AS wb
  FROM (SELECT b.*, top < 250 AND bin BETWEEN 38 AND 217 AS mid, top < 250 AND bin >= greatest(br, 64) AS wht FROM bins b JOIN pct USING (series)) b GROUP BY b.series)"""


def _bal(p: str, name: str) -> str:
    light = f"(0.2126 * {p}r + 0.7152 * {p}g + 0.0722 * {p}b)"
    return ", ".join(f"round(CASE WHEN {p}m >= total * 0.01 AND {light} > 0 THEN {p}{c} / {light} END, 7) AS {name}_{c}" for c in "rgb")


@query("d15_tones", f"SELECT series, round(lo / 255.0::DOUBLE, 7) AS low, round(md / 255.0::DOUBLE, 7) AS median, round(hi / 255.0::DOUBLE, 7) AS high, round(cl / total::DOUBLE, 7) AS clipped_low, round(ch / total::DOUBLE, 7) AS clipped_high, round(coalesce(f, 0) / total::DOUBLE, 7) AS flat, round(CASE WHEN mm > 0 THEN sat / mm ELSE 0 END, 7)::DOUBLE AS saturation, {_bal('m', 'grey')}, {_bal('w', 'white')} FROM pct JOIN agg USING (series) LEFT JOIN flt USING (series)", (POINTS, _PIXELS, _TONES))
def d15(spark: SparkSession, d: str) -> DataFrame:
    got = tones(pixels(spark, d), ["series"])
    return got.select("series", *(F.round(c, 7).alias(c) for c in got.columns[1:]))


_PALETTE = [(k * 37 % 256, k * 91 % 256, k * 151 % 256) for k in range(16)]
_NEAR = f"""pal AS (SELECT * FROM (VALUES {", ".join(f"({k}, {r}, {g}, {b})" for k, (r, g, b) in enumerate(_PALETTE) if k != 3)}) AS p(i, pr, pg, pb)),
idx AS (SELECT series, frame, pixel, (SELECT i FROM pal ORDER BY 2 * (pr - r) * (pr - r) + 4 * (pg - g) * (pg - g) + 3 * (pb - b) * (pb - b), i LIMIT 1) AS index FROM pix)"""


@query("d19_palette", "SELECT series, frame, pixel, index, CASE WHEN lag(index) OVER (PARTITION BY series, pixel ORDER BY frame) = index THEN 3 ELSE index END AS drawn FROM idx", (POINTS, _PIXELS, _NEAR))
def d19(spark: SparkSession, d: str) -> DataFrame:
    """Pixels in colours of a palette whose fourth one is kept for what doesn't change from frame to frame."""
    got = nearest_colours(pixels(spark, d), _PALETTE, 3)
    return unchanged_masked(got, ["series"], "frame", "pixel", 3).select("series", "frame", "pixel", "index", "drawn")


@query("d18_refined_frames")
def d18(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth frame of a user's frames, and up to five more between those that differ most in light."""
    p = pixels(spark, d).groupBy("series", "frame").agg(F.avg("g").alias("value"))
    return refined(p, p.where("frame % 4 = 0").select("series", "frame"), ["series"], F.abs(F.col("a") - F.col("b")), 20.0, 5)
