"""Queries of the interval operators over turns and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import POINTS, TICK, TURNS, points, ranges, ranges_sql, turns
from . import intervals as I

HOUR = 3_600_000_000
_LAID = "laid AS (SELECT *, coalesce(sum(dur) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_us FROM turns), lay AS (SELECT *, start_us + dur AS end_us FROM laid)"
_A, _B = ranges_sql("a", "view"), ranges_sql("b", "click", "b_")
_HIT = "a.user_id = b.user_id AND a.start_us < b.b_end_us AND b.b_start_us < a.end_us"


def _laid(spark: SparkSession, d: str) -> DataFrame:
    return I.layout(turns(spark, d), ["conv_id"], "pos")


@query("i1_sequence_layout", "SELECT conv_id, pos, start_us, end_us FROM lay", (TURNS, _LAID))
def i1(spark: SparkSession, d: str) -> DataFrame:
    return _laid(spark, d).select("conv_id", "pos", "start_us", "end_us")


@query("i2_total_duration", "SELECT conv_id, sum(dur)::BIGINT AS total_us, count(*) AS n FROM turns GROUP BY conv_id", (TURNS,))
def i2(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).groupBy("conv_id").agg(F.sum("dur").alias("total_us"), F.count("*").alias("n"))


def _probes(spark: SparkSession, d: str) -> DataFrame:
    total = turns(spark, d).groupBy("conv_id").agg(F.sum("dur").alias("total"))
    return total.select("conv_id", "total", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("q")).select("conv_id", "q", F.floor(F.col("total") * F.col("q") / 4).cast("long").alias("p"))


_PROBES = "probes AS (SELECT conv_id, q, CAST(floor(sum(dur) * q / 4) AS BIGINT) AS p FROM turns, (VALUES (1), (2), (3)) AS v(q) GROUP BY conv_id, q)"


@query("i3_point_in_interval", "SELECT r.conv_id, q, p, pos, role, p - start_us AS \"offset\" FROM probes r JOIN lay l ON r.conv_id = l.conv_id AND p >= start_us AND p < end_us", (TURNS, _LAID, _PROBES))
def i3(spark: SparkSession, d: str) -> DataFrame:
    return I.locate(_probes(spark, d), _laid(spark, d), ["conv_id"]).select("conv_id", "q", "p", "pos", "role", "offset")


@query("i4_source_to_output", "SELECT conv_id, pos, start_us + least(100, dur) AS output_us FROM lay WHERE dur > 50", (TURNS, _LAID))
def i4(spark: SparkSession, d: str) -> DataFrame:
    """The output time of source time 100 (or the end) of each item that is long enough."""
    return _laid(spark, d).where("dur > 50").select("conv_id", "pos", (F.col("start_us") + F.least(F.lit(100).cast("long"), "dur")).alias("output_us"))


@query("i5_fade_envelope", """SELECT conv_id, q, p, round(greatest(0, least(1, least(p / 40.0, (total - p) / 60.0))), 9) AS gain
FROM (SELECT conv_id, q, CAST(floor(sum(dur) * q / 4) AS BIGINT) AS p, sum(dur)::DOUBLE AS total FROM turns, (VALUES (1), (2), (3)) AS v(q) GROUP BY conv_id, q)""", (TURNS,))
def i5(spark: SparkSession, d: str) -> DataFrame:
    """Linear fade in over 40 and out over 60 units of each sequence."""
    total = turns(spark, d).groupBy("conv_id").agg(F.sum("dur").cast("double").alias("total"))
    p = _probes(spark, d).join(total, "conv_id")
    gain = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(F.col("p") / 40.0, (F.col("total") - F.col("p")) / 60.0)))
    return p.select("conv_id", "q", "p", F.round(gain, 9).alias("gain"))


@query("i6_intersect_reclock", f"SELECT a.user_id, a.id, b.b_id, greatest(a.start_us, b.b_start_us) AS from_us, least(a.end_us, b.b_end_us) AS to_us, 1000 + greatest(a.start_us, b.b_start_us) - b.b_start_us AS clock_us FROM a JOIN b ON {_HIT}", (POINTS, _A, _B))
def i6(spark: SparkSession, d: str) -> DataFrame:
    """What views share with clicks, on a clock that shows 1000 where the click begins."""
    got = I.intersect(ranges(spark, d, "view"), ranges(spark, d, "click", "b_"), ["user_id"])
    return got.select("user_id", "id", "b_id", "from_us", "to_us", (F.col("from_us") - F.col("b_start_us") + 1000).alias("clock_us"))


@query("i7_occurrence", f"SELECT a.user_id, a.id, b.b_id, row_number() OVER (PARTITION BY a.user_id, a.id ORDER BY greatest(a.start_us, b.b_start_us), b.b_id)::INTEGER - 1 AS n FROM a JOIN b ON {_HIT}", (POINTS, _A, _B))
def i7(spark: SparkSession, d: str) -> DataFrame:
    got = I.intersect(ranges(spark, d, "view"), ranges(spark, d, "click", "b_"), ["user_id"])
    return I.occurrence(got, ["user_id", "id"], ["from_us", "b_id"]).select("user_id", "id", "b_id", "n")


@query("i8_active_at", "SELECT p.user_id, p.event_id, min_by(a.id, (a.start_us, a.id)) AS id FROM pts p JOIN a ON p.user_id = a.user_id AND p.us >= a.start_us AND p.us < a.end_us WHERE p.kind = 'error' GROUP BY ALL", (POINTS, _A))
def i8(spark: SparkSession, d: str) -> DataFrame:
    """The first view, by start, that is on at each error."""
    at = points(spark, d).where("kind = 'error'").select("user_id", "event_id", F.col("us").alias("p"))
    return I.locate(at, ranges(spark, d, "view"), ["user_id"]).groupBy("user_id", "event_id").agg(F.min_by("id", F.struct("start_us", "id")).alias("id"))


@query("i9_usage", f"SELECT a.user_id, a.id, count(b.b_id) AS uses, coalesce(bool_or(b.b_start_us > a.start_us OR b.b_end_us < a.end_us), false) AS cut FROM a LEFT JOIN b ON {_HIT} GROUP BY ALL", (POINTS, _A, _B))
def i9(spark: SparkSession, d: str) -> DataFrame:
    a = ranges(spark, d, "view")
    got = I.intersect(a, ranges(spark, d, "click", "b_"), ["user_id"]).groupBy("user_id", "id").agg(F.count("*").alias("uses"), F.bool_or((F.col("b_start_us") > F.col("start_us")) | (F.col("b_end_us") < F.col("end_us"))).alias("cut"))
    return a.select("user_id", "id").join(got, ["user_id", "id"], "left").select("user_id", "id", F.coalesce("uses", F.lit(0).cast("long")).alias("uses"), F.coalesce("cut", F.lit(False)).alias("cut"))


@query("i10_visibility", f"""SELECT a.user_id, a.id, CASE WHEN bool_or(b.b_start_us <= a.start_us AND a.end_us <= b.b_end_us) THEN 'visible' WHEN count(b.b_id) > 0 THEN 'clipped' ELSE 'outside' END AS seen
FROM a LEFT JOIN b ON {_HIT} GROUP BY ALL""", (POINTS, _A, _B))
def i10(spark: SparkSession, d: str) -> DataFrame:
    a = ranges(spark, d, "view")
    got = I.intersect(a, ranges(spark, d, "click", "b_"), ["user_id"]).groupBy("user_id", "id").agg(F.bool_or((F.col("b_start_us") <= F.col("start_us")) & (F.col("end_us") <= F.col("b_end_us"))).alias("whole"))
    return a.select("user_id", "id").join(got, ["user_id", "id"], "left").select("user_id", "id", F.when(F.col("whole"), "visible").when(F.col("whole").isNotNull(), "clipped").otherwise("outside").alias("seen"))


@query("i11_clip_to_horizon", "SELECT user_id, id, start_us, least(end_us, (SELECT max(us) FROM pts)) AS end_us FROM a WHERE start_us < (SELECT max(us) FROM pts)", (POINTS, _A))
def i11(spark: SparkSession, d: str) -> DataFrame:
    horizon = points(spark, d).agg(F.max("us").alias("horizon"))
    return ranges(spark, d, "view").crossJoin(F.broadcast(horizon)).where("start_us < horizon").select("user_id", "id", "start_us", F.least("end_us", "horizon").alias("end_us"))


@query("i12_reverse_placement", f"SELECT a.user_id, a.id, b.b_id, greatest(a.start_us, b.b_start_us) - a.start_us AS at_us FROM a JOIN b ON {_HIT}", (POINTS, _A, _B))
def i12(spark: SparkSession, d: str) -> DataFrame:
    """Where in each view the clicks begin: the intersection seen from its other side."""
    left = ranges(spark, d, "click").withColumnRenamed("id", "b_id")
    right = ranges(spark, d, "view", "a_")
    got = I.intersect(left, right, ["user_id"], "a_")
    return got.select("user_id", F.col("a_id").alias("id"), "b_id", (F.col("from_us") - F.col("a_start_us")).alias("at_us"))


@query("i13_overlap_count", f"SELECT a.user_id, count(*) AS pairs FROM a JOIN b ON {_HIT} GROUP BY 1", (POINTS, _A, _B))
def i13(spark: SparkSession, d: str) -> DataFrame:
    return I.intersect(ranges(spark, d, "view"), ranges(spark, d, "click", "b_"), ["user_id"]).groupBy("user_id").agg(F.count("*").alias("pairs"))


@query("i14_first_overlapping", """SELECT a.user_id, a.id, min_by(o.id, (o.start_us, o.id)) AS other
FROM a LEFT JOIN a o ON a.user_id = o.user_id AND a.id <> o.id AND a.start_us < o.end_us AND o.start_us < a.end_us GROUP BY ALL""", (POINTS, _A))
def i14(spark: SparkSession, d: str) -> DataFrame:
    return I.first_overlapping(ranges(spark, d, "view"), ["user_id"]).select("user_id", "id", "other")


@query("i15_sorted", "SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY start_us, id)::INTEGER AS place FROM a", (POINTS, _A))
def i15(spark: SparkSession, d: str) -> DataFrame:
    return ranges(spark, d, "view").select("user_id", "id", F.row_number().over(Window.partitionBy("user_id").orderBy("start_us", "id")).alias("place"))


_SUB = f"""cut AS (SELECT a.user_id, a.id, a.start_us, a.end_us, greatest(a.start_us, b.b_start_us) AS f, least(a.end_us, b.b_end_us) AS t FROM a JOIN b ON {_HIT}
  UNION ALL SELECT user_id, id, start_us, end_us, end_us, end_us FROM a),
gaps AS (SELECT user_id, id, coalesce(max(t) OVER (PARTITION BY user_id, id ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start_us) AS s, f AS e FROM cut),
pieces AS (SELECT user_id, id, s AS start_us, e AS end_us FROM gaps WHERE e > s)"""


@query("i16_subtract", "SELECT user_id, id, row_number() OVER (PARTITION BY user_id, id ORDER BY start_us)::INTEGER - 1 AS piece, start_us, end_us FROM pieces", (POINTS, _A, _B, _SUB))
def i16(spark: SparkSession, d: str) -> DataFrame:
    return I.subtract(ranges(spark, d, "view"), ranges(spark, d, "click", "b_"), ["user_id"])


@query("i17_cut_report", f"""SELECT a.user_id, (sum(a.end_us - a.start_us) / any_value(1))::BIGINT AS before_us, any_value(k.kept_us)::BIGINT AS after_us, any_value(k.dropped)::BIGINT AS dropped
FROM a JOIN (SELECT r.user_id, coalesce(sum(p.end_us - p.start_us) FILTER (p.end_us - p.start_us >= {HOUR}), 0) AS kept_us, count(*) FILTER (p.end_us - p.start_us < {HOUR}) AS dropped
  FROM (SELECT DISTINCT user_id FROM a) r LEFT JOIN pieces p ON r.user_id = p.user_id GROUP BY 1) k ON a.user_id = k.user_id GROUP BY 1""", (POINTS, _A, _B, _SUB))
def i17(spark: SparkSession, d: str) -> DataFrame:
    """Length before and after the cuts, and how many pieces under an hour are dropped."""
    a = ranges(spark, d, "view")
    size = F.col("end_us") - F.col("start_us")
    before = a.groupBy("user_id").agg(F.sum(size).alias("before_us"))
    after = I.subtract(a, ranges(spark, d, "click", "b_"), ["user_id"]).groupBy("user_id").agg(F.sum(F.when(size >= HOUR, size)).alias("after_us"), F.count_if(size < HOUR).alias("dropped"))
    zero = F.lit(0).cast("long")
    return before.join(after, "user_id", "left").select("user_id", "before_us", F.coalesce("after_us", zero).alias("after_us"), F.coalesce("dropped", zero).alias("dropped"))


@query("i18_within_limit")
def i18(spark: SparkSession, d: str) -> DataFrame:
    """Cuts of views by clicks, longest first, while a user keeps to 20 pieces of a tenth of a second or more."""
    clips = ranges(spark, d, "view")
    cuts = I.intersect(clips, ranges(spark, d, "click", "b_"), ["user_id"]).select("user_id", "id", "b_id", F.col("from_us").alias("b_start_us"), F.col("to_us").alias("b_end_us"))
    return I.within_limit(clips, cuts, ["user_id"], 20, 100_000)


def _islands(table: str, gap: int) -> str:
    return f"""SELECT user_id, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start_us > max(end_us) OVER (PARTITION BY user_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 1
      WHEN row_number() OVER (PARTITION BY user_id ORDER BY start_us, end_us) = 1 THEN 1 ELSE 0 END AS new FROM {table})) GROUP BY user_id, island"""


@query("i19_coalesce", _islands("a", 0), (POINTS, _A))
def i19(spark: SparkSession, d: str) -> DataFrame:
    return I.coalesce_ranges(ranges(spark, d, "view"), ["user_id"])


@query("i20_selected_lines", f"""SELECT user_id, min(s) AS start_us, max(e) AS end_us, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN place = lag(place) OVER w + 1 OR s - max(e) OVER (PARTITION BY user_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {HOUR} THEN 0 ELSE 1 END AS new
  FROM (SELECT user_id, id, place, greatest(0, start_us - 150000) AS s, end_us AS e FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_us, id) AS place FROM a) WHERE id % 3 <> 0)
  WINDOW w AS (PARTITION BY user_id ORDER BY place))) GROUP BY user_id, island""", (POINTS, _A))
def i20(spark: SparkSession, d: str) -> DataFrame:
    """Selected lines merge with the selected line before them in the list, or within an hour; 150 ms of lead."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("start_us", "id"))
    rows = ranges(spark, d, "view").withColumn("place", place).where("id % 3 <> 0").withColumn("start_us", F.greatest(F.lit(0).cast("long"), F.col("start_us") - 150000))
    w = Window.partitionBy("user_id").orderBy("place")
    reach = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    joins = (F.col("place") == F.lag("place").over(w) + 1) | (F.col("start_us") - reach <= HOUR)
    island = rows.withColumn("new", F.when(joins, 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("user_id", "island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n")).drop("island")


@query("i21_coalesce_and_pad", f"SELECT user_id, start_us - 250000 AS start_us, end_us + 250000 AS end_us, n FROM ({_islands('a', HOUR)})", (POINTS, _A))
def i21(spark: SparkSession, d: str) -> DataFrame:
    """Ranges at most an hour apart merge; then each is padded by 0.25 s without merging again."""
    got = I.coalesce_ranges(ranges(spark, d, "view"), ["user_id"], HOUR)
    return got.select("user_id", (F.col("start_us") - 250000).alias("start_us"), (F.col("end_us") + 250000).alias("end_us"), "n")


@query("i22_reanchor", f"""SELECT user_id, id, min(at_us) AS start_us, max(at_us + size) AS end_us, count(*) AS n FROM (
  SELECT a.user_id, a.id, b.b_id, greatest(a.start_us, b.b_start_us) - b.b_start_us AS at_us, least(a.end_us, b.b_end_us) - greatest(a.start_us, b.b_start_us) AS size FROM a JOIN b ON {_HIT}) WHERE size >= {HOUR} GROUP BY ALL""", (POINTS, _A, _B))
def i22(spark: SparkSession, d: str) -> DataFrame:
    """Each view on the clocks of the clicks it meets: pieces of an hour or more, and their hull."""
    got = I.intersect(ranges(spark, d, "view"), ranges(spark, d, "click", "b_"), ["user_id"])
    piece = got.select("user_id", "id", (F.col("from_us") - F.col("b_start_us")).alias("at_us"), (F.col("to_us") - F.col("from_us")).alias("size")).where(F.col("size") >= HOUR)
    return piece.groupBy("user_id", "id").agg(F.min("at_us").alias("start_us"), F.max(F.col("at_us") + F.col("size")).alias("end_us"), F.count("*").alias("n"))


_NOTES = """cl AS (SELECT conv_id, start_us, end_us, end_us - start_us + 0 AS size, coalesce(sum(dur) OVER (PARTITION BY conv_id, pos // 2 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + pos // 2 * 100000 AS src FROM lay WHERE dur > 0),
notes AS (SELECT conv_id, k AS id, k * 300 AS s, k * 300 + 450 AS e FROM (SELECT conv_id, unnest(range(sum(dur)::BIGINT // 300 + 1)) AS k FROM turns GROUP BY conv_id)),
cut AS (SELECT n.conv_id, n.id, greatest(s, start_us) AS f, least(e, end_us) AS t, src + greatest(s, start_us) - start_us AS a, src + least(e, end_us) - start_us AS z FROM notes n JOIN cl c ON n.conv_id = c.conv_id AND s < end_us AND start_us < e),
isl AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, id ORDER BY f ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS piece FROM (SELECT *, CASE WHEN lag(t) OVER w = f AND lag(z) OVER w = a THEN 0 ELSE 1 END AS new FROM cut WINDOW w AS (PARTITION BY conv_id, id ORDER BY f)))"""


@query("i22_split_and_rejoin", "SELECT conv_id, id, piece, min(a) AS start_us, max(z) AS end_us FROM isl GROUP BY conv_id, id, piece", (TURNS, _LAID, _NOTES))
def i22_rejoin(spark: SparkSession, d: str) -> DataFrame:
    """Notes of 450 units, one every 300, over turns of which two at a time stand together in the source."""
    pair = F.floor(F.col("pos") / 2).cast("long")
    before = F.coalesce(F.sum("dur").over(Window.partitionBy("conv_id", pair).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    clips = _laid(spark, d).where("dur > 0").select("conv_id", F.col("start_us").alias("c_start_us"), F.col("end_us").alias("c_end_us"), (before + pair * 100_000).alias("c_source_us"))
    total = turns(spark, d).groupBy("conv_id").agg(F.sum("dur").alias("total"))
    notes = total.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("total") / 300).cast("long"))).alias("id")).select("conv_id", "id", (F.col("id") * 300).alias("start_us"), (F.col("id") * 300 + 450).alias("end_us"))
    return I.reanchored(notes, clips, ["conv_id"], 1000)


@query("i23_piece_ids", "SELECT user_id, CASE WHEN k = 1 THEN CAST(id AS VARCHAR) ELSE id || '-' || k END AS piece_id, start_us FROM (SELECT *, row_number() OVER (PARTITION BY user_id, id ORDER BY start_us) AS k FROM pieces)", (POINTS, _A, _B, _SUB))
def i23(spark: SparkSession, d: str) -> DataFrame:
    """The first piece of a range keeps its id, the others get the id and their number."""
    p = I.subtract(ranges(spark, d, "view"), ranges(spark, d, "click", "b_"), ["user_id"])
    return p.select("user_id", F.when(F.col("piece") == 0, F.col("id").cast("string")).otherwise(F.concat_ws("-", "id", F.col("piece") + 1)).alias("piece_id"), "start_us")


@query("i24_shift_all_or_nothing", f"""SELECT user_id, id, CASE WHEN bool_or(start_us - 86400000000 < 1704067200000000) OVER (PARTITION BY user_id) THEN start_us ELSE start_us - 86400000000 END AS start_us FROM a""", (POINTS, _A))
def i24(spark: SparkSession, d: str) -> DataFrame:
    """A user's ranges move back by a day if none would begin before 2024."""
    out = F.bool_or(F.col("start_us") - 86_400_000_000 < 1_704_067_200_000_000).over(Window.partitionBy("user_id"))
    return ranges(spark, d, "view").select("user_id", "id", F.when(out, F.col("start_us")).otherwise(F.col("start_us") - 86_400_000_000).alias("start_us"))


_NEXT = f"CASE WHEN o.end_us - o.start_us < {HOUR} THEN 'too_short' WHEN o.start_us < st.last_end THEN 'overlap' WHEN st.k >= 8 THEN 'limit' ELSE 'accepted' END"


@query("i25_ordered_admission", f"""WITH RECURSIVE {POINTS}, {ranges_sql("rv", "view")}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_us, id) AS n FROM rv),
st AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::BIGINT AS last_end, 0 AS k, NULL::VARCHAR AS verdict FROM (SELECT DISTINCT user_id FROM o)
  UNION ALL SELECT o.user_id, o.n, o.id, CASE WHEN {_NEXT} = 'accepted' THEN o.end_us ELSE st.last_end END, st.k + ({_NEXT} = 'accepted')::INTEGER, {_NEXT} FROM st JOIN o ON o.user_id = st.user_id AND o.n = st.n + 1)
SELECT user_id, id, verdict FROM st WHERE n > 0""")
def i25(spark: SparkSession, d: str) -> DataFrame:
    return I.accepted_in_order(ranges(spark, d, "view"), ["user_id"], 8, HOUR)


@query("i26_anti_overlap_union", """SELECT user_id, id, start_us, 'unclear' AS kind FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.user_id = b.user_id AND a.start_us < b.b_end_us AND b.b_start_us < a.end_us)
UNION ALL SELECT user_id, b_id, b_start_us, 'line' FROM b""", (POINTS, _A, _B))
def i26(spark: SparkSession, d: str) -> DataFrame:
    b = ranges(spark, d, "click", "b_")
    left = I.without_overlap(ranges(spark, d, "view"), b, ["user_id"]).select("user_id", "id", "start_us", F.lit("unclear").alias("kind"))
    return left.unionByName(b.select("user_id", F.col("b_id").alias("id"), F.col("b_start_us").alias("start_us"), F.lit("line").alias("kind")))


@query("i27_as_of", "SELECT p.user_id, p.event_id, max_by(q.event_id, (q.us, q.event_id)) AS last_view FROM pts p LEFT JOIN pts q ON p.user_id = q.user_id AND q.kind = 'view' AND q.us <= p.us WHERE p.kind = 'purchase' GROUP BY ALL", (POINTS,))
def i27(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    probes = p.where("kind = 'purchase'").select("user_id", "event_id", F.col("us").alias("p"))
    rows = p.where("kind = 'view'").select("user_id", "us", F.col("event_id").alias("last_view"))
    return I.as_of(probes, rows, ["user_id"], "p", "us", ["last_view"]).select("user_id", "event_id", "last_view")


@query("i28_first_gap", f"""SELECT user_id, min_by(end_us, end_us) AS at_us, min_by(least(nxt - end_us, {6 * HOUR}), end_us) AS size_us FROM (
  SELECT user_id, end_us, coalesce(lead(start_us) OVER (PARTITION BY user_id ORDER BY start_us), end_us + {100 * HOUR}) AS nxt FROM ({_islands('a', 0)})) WHERE nxt - end_us >= {HOUR} GROUP BY user_id""", (POINTS, _A))
def i28(spark: SparkSession, d: str) -> DataFrame:
    """The first gap of an hour or more after a range, six hours of it at most."""
    got = I.coalesce_ranges(ranges(spark, d, "view"), ["user_id"])
    nxt = F.coalesce(F.lead("start_us").over(Window.partitionBy("user_id").orderBy("start_us")), F.col("end_us") + 100 * HOUR)
    gaps = got.withColumn("nxt", nxt).where(F.col("nxt") - F.col("end_us") >= HOUR)
    return gaps.groupBy("user_id").agg(F.min("end_us").alias("at_us"), F.min_by(F.least(F.col("nxt") - F.col("end_us"), F.lit(6 * HOUR)), "end_us").alias("size_us"))


@query("i29_marks", "SELECT conv_id, pos, round(100.0 * start_us / sum(dur) OVER (PARTITION BY conv_id), 6)::DOUBLE AS left_pct, round(100.0 * dur / sum(dur) OVER (PARTITION BY conv_id), 6)::DOUBLE AS width_pct FROM lay", (TURNS, _LAID))
def i29(spark: SparkSession, d: str) -> DataFrame:
    whole = F.sum("dur").over(Window.partitionBy("conv_id"))
    return _laid(spark, d).select("conv_id", "pos", F.round(100.0 * F.col("start_us") / whole, 6).alias("left_pct"), F.round(100.0 * F.col("dur") / whole, 6).alias("width_pct"))


@query("i30_slice", f"SELECT a.user_id, a.id, greatest(a.start_us, b.b_start_us) - b.b_start_us AS start_us, least(a.end_us, b.b_end_us) - b.b_start_us AS end_us FROM a JOIN (SELECT user_id, min_by(b_id, b_start_us) AS b_id, min(b_start_us) AS b_start_us, min_by(b_end_us, b_start_us) AS b_end_us FROM b GROUP BY 1) b ON {_HIT}", (POINTS, _A, _B))
def i30(spark: SparkSession, d: str) -> DataFrame:
    """The views in the slot of each user's first click, on its clock."""
    slot = ranges(spark, d, "click", "b_").groupBy("user_id").agg(F.min_by("b_id", "b_start_us").alias("b_id"), F.min_by("b_end_us", "b_start_us").alias("b_end_us"), F.min("b_start_us").alias("b_start_us"))
    got = I.intersect(ranges(spark, d, "view"), slot, ["user_id"])
    return got.select("user_id", "id", (F.col("from_us") - F.col("b_start_us")).alias("start_us"), (F.col("to_us") - F.col("b_start_us")).alias("end_us"))


@query("i31_snap_to_frames", """SELECT event_id, CAST(floor(floor(v * 1000.0 * 30000 / 1001000000 + 0.5) * 1001000000 / 30000 + 0.5) AS BIGINT) AS nearest_us,
CAST(floor(floor(v * 1000.0 * 30000 / 1001000000) * 1001000000 / 30000 + 0.5) AS BIGINT) AS before_us, CAST(floor(ceil(v * 1000.0 * 30000 / 1001000000) * 1001000000 / 30000 + 0.5) AS BIGINT) AS after_us FROM pts""", (POINTS,))
def i31(spark: SparkSession, d: str) -> DataFrame:
    us = F.col("v") * 1000
    return points(spark, d).select("event_id", *(I.snapped(us, 30000, 1001, how).alias(n) for how, n in (("round", "nearest_us"), ("floor", "before_us"), ("ceil", "after_us"))))


@query("i32_edge_bounds", f"SELECT user_id, id, greatest(start_us - {HOUR}, coalesce(lag(end_us) OVER w, 0)) AS low_us, greatest(start_us, end_us - 100000) AS high_us FROM a WINDOW w AS (PARTITION BY user_id ORDER BY start_us, id)", (POINTS, _A))
def i32(spark: SparkSession, d: str) -> DataFrame:
    """How far the left edge of a range may go: an hour back but not into the range before, and 0.1 s before its end."""
    before = F.coalesce(F.lag("end_us").over(Window.partitionBy("user_id").orderBy("start_us", "id")), F.lit(0).cast("long"))
    return ranges(spark, d, "view").select("user_id", "id", F.greatest(F.col("start_us") - HOUR, before).alias("low_us"), F.greatest("start_us", F.col("end_us") - 100000).alias("high_us"))


@query("i33_row_offsets", "SELECT conv_id, pos, (start_us + 8 * (row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1))::BIGINT AS top FROM lay", (TURNS, _LAID))
def i33(spark: SparkSession, d: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("pos")) - 1
    return _laid(spark, d).select("conv_id", "pos", (F.col("start_us") + 8 * nth).cast("long").alias("top"))


@query("i34_fit_with_fade", f"SELECT user_id, id, least(end_us, lim) AS end_us, least({2 * HOUR}, (least(end_us, lim) - start_us) // 2) AS fade_us FROM (SELECT *, start_us + {12 * HOUR} AS lim FROM a)", (POINTS, _A))
def i34(spark: SparkSession, d: str) -> DataFrame:
    """Ranges end twelve hours after their start at most; the fade of two hours shrinks to half of the length."""
    end = F.least("end_us", F.col("start_us") + 12 * HOUR)
    return ranges(spark, d, "view").select("user_id", "id", end.alias("end_us"), F.least(F.lit(2 * HOUR), F.floor((end - F.col("start_us")) / 2).cast("long")).alias("fade_us"))


@query("i35_midpoint_coverage", """SELECT a.user_id, count(*) AS words, coalesce(sum(a.end_us - a.start_us) FILTER (EXISTS (SELECT 1 FROM b WHERE b.user_id = a.user_id AND (a.start_us + a.end_us) // 2 >= b_start_us AND (a.start_us + a.end_us) // 2 < b_end_us)), 0)::BIGINT AS covered_us FROM a GROUP BY 1""", (POINTS, _A, _B))
def i35(spark: SparkSession, d: str) -> DataFrame:
    """Length of the views whose middle is in some click."""
    a, b = ranges(spark, d, "view").withColumn("mid", F.floor((F.col("start_us") + F.col("end_us")) / 2).cast("long")), ranges(spark, d, "click", "b_")
    size = F.col("end_us") - F.col("start_us")
    spans = b.select("user_id", F.col("b_start_us").alias("start_us"), F.col("b_end_us").alias("end_us"))
    held = I.locate(a.select("user_id", "id", "mid", size.alias("size")), spans, ["user_id"], "mid").select("user_id", "id", "size").distinct()
    inside = held.groupBy("user_id").agg(F.sum("size").alias("covered_us"))
    return a.groupBy("user_id").agg(F.count("*").alias("words")).join(inside, "user_id", "left").select("user_id", "words", F.coalesce("covered_us", F.lit(0).cast("long")).alias("covered_us"))


@query("i36_overlap_length", f"SELECT a.user_id, a.id, sum(least(a.end_us, b.b_end_us) - greatest(a.start_us, b.b_start_us))::BIGINT AS shared_us FROM a JOIN b ON {_HIT} GROUP BY ALL", (POINTS, _A, _B))
def i36(spark: SparkSession, d: str) -> DataFrame:
    got = I.intersect(ranges(spark, d, "view"), ranges(spark, d, "click", "b_"), ["user_id"])
    return got.groupBy("user_id", "id").agg(F.sum(F.col("to_us") - F.col("from_us")).alias("shared_us"))


_C = ranges_sql("c", "error", "b_")


@query("i37_classify_cuts", f"""SELECT a.user_id, a.id, CASE WHEN x.b_id IS NOT NULL THEN 'gap' WHEN y.b_id IS NOT NULL THEN 'pause' ELSE 'speech' END AS class, coalesce(x.b_id, y.b_id) AS by_id
FROM a LEFT JOIN (SELECT a.user_id, a.id, min_by(b.b_id, (b.b_start_us, b.b_id)) AS b_id FROM a JOIN b ON {_HIT} GROUP BY ALL) x ON a.id = x.id AND a.user_id = x.user_id
LEFT JOIN (SELECT a.user_id, a.id, min_by(b.b_id, (b.b_start_us, b.b_id)) AS b_id FROM a JOIN c b ON {_HIT} GROUP BY ALL) y ON a.id = y.id AND a.user_id = y.user_id""", (POINTS, _A, _B, _C))
def i37(spark: SparkSession, d: str) -> DataFrame:
    """A view is a gap if a click overlaps it, else a pause if an error does, else speech; the first one names it."""
    a = ranges(spark, d, "view")

    def first(kind: str, name: str) -> DataFrame:
        return I.intersect(a, ranges(spark, d, kind, "b_"), ["user_id"]).groupBy("user_id", "id").agg(F.min_by("b_id", F.struct("b_start_us", "b_id")).alias(name))

    got = a.join(first("click", "x"), ["user_id", "id"], "left").join(first("error", "y"), ["user_id", "id"], "left")
    return got.select("user_id", "id", F.when(F.col("x").isNotNull(), "gap").when(F.col("y").isNotNull(), "pause").otherwise("speech").alias("class"), F.coalesce("x", "y").alias("by_id"))


@query("i38_frame_pick", f"""SELECT t.user_id, t.target, max_by(p.event_id, (p.us, p.event_id)) AS frame, coalesce(max(p.us + {12 * HOUR} - t.target) > 0, false) AS fresh
FROM (SELECT user_id, unnest(range(lo, hi + 1, {24 * HOUR})) AS target FROM (SELECT user_id, min(us) AS lo, max(us) AS hi FROM pts GROUP BY user_id)) t LEFT JOIN pts p ON p.user_id = t.user_id AND p.kind = 'view' AND p.us <= t.target GROUP BY ALL""", (POINTS,))
def i38(spark: SparkSession, d: str) -> DataFrame:
    """On a daily grid from each user's first event, the last view, and whether it is less than twelve hours old."""
    p = points(spark, d)
    grid = p.groupBy("user_id").agg(F.min("us").alias("a"), F.max("us").alias("z")).select("user_id", F.explode(F.sequence("a", "z", F.lit(24 * HOUR))).alias("target"))
    rows = p.where("kind = 'view'").select("user_id", "us", F.col("event_id").alias("frame"))
    got = I.as_of(grid, rows, ["user_id"], "target", "us", ["frame"])
    return got.select("user_id", "target", "frame", F.coalesce(F.col("us") + 12 * HOUR > F.col("target"), F.lit(False)).alias("fresh"))
