"""Alignment of token sequences and aggregates of quality measures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import percentile_ceil, ratio
from ..registry import query
from ..sources.tables import POINTS, TURNS, points, table, turns
from . import intervals
from .textsearch import fold, tokens


def alignment(ref: list[str], hyp: list[str]) -> tuple[int, int, int, int]:
    """(substitutions, deletions, insertions, hits) of the least edits; of equal ways back the diagonal, then a deletion.

    Each place of a row takes over the counts of the place that its way back leads to, so one row of counts is held and
    no way is walked back; a run of insertions takes them from the place before it."""
    n, m = len(ref), len(hyp)
    ids = {w: k for k, w in enumerate(dict.fromkeys([*ref, *hyp]))}
    h = np.array([ids[w] for w in hyp], np.int64)
    ramp = np.arange(m + 1)
    d, counts = ramp.copy(), ramp.copy()  # counts of a place in one number: 21 bits each for substitutions, deletions, insertions
    row, source, taken, steps = np.empty_like(d), np.zeros_like(d), np.empty_like(d), ramp[1:]
    costs: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for i, w in enumerate(ref, 1):
        if w not in costs:
            other = (h != ids[w]).astype(np.int64)
            costs[w] = other, other << 42
        other, substituted = costs[w]
        diagonal = d[:-1] + other
        best = np.minimum(diagonal, d[1:] + 1)
        row[0], taken[0] = i, i << 21
        np.subtract(best, steps, out=row[1:])
        np.minimum.accumulate(row, out=row)
        row += ramp
        np.multiply(row[1:] == best, steps, out=source[1:])
        np.maximum.accumulate(source, out=source)
        taken[1:] = np.where(best == diagonal, counts[:-1] + substituted, counts[1:] + (1 << 21))
        d, row = row, d
        counts = taken.take(source)
        counts += ramp
        counts -= source
    last = int(counts[-1])
    sub, dele, ins = last >> 42, last >> 21 & 0x1FFFFF, last & 0x1FFFFF
    return sub, dele, ins, n - sub - dele


def aligned(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_ref, sub, del, ins, hit of each pair of texts (ref, hyp); null reads as empty."""
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in it:
            got = [(len(r.split()), *alignment(r.split(), h.split())) for r, h in zip(g.ref.fillna(""), g.hyp.fillna(""), strict=True)]
            yield g[keys].assign(**{c: [x[k] for x in got] for k, c in enumerate(("n_ref", "sub", "del", "ins", "hit"))})

    return pairs.mapInPandas(score, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n_ref int, sub int, del int, ins int, hit int")


def error_rates(scored: DataFrame, by: list[str]) -> DataFrame:
    """Rates of groups: sums of errors over sums of words, never means of rates."""
    e = F.col("sub") + F.col("del") + F.col("ins")
    return scored.groupBy(*by).agg(F.count("*").alias("n"), F.round(ratio(F.sum(e), F.sum("n_ref")), 9).alias("wer"), F.round(ratio(F.sum("hit"), F.sum("n_ref")), 9).alias("hits"))


def offsets(rows: DataFrame, by: list[str], value: str, within: float) -> DataFrame:
    """by, n, median_abs, p95_abs, mean_signed, share_within of signed offsets."""
    x = rows.select(*by, F.col(value).alias("x"), F.abs(value).alias("a"))
    kind = x.schema["a"].dataType
    return x.groupBy(*by).agg(F.count("x").alias("n"), percentile_ceil("a", 0.5).cast(kind).alias("median_abs"), percentile_ceil("a", 0.95).cast(kind).alias("p95_abs"), F.round(F.avg("x"), 6).alias("mean_signed"), F.round(F.avg((F.col("a") <= within).cast("double")), 9).alias("share_within"))


def nearest_within(rows: DataFrame, others: DataFrame, by: list[str], bin_us: int) -> DataFrame:
    """Each row (id, us) with the nearest other (b_id, b_us) less than bin_us away, the earlier of equals: others are
    looked for in the row's bin of time and the two beside it, so the join is an equality."""
    b = others.withColumn("bin", F.floor(F.col("b_us") / bin_us))
    a = rows.withColumn("bin", F.explode(F.array(*[F.floor(F.col("us") / bin_us) + k for k in (-1, 0, 1)])))
    hit = a.join(b, [*by, "bin"]).where(F.abs(F.col("us") - F.col("b_us")) < bin_us)
    return hit.groupBy(*by, "id", "us").agg(F.min_by(F.struct("b_id", "b_us"), F.struct(F.abs(F.col("us") - F.col("b_us")), "b_us", "b_id")).alias("m")).select(*by, "id", "us", "m.*")


def share(part: Column, whole: Column) -> Column:
    """Per cent to one decimal, halves up; null of nothing."""
    return F.floor(ratio(part, whole) * 1000 + 0.5) / 10


#: Budgets that may be broadcast.
MOST_BUDGETS = 10_000


def judged(measures: DataFrame, budgets: DataFrame) -> DataFrame:
    """id, value, verdict: by the budget of exactly that id, else the first whose pattern (`*` for a part without dots)
    matches. budgets: place, pattern, low, high. Exact ids are joined by equality; each different id that is left is tried
    with the patterns, which are broadcast after their number is checked."""
    first = budgets.groupBy("pattern").agg(F.min_by(F.struct("low", "high"), "place").alias("exact"))
    got = measures.join(first.withColumnRenamed("pattern", "id"), "id", "left")
    rx = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("pattern", r"[.+?^${}()|\[\]\\]", r"\\$0"), r"\*", "[^.]+"), F.lit("$"))
    wide = budgets.where(F.contains("pattern", F.lit("*"))).select("place", "low", "high", rx.alias("rx"))
    if wide.count() > MOST_BUDGETS:
        raise ValueError("too many patterns to broadcast")
    rest = got.where("exact IS NULL").select("id").distinct()
    hit = rest.join(F.broadcast(wide), F.expr("regexp_like(id, rx)")).groupBy("id").agg(F.min_by(F.struct("low", "high"), "place").alias("matched"))
    got = got.join(hit, "id", "left").withColumn("b", F.coalesce("exact", "matched"))
    over = (F.col("value") > F.col("b.high")) | (F.col("value") < F.col("b.low"))
    return got.select("id", "value", F.when(F.col("value").isNull(), "unmeasured").when(F.col("b").isNull(), "info").when(over, "over").otherwise("ok").alias("verdict"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d).select("conv_id", "pos", "role", fold(F.col("text")).alias("ref"))
    return t.withColumn("hyp", F.lead("ref").over(Window.partitionBy("conv_id").orderBy("pos"))).where("hyp is not null")


@query("e1_e2_alignment")
def e1(spark: SparkSession, d: str) -> DataFrame:
    """Each turn against the next one of its conversation."""
    return aligned(_pairs(spark, d), ["conv_id", "pos", "role"])


@query("e3_group_rates")
def e3(spark: SparkSession, d: str) -> DataFrame:
    return error_rates(e1(spark, d), ["role"])


@query("e4_offset_stats", """SELECT kind, count(*) AS n, quantile_disc(abs(x), 0.5) AS median_abs, quantile_disc(abs(x), 0.95) AS p95_abs, round(avg(x), 6)::DOUBLE AS mean_signed, round(avg(CASE WHEN abs(x) <= 1000 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS share_within
FROM (SELECT kind, v - 3000 AS x FROM pts) GROUP BY kind""", (POINTS,))
def e4(spark: SparkSession, d: str) -> DataFrame:
    return offsets(points(spark, d).withColumn("x", F.col("v") - 3000), ["kind"], "x", 1000)


@query("e5_distinct_labels", "SELECT conv_id, count(DISTINCT role) AS heard, count(DISTINCT role) = 2 AS expected FROM turns GROUP BY conv_id", (TURNS,))
def e5(spark: SparkSession, d: str) -> DataFrame:
    """Labels in the union of the first and the second half of each conversation."""
    t = turns(spark, d)
    halves = t.groupBy("conv_id").agg(F.collect_set(F.when(F.col("pos") < 4, F.col("role"))).alias("a"), F.collect_set(F.when(F.col("pos") >= 4, F.col("role"))).alias("b"))
    n = F.size(F.array_union("a", "b")).cast("long")
    return halves.select("conv_id", n.alias("heard"), (n == 2).alias("expected"))


_GAPS = "gaps AS (SELECT user_id, us + 300000 AS s, us + v * 10000000 - 300000 AS e FROM pts WHERE kind = 'error')"


@query("e6_words_in_gaps", "SELECT user_id, event_id FROM pts p WHERE kind = 'view' AND EXISTS (SELECT 1 FROM gaps g WHERE g.user_id = p.user_id AND p.us >= s AND p.us < e)", (POINTS, _GAPS))
def e6(spark: SparkSession, d: str) -> DataFrame:
    """Views in the time of an error, 0.3 s off its edges."""
    p = points(spark, d)
    g = p.where("kind = 'error'").select(F.col("user_id").alias("g"), (F.col("us") + 300_000).alias("s"), (F.col("us") + F.col("v") * 10_000_000 - 300_000).alias("e"))
    return p.where("kind = 'view'").join(g, (F.col("user_id") == F.col("g")) & (F.col("us") >= F.col("s")) & (F.col("us") < F.col("e")), "left_semi").select("user_id", "event_id")


@query("e7_timing_checks", "SELECT user_id, bool_and(coalesce(us >= before, true)) AS monotone, count(*) FILTER (us - before > 86400000000) AS gaps, max(us - before) AS longest_us FROM (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM pts) GROUP BY user_id", (POINTS,))
def e7(spark: SparkSession, d: str) -> DataFrame:
    x = points(spark, d).withColumn("before", F.lag("us").over(Window.partitionBy("user_id").orderBy("event_id")))
    step = F.col("us") - F.col("before")
    return x.groupBy("user_id").agg(F.bool_and(F.coalesce(step >= 0, F.lit(True))).alias("monotone"), F.count_if(step > 86_400_000_000).alias("gaps"), F.max(step).alias("longest_us"))


_JUDGED = "judged AS (SELECT d.doc_id, d.lang, d.source, l.quality = 1 AS wanted, length(d.text) > 800 AS said FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", (F.char_length("text") > 800).alias("said"))
    return docs.join(table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("wanted")), "doc_id")


@query("e8_recall_precision", """SELECT lang, count(*) AS n, floor(count(*) FILTER (wanted AND said) * 1000.0 / nullif(count(*) FILTER (wanted), 0) + 0.5)::DOUBLE / 10 AS recall_pct, floor(count(*) FILTER (wanted AND said) * 1000.0 / nullif(count(*) FILTER (said), 0) + 0.5)::DOUBLE / 10 AS precision_pct FROM judged GROUP BY lang""", (_JUDGED,))
def e8(spark: SparkSession, d: str) -> DataFrame:
    both = F.count_if(F.col("wanted") & F.col("said"))
    return _judged(spark, d).groupBy("lang").agg(F.count("*").alias("n"), share(both, F.count_if("wanted")).alias("recall_pct"), share(both, F.count_if("said")).alias("precision_pct"))


@query("e9_by_tag", "SELECT tag, count(*) AS n, count(*) FILTER (wanted = said) AS hits FROM (SELECT *, unnest([lang, source, lang || '-' || source]) AS tag FROM judged) GROUP BY tag", (_JUDGED,))
def e9(spark: SparkSession, d: str) -> DataFrame:
    tags = F.explode(F.split(F.concat_ws(" ", "lang", "source", F.concat_ws("-", "lang", "source")), " "))
    return _judged(spark, d).withColumn("tag", tags).groupBy("tag").agg(F.count("*").alias("n"), F.count_if(F.col("wanted") == F.col("said")).alias("hits"))


@query("e10_held_out", "SELECT doc_id FROM documents d WHERE doc_id >= 500 AND NOT EXISTS (SELECT 1 FROM documents s WHERE s.doc_id < 500 AND lower(s.text) = lower(d.text))")
def e10(spark: SparkSession, d: str) -> DataFrame:
    """Later documents whose text wasn't seen among the first ones, whatever the case: compared by digest."""
    x = table(spark, d, "documents").select("doc_id", F.sha2(F.lower("text").cast("binary"), 256).alias("k"))
    return x.where("doc_id >= 500").join(x.where("doc_id < 500").select("k"), "k", "left_anti").select("doc_id")


@query("e11_detector_summary", "SELECT kind, v // 2000 AS nominal, count(*) AS n, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, max(v) AS most FROM pts GROUP BY ALL", (POINTS,))
def e11(spark: SparkSession, d: str) -> DataFrame:
    g = points(spark, d).groupBy("kind", F.floor(F.col("v") / 2000).cast("long").alias("nominal"))
    return g.agg(F.count("*").alias("n"), percentile_ceil("v", 0.5).cast("long").alias("p50"), percentile_ceil("v", 0.95).cast("long").alias("p95"), F.max("v").alias("most"))


BUDGETS = [(0, "lang.en.*", 5.0, 40.0), (1, "lang.*.src1", 0.0, 10.0), (2, "lang.fr.*", 0.0, 1000.0), (3, "lang.de.src2", 3.0, 4.0)]


@query("e12_budgets", """SELECT id, value, CASE WHEN low IS NULL THEN 'info' WHEN value > high OR value < low THEN 'over' ELSE 'ok' END AS verdict FROM (SELECT id, value, (b).low AS low, (b).high AS high FROM (
  SELECT m.id, m.value, min_by({'low': low, 'high': high}, CASE WHEN m.id = pattern THEN -1 ELSE place END) AS b FROM (SELECT 'lang.' || lang || '.' || source AS id, count(*)::DOUBLE AS value FROM documents GROUP BY 1) m
  LEFT JOIN (VALUES (0, 'lang.en.*', 5.0, 40.0), (1, 'lang.*.src1', 0.0, 10.0), (2, 'lang.fr.*', 0.0, 1000.0), (3, 'lang.de.src2', 3.0, 4.0)) AS b(place, pattern, low, high)
  ON regexp_full_match(m.id, replace(replace(pattern, '.', '[.]'), '*', '[^.]+')) GROUP BY m.id, m.value))""")
def e12(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").groupBy(F.concat_ws(".", F.lit("lang"), "lang", "source").alias("id")).agg(F.count("*").cast("double").alias("value"))
    return judged(m, spark.createDataFrame(BUDGETS, "place int, pattern string, low double, high double"))


@query("e13_sections", "SELECT kind AS section, min(us) AS oldest_us, max(us) AS newest_us, count(*) AS n FROM pts GROUP BY kind", (POINTS,))
def e13(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).groupBy(F.col("kind").alias("section")).agg(F.min("us").alias("oldest_us"), F.max("us").alias("newest_us"), F.count("*").alias("n"))


@query("e14_run_history", "SELECT event_id, k, k - lag(k) OVER (PARTITION BY user_id ORDER BY us, event_id) AS change FROM (SELECT user_id, us, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM pts JOIN (SELECT event_id AS e, props FROM events) ON event_id = e)", (POINTS,))
def e14(spark: SparkSession, d: str) -> DataFrame:
    """A nested measure and its change from run to run."""
    k = table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
    x = points(spark, d).join(k, "event_id")
    return x.select("event_id", "k", (F.col("k") - F.lag("k").over(Window.partitionBy("user_id").orderBy("us", "event_id"))).alias("change"))


@query("e15_nearest_match", """SELECT a.user_id, a.event_id AS id, min_by(b.event_id, (abs(a.us - b.us), b.us, b.event_id)) AS b_id FROM pts a JOIN pts b ON a.user_id = b.user_id AND b.kind = 'click' AND abs(a.us - b.us) < 7200000000 WHERE a.kind = 'view' GROUP BY ALL""", (POINTS,))
def e15(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    a = p.where("kind = 'view'").select("user_id", F.col("event_id").alias("id"), "us")
    b = p.where("kind = 'click'").select("user_id", F.col("event_id").alias("b_id"), F.col("us").alias("b_us"))
    return nearest_within(a, b, ["user_id"], 7_200_000_000).select("user_id", "id", "b_id")


@query("e16_expected_rows", """SELECT user_id, count(*) AS n, count(*) FILTER (got = want) AS good FROM (SELECT p.user_id, p.event_id, any_value(p.v) % 5 AS got, max_by(q.v, (q.us, q.event_id)) % 5 AS want FROM pts p JOIN pts q ON p.user_id = q.user_id AND q.kind = 'view' AND q.us <= p.us + 1000 WHERE p.kind = 'click' GROUP BY p.user_id, p.event_id) GROUP BY user_id""", (POINTS,))
def e16(spark: SparkSession, d: str) -> DataFrame:
    """Each click against the view that is expected at its time, a millisecond allowed."""
    p = points(spark, d)
    probes = p.where("kind = 'click'").select("user_id", "event_id", (F.col("us") + 1000).alias("p"), (F.col("v") % 5).alias("got"))
    rows = p.where("kind = 'view'").select("user_id", "us", "event_id", (F.col("v") % 5).alias("want")).withColumnRenamed("event_id", "view")
    x = intervals.as_of(probes, rows, ["user_id"], "p", "us", ["view", "want"]).where("want is not null")
    return x.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("got") == F.col("want")).alias("good"))


@query("e17_stage_profile", "SELECT kind, sum(v)::BIGINT AS total, count(*) AS n, max(v) AS most, round(avg(v), 6)::DOUBLE AS mean, round(sum(v) / (SELECT sum(v) FROM pts), 9)::DOUBLE AS share FROM pts GROUP BY kind", (POINTS,))
def e17(spark: SparkSession, d: str) -> DataFrame:
    g = points(spark, d).groupBy("kind").agg(F.sum("v").alias("total"), F.count("*").alias("n"), F.max("v").alias("most"), F.round(F.avg("v"), 6).alias("mean"))
    return g.withColumn("share", F.round(F.col("total") / F.sum("total").over(Window.partitionBy()), 9))


@query("e18_set_report")
def e18(spark: SparkSession, d: str) -> DataFrame:
    """By role: rates of sums, turns without any hit, and turns longer than what they should be."""
    x = e1(spark, d)
    more = x.groupBy("role").agg(F.count_if(F.col("hit") == 0).alias("missed"), F.count_if(F.col("ins") > F.col("n_ref")).alias("invented"))
    return error_rates(x, ["role"]).join(more, "role")
