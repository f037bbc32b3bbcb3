"""Half-open ranges [start_us, end_us): layout, joins, subtraction, coalescing. Microseconds are integers.

Ranges meet by an equality on the group columns `by` and on bins of time, so joins are hash or sort-merge joins and
don't pair all rows of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import folded

#: Width of the bins of time by which ranges meet: about the length of a range is best.
BIN_US = 24 * 3_600_000_000


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Two half-open ranges share a point."""
    return (a0 < b1) & (b0 < a1)


def layout(items: DataFrame, by: list[str], order: str, duration: str = "dur") -> DataFrame:
    """Adds start_us and end_us: the items of a group one after another from 0 in their order."""
    before = F.sum(duration).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0).cast("long"))
    return items.withColumn("start_us", start).withColumn("end_us", F.col("start_us") + F.col(duration))


def binned(ranges: DataFrame, start: str, end: str, bin_us: int) -> DataFrame:
    """ranges once for each bin of time that they reach into, with _bin. An empty range is in the bin of its start."""
    at = lambda c: F.floor(c / bin_us).cast("long")
    return ranges.withColumn("_bin", F.explode(F.sequence(at(F.col(start)), at(F.greatest(F.col(start), F.col(end) - 1)))))


def locate(points: DataFrame, ranges: DataFrame, by: list[str], at: str = "p", bin_us: int = BIN_US) -> DataFrame:
    """Each point with the ranges of its group that hold it, and its offset in them. A point meets the ranges of its bin."""
    own = points.withColumn("_bin", F.floor(F.col(at) / bin_us).cast("long"))
    hit = own.join(binned(ranges, "start_us", "end_us", bin_us), [*by, "_bin"]).where((F.col(at) >= F.col("start_us")) & (F.col(at) < F.col("end_us")))
    return hit.drop("_bin").withColumn("offset", F.col(at) - F.col("start_us"))


def intersect(left: DataFrame, right: DataFrame, by: list[str], prefix: str = "b_", bin_us: int = BIN_US) -> DataFrame:
    """Pairs of overlapping ranges of a group, with from_us and to_us of what they share. The columns of right begin with
    prefix. Ranges meet by group and bin of time, and a pair counts in the bin where its overlap begins, so a group with
    very many ranges is spread, and rows that are far apart never meet."""
    hit = overlap(F.col("start_us"), F.col("end_us"), F.col(f"{prefix}start_us"), F.col(f"{prefix}end_us"))
    begins = F.floor(F.greatest("start_us", f"{prefix}start_us") / bin_us).cast("long") == F.col("_bin")
    met = binned(left, "start_us", "end_us", bin_us).join(binned(right, f"{prefix}start_us", f"{prefix}end_us", bin_us), [*by, "_bin"]).where(begins & hit).drop("_bin")
    return met.withColumns({"from_us": F.greatest("start_us", f"{prefix}start_us"), "to_us": F.least("end_us", f"{prefix}end_us")})


def occurrence(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Adds n, from 0: which of the rows of its key a row is."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)


def coalesce_ranges(ranges: DataFrame, by: list[str], gap_us: int = 0) -> DataFrame:
    """Merges ranges of a group that overlap, touch or lie at most gap_us apart: by, start_us, end_us, n (ranges merged)."""
    order = Window.partitionBy(*by).orderBy("start_us", "end_us")
    reach = F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.coalesce((F.col("start_us") > reach + gap_us).cast("int"), F.lit(1)))
    island = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "_island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n")).drop("_island")


def subtract(ranges: DataFrame, removals: DataFrame, by: list[str], prefix: str = "b_") -> DataFrame:
    """What is left of each range (by, id, start_us, end_us) without the removals of its group: by, id, piece, start_us, end_us."""
    cut = intersect(ranges, removals, by, prefix).select(*by, "id", "start_us", "end_us", "from_us", "to_us")
    tail = ranges.select(*by, "id", "start_us", "end_us", F.col("end_us").alias("from_us"), F.col("end_us").alias("to_us"))
    order = Window.partitionBy(*by, "id").orderBy("from_us", "to_us").rowsBetween(Window.unboundedPreceding, -1)
    gaps = cut.unionByName(tail).withColumn("_at", F.coalesce(F.max("to_us").over(order), F.col("start_us"))).where("from_us > _at")
    pieces = gaps.select(*by, "id", F.col("_at").alias("start_us"), F.col("from_us").alias("end_us"))
    return occurrence(pieces, [*by, "id"], ["start_us"]).withColumnRenamed("n", "piece")


def as_of(probes: DataFrame, rows: DataFrame, by: list[str], at: str, time: str, value: list[str]) -> DataFrame:
    """Each probe with the last row of its group at or before it (null without one); of rows at one time the last by value.

    Both go through one window over the group, so nothing is multiplied; rows come before probes of the same time.
    """
    right = rows.select(*by, F.col(time).alias("_t"), F.struct(time, *value).alias("_row"), F.lit(0).alias("_kind"))
    names = [c for c in probes.columns if c not in by]
    left = probes.select(*by, F.col(at).alias("_t"), F.struct(*names).alias("_probe"), F.lit(1).alias("_kind"))
    both = right.unionByName(left, allowMissingColumns=True)
    last = F.last("_row", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_t", "_kind", "_row").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_row", last).where("_kind = 1").select(*by, "_probe.*", *[F.col(f"_row.{v}").alias(v) for v in [time, *value]])


def reanchored(notes: DataFrame, clips: DataFrame, by: list[str], bin_us: int = BIN_US) -> DataFrame:
    """by, id, piece, start_us, end_us: notes (by, id, start_us, end_us) on an output's clock as ranges of its source. clips
    (by, c_start_us, c_end_us, c_source_us): where each clip stands in the output, and where its source begins. A note
    is split where clips meet, and pieces that follow each other in the output and in the source become one again."""
    met = intersect(notes.select(*by, "id", "start_us", "end_us"), clips, by, "c_", bin_us)
    source = F.col("c_source_us") + F.col("from_us") - F.col("c_start_us")
    cut = met.select(*by, "id", "from_us", "to_us", source.alias("_a"), (source + F.col("to_us") - F.col("from_us")).alias("_z"))
    order = Window.partitionBy(*by, "id").orderBy("from_us", "_a")
    goes_on = (F.lag("to_us").over(order) == F.col("from_us")) & (F.lag("_z").over(order) == F.col("_a"))
    island = cut.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("piece", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return island.groupBy(*by, "id", "piece").agg(F.min("_a").alias("start_us"), F.max("_z").alias("end_us"))


def first_overlapping(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Each range with the id of the first other range of its group that overlaps it, by start and then id; null if none."""
    other = ranges.select(*by, F.col("id").alias("b_id"), F.col("start_us").alias("b_start_us"), F.col("end_us").alias("b_end_us"))
    found = intersect(ranges.select(*by, "id", "start_us", "end_us"), other, by).where("id <> b_id").groupBy(*by, "id").agg(F.min_by("b_id", F.struct("b_start_us", "b_id")).alias("other"))
    return ranges.join(found, [*by, "id"], "left")


def without_overlap(rows: DataFrame, blockers: DataFrame, by: list[str], prefix: str = "b_") -> DataFrame:
    """Rows (by, id, start_us, end_us, ...) that overlap no blocker of their group."""
    hit = intersect(rows.select(*by, "id", "start_us", "end_us"), blockers, by, prefix).select(*by, "id").distinct()
    return rows.join(hit, [*by, "id"], "left_anti")


def snapped(us: Column, num: int, den: int, how: str = "round") -> Column:
    """Microseconds on the nearest, previous or next frame of a rate of num/den frames a second."""
    frame = us * num / (den * 1_000_000)
    index = {"round": F.floor(frame + 0.5), "floor": F.floor(frame), "ceil": F.ceil(frame)}[how]
    return F.floor(index * den * 1_000_000 / F.lit(num) + 0.5).cast("long")


def accepted_in_order(rows: DataFrame, by: list[str], most: int, least_us: int) -> DataFrame:
    """Admission in order of start and id: by, id, verdict. A row is refused as too_short, overlapping the last accepted
    row, or over the limit of rows; each accepted row blocks later ones. The state is the last accepted row's end and
    the number accepted."""

    def step(state: tuple, row: tuple) -> tuple:
        (end, n), (s, e) = state, row
        if e - s < least_us:
            return state, "too_short"
        if end is not None and s < end:
            return state, "overlap"
        return (state, "limit") if n >= most else ((e, n + 1), "accepted")

    return folded(rows.select(*by, "id", "start_us", "end_us"), by, ["start_us", "id"], lambda: (None, 0), step, ["start_us", "end_us"], "verdict", "string").select(*by, "id", "verdict")


def cut_out(gaps: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    """What is left of ranges without [a, b)."""
    return [g for s, e in gaps for g in ((s, min(e, a)), (max(s, b), e)) if g[1] > g[0]] if b > a else gaps


def within_limit(clips: DataFrame, removals: DataFrame, by: list[str], most: int, least_us: int) -> DataFrame:
    """Removals (by, id, b_id, b_start_us, b_end_us) taken longest first, ties by start and ids, as long as the clips of the
    group keep to `most` pieces of least_us or more: by, id, b_id, taken. Each choice depends on those before; the state is
    the number of pieces and what is left of the clips that were cut so far, so a group's rows stream through."""
    own = clips.select(*by, "id", F.col("start_us").alias("_s"), F.col("end_us").alias("_e"))
    fresh = removals.select(*(F.col(c).alias(c) for c in [*by, "id", "b_id", "b_start_us", "b_end_us"]))  # removals may come from clips
    rows = fresh.join(own, [*by, "id"], "left").join(clips.groupBy(*by).agg(F.count("*").alias("_n")), by, "left").withColumn("_less", F.col("b_start_us") - F.col("b_end_us"))

    def step(state: tuple, row: tuple) -> tuple:
        (pieces, left), (i, a, b, s, e, n) = state, row
        if s is None:
            return state, False
        pieces = n if pieces is None else pieces
        before, count = left.get(i, ([(s, e)], 1))
        after = cut_out(before, a, b)
        now = sum(y - x >= least_us for x, y in after)
        if pieces - count + now > most:
            return (pieces, left), False
        left[i] = (after, now)
        return (pieces - count + now, left), True

    got = folded(rows, by, ["_less", "b_start_us", "b_id", "id"], lambda: (None, {}), step, ["id", "b_start_us", "b_end_us", "_s", "_e", "_n"], "taken", "boolean")
    return got.select(*by, "id", "b_id", "taken")
