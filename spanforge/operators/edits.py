"""Logs of edits: lists whose items are added, removed, moved and changed, and histories that are undone and redone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import POINTS, points
from .folds import folded

# Clips of a list, the shortest one, microseconds of a list; steps that can be undone.
MOST_CLIPS, LEAST_US, MOST_US, STEPS = 20, 100_000, 14_400_000_000, 100
#: Letters of order keys, in order.
_LETTERS = "0123456789abcdefghijklmnopqrstuvwxyz"


def between(a: str, b: str) -> str:
    """A key after a and before b ('' for none on that side), as strings compare; there always is one, as no key ends in 0."""
    out = ""
    for k in range(len(a) + len(b) + 1):
        low = _LETTERS.index(a[k]) if k < len(a) else 0
        high = _LETTERS.index(b[k]) if k < len(b) else len(_LETTERS)
        if high - low > 1:
            return out + _LETTERS[(low + high) // 2]
        out += _LETTERS[low]
        if high > low:
            b = ""  # what follows may be anything above the rest of a
    raise ValueError(f"no key between {a!r} and {b!r}")


def _edit(state: tuple, row: tuple) -> tuple[tuple, str]:
    """One edit. The state: keys, in order, of the clips that are there ({key: (clip, length)}), MOST_CLIPS at most; the answer
    is a verdict and, where something changed, the clip's key after a colon."""
    op, clip, a, b, source = row
    held = {c: k for k, (c, _) in state}
    at = [c for _, (c, _) in state].index(clip) if clip in held else None

    def placed(rest: tuple, index: int, size: int) -> tuple[tuple, str]:
        key = between(rest[index - 1][0] if index else "", rest[index][0] if index < len(rest) else "")
        return (*rest[:index], (key, (clip, size)), *rest[index:]), f"ok:{key}"

    if op in ("add", "update"):
        size = b - a
        others = sum(n for _, (c, n) in state if op == "add" or c != clip)
        rules = [("range_reversed", size <= 0), ("range_out_of_source", a < 0 or b > source), ("clip_too_short", size < LEAST_US), ("clip_limit_exceeded", op == "add" and len(state) >= MOST_CLIPS), ("no_source", op == "update" and at is None), ("timeline_duration_exceeds_policy", others + size > MOST_US)]
        refusal = next((code for code, broken in rules if broken), None)
        if refusal:
            return state, refusal
        if op == "add":
            return placed(state, len(state), size)
        key = held[clip]
        return tuple((k, (c, size if c == clip else n)) for k, (c, n) in state), f"ok:{key}"
    if at is None:
        return state, "unchanged"
    rest, size = state[:at] + state[at + 1 :], state[at][1][1]
    if op == "remove":
        return rest, "ok:"
    to = at + a if op == "move_by" else max(0, min(len(rest), a))
    return placed(rest, to, size) if 0 <= to <= len(rest) and to != at else (state, "unchanged")


def edited(log: DataFrame, by: list[str]) -> DataFrame:
    """log with verdict and key: each edit of a list answered in order of n.

    log: by, n, op, clip, a, b, source_us. add and update give a clip the range a to b of the source, add at the end; remove;
    move_to place a (the nearest there is); move_by a places, if that place is there. A verdict is ok, unchanged or the first
    rule that is broken. A clip's key tells its place among the others and is changed by its own edits alone; so a list is
    the last key of each clip, in order (see lists). The fold holds the clips of a list, of which there are MOST_CLIPS at most,
    however long its log. Each add has a clip of its own; an empty log gives no rows."""
    x = folded(log, by, ["n"], tuple, _edit, ["op", "clip", "a", "b", "source_us"], "answer", "string")
    parts = F.split("answer", ":")
    return x.withColumn("verdict", F.get(parts, F.lit(0))).withColumn("key", F.get(parts, F.lit(1))).drop("answer")


def lists(log: DataFrame, by: list[str]) -> DataFrame:
    """by, place, clip, a, b: the lists that a log of edits leaves, from the last key and the last range of each clip."""
    done = edited(log, by).where("verdict = 'ok'")
    ranged = F.when(F.col("op").isin("add", "update"), F.struct("a", "b"))
    last = done.groupBy(*by, "clip").agg(F.max_by("key", "n").alias("key"), F.max_by(ranged, F.when(ranged.isNotNull(), F.col("n"))).alias("r")).where("key <> ''")
    place = F.row_number().over(Window.partitionBy(*by).orderBy("key")) - 1
    return last.select(*by, place.alias("place"), "clip", "r.a", "r.b")


def histories(log: DataFrame, by: list[str], steps: int = STEPS) -> DataFrame:
    """log with depth and present: what a history shows after each step, in order of n.

    log: by, n, op (commit, replace, undo, redo), value. A commit goes one step deeper and ends what could be redone, a
    replace changes what is shown, undo and redo go a step up and down as far as there are steps, `steps` up at most. What is
    shown at a depth is what was committed or replaced last there, so no stack is kept: a fold over three numbers gives the
    depth, and a window by depth the value (null: the first one, which isn't in the log)."""

    def step(state: tuple, row: tuple) -> tuple[tuple, float]:
        """The state: how deep it is now, the deepest that a redo reaches, the least that an undo reaches."""
        (op,), (depth, top, base) = row, state
        if op == "commit":
            depth += 1
            top, base = depth, max(base, depth - steps)
        elif op == "undo":
            depth = max(depth - 1, base)
        elif op == "redo":
            depth = min(depth + 1, top)
        return (depth, top, base), float(depth)

    x = folded(log, by, ["n"], lambda: (0, 0, 0), step, ["op"], "depth", "double").withColumn("depth", F.col("depth").cast("int"))
    here = Window.partitionBy(*by, "depth").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("present", F.last(F.when(F.col("op").isin("commit", "replace"), F.col("value")), ignorenulls=True).over(here))


def _nth() -> Column:
    return F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id"))


@query("v13_edited_lists")
def v13(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as edits of a list of pieces of one source: half of them add, the others change one of the last five."""
    p = points(spark, d).withColumn("n", _nth()).withColumn("v", F.col("v") + F.col("event_id") % 7)
    op = F.when((F.col("v") % 2 == 0) | (F.col("n") <= 3), "add").when(F.col("v") % 8 == 1, "remove").when(F.col("v") % 8 == 3, "move_to").when(F.col("v") % 8 == 5, "move_by").otherwise("update")
    clip = F.when(op == "add", F.col("n")).otherwise(F.greatest(F.lit(1), F.col("n") - 1 - F.col("v") % 5)).cast("string")
    a = F.when(op == "move_to", F.col("v") % 6).when(op == "move_by", F.col("v") % 3 - 1).otherwise(F.col("v") * 10_000)
    log = p.select("user_id", "n", op.alias("op"), clip.alias("clip"), a.cast("long").alias("a"), (F.col("v") * 10_000 + F.col("v") % 50 * 20_000_000).alias("b"), F.lit(10_000_000_000).alias("source_us"))
    return lists(log, ["user_id"])


@query("v14_undo_history", """WITH RECURSIVE pts AS (SELECT user_id, event_id, epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) AS v FROM events),
l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n, CASE WHEN v % 10 < 4 THEN 'commit' WHEN v % 10 < 5 THEN 'replace' WHEN v % 10 < 8 THEN 'undo' ELSE 'redo' END AS op FROM pts),
st AS (SELECT user_id, 0::BIGINT AS n, 0 AS depth, 0 AS top, 0 AS base FROM (SELECT DISTINCT user_id FROM l)
  UNION ALL SELECT l.user_id, l.n, CASE op WHEN 'commit' THEN depth + 1 WHEN 'undo' THEN greatest(depth - 1, base) WHEN 'redo' THEN least(depth + 1, top) ELSE depth END, CASE op WHEN 'commit' THEN depth + 1 ELSE top END, CASE op WHEN 'commit' THEN greatest(base, depth + 1 - 100) ELSE base END FROM st JOIN l ON l.user_id = st.user_id AND l.n = st.n + 1)
SELECT l.user_id, l.n::INTEGER AS n, depth, last_value(CASE WHEN op IN ('commit', 'replace') THEN event_id END IGNORE NULLS) OVER (PARTITION BY l.user_id, depth ORDER BY l.n) AS present FROM st JOIN l ON l.user_id = st.user_id AND l.n = st.n""")
def v14(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as steps of a history."""
    k = F.col("v") % 10
    op = F.when(k < 4, "commit").when(k < 5, "replace").when(k < 8, "undo").otherwise("redo")
    log = points(spark, d).select("user_id", _nth().alias("n"), op.alias("op"), F.col("event_id").alias("value"))
    return histories(log, ["user_id"]).select("user_id", "n", "depth", "present")
