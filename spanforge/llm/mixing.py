"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage

#: Parts of each unit of the rank whose sizes are summed before the exact cut; only the part with the cut is sorted.
PARTS = 64


def _rank_inputs(docs: DataFrame, seed: int) -> list:
    """Words and a reproducible random number in (0, 1) of each document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    return [size, _uniform(seed).alias("u")]


def _uniform(seed: int) -> F.Column:
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    return (F.shiftrightunsigned(h, 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def _pi() -> F.Column:
    """Chance of one more copy: in proportion to the size, up to certainty."""
    return F.least(F.lit(1.0), F.col("c") * F.col("size"))


def _rank() -> F.Column:
    """Logarithm of the random odds u / (1 - u) over the inclusion odds pi / (1 - pi); null where the odds are none."""
    u, pi = F.col("u"), _pi()
    return F.when((pi > 0) & (pi < 1), F.ln(u) - F.log1p(-u) - F.ln(pi) + F.log1p(-pi))


def targets(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, target. Weights repeat over the sources in code point order, null last. What a source
    can't take beyond cap times its size is dealt to the others by weight: the level at which all share it is found
    by going through the sources in the order in which they fill up. One row per source, so the window is small."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), k + 1)
    full = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, whole = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = by.select("source", "source_size", w.alias("w"), (F.col("source_size") * float(cap)).alias("most"))
    t = t.withColumn("ratio", F.col("most") / F.col("w"))
    rest = share * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    t = t.withColumn("level", rest / F.greatest(F.sum("w").over(full.rowsBetween(0, Window.unboundedFollowing)), F.lit(1e-12)))
    t = t.withColumn("place", F.row_number().over(full))
    level = F.min_by(F.when(F.col("level") < F.col("ratio"), F.col("level")), F.when(F.col("level") < F.col("ratio"), F.col("place"))).over(whole)
    return t.select("source", "source_size", F.least("most", F.coalesce(level * F.col("w"), F.col("most"))).alias("target"))


def _shares(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """source, c, certain: the factor by which sizes become chances, so that the expected words of one more copy are the
    source's rest, and the words of documents whose chance is 1. The largest sizes are certain first: with all above
    a size certain, the rest is shared by the squares of the others. One row per size of a source goes through windows."""
    n = sized.where("size > 0").groupBy("source", "size").agg(F.count("*").cast("double").alias("n"))
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    size = F.col("size").cast("double")
    above = F.coalesce(F.sum(F.col("n") * size).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    squares = F.sum(F.col("n") * size * size).over(down.rowsBetween(0, Window.unboundedFollowing))
    x = n.withColumn("above", above).withColumn("squares", squares).alias("n").join(plan.alias("p"), F.col("n.source").eqNullSafe(F.col("p.source"))).select("p.source", "size", "above", "squares", "rest")
    x = x.withColumn("c", (F.col("rest") - F.col("above")) / F.col("squares")).where(F.col("c") * F.col("size") <= 1)
    return x.groupBy("source").agg(F.max_by(F.struct("c", F.col("above").alias("certain")), "size").alias("x")).select("source", "x.c", "x.certain")


def allocation(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(sized, alloc). sized: doc_id, source, size, u of each row of docs; alloc: source, source_size, target, whole
    (copies that every document of the source gets), c (see _shares) and cut (rank up to which one more is given).

    Beyond the whole copies, documents of a source have unequal chances of one more: in proportion to their size, those
    of the largest being 1. The sample of the others is of fixed size in words: documents come in the order of their
    rank until what remains is met as nearly as whole documents allow. A source's ranks are summed by parts of their
    range, so a source with a third of all rows is spread over all tasks; only the part with the cut is sorted. Rows
    that agree in doc_id and text share a rank and fall on the same side of the cut.
    """
    sized = stage(docs.select("doc_id", "source", *_rank_inputs(docs, seed)))
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    plan = stage(targets(sized, weights, share, cap).withColumn("whole", F.floor(ratio + 1e-12).cast("long")).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))))
    plan = stage(plan.alias("p").join(_shares(sized, plan).alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")), "left").select("p.*", F.greatest(F.lit(0.0), F.coalesce("c", F.lit(0.0))).alias("c"), (F.col("rest") - F.coalesce("certain", F.lit(0.0))).alias("left")))
    ranked = sized.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source"))).select("p.source", "size", "left", _rank().alias("v")).where("v IS NOT NULL")
    ranked = ranked.withColumn("part", F.floor(F.col("v") * PARTS).cast("int"))
    parts = ranked.groupBy("source", "part").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    run = F.sum("words").over(Window.partitionBy("source").orderBy("part"))
    edge = parts.withColumn("upto", run).where("upto >= left").groupBy("source").agg(F.min_by(F.struct("part", (F.col("upto") - F.col("words")).alias("before")), "part").alias("edge")).select("source", "edge.*")
    inside = ranked.alias("r").join(edge.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.part") == F.col("e.part"))).select("r.source", "r.part", "v", "size", "left", "before")
    same = inside.groupBy("source", "part", "v").agg(F.sum("size").alias("size"), F.first("left").alias("left"), F.first("before").alias("before"))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source", "part").orderBy("v"))
    near = same.withColumn("upto", upto).where(F.col("upto") - F.col("left") < F.col("left") - (F.col("upto") - F.col("size")))
    cuts = edge.alias("e").join(near.groupBy("source").agg(F.max("v").alias("v")).alias("n"), F.col("e.source").eqNullSafe(F.col("n.source")), "left").select("e.source", F.coalesce("n.v", (F.col("e.part") - 1e-9) / PARTS).alias("cut"))
    alloc = plan.alias("p").join(cuts.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left").select("p.*", F.coalesce("c.cut", F.lit(float("inf"))).alias("cut"))
    return sized, stage(alloc)


def _copies() -> F.Column:
    """Copies of a row that has size and u, and its source's whole, c and cut."""
    return F.col("whole") + F.when((_pi() >= 1) | (_rank() <= F.col("cut")), 1).otherwise(0)


def mixture(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of each row of docs (doc_id, text, source): see allocation.

    A null text has size 0; null sources form one source, the last; further columns are not read; an empty table
    gives no rows; whole documents are taken 0, 1 or 2 times.
    """
    sized, alloc = allocation(docs, **how)
    return sized.alias("s").join(alloc.alias("a"), F.col("s.source").eqNullSafe(F.col("a.source"))).select("s.doc_id", "s.source", "s.size", "a.source_size", "a.target", (F.col("s.size") * _copies()).alias("taken"))


def mixed(docs: DataFrame, seed: int = 7, **how) -> DataFrame:
    """The rows of docs, all columns, each as often as the mixture takes it."""
    _, alloc = allocation(docs, seed=seed, **how)
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("source"), *_rank_inputs(docs, seed))
    taken = rows.alias("r").join(alloc.alias("a"), F.col("r.source").eqNullSafe(F.col("a.source"))).withColumn("n", _copies())
    return taken.where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")
