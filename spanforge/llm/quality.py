"""Quality classifier: tree paths as conjunctive rules over text statistics, lasso logistic weights, one column expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Labelled rows that the trees and the weights are fitted on at most; the statistics and scores cover all rows.
MAX_LABELLED = 8000
THRESHOLD = 0.3
SPACE = r"[\x20\x09-\x0D]+"


def statistics() -> dict[str, F.Column]:
    """Numbers about the column `text`, computed by Spark's own functions over the whole text; null reads as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    chars = F.greatest(F.char_length(text), F.lit(1))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n = F.size(words)
    kinds = F.size(F.array_distinct(words))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / chars
    repeats = F.aggregate(words, F.struct(F.lit("").alias("last"), F.lit(0).alias("n")), lambda a, w: F.struct(w.alias("last"), (a["n"] + (a["last"] == w).cast("int")).alias("n")), lambda a: a["n"])
    return {
        "n_words": n.cast("double"),
        "word_length": F.char_length(text) / F.greatest(n, F.lit(1)),
        "distinct_share": kinds / F.greatest(n, F.lit(1)),
        "distinct_power": F.when(n > 1, F.ln(kinds.cast("double")) / F.ln(n.cast("double"))).otherwise(1.0),
        "repeat_share": repeats / F.greatest(n, F.lit(1)),
        "symbol_share": share(r"[*$%&#@^~=<>{}\\_]"),
        "bar_share": share(r"\|"),
        "shout_share": share("!"),
        "upper_share": share(r"\p{Lu}"),
        "digit_share": share("[0-9]"),
        "stop_share": share(r"[.,;:?]"),
        "line_share": share("\n"),
    }


@dataclass(frozen=True)
class Rule:
    """All of the conditions (statistic, "<=" or ">", threshold) hold."""

    conditions: tuple[tuple[str, str, float], ...]

    def column(self) -> F.Column:
        out = F.lit(True)
        for name, sign, at in self.conditions:
            out = out & (F.col(name) <= at if sign == "<=" else F.col(name) > at)
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    """A logistic model over rules; rules of weight 0 are left out."""

    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> F.Column:
        z = F.lit(self.intercept)
        for rule, w in self.weights:
            z = z + F.when(rule.column(), w).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def _paths(node, names: list[str], held: dict[tuple[str, str], float]) -> set[Rule]:
    """Rules of all nodes below this one; a statistic asked twice on one side keeps the tighter threshold."""
    out = {Rule(tuple(sorted((n, s, t) for (n, s), t in held.items())))} if held else set()
    if node.getClass().getSimpleName() != "InternalNode":
        return out
    split = node.split()
    name, at = names[split.featureIndex()], split.threshold()
    left = held | {(name, "<="): min(at, held.get((name, "<="), at))}
    right = held | {(name, ">"): max(at, held.get((name, ">"), at))}
    return out | _paths(node.leftChild(), names, left) | _paths(node.rightChild(), names, right)


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED, trees: int = 16, depth: int = 3, penalty: float = 0.001) -> RuleEnsemble:
    """A rule ensemble for labels (doc_id, quality 0 or 1) on the texts of docs (doc_id, text).

    Of the labels whose crc32(doc_id) mod 5 isn't 0, the `bound` rows that a hash of their doc_id puts first are used;
    null labels and doc_ids don't count. Without any, the score is 0.5 everywhere, and with one class that class's. An
    empty table counts as no labels; rows of docs that repeat a labelled doc_id each count; further columns are not read.
    """
    stats = statistics()
    known = labels.where("quality in (0, 1) and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    some = known.select("doc_id", F.col("quality").cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("label", *(c.alias(n) for n, c in stats.items()))
    rows = stage(rows.select("label", array_to_vector(F.array(*stats)).alias("stats"), *stats)).coalesce(8)  # of `bound` rows at most
    seen = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(seen) < 2:
        return RuleEnsemble({1.0: 4.0, 0.0: -4.0}[next(iter(seen))] if seen else 0.0, ())
    forest = RandomForestClassifier(featuresCol="stats", labelCol="label", numTrees=trees, maxDepth=depth, seed=11, subsamplingRate=0.7, featureSubsetStrategy="onethird").fit(rows)
    rules = sorted(set().union(*(_paths(t._java_obj.rootNode(), list(stats), {}) for t in forest.trees)), key=lambda r: r.conditions)
    if not rules:
        return RuleEnsemble(0.0, ())
    held = rows.select("label", array_to_vector(F.array(*(r.column().cast("double") for r in rules))).alias("rules")).cache()
    lasso = LogisticRegression(featuresCol="rules", labelCol="label", regParam=penalty, elasticNetParam=1.0, standardization=False, maxIter=60).fit(held)
    held.unpersist()
    return RuleEnsemble(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if abs(w) > 1e-9))


def scored(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """One row (row: all columns of docs, score) per row of docs; repeated rows each keep theirs."""
    stats = statistics()
    return docs.select(F.struct("*").alias("row"), *(c.alias(n) for n, c in stats.items())).select("row", model.score().alias("score"))


def quality_scores(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs. Null and empty texts are scored like any other, null as empty;
    a null doc_id isn't held out; repeated rows each keep theirs, with one score; further columns are not read, whatever
    their names; an empty table gives no rows."""
    got = scored(docs.select("doc_id", "text"), fit(docs, labels, **how))
    out = F.crc32(F.col("row.doc_id").cast("string")) % 5 == 0
    return got.select("row.doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns, that the classifier doesn't reject."""
    return scored(docs, fit(docs, labels, **how)).where(F.col("score") >= THRESHOLD).select("row.*")
