"""Search of tasks by what people type: words with endings and slips, phrases and pairs, scores, order and confidence.

What a token may be read as doesn't depend on its request, so it is worked out once for each distinct token, by joins on
beginnings of words and on words with a letter left out. Lists of tasks are tables of a checked size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.staging import staged
from ..sources.tables import TURNS, turns
from .endings import ENGLISH, LONGEST, NEEDS, ends, ends_sql, surfaces
from .textsearch import _FOLD, _STOP, STOP, fold

# Letters of a word that may be a slip (of one beside its neighbour: SLIP_NEAR), from which it may carry an
# ending, from which a part is sure, from which a phrase takes any longer word; what single words, phrases and pairs score.
SLIP, SLIP_NEAR, FORM, SURE, GOES_ON = 5, 4, 3, 4, 5
STRONG = {"exact": 3.0, "part": 2.0, "typo": 2.0}
WEAK = {"exact": 1.0, "part": 0.75, "typo": 0.0}
TOGETHER, MORE_WORD, GUESS_WORDS, RESULTS = 4.0, 1.0, 4, 3
# For an answer that one word (first row) or more stand behind, with 0, 1 or more words left over: the score it
# needs, and the share of it that the next must stay below. Shares of the best that others need: beside it, among choices,
# and of a task that works beside one that doesn't yet.
BARS = [[(2.0, 0.8), (3.0, 0.5), (0.0, 0.0)], [(0.0, 0.8), (0.0, 0.8), (0.0, 0.5)]]
KEPT, KEPT_CHOICE, KEPT_UNDER = 0.4, 0.25, 0.8
#: Rows of a list that may be broadcast.
MOST_WORDS = 100_000


@dataclass(frozen=True)
class Tasks:
    """tasks: task, place, generic, available. words: task, strong, word, yielding. stems: task, stem (verbs whose negative
    means it). phrases: task, k (place in its list), phrase. pairs: task, k, side (0 or 1), word, gap."""

    tasks: DataFrame
    words: DataFrame
    stems: DataFrame
    phrases: DataFrame
    pairs: DataFrame

    def small(self) -> Tasks:
        if any(t.count() > MOST_WORDS for t in (self.tasks, self.words, self.stems, self.phrases, self.pairs)):
            raise ValueError("a list of tasks is too large to broadcast")
        return self


def one_slip(typed: Column, word: Column) -> Column:
    """A letter more or less, two neighbours swapped, or, in a word of over SLIP letters, one letter other or none."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word) - 1))
    swap = lambda i: F.overlay(word, F.concat(F.substring(word, i + 1, F.lit(1)), F.substring(word, i, F.lit(1))), i, F.lit(2))
    same = F.length(typed) == F.length(word)
    swapped = same & (F.length(word) > 1) & (typed != word) & F.exists(at, lambda i: swap(i) == typed)
    return swapped | ((F.levenshtein(typed, word) <= 1) & (~same | (F.length(typed) > SLIP)))


def _missing(word: Column) -> Column:
    """The word, and the word less each of its letters: words one slip apart have one of these in common."""
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))))


def forms(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """token, word, rest, form, negative: tokens (token, distinct) that begin like a word (words: word), as it stands or as it
    changes before an ending, with what follows. form: that is an ending (or nothing); negative: one that negates."""
    last, stem = F.right("word", F.lit(1)), F.left("word", F.length("word") - 1)
    soft = F.when(last == "k", "g").when(last == "p", "b").when(last == "t", "d")
    face = lambda letters, need, when: F.when(when, F.struct(letters.alias("face"), F.lit(need).alias("need")))
    own = F.array_compact(F.array(face(F.col("word"), "any", F.lit(True)), face(F.concat(stem, soft), "vowel", soft.isNotNull()), face(stem, "narrow", last.isin("a", "e") & (F.length("word") >= 3))))
    faces = F.broadcast(words.select("word").distinct().select("word", F.inline(own)))
    begun = tokens.select("token", F.explode(F.sequence(F.lit(1), F.length("token"))).alias("n")).withColumn("face", F.left("token", F.col("n")))
    rest = F.substring("token", F.col("n") + 1, F.length("token"))
    hit = begun.join(faces, "face").withColumn("rest", rest)
    needed = reduce(lambda a, b: a | b, ((F.col("need") == n) & F.col("rest").rlike(p) for n, p in NEEDS.items()))
    hit = hit.where(needed)
    form = ends(F.col("rest")) | ((F.col("need") == "any") & F.col("rest").isin(ENGLISH))
    return hit.select("token", "word", "rest", form.alias("form"), ends(F.col("rest"), negative=True).alias("negative"))


def slips(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """token, word: distinct tokens that are one slip from a word of SLIP letters or more with the same first letter, or are
    such a slip of SLIP letters or more with an ending after it."""
    long = words.where(F.length("word") >= SLIP).select("word").distinct()
    keyed = F.broadcast(long.select("word", F.explode(_missing(F.col("word"))).alias("less")))
    begun = tokens.where(F.length("token") >= SLIP_NEAR).select("token", F.explode(F.sequence(F.greatest(F.lit(SLIP_NEAR), F.length("token") - LONGEST), F.length("token"))).alias("n"))
    begun = begun.where((F.col("n") >= SLIP) | (F.col("n") == F.length("token"))).withColumn("typed", F.left("token", F.col("n")))
    hit = begun.select("token", "typed", F.explode(_missing(F.col("typed"))).alias("less")).join(keyed, "less").select("token", "typed", "word").distinct()
    fine = (F.left("typed", F.lit(1)) == F.left("word", F.lit(1))) & one_slip(F.col("typed"), F.col("word")) & ends(F.substring("token", F.length("typed") + 1, F.length("token")))
    whole = F.col("typed") == F.col("token")
    return hit.where(fine & (whole | (F.length("token") > F.length("word")))).select("token", "word").distinct()


def asked(rows: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, raw, token, place, typing, alone: the folded words of requests. place: among those that carry intent (two letters
    or more, no stop words, nothing that begins with video), else null; typing: the last word, which no space follows;
    alone: the only one."""
    words = rows.select(*by, F.rlike(text, F.lit(r"\s$")).alias("spaced"), F.split(fold(F.col(text)), " ").alias("w"))
    words = words.select(*by, "spaced", F.size("w").alias("n"), F.posexplode("w").alias("raw", "token")).where("token <> ''")
    intent = (F.length("token") >= 2) & ~F.col("token").isin(STOP) & ~F.startswith("token", F.lit("video"))
    place = F.sum(intent.cast("int")).over(Window.partitionBy(*by).orderBy("raw")) - 1
    return words.select(*by, "raw", "token", F.when(intent, place).cast("int").alias("place"), (~F.col("spaced") & (F.col("raw") == F.col("n") - 1)).alias("typing"), (F.col("n") == 1).alias("alone"))


def readings(words: DataFrame, lists: Tasks) -> tuple[DataFrame, DataFrame]:
    """The readings of distinct tokens, by forms and by slips, of all words of the lists, written once as several operators
    read them."""
    every = lists.words.select("word").union(lists.stems.select("stem")).union(lists.phrases.select(F.explode(F.split("phrase", " ")))).union(lists.pairs.select("word")).distinct()
    tokens = words.select("token").distinct()
    return staged(forms(tokens, every)), staged(slips(tokens, every))


def word_matches(words: DataFrame, by: list[str], lists: Tasks, read: tuple[DataFrame, DataFrame]) -> DataFrame:
    """by, place, token, task, kind, tier, strong, yielding: the surest reading of each token of intent by each task; of
    these the best of the token (tier, then letters of the word), all tasks that have it.

    exact: the word, or a stem's negative; part: the word with an ending, or, for the word still being typed, its
    beginning; typo: a slip of a strong word."""
    form, slip = read
    lex, stems = F.broadcast(lists.words), F.broadcast(lists.stems)
    said = lambda kind, tier, letters, strong, firm: F.struct(tier.alias("tier"), letters.alias("letters"), strong.alias("strong"), firm.alias("firm"), F.lit(kind).alias("kind"))
    size, word_size, firm = F.length("token"), F.length("word"), ~F.col("yielding")
    tier = lambda letters: F.when(letters >= SURE, 3).otherwise(1)
    whole = form.where("token = word").select("token", "word").join(lex, "word").select("token", "task", said("exact", F.lit(4), size, F.col("strong"), firm).alias("m"))
    part = form.where(F.col("form") & (F.col("token") != F.col("word")) & (word_size >= FORM) & (size > word_size)).select("token", "word").join(lex, "word").select("token", "task", said("part", tier(word_size), word_size, F.col("strong"), firm).alias("m"))
    typo = slip.where((size >= SLIP) & (F.col("token") != F.col("word"))).join(lex.where("strong"), "word").select("token", "task", said("typo", F.lit(2), F.least(size, word_size), F.col("strong"), firm).alias("m"))
    cannot = form.where("negative").select("token", F.col("word").alias("stem")).join(stems, "stem").select("token", "task", said("exact", F.lit(4), size, F.lit(True), F.lit(True)).alias("m"))
    known = whole.unionByName(part).unionByName(typo).unionByName(cannot).groupBy("token", "task").agg(F.max("m").alias("m"))
    own = words.where("place IS NOT NULL").select(*by, "place", "token", "typing", "alone")
    hit = own.join(known, "token").select(*by, "place", "token", "task", "m")
    begun = F.broadcast(lists.words.select("task", "strong", "yielding", "word", F.explode(F.sequence(F.lit(2), F.length("word"))).alias("n")).where(F.col("n") < F.length("word")).withColumn("token", F.left("word", F.col("n"))))
    typing = own.where("typing").join(begun, "token").where((size >= FORM) | (F.col("strong") & F.col("alone")))
    hit = hit.unionByName(typing.select(*by, "place", "token", "task", said("part", tier(size), size, F.col("strong"), firm).alias("m")))
    best = hit.groupBy(*by, "place", "token", "task").agg(F.max("m").alias("m"))
    order = Window.partitionBy(*by, "place").orderBy(F.col("m.tier").desc(), F.col("m.letters").desc())
    best = best.withColumn("r", F.rank().over(order)).where("r = 1")
    return best.select(*by, "place", "token", "task", "m.kind", "m.tier", "m.strong", (~F.col("m.firm")).alias("yielding"))


def combined(words: DataFrame, by: list[str], lists: Tasks, read: tuple[DataFrame, DataFrame]) -> DataFrame:
    """by, task, score, places: of each task the longest phrase that a request holds, else its first pair.

    A word of either may be met with an ending or a slip, in a phrase also by a longer word. Words of a phrase follow each
    other, stop words counted: they meet on one diagonal (place less place in the phrase). A pair's sides stand in
    either order with up to `gap` words of intent between. places: of the words that carry intent."""
    form, slip = read
    loose = form.where("form AND length(word) >= 2 OR token = word").select("token", "word").unionByName(slip).distinct()
    longer = form.where(F.startswith("token", F.col("word")) & (F.length("word") >= GOES_ON)).select("token", "word")
    parts = lists.phrases.select("task", "k", F.size(F.split("phrase", " ")).alias("n"), F.posexplode(F.split("phrase", " ")).alias("i", "word")).where("n >= 2")
    met = loose.unionByName(longer).distinct().join(F.broadcast(parts), "word").select("token", "task", "k", "n", "i").distinct()
    runs = words.join(met, "token").groupBy(*by, "task", "n", "k", (F.col("raw") - F.col("i")).alias("start")).agg(F.count("*").alias("c"), F.array_sort(F.collect_set("place")).alias("places")).where("c = n")
    phrase = runs.groupBy(*by, "task").agg(F.max(F.struct("n", (-F.col("k")).alias("k"), (-F.col("start")).alias("start"), "places")).alias("x"))
    phrase = phrase.select(*by, "task", (TOGETHER + MORE_WORD * (F.col("x.n") - 2)).alias("score"), "x.places")
    sides = loose.join(F.broadcast(lists.pairs), "word").select("token", "task", "k", "side", "gap").distinct()
    at = words.where("place IS NOT NULL").select(*by, "place", "token").join(sides, "token").select(*by, "place", "task", "k", "side", "gap")
    other = at.select(*by, F.col("place").alias("other"), "task", "k", (1 - F.col("side")).alias("side"))
    near = at.join(other, [*by, "task", "k", "side"]).where((F.col("other") > F.col("place")) & (F.col("other") - F.col("place") <= F.col("gap") + 1))
    two = near.groupBy(*by, "task").agg(F.min(F.struct("k", "place", "other")).alias("x")).select(*by, "task", F.lit(TOGETHER).alias("score"), F.array("x.place", "x.other").alias("places"))
    return phrase.unionByName(two.join(phrase.select(*by, "task"), [*by, "task"], "left_anti"))


def tallies(matches: DataFrame, together: DataFrame, by: list[str]) -> DataFrame:
    """by, task, score, specific, combined, yields, explained, covered: a task's single words by kind, and its one phrase or
    pair. A yielding word counts as strong while no other task has anything of its own (a strong word that doesn't yield, a
    phrase, a pair), else as weak. covered: the request's places that stand behind it."""
    worth = lambda t: F.element_at(F.create_map(*[F.lit(x) for kv in t.items() for x in kv]), F.col("kind"))
    value = F.when(F.col("strong"), worth(STRONG)).otherwise(worth(WEAK))
    none, y = F.lit(0.0), F.col("yielding")
    single = matches.select(*by, "task", F.when(y, none).otherwise(value).alias("own"), F.when(y, worth(STRONG)).otherwise(none).alias("up"), F.when(y, worth(WEAK)).otherwise(none).alias("down"), (F.col("strong") & ~y).alias("specific"), F.lit(False).alias("combined"), F.lit(1).alias("explained"), F.array("place").alias("places"))
    groups = together.select(*by, "task", F.col("score").alias("own"), none.alias("up"), none.alias("down"), F.lit(True).alias("specific"), F.lit(True).alias("combined"), F.lit(0).alias("explained"), "places")
    t = single.unionByName(groups).groupBy(*by, "task").agg(*(F.sum(c).alias(c) for c in ("own", "up", "down", "explained")), *(F.bool_or(c).alias(c) for c in ("specific", "combined")), F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"))
    others = F.sum(F.col("specific").cast("int")).over(Window.partitionBy(*by)) > F.col("specific").cast("int")
    t = t.withColumn("score", F.col("own") + F.when(others, F.col("down")).otherwise(F.col("up")))
    return t.select(*by, "task", "score", "specific", "combined", (F.col("up") > 0).alias("yields"), F.col("explained").cast("int").alias("explained"), "covered")


def answers(found: DataFrame, words: DataFrame, by: list[str], tasks: DataFrame) -> DataFrame:
    """by, task, score, n, confidence, words, covered, left, second: at most RESULTS tasks of a request in order of score,
    generic ones after others, then by the task's place.

    The best is sure where its score reaches the bar, and the next stays under the bar's share, that BARS sets by how many
    words stand behind it and how many are left over; an answer that it can't be done yet is always sure. None where one
    weak word of a request of GUESS_WORDS words or more is all there is."""
    sizes = words.groupBy(*by).agg(F.count("place").cast("int").alias("words"))
    x = found.where("score > 0").join(F.broadcast(tasks), "task").join(sizes, by)
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "generic", F.col("tasks_place"))
    x = x.withColumn("n", F.row_number().over(w))
    facts = F.struct("score", "available", F.size("covered").alias("covered"), (~F.col("specific") & (F.col("explained") <= 1) & ~F.col("yields")).alias("thin"))
    per = x.groupBy(*by).agg(F.max_by(facts, F.when(F.col("n") == 1, 1)).alias("top"), F.coalesce(F.max(F.when(F.col("n") == 2, F.col("score"))), F.lit(0.0)).alias("second"), F.first("words").alias("words"))
    per = per.where(~(F.col("top.thin") & (F.col("words") >= GUESS_WORDS))).withColumn("left", F.col("words") - F.col("top.covered"))
    bars = F.array(*(F.array(*(F.struct(F.lit(a).alias("least"), F.lit(b).alias("share")) for a, b in row)) for row in BARS))
    bar = F.get(F.get(bars, (F.col("top.covered") >= 2).cast("int")), F.least(F.col("left"), F.lit(2)))
    per = per.withColumn("bar", bar)
    sure = (F.col("top.score") >= F.col("bar.least")) & (F.col("second") / F.col("top.score") < F.col("bar.share"))
    per = per.withColumn("confidence", F.when(sure | ~F.col("top.available"), "sure").otherwise("ask"))
    x = x.drop("words", "covered").join(per, by)
    beside = F.when((F.col("confidence") == "ask") & F.col("available"), KEPT_CHOICE).otherwise(KEPT)
    under = F.when(F.col("available") & ~F.col("top.available"), KEPT_UNDER).otherwise(0.0)
    x = x.where(F.col("score") >= F.col("top.score") * F.greatest(beside, under))
    x = x.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("n"))).where(F.col("n") <= RESULTS)
    return x.select(*by, "task", "score", "n", "confidence", "words", F.col("top.covered").alias("covered"), "left", "second")


KEYS = ["conv_id", "pos", "part"]
#: A small list of tasks for the words of the tables: (place, generic, available), words, verbs, phrases, pairs (two sides, gap).
TASKS = [("cut", 0, True, True), ("join", 1, False, True), ("mute", 2, False, True), ("crop", 3, False, False)]
WORDS = [("cut", True, "thtion", False), ("cut", False, "her", False), ("cut", True, "erble", False), ("join", True, "ering", False), ("join", False, "that", False), ("join", True, "with", True), ("mute", True, "thing", True), ("mute", False, "from", False), ("mute", True, "onble", False), ("crop", True, "nicht", False), ("crop", False, "not", False), ("crop", True, "heble", False), ("crop", False, "for", False), ("mute", True, "an", False), ("join", True, "que", False)]
STEMS = [("mute", "re"), ("crop", "est"), ("cut", "on")]
PHRASES = [("join", 0, "in to"), ("mute", 0, "is it"), ("crop", 0, "in th that"), ("cut", 0, "to be"), ("cut", 1, "her ing the"), ("mute", 1, "thtion er"), ("join", 1, "that onble of")]
PAIRS = [("join", 0, ["on", "an"], ["that", "her"], 0), ("cut", 0, ["is"], ["to", "in"], 1), ("mute", 0, ["en"], ["un", "er"], 2), ("crop", 0, ["was"], ["it"], 0), ("crop", 1, ["onble", "heble"], ["in", "ent"], 1)]
_SIDES = [(t, k, side, w, gap) for t, k, a, b, gap in PAIRS for side, ws in enumerate((a, b)) for w in ws]


def small_tasks(spark: SparkSession) -> Tasks:
    return Tasks(
        spark.createDataFrame(TASKS, "task string, tasks_place int, generic boolean, available boolean"), spark.createDataFrame(WORDS, "task string, strong boolean, word string, yielding boolean"),
        spark.createDataFrame(STEMS, "task string, stem string"), spark.createDataFrame(PHRASES, "task string, k int, phrase string"), spark.createDataFrame(_SIDES, "task string, k int, side int, word string, gap int"),
    ).small()


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of turns as requests."""
    return asked(turns(spark, d).select("conv_id", "pos", F.posexplode(F.split("text", r"[.,?!\n]")).alias("part", "text")), KEYS)


def _all(spark: SparkSession, d: str) -> tuple[DataFrame, Tasks, DataFrame, DataFrame]:
    words, lists = staged(requests(spark, d)), small_tasks(spark)
    read = readings(words, lists)
    return words, lists, word_matches(words, KEYS, lists, read), combined(words, KEYS, lists, read)


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower()
    return f"{name} AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS v({columns}))"


# In SQL all distinct tokens meet all words; each pair is judged by itself.
_EVERY = sorted({w for _, _, w, _ in WORDS} | {s for _, s in STEMS} | {w for _, _, p in PHRASES for w in p.split()} | {r[3] for r in _SIDES})
_ASKED = f"""parts AS (SELECT conv_id, pos, unnest(regexp_split_to_array(text, '[.,?!\\n]')) AS text, unnest(range(len(regexp_split_to_array(text, '[.,?!\\n]'))))::INTEGER AS part FROM turns),
spl AS (SELECT conv_id, pos, part, regexp_matches(text, '[ \\t\\n\\x0B\\f\\r]$') AS spaced, string_split({_FOLD}, ' ') AS w FROM parts),
raws AS (SELECT conv_id, pos, part, spaced, len(w) AS n, (unnest(range(len(w))))::INTEGER AS raw, unnest(w) AS token FROM spl),
ask0 AS (SELECT *, length(token) >= 2 AND token NOT IN ({_STOP}) AND NOT starts_with(token, 'video') AS intent FROM raws WHERE token <> ''),
ask AS (SELECT conv_id, pos, part, raw, token, CASE WHEN intent THEN (sum(intent::INTEGER) OVER (PARTITION BY conv_id, pos, part ORDER BY raw) - 1)::INTEGER END AS place, NOT spaced AND raw = n - 1 AS typing, n = 1 AS alone FROM ask0)"""
_FACES = _values("faces", "word, face, need", [(w, f, n) for w in _EVERY for f, n in surfaces(w)])
_ENG = "(" + ", ".join(f"'{e}'" for e in ENGLISH) + ")"
_OSA = "damerau_levenshtein({a}, {b}) <= 1 AND (length({a}) <> length({b}) OR length({a}) > 5 OR levenshtein({a}, {b}) = 2)"
_READ = f"""dis AS (SELECT DISTINCT token FROM ask),
fit AS (SELECT token, word, need, substr(token, length(face) + 1) AS rest FROM dis JOIN faces ON starts_with(token, face)
  AND CASE need WHEN 'any' THEN true WHEN 'vowel' THEN regexp_matches(substr(token, length(face) + 1), '{NEEDS["vowel"]}') ELSE regexp_matches(substr(token, length(face) + 1), '{NEEDS["narrow"]}') END),
form AS (SELECT token, word, rest, {ends_sql("rest")} OR need = 'any' AND rest IN {_ENG} AS form, {ends_sql("rest", True)} AS negative FROM fit),
cuts AS (SELECT token, left(token, n) AS typed, substr(token, n + 1) AS rest FROM (SELECT token, unnest(range(4, length(token) + 1)) AS n FROM dis) WHERE n = length(token) OR n >= 5),
slp AS (SELECT DISTINCT token, word FROM cuts JOIN (SELECT DISTINCT word FROM faces WHERE length(word) >= 5) ON left(typed, 1) = left(word, 1) AND {_OSA.format(a="typed", b="word")}
  AND (typed = token OR length(token) > length(word)) AND {ends_sql("rest")})"""
_MATCH = f"""{_values("lex", "task, strong, word, yielding", WORDS)}, {_values("stm", "task, stem", STEMS)},
cand AS (SELECT token, task, 4 AS tier, length(token) AS letters, strong, NOT yielding AS firm, 'exact' AS kind FROM dis JOIN lex ON token = word
  UNION ALL SELECT token, task, CASE WHEN length(word) >= 4 THEN 3 ELSE 1 END, length(word), strong, NOT yielding, 'part' FROM form JOIN lex USING (word) WHERE form AND token <> word AND length(word) >= 3 AND length(token) > length(word)
  UNION ALL SELECT token, task, 2, least(length(token), length(word)), strong, NOT yielding, 'typo' FROM slp JOIN lex USING (word) WHERE strong AND length(token) >= 5 AND token <> word
  UNION ALL SELECT token, task, 4, length(token), true, true, 'exact' FROM form JOIN stm ON word = stem WHERE negative),
occ AS (SELECT conv_id, pos, part, place, token, c.* EXCLUDE (token) FROM ask JOIN cand c USING (token) WHERE place IS NOT NULL
  UNION ALL SELECT conv_id, pos, part, place, token, task, CASE WHEN length(token) >= 4 THEN 3 ELSE 1 END, length(token), strong, NOT yielding, 'part' FROM ask JOIN lex ON starts_with(word, token) AND word <> token WHERE place IS NOT NULL AND typing AND (length(token) >= 3 OR strong AND alone)),
one AS (SELECT * FROM occ QUALIFY row_number() OVER (PARTITION BY conv_id, pos, part, place, task ORDER BY tier DESC, letters DESC, strong DESC, firm DESC, kind DESC) = 1),
hit AS (SELECT conv_id, pos, part, place, token, task, kind, tier, strong, NOT firm AS yielding FROM one QUALIFY rank() OVER (PARTITION BY conv_id, pos, part, place ORDER BY tier DESC, letters DESC) = 1)"""
_TOGETHER = f"""{_values("ph", "task, k, phrase", PHRASES)}, {_values("sd", "task, k, side, word, gap", _SIDES)},
loose AS (SELECT token, word FROM form WHERE form AND length(word) >= 2 OR token = word UNION SELECT token, word FROM slp),
looser AS (SELECT * FROM loose UNION SELECT token, word FROM form WHERE starts_with(token, word) AND length(word) >= 5),
pw AS (SELECT task, k, len(string_split(phrase, ' ')) AS n, unnest(string_split(phrase, ' ')) AS word, unnest(range(len(string_split(phrase, ' ')))) AS i FROM ph),
runs AS (SELECT a.conv_id, a.pos, a.part, task, k, n, raw - i AS start, list_sort(list(DISTINCT place) FILTER (place IS NOT NULL)) AS places FROM ask a JOIN looser USING (token) JOIN pw USING (word) GROUP BY ALL HAVING count(DISTINCT i) = n),
phr AS (SELECT conv_id, pos, part, task, 4.0 + (n - 2) AS score, coalesce(places, []) AS places FROM runs QUALIFY row_number() OVER (PARTITION BY conv_id, pos, part, task ORDER BY n DESC, k, start) = 1),
spots AS (SELECT DISTINCT conv_id, pos, part, place, task, k, side, gap FROM ask JOIN loose USING (token) JOIN sd USING (word) WHERE place IS NOT NULL),
two AS (SELECT a.conv_id, a.pos, a.part, a.task, 4.0 AS score, [a.place, b.place] AS places FROM spots a JOIN spots b ON a.conv_id = b.conv_id AND a.pos = b.pos AND a.part = b.part AND a.task = b.task AND a.k = b.k AND a.side <> b.side AND b.place > a.place AND b.place <= a.place + a.gap + 1
  QUALIFY row_number() OVER (PARTITION BY a.conv_id, a.pos, a.part, a.task ORDER BY a.k, a.place, b.place) = 1),
grp AS (SELECT * FROM phr UNION ALL SELECT * FROM two t WHERE NOT EXISTS (SELECT 1 FROM phr p WHERE p.conv_id = t.conv_id AND p.pos = t.pos AND p.part = t.part AND p.task = t.task))"""
_TALLY = """val AS (SELECT *, (CASE kind WHEN 'exact' THEN 3.0 ELSE 2.0 END)::DOUBLE AS s, (CASE kind WHEN 'exact' THEN 1.0 WHEN 'part' THEN 0.75 ELSE 0.0 END)::DOUBLE AS w FROM hit),
rws AS (SELECT conv_id, pos, part, task, CASE WHEN yielding THEN 0 WHEN strong THEN s ELSE w END AS own, CASE WHEN yielding THEN s ELSE 0 END AS up, CASE WHEN yielding THEN w ELSE 0 END AS down, strong AND NOT yielding AS specific, false AS combined, 1 AS explained, [place] AS places FROM val
  UNION ALL SELECT conv_id, pos, part, task, score, 0, 0, true, true, 0, places FROM grp),
tal0 AS (SELECT conv_id, pos, part, task, sum(own) AS own, sum(up) AS up, sum(down) AS down, sum(explained)::INTEGER AS explained, bool_or(specific) AS specific, bool_or(combined) AS combined, len(list_distinct(flatten(list(places))))::INTEGER AS covered FROM rws GROUP BY ALL),
tal AS (SELECT *, up > 0 AS yields, (own + CASE WHEN sum(specific::INTEGER) OVER (PARTITION BY conv_id, pos, part) - specific::INTEGER > 0 THEN down ELSE up END)::DOUBLE AS score FROM tal0)"""
_ANSWER = f"""{_values("tasks", 'task, ord, generic, available', TASKS)},
sz AS (SELECT conv_id, pos, part, count(place)::INTEGER AS words FROM ask GROUP BY ALL),
ord0 AS (SELECT t.*, s.words, k.available, row_number() OVER (PARTITION BY conv_id, pos, part ORDER BY score DESC, generic, ord) AS n FROM tal t JOIN tasks k USING (task) JOIN sz s USING (conv_id, pos, part) WHERE score > 0),
tops AS (SELECT o.conv_id, o.pos, o.part, o.task, o.score, o.available, o.n, o.words, t.score AS best, t.available AS able, t.covered, coalesce(s.score, 0)::DOUBLE AS second, o.words - t.covered AS rest, NOT t.specific AND t.explained <= 1 AND NOT t.yields AND o.words >= 4 AS guess
  FROM ord0 o JOIN ord0 t ON o.conv_id = t.conv_id AND o.pos = t.pos AND o.part = t.part AND t.n = 1 LEFT JOIN ord0 s ON o.conv_id = s.conv_id AND o.pos = s.pos AND o.part = s.part AND s.n = 2),
conf AS (SELECT *, CASE WHEN NOT able OR (SELECT max(b.least <= best AND second / best < b.share) FROM (VALUES {", ".join(f"({i}, {j}, {a}, {b})" for i, row in enumerate(BARS) for j, (a, b) in enumerate(row))}) AS b(more, rest, least, share) WHERE b.more = (covered >= 2)::INTEGER AND b.rest = least(tops.rest, 2)) THEN 'sure' ELSE 'ask' END AS confidence FROM tops WHERE NOT guess),
kept AS (SELECT *, row_number() OVER (PARTITION BY conv_id, pos, part ORDER BY n)::INTEGER AS place FROM conf WHERE score >= best * CASE WHEN confidence = 'ask' AND available THEN 0.25 ELSE 0.4 END AND (able OR NOT available OR score >= best * 0.8))"""
_ALL = (TURNS, _ASKED, _FACES, _READ, _MATCH, _TOGETHER, _TALLY, _ANSWER)


@query("t5_word_forms", "SELECT DISTINCT token, word, rest, negative FROM form WHERE form OR negative", _ALL[:4])
def t5(spark: SparkSession, d: str) -> DataFrame:
    """Distinct tokens that are a word of the lists with an ending."""
    words, lists = requests(spark, d), small_tasks(spark)
    return readings(words, lists)[0].where("form OR negative").select("token", "word", "rest", "negative").distinct()


@query("t4_slips_with_endings", "SELECT token, word FROM slp", _ALL[:4])
def t4(spark: SparkSession, d: str) -> DataFrame:
    """Distinct tokens that are slips of words of the lists, with or without an ending."""
    words, lists = requests(spark, d), small_tasks(spark)
    return readings(words, lists)[1]


@query("t6_t7_word_matches", "SELECT conv_id, pos, part, place, token, task, kind, tier, strong, yielding FROM hit", _ALL[:5])
def t6(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d)[2]


@query("t8_t9_phrases_and_pairs", "SELECT conv_id, pos, part, task, score::DOUBLE AS score, array_to_string(list_sort(places), ',') AS places FROM grp", (*_ALL[:4], _TOGETHER))
def t8(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d)[3].withColumn("places", F.array_join(F.col("places").cast("array<string>"), ","))


@query("t10_task_scores", "SELECT conv_id, pos, part, task, score, specific, combined, yields, explained, covered FROM tal", _ALL[:7])
def t10(spark: SparkSession, d: str) -> DataFrame:
    _, _, matches, together = _all(spark, d)
    return tallies(matches, together, KEYS).withColumn("covered", F.size("covered"))


@query("t11_t12_answers", "SELECT conv_id, pos, part, task, score, place AS n, confidence, words, covered, rest AS left, second FROM kept WHERE place <= 3", _ALL)
def t11(spark: SparkSession, d: str) -> DataFrame:
    words, lists, matches, together = _all(spark, d)
    return answers(tallies(matches, together, KEYS), words, KEYS, lists.tasks)
