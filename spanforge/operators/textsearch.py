"""Folding, tokens, edit distance, captions, times and fingerprints."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import fnv1a
from ..registry import query
from ..sources.tables import POINTS, TURNS, points, table, turns

# Letters with marks and what they fold to, stop words.
MARKED, PLAIN = "áàâäãåçéèêëíìîïñóòôöõúùûüıßğş", "aaaaaaceeeeiiiinooooouuuuisgs"
STOP = ["the", "of", "and", "de", "la", "le", "der", "die"]


def fold(text: Column) -> Column:
    """Lower case without marks, anything but letters and digits as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), "[^a-z0-9]+", " "))


def tokens(rows: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, place, token: words of the folded text with their places, without stop words and single letters."""
    words = rows.select(*by, F.posexplode(F.split(fold(F.col(text)), " ")).alias("place", "token"))
    return words.where((F.length("token") > 1) & ~F.col("token").isin(STOP))


def aligned_distance(a: str, b: str, limit: int = 2) -> int:
    """Edits between words with a swap of neighbours as one, each place changed once; limit + 1 where it is more."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a):
        older, before, row = before, row, [i + 1]
        for j, y in enumerate(b):
            d = min(before[j + 1] + 1, row[j] + 1, before[j] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                d = min(d, older[j - 1] + 1)
            row.append(d)
    return min(row[-1], limit + 1)


@F.pandas_udf(T.IntegerType())
def distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else aligned_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(T.StringType())
def decomposed(text: pd.Series) -> pd.Series:
    """Lower case without any combining marks."""
    return text.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x.lower()) if not unicodedata.combining(c)))


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else html.unescape(x))


def caption_text(text: Column) -> Column:
    """Line feeds only, no other control characters, single spaces, trimmed lines, no empty ones."""
    clean = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[\x00-\x08\x0B-\x1F\x7F]", "")
    return F.array_join(F.filter(F.transform(F.split(clean, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " "))), lambda x: x != ""), "\n")


def timestamp(ms: Column, mark: str = ",") -> Column:
    """Milliseconds as hours, minutes, seconds and thousandths."""
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3_600_000).cast("long"), F.floor(ms / 60_000).cast("long") % 60, F.floor(ms / 1000).cast("long") % 60, ms % 1000)


def parsed_timestamp(text: Column) -> Column:
    """Milliseconds of a time like 01:02:03,004 or 02:03.004; null for anything else."""
    p = r"^(?:(\d{1,3}):)?(\d{2}):(\d{2})[,.](\d{3})$"
    part = lambda k: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, p, k), F.lit("")), F.lit("999")).cast("long"), F.lit(0).cast("long"))
    return F.when(text.rlike(p), ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4))


def subtitles(files: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, block, start_ms, end_ms, cue, problem of each block between empty lines: a time line first or second, then text
    of which markup goes. A block without times is bad_timing, one without text no_text."""
    blocks = files.select(*by, F.posexplode(F.split(F.regexp_replace(F.trim(F.regexp_replace(text, "\r\n?", "\n")), "^﻿", ""), "\n[ \t]*\n+")).alias("block", "b"))
    lines = blocks.withColumn("lines", F.split("b", "\n"))
    at = F.when(F.get("lines", F.lit(0)).contains("-->"), 0).when(F.get("lines", F.lit(1)).contains("-->"), 1)
    lines = lines.withColumn("at", at).withColumn("times", F.split(F.get("lines", F.col("at")), r"\s*-->\s*"))
    body = F.array_join(F.filter(F.transform(F.slice("lines", F.coalesce("at", F.lit(0)) + 2, F.greatest(F.size("lines"), F.lit(1))), lambda x: F.trim(F.regexp_replace(x, r"</?(?:[a-zA-Z][^<>]*|\d[\d:.]*)>", ""))), lambda x: x != ""), "\n")
    got = lines.select(*by, "block", parsed_timestamp(F.trim(F.get("times", F.lit(0)))).alias("start_ms"), parsed_timestamp(F.trim(F.regexp_extract(F.get("times", F.lit(1)), r"^\S+", 0))).alias("end_ms"), body.alias("cue"))
    bad = F.col("start_ms").isNull() | F.col("end_ms").isNull() | (F.col("end_ms") <= F.col("start_ms"))
    got = got.withColumn("problem", F.when(bad, "bad_timing").when(F.col("cue") == "", "no_text"))
    keep = F.col("problem").isNull()
    return got.select(*by, "block", F.when(keep, F.col("start_ms")).alias("start_ms"), F.when(keep, F.col("end_ms")).alias("end_ms"), F.when(keep, unescaped("cue")).alias("cue"), "problem")


_FOLD = f"trim(regexp_replace(translate(lower(text), '{MARKED}', '{PLAIN}'), '[^a-z0-9]+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in STOP)
_TOKENS = f"tok AS (SELECT conv_id, pos, (k - 1)::INTEGER AS place, w AS token FROM (SELECT conv_id, pos, unnest(string_split({_FOLD}, ' ')) AS w, unnest(range(1, len(string_split({_FOLD}, ' ')) + 1)) AS k FROM turns) WHERE length(w) > 1 AND w NOT IN ({_STOP}))"
KEYS = ["conv_id", "pos"]


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens(turns(spark, d), KEYS)


@query("t1_folded", f"SELECT conv_id, pos, {_FOLD} AS folded FROM turns", (TURNS,))
def t1(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("conv_id", "pos", fold(F.col("text")).alias("folded"))


@query("t2_tokens", "SELECT conv_id, pos, place, token FROM tok", (TURNS, _TOKENS))
def t2(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d)


@query("t3_aligned_distance")
def t3(spark: SparkSession, d: str) -> DataFrame:
    """Distances between each token and the next one of its turn."""
    after = F.lead("token").over(Window.partitionBy(*KEYS).orderBy("place"))
    return _tokens(spark, d).select(*KEYS, "place", "token", after.alias("other")).where("other is not null").withColumn("distance", distance("token", "other"))


@query("t13_accent_search", "SELECT conv_id, pos, coalesce(lead(pos) OVER (PARTITION BY conv_id ORDER BY pos), min(pos) OVER (PARTITION BY conv_id)) AS next FROM turns WHERE contains(strip_accents(lower(text)), 'etre')", (TURNS,))
def t13(spark: SparkSession, d: str) -> DataFrame:
    """Turns that hold `etre` whatever the marks, and the next such turn of the conversation, after the last the first."""
    t = turns(spark, d).where(decomposed("text").contains("etre")).select("conv_id", "pos")
    w = Window.partitionBy("conv_id")
    return t.withColumn("next", F.coalesce(F.lead("pos").over(w.orderBy("pos")), F.min("pos").over(w)))


@query("t14_caption_text", r"""SELECT conv_id, pos, t AS caption, CASE WHEN t = '' THEN 'empty' WHEN length(t) > 200 THEN 'too_long' WHEN len(string_split(t, chr(10))) > 2 THEN 'too_many_lines' END AS problem FROM (
SELECT conv_id, pos, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS t FROM turns)""", (TURNS,))
def t14(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d).select("conv_id", "pos", caption_text(F.col("text")).alias("caption"))
    problem = F.when(F.col("caption") == "", "empty").when(F.char_length("caption") > 200, "too_long").when(F.size(F.split("caption", "\n")) > 2, "too_many_lines")
    return t.withColumn("problem", problem)


def wrapped(text: Column, width: int) -> Column:
    """The words of a text in lines of at most `width` characters, a longer word on a line of its own."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    start = F.struct(F.expr("array()").cast("array<string>").alias("done"), F.lit("").alias("line"))

    def add(state: Column, w: Column) -> Column:
        line = state["line"]
        fits = (line != "") & (F.char_length(line) + 1 + F.char_length(w) <= width)
        done = F.when(fits | (line == ""), state["done"]).otherwise(F.array_append(state["done"], line))
        return F.struct(done.alias("done"), F.when(fits, F.concat_ws(" ", line, w)).otherwise(w).alias("line"))

    return F.aggregate(words, start, add, lambda s: F.when(s["line"] == "", s["done"]).otherwise(F.array_append(s["done"], s["line"])))


@query("t15_wrapped")
def t15(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("conv_id", "pos", wrapped(F.col("text"), 42).alias("lines"))


@query("t16_parsed_subtitles", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos)::INTEGER - 1 AS block, pos * 5000 AS start_ms, pos * 5000 + 4000 AS end_ms, role AS cue, CAST(NULL AS VARCHAR) AS problem FROM turns", (TURNS,))
def t16(spark: SparkSession, d: str) -> DataFrame:
    """The subtitles of t18, read back."""
    return subtitles(t18(spark, d), ["conv_id"], "srt")


@query("t17_timestamps", "SELECT event_id, printf('%02d:%02d:%02d,%03d', v * 977 // 3600000, v * 977 // 60000 % 60, v * 977 // 1000 % 60, v * 977 % 1000) AS stamp, v * 977 AS ms FROM pts", (POINTS,))
def t17(spark: SparkSession, d: str) -> DataFrame:
    """Times written and read back."""
    return points(spark, d).select("event_id", timestamp(F.col("v") * 977).alias("stamp")).withColumn("ms", parsed_timestamp(F.col("stamp")))


def serialised(cues: DataFrame, by: list[str], start: str, end: str, text: str) -> DataFrame:
    """by, srt: the cues of each group, numbered in order of their start."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(start))
    block = F.concat_ws("\n", nth.cast("string"), F.concat_ws(" --> ", timestamp(F.col(start)), timestamp(F.col(end))), F.col(text))
    got = cues.select(*by, nth.alias("n"), block.alias("b")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("n", "b"))).alias("bs"))
    return got.select(*by, F.concat(F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n"), F.lit("\n")).alias("srt"))


@query("t18_serialised_subtitles", """SELECT conv_id, string_agg(n || chr(10) || printf('%02d:%02d:%02d,%03d', s // 3600000, s // 60000 % 60, s // 1000 % 60, s % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', e // 3600000, e // 60000 % 60, e // 1000 % 60, e % 1000) || chr(10) || role, chr(10) || chr(10) ORDER BY n) || chr(10) AS srt
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS n, pos * 5000 AS s, pos * 5000 + 4000 AS e FROM turns) GROUP BY conv_id""", (TURNS,))
def t18(spark: SparkSession, d: str) -> DataFrame:
    c = turns(spark, d).select("conv_id", (F.col("pos") * 5000).alias("s"), (F.col("pos") * 5000 + 4000).alias("e"), "role")
    return serialised(c, ["conv_id"], "s", "e", "role")


@query("t19_timecodes", "SELECT event_id, printf('%d:%02d', v // 60, v % 60) AS code, v // 60 * 60 + v % 60 AS seconds FROM pts", (POINTS,))
def t19(spark: SparkSession, d: str) -> DataFrame:
    code = points(spark, d).select("event_id", F.format_string("%d:%02d", F.floor(F.col("v") / 60).cast("long"), F.col("v") % 60).alias("code"))
    p = F.split("code", ":")
    return code.withColumn("seconds", F.get(p, F.lit(0)).cast("long") * 60 + F.get(p, F.lit(1)).cast("long"))


@query("t20_file_names", r"SELECT page_id, coalesce(nullif(substr(trim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[^\p{L}\p{N}]+', '-', 'g'), '-'), 1, 40), ''), 'video') AS name FROM pages")
def t20(spark: SparkSession, d: str) -> DataFrame:
    clean = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[^\p{L}\p{N}]+", "-")
    return table(spark, d, "pages").select("page_id", F.coalesce(F.nullif(F.substring(F.trim(clean, F.lit("-")), 1, 40), F.lit("")), F.lit("video")).alias("name"))


@query("t21_fingerprints", """SELECT event_id, printf('%08x', list_reduce(list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT)) AS fingerprint FROM (SELECT event_id, user_id || '|' || us || '|' || kind AS s FROM pts)""", (POINTS,))
def t21(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return p.select("event_id", fnv1a(F.concat_ws("|", "user_id", "us", "kind")).alias("fingerprint"))


@query("t22_sha256", "SELECT conv_id, pos, sha256(text) AS digest FROM turns", (TURNS,))
def t22(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("conv_id", "pos", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("t23_identity", """SELECT a.user_id, a.event_id, b.event_id AS other, CASE WHEN a.v = b.v AND a.us = b.us THEN 'exact' WHEN a.kind = b.kind THEN 'likely' ELSE 'mismatch' END AS match
FROM pts a JOIN pts b ON a.user_id = b.user_id AND a.v % 100 = b.v % 100 AND a.event_id < b.event_id AND abs(a.us - b.us) <= 86400000000""", (POINTS,))
def t23(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that agree in a size and lie within a day: the same, likely the same by kind, or not."""
    a = points(spark, d).withColumn("size", F.col("v") % 100)
    b = a.select("user_id", "size", F.col("event_id").alias("other"), F.col("us").alias("us_b"), F.col("v").alias("v_b"), F.col("kind").alias("kind_b"))
    got = a.join(b, ["user_id", "size"]).where("event_id < other AND abs(us - us_b) <= 86400000000")
    return got.select("user_id", "event_id", "other", F.when(F.expr("v = v_b AND us = us_b"), "exact").when(F.expr("kind = kind_b"), "likely").otherwise("mismatch").alias("match"))


@query("t24_normalised_words", r"SELECT conv_id, pos, trim(regexp_replace(lower(nfc_normalize(text)), '[^\p{L}\p{N}'']+', ' ', 'g')) AS words FROM turns", (TURNS,))
def t24(spark: SparkSession, d: str) -> DataFrame:
    """Words for scoring: composed letters, lower case, no signs, single spaces."""

    @F.pandas_udf("string")
    def composed(text: pd.Series) -> pd.Series:
        return text.map(lambda x: unicodedata.normalize("NFC", x).lower())

    return turns(spark, d).select("conv_id", "pos", F.trim(F.regexp_replace(composed("text"), r"[^\p{L}\p{N}']+", " ")).alias("words"))


@query("t26_gains", "SELECT event_id, round(power(10, ((v % 6000) / 100.0 - 60) / 20), 9)::DOUBLE AS gain, round(least(1.0, 1 / greatest(0.000001, power(10, ((v % 6000) / 100.0 - 50) / 20))), 6)::DOUBLE AS safety FROM pts", (POINTS,))
def t26(spark: SparkSession, d: str) -> DataFrame:
    db = (F.col("v") % 6000) / 100.0 - 60
    return points(spark, d).select("event_id", F.round(F.pow(F.lit(10.0), db / 20), 9).alias("gain"), F.round(F.least(F.lit(1.0), 1 / F.greatest(F.lit(0.000001), F.pow(F.lit(10.0), (db + 10) / 20))), 6).alias("safety"))


@query("t27_shifts", r"""SELECT event_id, s AS typed, CASE WHEN regexp_full_match(s, '[-+]?[0-9]+([,.][0-9]{1,3})?') AND abs(CAST(replace(s, ',', '.') AS DOUBLE)) <= 86400 THEN CAST(round(CAST(replace(s, ',', '.') AS DOUBLE) * 1000) AS BIGINT) END AS ms
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '-' || v // 100 || ',' || v % 100 WHEN 1 THEN CAST(v AS VARCHAR) WHEN 2 THEN v || ',5555' ELSE v * 100 || '.5' END AS s FROM pts)""", (POINTS,))
def t27(spark: SparkSession, d: str) -> DataFrame:
    """Typed shifts in seconds, with comma or point and at most three decimals, up to a day."""
    v, k = F.col("v"), F.col("event_id") % 4
    s = F.when(k == 0, F.concat(F.lit("-"), F.floor(v / 100).cast("string"), F.lit(","), (v % 100).cast("string"))).when(k == 1, v.cast("string")).when(k == 2, F.concat(v.cast("string"), F.lit(",5555"))).otherwise(F.concat((v * 100).cast("string"), F.lit(".5")))
    n = F.regexp_replace("typed", ",", ".").try_cast("double")
    return points(spark, d).select("event_id", s.alias("typed")).withColumn("ms", F.when(F.col("typed").rlike(r"^[-+]?[0-9]+([,.][0-9]{1,3})?$") & (F.abs(n) <= 86400), F.round(n * 1000).cast("long")))


@query("t28_device_class", "SELECT page_id, regexp_matches(html, 'Mobile|Android|iPhone') AS handheld, CASE WHEN page_id % 2 = 0 THEN 'client-hints' ELSE 'user-agent' END AS source FROM pages")
def t28(spark: SparkSession, d: str) -> DataFrame:
    """Hints first, which every second page has; then a pattern over the text."""
    return table(spark, d, "pages").select("page_id", F.col("html").rlike("Mobile|Android|iPhone").alias("handheld"), F.when(F.col("page_id") % 2 == 0, "client-hints").otherwise("user-agent").alias("source"))
