"""Versioned JSON documents: validation to issue rows, migration, sanitising, retention, key-value state."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import POINTS, TURNS, points, table, turns

VERSION = 6


def issues(rows: DataFrame, by: list[str], rules: list[tuple[str, str, Column]]) -> DataFrame:
    """by, code, path: a row for each rule (code, path, condition that is wrong) that a document breaks; null breaks none."""
    found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(path).alias("path"))) for code, path, bad in rules]))
    return rows.select(*by, F.explode(found).alias("i")).select(*by, "i.code", "i.path")


# Fixed values of the limits of a recipe: videos, clips, the shortest clip, gains in decibels, the longest timeline and
# source, caption tracks and lines, and the shortest line.
VIDEOS, CLIPS, CLIP_US, GAIN_DB, TIMELINE_US, SOURCE_US = 5, 20, 100_000, (-60.0, 12.0), 3_600_000_000, 3_600_000_000
TRACKS, LINES, LINE_US, LINE_CHARS = 8, 2000, 100_000, 500
# What a field may be, the greatest safe integer, places of speakers and marked stretches of a track.
SHAPES, COLOR, FITS = ["9:16", "16:9", "1:1"], "^#[0-9a-fA-F]{6}$", ["cover", "contain"]
ORIGINS, BASES, LANGUAGE = ["manual", "imported", "transcript"], ["output", "source"], "^[a-z]{2,3}(-[A-Z]{2})?$"
STYLE = {"preset": ["box", "outline"], "position": ["bottom", "middle", "top"], "size": ["small", "medium", "large"]}
EXPORT, EXPORT_WHOLE = {"container": ["mp4"], "videoCodec": ["h264"], "audioCodec": ["aac"], "colorMode": ["sdr_rec709"]}, ["shortEdge", "fpsNum", "fpsDen", "audioSampleRate"]
STRENGTHS, LOUDNESS, SAFE, SPEAKERS = ["light", "auto", "strong"], [-16.0], 9007199254740991, 20
FIELDS = ["schemaVersion", "projectId", "revision", "assets", "canvas", "clips", "music", "export", "captionTracks", "enhance", "soundFix"]
NEEDED = ["projectId", "revision", "assets", "clips", "captionTracks"]
ID = "^[A-Za-z0-9_-]{1,64}$"
RECIPE = """schemaVersion int, projectId string, revision bigint, assets array<struct<assetId:string,kind:string,durationUs:bigint,displayWidth:int,displayHeight:int>>,
clips array<struct<clipId:string,assetId:string,sourceInUs:bigint,sourceOutUs:bigint,sourceGainDb:double,view:struct<x:double,y:double,width:double,height:double,fit:string>>>,
music struct<assetId:string,sourceInUs:bigint,sourceOutUs:bigint,timelineStartUs:bigint,gainDb:double,fadeInUs:bigint,fadeOutUs:bigint>,
canvas struct<aspect:string,background:string>, enhance struct<strength:string>, soundFix struct<targetLufs:double>,
export struct<container:string,videoCodec:string,audioCodec:string,colorMode:string,shortEdge:double,fpsNum:double,fpsDen:double,audioSampleRate:double>,
captionTracks array<struct<trackId:string,origin:string,timeBase:string,assetId:string,language:string,style:struct<preset:string,position:string,size:string>,unclear:array<struct<startUs:bigint,endUs:bigint>>,cues array<struct<cueId:string,startUs:bigint,endUs:bigint,text:string,speaker:string>>>>""".replace("cues array", "cues:array")


def _each(items: Column, path: str, rules: Callable[[Column], list[tuple[str, Column]]]) -> Column:
    """(code, path with the item's number) of each rule that an item breaks."""
    def one(x: Column, i: Column) -> Column:
        at = F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]"))
        return F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(code).alias("code"), at.alias("path"))) for code, bad in rules(x)]))

    return F.flatten(F.transform(items, one))


def _repeats(ids: Column) -> Column:
    return F.size(F.array_distinct(ids)) < F.size(ids)


def recipe_issues(json: Column, r: Column) -> Column:
    """All that is wrong with a recipe (its text, and parsed by RECIPE) as an array of (code, path). A rule that needs what
    isn't there says nothing; what has to be there is missing_field. After another version nothing else is looked at."""
    keys = F.json_object_keys(json)
    assets, clips, tracks = (F.coalesce(r[n], F.expr("array()")) for n in ("assets", "clips", "captionTracks"))
    kinds = F.map_from_entries(F.transform(F.array_distinct(F.transform(F.filter(assets, lambda a: a["assetId"].isNotNull()), lambda a: a["assetId"])), lambda i: F.struct(i, F.get(F.filter(assets, lambda a: a["assetId"] == i), F.lit(0)))))
    wrong_id = lambda i: ~F.coalesce(F.rlike(i, F.lit(ID)), F.lit(False))
    span = lambda x: x["sourceOutUs"] - x["sourceInUs"]
    of = lambda x: F.try_element_at(kinds, x["assetId"])
    length = F.aggregate(clips, F.lit(0).cast("bigint"), lambda t, c: t + F.greatest(F.lit(0), F.coalesce(span(c), F.lit(0))))
    sources = F.aggregate(F.filter(assets, lambda a: a["kind"] == "video"), F.lit(0).cast("bigint"), lambda t, a: t + F.coalesce(a["durationUs"], F.lit(0)))
    cues = F.flatten(F.transform(tracks, lambda t: F.coalesce(t["cues"], F.expr("array()"))))
    m = r["music"]
    wrong = lambda x, allowed: ~F.coalesce(x.isin(allowed), F.lit(False))
    unsafe = lambda x, *names: reduce(lambda a, b: a | b, (~F.coalesce(x[n].between(0, SAFE), F.lit(False)) for n in names))
    there = lambda x, rule: x.isNotNull() & rule
    whole = [
        ("revision_invalid", "revision", r["revision"] < 0),
        ("id_invalid", "projectId", r["projectId"].isNotNull() & wrong_id(r["projectId"])),
        ("asset_id_duplicate", "assets", _repeats(F.transform(assets, lambda a: a["assetId"]))),
        ("video_asset_limit_exceeded", "assets", F.size(F.filter(assets, lambda a: a["kind"] == "video")) > VIDEOS),
        ("source_duration_exceeds_policy", "assets", sources > SOURCE_US),
        ("clips_empty", "clips", r["clips"].isNotNull() & (F.size(clips) == 0)),
        ("clip_limit_exceeded", "clips", F.size(clips) > CLIPS),
        ("id_duplicate", "clips", _repeats(F.transform(clips, lambda c: c["clipId"]))),
        ("timeline_duration_exceeds_policy", "clips", length > TIMELINE_US),
        ("caption_track_limit_exceeded", "captionTracks", F.size(tracks) > TRACKS),
        ("caption_cue_limit_exceeded", "captionTracks", F.size(cues) > LINES),
        ("caption_id_duplicate", "captionTracks", _repeats(F.transform(cues, lambda c: c["cueId"]))),
        ("music_null", "music", F.array_contains(keys, "music") & F.get_json_object(json, "$.music").isNull()),
        ("asset_unknown", "music", m["assetId"].isNotNull() & of(m).isNull()),
        ("asset_kind_mismatch", "music", of(m)["kind"] != "audio"),
        ("range_reversed", "music", span(m) <= 0),
        ("range_out_of_source", "music", m["sourceOutUs"] > of(m)["durationUs"]),
        ("gain_out_of_range", "music", ~m["gainDb"].between(*GAIN_DB)),
        ("fade_negative", "music", F.least(m["fadeInUs"], m["fadeOutUs"]) < 0),
        ("fade_exceeds_selection", "music", F.greatest(m["fadeInUs"], m["fadeOutUs"]) > span(m)),
        ("music_start_after_output", "music", m["timelineStartUs"] >= length),
        ("time_not_safe_integer", "music", there(m, unsafe(m, "sourceInUs", "sourceOutUs", "timelineStartUs"))),
        ("aspect_invalid", "canvas.aspect", there(r["canvas"], wrong(r["canvas"]["aspect"], SHAPES))),
        ("color_invalid", "canvas.background", there(r["canvas"], ~F.coalesce(F.rlike(r["canvas"]["background"], F.lit(COLOR)), F.lit(False)))),
        *(("export_spec_invalid", f"export.{k}", there(r["export"], wrong(r["export"][k], allowed))) for k, allowed in EXPORT.items()),
        *(("export_spec_invalid", f"export.{k}", there(r["export"], ~F.coalesce((r["export"][k] > 0) & (r["export"][k] == F.floor(r["export"][k])), F.lit(False)))) for k in EXPORT_WHOLE),
        ("enhance_invalid", "enhance.strength", there(r["enhance"], wrong(r["enhance"]["strength"], STRENGTHS))),
        ("sound_fix_invalid", "soundFix.targetLufs", there(r["soundFix"], wrong(r["soundFix"]["targetLufs"], LOUDNESS))),
    ]
    found = [
        F.transform(F.array_except(keys, F.array(*map(F.lit, FIELDS))), lambda k: F.struct(F.lit("unknown_field").alias("code"), k.alias("path"))),
        F.transform(F.array_except(F.array(*map(F.lit, NEEDED)), keys), lambda k: F.struct(F.lit("missing_field").alias("code"), k.alias("path"))),
        F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(path).alias("path"))) for code, path, bad in whole])),
        _each(assets, "assets", lambda a: [("id_invalid", wrong_id(a["assetId"])), ("asset_kind_invalid", ~F.coalesce(a["kind"].isin("video", "audio"), F.lit(False))), ("asset_duration_invalid", F.coalesce(a["durationUs"] <= 0, F.lit(True))), ("asset_dimension_invalid", F.least(a["displayWidth"], a["displayHeight"]) <= 0)]),
        _each(clips, "clips", lambda c: [("id_invalid", wrong_id(c["clipId"])), ("asset_unknown", of(c).isNull()), ("asset_kind_mismatch", of(c)["kind"] != "video"), ("time_not_safe_integer", unsafe(c, "sourceInUs", "sourceOutUs")), ("range_reversed", ~unsafe(c, "sourceInUs", "sourceOutUs") & (span(c) <= 0)), ("fit_invalid", there(c["view"], wrong(c["view"]["fit"], FITS))), ("clip_too_short", span(c).between(1, CLIP_US - 1)), ("range_out_of_source", c["sourceOutUs"] > of(c)["durationUs"]), ("gain_out_of_range", ~c["sourceGainDb"].between(*GAIN_DB)), ("view_size_invalid", F.least(c["view"]["width"], c["view"]["height"]) <= 0), ("view_out_of_bounds", (F.least(c["view"]["x"], c["view"]["y"]) < 0) | (c["view"]["x"] + c["view"]["width"] > 1) | (c["view"]["y"] + c["view"]["height"] > 1))]),
        _each(cues, "cues", lambda c: [("id_invalid", wrong_id(c["cueId"])), ("time_not_safe_integer", unsafe(c, "startUs", "endUs")), ("caption_cue_too_short", ~unsafe(c, "startUs", "endUs") & (c["endUs"] - c["startUs"] < LINE_US)), ("caption_text_invalid", F.coalesce((F.trim(c["text"]) == "") | (F.char_length(c["text"]) > LINE_CHARS), F.lit(True)))]),
        _each(tracks, "captionTracks", lambda t: [
            ("caption_track_invalid", wrong(t["origin"], ORIGINS) | wrong(t["timeBase"], BASES) | ~F.coalesce(F.rlike(t["language"], F.lit(LANGUAGE)), F.lit(False)) | (t["assetId"].isNotNull() & ~F.coalesce(t["timeBase"] == "source", F.lit(False)))
             | (t["unclear"].isNotNull() & ~F.coalesce((t["origin"] == "transcript") & (t["timeBase"] == "source"), F.lit(False))) | (~F.coalesce(t["origin"] == "transcript", F.lit(False)) & F.exists(F.coalesce(t["cues"], F.expr("array()")), lambda c: c["speaker"].isNotNull()))),
            ("caption_style_invalid", t["style"].isNull() | reduce(lambda a, b: a | b, (wrong(t["style"][k], v) for k, v in STYLE.items()))),
            ("caption_speaker_invalid", (t["origin"] == "transcript") & F.exists(F.coalesce(t["cues"], F.expr("array()")), lambda c: c["speaker"].isNotNull() & ~F.coalesce(F.try_to_number(F.when(F.rlike(c["speaker"], F.lit("^[0-9]{1,4}$")), c["speaker"]), F.lit("9999")).between(1, SPEAKERS), F.lit(False)))),
            ("asset_unknown", (t["timeBase"] == "source") & of(t).isNull()), ("asset_kind_mismatch", (t["timeBase"] == "source") & (of(t)["kind"] != "video")),
            ("time_not_safe_integer", F.exists(F.coalesce(t["unclear"], F.expr("array()")), lambda u: unsafe(u, "startUs", "endUs"))), ("range_reversed", F.exists(F.coalesce(t["unclear"], F.expr("array()")), lambda u: ~unsafe(u, "startUs", "endUs") & (u["endUs"] <= u["startUs"]))),
            ("range_out_of_source", F.exists(F.coalesce(t["unclear"], F.expr("array()")), lambda u: u["endUs"] > of(t)["durationUs"])),
        ]),
        F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(tracks) - 1)), lambda k: F.exists(F.coalesce(F.get(tracks, k)["cues"], F.expr("array()")), lambda c: F.exists(F.get(tracks, k)["cues"], lambda o: (o["cueId"] != c["cueId"]) & (o["startUs"] < c["endUs"]) & (c["startUs"] < o["endUs"])))), lambda k: F.struct(F.lit("caption_cue_overlap").alias("code"), F.concat(F.lit("captionTracks["), k.cast("string"), F.lit("]")).alias("path"))),
    ]
    alone = F.array(F.struct(F.lit("schema_version_unsupported").alias("code"), F.lit("schemaVersion").alias("path")))
    return F.when(F.coalesce(r["schemaVersion"] != VERSION, F.lit(True)), alone).otherwise(F.concat(*found))


def validated(docs: DataFrame, key: str = "id") -> DataFrame:
    """key, code, path of the recipes (key, json); text that isn't an object is not_an_object."""
    parsed = docs.withColumn("r", F.from_json("json", RECIPE)).withColumn("ok", F.json_object_keys("json").isNotNull())
    bad = parsed.where("NOT coalesce(ok, false)").select(key, F.lit("not_an_object").alias("code"), F.lit("").alias("path"))
    return bad.unionByName(parsed.where("ok").select(key, F.explode(recipe_issues(F.col("json"), F.col("r"))).alias("i")).select(key, "i.code", "i.path"))


def migrated(docs: DataFrame) -> DataFrame:
    """Recipes of versions 1 to 5 as version 6; only fields of the document itself are touched, so a number of that name
    further inside or in a text stays. Version 1 gets an empty list of caption tracks.

    A recipe with a field that its version never had is left as it is: soundFix before 6, a line's speaker before 5,
    enhance before 4, captionTracks in 1. So is whatever isn't an object with such a version. Fields come out sorted."""
    fields = F.expr("try_cast(try_parse_json(json) AS map<string, variant>)")
    has = lambda name: F.array_contains(F.map_keys("_f"), name)
    v = F.expr("try_variant_get(try_parse_json(json), '$.schemaVersion', 'int')")
    spoken = F.get_json_object("json", "$.captionTracks[*].cues[*].speaker").isNotNull()
    odd = has("soundFix") | ((F.col("_v") < 5) & spoken) | ((F.col("_v") < 4) & has("enhance")) | ((F.col("_v") == 1) & has("captionTracks"))
    rest = F.map_filter("_f", lambda k, _: k != "schemaVersion")
    number, none = F.parse_json(F.lit(str(VERSION))), F.parse_json(F.lit("[]"))
    with_number = F.map_concat(rest, F.create_map(F.lit("schemaVersion"), number))
    up = F.when(F.col("_v") == 1, F.map_concat(with_number, F.create_map(F.lit("captionTracks"), none))).otherwise(with_number)
    sorted_ = F.map_from_entries(F.transform(F.array_sort(F.map_keys(up)), lambda k: F.struct(k, F.element_at(up, k))))
    x = docs.withColumn("_f", fields).withColumn("_v", v)
    return x.withColumn("json", F.when(F.col("_v").between(1, VERSION - 1) & ~odd, F.to_json(sorted_)).otherwise(F.col("json"))).drop("_f", "_v")


def newest(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each group."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def _props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("kind"), F.from_json("props", "k long")["k"].alias("k"))


_PROPS = "props AS (SELECT event_id, user_id, event_type AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"


@query("v2_references", """SELECT l_orderkey AS key, 'orphan' AS code, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'P') GROUP BY 1
UNION ALL SELECT l_orderkey, 'repeated', count(*) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def v2(spark: SparkSession, d: str) -> DataFrame:
    """Lines without an order that counts, and line numbers that repeat."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber")
    orders = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("key"))
    orphan = lines.join(orders, "key", "left_anti").groupBy("key").agg(F.count("*").alias("n")).select("key", F.lit("orphan").alias("code"), "n")
    twice = lines.groupBy("key", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit("repeated").alias("code"), "n")
    return orphan.unionByName(twice)


@query("v3_overlapping_cues", "SELECT user_id, event_id FROM (SELECT *, lag(us + v * 10000000) OVER (PARTITION BY user_id ORDER BY us, event_id) AS before FROM pts WHERE kind = 'view') WHERE us < before", (POINTS,))
def v3(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag(F.col("us") + F.col("v") * 10_000_000).over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    return points(spark, d).where("kind = 'view'").withColumn("before", before).where("us < before").select("user_id", "event_id")


@query("v4_limits", "SELECT conv_id, count(*) > 6 AS too_many, sum(dur) > 3000 AS too_long FROM turns GROUP BY conv_id HAVING count(*) > 6 OR sum(dur) > 3000", (TURNS,))
def v4(spark: SparkSession, d: str) -> DataFrame:
    g = turns(spark, d).groupBy("conv_id").agg((F.count("*") > 6).alias("too_many"), (F.sum("dur") > 3000).alias("too_long"))
    return g.where("too_many OR too_long")


@query("v1_recipe_issues", """SELECT order_id, unnest(list_filter([CASE WHEN reversed THEN {'code': 'range_reversed', 'path': 'clips[0]'} END, CASE WHEN short THEN {'code': 'clip_too_short', 'path': 'clips[0]'} END, CASE WHEN beyond THEN {'code': 'range_out_of_source', 'path': 'clips[0]'} END,
  CASE WHEN unknown THEN {'code': 'asset_unknown', 'path': 'clips[0]'} END, CASE WHEN negative THEN {'code': 'revision_invalid', 'path': 'revision'} END, CASE WHEN long THEN {'code': 'timeline_duration_exceeds_policy', 'path': 'clips'} END], lambda x: x IS NOT NULL), recursive := true)
FROM (SELECT o_orderkey AS order_id, o_orderkey % 11 = 0 AS reversed, o_orderkey % 11 <> 0 AND o_totalprice < 1000 AS short, o_orderkey % 11 <> 0 AND o_orderkey % 6 <> 0 AND floor(o_totalprice) * 100 > 20000000 AS beyond, o_orderkey % 6 = 0 AS unknown, o_custkey % 9 = 0 AS negative, o_orderkey % 11 <> 0 AND floor(o_totalprice) * 100 > 3600000000 AS long FROM orders)""")
def v1_recipes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as recipes of one clip of one video, a hundred microseconds for each unit of their price."""
    o = table(spark, d, "orders")
    stop = F.when(F.col("o_orderkey") % 11 == 0, 0).otherwise(F.floor("o_totalprice") * 100)
    asset = F.when(F.col("o_orderkey") % 6 == 0, "other").otherwise("video1")
    revision = F.when(F.col("o_custkey") % 9 == 0, -1).otherwise(F.col("o_custkey"))
    text = F.format_string('{"schemaVersion":6,"projectId":"p%d","revision":%d,"assets":[{"assetId":"video1","kind":"video","durationUs":20000000}],"clips":[{"clipId":"c1","assetId":"%s","sourceInUs":0,"sourceOutUs":%d}],"captionTracks":[]}', F.col("o_orderkey"), revision.cast("long"), asset, stop.cast("long"))
    return validated(o.select(F.col("o_orderkey").alias("order_id"), text.alias("json")), "order_id")


@query("v5_migration", """SELECT event_id, CASE WHEN k % 8 BETWEEN 1 AND 5 AND NOT (k % 8 < 4 AND k % 3 = 0) THEN '{' || CASE WHEN k % 8 = 1 THEN '"captionTracks":[],' ELSE '' END || CASE WHEN k % 3 = 0 THEN '"enhance":{"schemaVersion":1},' ELSE '' END || '"note":"\\"schemaVersion\\":2","revision":' || k || ',"schemaVersion":6}'
ELSE '{"schemaVersion":' || k % 8 || CASE WHEN k % 3 = 0 THEN ',"enhance":{"schemaVersion":1}' ELSE '' END || ',"revision":' || k || ',"note":"\\"schemaVersion\\":2"}' END AS json FROM props""", (_PROPS,))
def v5(spark: SparkSession, d: str) -> DataFrame:
    """Recipes of eight versions, some with a field of a later one, and with the version's name inside."""
    k = F.col("k")
    odd = F.when(k % 3 == 0, ',"enhance":{"schemaVersion":1}').otherwise("")
    doc = F.concat(F.lit('{"schemaVersion":'), (k % 8).cast("string"), odd, F.lit(',"revision":'), k.cast("string"), F.lit(',"note":"\\"schemaVersion\\":2"}'))
    return migrated(_props(spark, d).select("event_id", doc.alias("json")))


@query("v6_sanitised", "SELECT event_id, CASE WHEN k BETWEEN 10 AND 80 THEN k END AS k, CASE WHEN regexp_full_match(kind, '[a-u]+') THEN kind END AS kind FROM props WHERE k % 11 <> 0", (_PROPS,))
def v6(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return _props(spark, d).where(k % 11 != 0).select("event_id", F.when(k.between(10, 80), k).alias("k"), F.when(F.col("kind").rlike("^[a-u]+$"), F.col("kind")).alias("kind"))


@query("v7_newest", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS n FROM pts) WHERE n <= 20", (POINTS,))
def v7(spark: SparkSession, d: str) -> DataFrame:
    return newest(points(spark, d), ["user_id"], ["us", "event_id"], 20).select("user_id", "event_id")


@query("v8_last_version", "SELECT user_id, kind, value FROM (SELECT user_id, kind, max_by(v, (us, event_id)) AS value FROM pts GROUP BY ALL) WHERE value % 10 <> 0", (POINTS,))
def v8(spark: SparkSession, d: str) -> DataFrame:
    """The last value of each key; one divisible by ten stands for a deletion."""
    return points(spark, d).groupBy("user_id", "kind").agg(F.max_by("v", F.struct("us", "event_id")).alias("value")).where(F.col("value") % 10 != 0)


@query("v10_missing_bindings", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def v10(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@query("v11_table_sums", "SELECT o_orderkey, CASE WHEN n IS NULL THEN 'unknown' WHEN n = o_orderkey % 7 + 1 THEN 'sane' ELSE 'broken' END AS verdict FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def v11(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = table(spark, d, "orders").select("o_orderkey").join(n, "o_orderkey", "left")
    return o.select("o_orderkey", F.when(F.col("n").isNull(), "unknown").when(F.col("n") == F.col("o_orderkey") % 7 + 1, "sane").otherwise("broken").alias("verdict"))


@query("v12_next_ids", "SELECT user_id, 'clip' || (max(event_id) + 1) AS next FROM pts GROUP BY user_id", (POINTS,))
def v12(spark: SparkSession, d: str) -> DataFrame:
    """The number after the greatest one in ids like clip12."""
    ids = points(spark, d).select("user_id", F.concat(F.lit("clip"), "event_id").alias("id"))
    return ids.groupBy("user_id").agg(F.concat(F.lit("clip"), (F.max(F.regexp_extract("id", "([0-9]+)$", 1).cast("long")) + 1).cast("string")).alias("next"))


@query("v15_missing_bytes", "SELECT s_suppkey, sum(bytes)::BIGINT AS missing FROM (SELECT s_suppkey, p_partkey, p_size * 100 AS bytes FROM supplier JOIN part ON p_partkey % 100 = s_suppkey) m WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = m.s_suppkey AND l.l_partkey = m.p_partkey) GROUP BY 1")
def v15(spark: SparkSession, d: str) -> DataFrame:
    """Manifest rows of each supplier that no line has, and their bytes."""
    parts = table(spark, d, "part").select((F.col("p_partkey") % 100).alias("s_suppkey"), "p_partkey", (F.col("p_size") * 100).cast("long").alias("bytes"))
    manifest = table(spark, d, "supplier").select("s_suppkey").join(parts, "s_suppkey")
    held = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey"))
    return manifest.join(held, ["s_suppkey", "p_partkey"], "left_anti").groupBy("s_suppkey").agg(F.sum("bytes").alias("missing"))


@query("v16_integrity", "SELECT doc_id, CASE WHEN length(text) <> n_chars THEN 'size' WHEN sha256(text) < '8' THEN 'hash' ELSE 'ok' END AS reason FROM documents")
def v16(spark: SparkSession, d: str) -> DataFrame:
    """Size first, then the hash: here hashes that begin below 8 count as wrong."""
    return table(spark, d, "documents").select("doc_id", F.when(F.char_length("text") != F.col("n_chars"), "size").when(F.sha2(F.col("text").cast("binary"), 256) < "8", "hash").otherwise("ok").alias("reason"))


@query("v17_block_numbers", """SELECT g.conv_id, g.pos, f.n::INTEGER AS block FROM (SELECT conv_id, pos, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS k FROM turns WHERE role <> 'system') g
JOIN (SELECT conv_id, n, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS k FROM (SELECT conv_id, unnest(range(1, c + 1)) AS n FROM (SELECT conv_id, count(*) AS c FROM turns GROUP BY 1)) s WHERE NOT EXISTS (SELECT 1 FROM turns b WHERE b.conv_id = s.conv_id AND b.role = 'system' AND b.pos + 1 = s.n)) f ON f.conv_id = g.conv_id AND f.k = g.k""", (TURNS,))
def v17(spark: SparkSession, d: str) -> DataFrame:
    """Good rows get the block numbers, from 1, that bad rows (of the system, at pos + 1) didn't take."""
    t = turns(spark, d)
    free = t.groupBy("conv_id").agg(F.count("*").cast("int").alias("c")).select("conv_id", F.explode(F.sequence(F.lit(1), "c")).alias("block"))
    taken = t.where("role = 'system'").select("conv_id", (F.col("pos") + 1).cast("int").alias("block"))
    free = free.join(taken, ["conv_id", "block"], "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("block")))
    good = t.where("role <> 'system'").select("conv_id", "pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("pos")).alias("k"))
    return good.join(free, ["conv_id", "k"]).select("conv_id", "pos", "block")


@query("v18_whole_source", "SELECT conv_id, bool_and(pos = coalesce(before + 1, 0)) AS whole FROM (SELECT conv_id, pos, lag(pos) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM turns) GROUP BY conv_id", (TURNS,))
def v18(spark: SparkSession, d: str) -> DataFrame:
    """Whether the positions of a conversation begin at 0 and leave no gap."""
    before = F.lag("pos").over(Window.partitionBy("conv_id").orderBy("pos"))
    return turns(spark, d).withColumn("fits", F.col("pos") == F.coalesce(before + 1, F.lit(0))).groupBy("conv_id").agg(F.bool_and("fits").alias("whole"))


@query("v19_shape", "SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, sum(dur)::BIGINT AS chars FROM turns GROUP BY conv_id", (TURNS,))
def v19(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_distinct("role").alias("roles"), F.sum("dur").alias("chars"))


@query("v20_completeness", "SELECT user_id, max(us) AS declared_us, min(us) FILTER (kind = 'error') AS readable_us, CASE WHEN min(us) FILTER (kind = 'error') IS NULL THEN 'complete' WHEN max(us) - min(us) FILTER (kind = 'error') <= 86400000000 THEN 'nearly' ELSE 'cut_off' END AS verdict FROM pts GROUP BY user_id", (POINTS,))
def v20(spark: SparkSession, d: str) -> DataFrame:
    g = points(spark, d).groupBy("user_id").agg(F.max("us").alias("declared_us"), F.min(F.when(F.col("kind") == "error", F.col("us"))).alias("readable_us"))
    verdict = F.when(F.col("readable_us").isNull(), "complete").when(F.col("declared_us") - F.col("readable_us") <= 86_400_000_000, "nearly").otherwise("cut_off")
    return g.withColumn("verdict", verdict)
