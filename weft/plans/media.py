"""Media queries: events stand for observations of media, parts and pages for their descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions import text as tx
from weft.operators import media, timeline
from weft.plans.catalog import query, table
from weft.plans.timeline import EVENTS_SQL, events, scenes

# Made-up review marks of order lines, in words that Spark and DuckDB both understand.
REVIEW = [
    "CASE WHEN l_linenumber % 2 = 0 THEN 'approved' END AS license_review_status",
    "CASE WHEN l_quantity > 20 THEN 'approved' ELSE 'open' END AS content_review_status",
    "'approved' AS adjudication_status",
    "CASE WHEN l_returnflag = 'A' THEN 'ai_single_reviewer_v1' END AS review_protocol",
    "CASE WHEN l_partkey % 3 <> 0 THEN 'R1' ELSE 'R2' END AS reviewer_id",
    "'completed' AS review_status",
    "CASE WHEN l_linestatus = 'O' THEN 'verified' END AS license_evidence_status",
    "CASE WHEN l_suppkey % 5 <> 0 THEN 'accept' ELSE 'reject' END AS final_decision",
]


@query(
    "review_gate",
    f"""
  SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT l_orderkey, l_linenumber, l_partkey, {", ".join(REVIEW)} FROM lineitem)
  WHERE final_decision = 'accept' AND ((license_review_status = 'approved' AND content_review_status = 'approved' AND adjudication_status = 'approved')
    OR (review_protocol = 'ai_single_reviewer_v1' AND reviewer_id = 'R1' AND review_status = 'completed' AND license_evidence_status = 'verified'))
""",
)
def review_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", *REVIEW)
    return media.accepted(rows).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "media_limits",
    "SELECT p_partkey, CASE WHEN p_size - 3 <= 0 OR p_size - 3 > 40 THEN 'duration' WHEN p_size * 100 * CAST(p_retailprice AS BIGINT) > 3000000 THEN 'resolution' END AS problem FROM part",
)
def media_limits(spark: SparkSession, d: str) -> DataFrame:
    problem = media.media_problem(F.col("p_size") - 3, F.col("p_size") * 100, F.rint("p_retailprice").cast("long"), 40.0, 3_000_000)
    return table(spark, d, "part").select("p_partkey", problem.alias("problem"))


LINES_SQL = """
  o AS (SELECT user_id, list(event_type || ' ' ORDER BY event_id) AS texts, list(abs(value) / 100 ORDER BY event_id)[1:5] AS scores, list([[value, 1], [2, abs(value)]] ORDER BY event_id)[1:7] AS polys FROM events GROUP BY user_id),
  l AS (SELECT user_id, unnest(range(len(texts))) AS line, texts, scores, polys FROM o)
"""


@query(
    "recognised_lines",
    f"""WITH {LINES_SQL} SELECT user_id, CAST(line AS INTEGER) AS line, trim(texts[line + 1]) AS text, round(coalesce(scores[line + 1], 0), 6) AS score, CAST(coalesce(len(polys[line + 1]), 0) AS INTEGER) AS points FROM l WHERE trim(texts[line + 1]) <> '' AND coalesce(scores[line + 1], 0) >= 0.02""",
)
def recognised_lines(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as one recognition result: all texts, five scores, seven polygons."""
    listed = F.array_sort(F.collect_list(F.struct("event_id", F.concat("event_type", F.lit(" ")).alias("t"), (F.abs("value") / 100).alias("s"), F.array(F.array("value", F.lit(1.0)), F.array(F.lit(2.0), F.abs("value"))).alias("p"))))
    rows = table(spark, d, "events").groupBy("user_id").agg(listed.alias("x"))
    rows = rows.select("user_id", F.transform("x", lambda e: e["t"]).alias("texts"), F.slice(F.transform("x", lambda e: e["s"]), 1, 5).alias("scores"), F.slice(F.transform("x", lambda e: e["p"]), 1, 7).alias("polys"))
    out = media.recognised_lines(rows, "texts", "scores", "polys", 0.02)
    return out.select("user_id", "line", "text", F.round("score", 6).alias("score"), F.size(F.from_json("polygon", "array<array<double>>")).alias("points"))


@query("frame_times", "SELECT event_id, least((event_id % 700) * 2.5e0, 1200e0) AS at FROM events")
def frame_times(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("frames/rec_"), F.col("user_id").cast("string"), F.lit("/frame_"), F.lpad((F.col("event_id") % 700).cast("string"), 6, "0"), F.lit(".jpg"))
    return table(spark, d, "events").select("event_id", media.frame_time(name, F.lit(2.5), F.lit(1200.0)).alias("at"))


@query("fresh_runs", "SELECT o_orderkey, coalesce(o_orderdate + INTERVAL 1 DAY * (o_custkey % 3 - 1) >= o_orderdate, FALSE) AS fresh FROM orders")
def fresh_runs(spark: SparkSession, d: str) -> DataFrame:
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    prior = F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_custkey") % 3 - 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", media.fresh(iso(prior), iso(F.col("o_orderdate"))).alias("fresh"))


@query(
    "interval_normalised",
    """
  WITH x AS (SELECT event_id, 10.0e0 + event_id % 7 AS a, 10.0e0 + event_id % 7 + 2 + event_id % 5 AS b, CASE event_id % 4 WHEN 0 THEN 10.0e0 + event_id % 7 + 1 WHEN 1 THEN 1.0e0 WHEN 2 THEN 2.0e0 ELSE event_id % 23 - 3.0e0 END AS s FROM events),
  y AS (SELECT *, CASE event_id % 4 WHEN 0 THEN s + 0.5e0 WHEN 1 THEN 1.02e0 WHEN 2 THEN 3.5e0 ELSE s + event_id % 3 END AS e, b - a AS n FROM x),
  z AS (SELECT *, a - 0.05e0 <= s AND s < e AND e <= b + 0.05e0 AS ab FROM y), r AS (SELECT *, CASE WHEN ab THEN s - a ELSE s END AS s1, CASE WHEN ab THEN e - a ELSE e END AS e1 FROM z),
  p AS (SELECT *, s1 >= 0 AND s1 <= n + 0.05e0 AND abs(e1 - s1) <= 0.05e0 AS pt, least(n, greatest(0.0e0, s1)) AS mid FROM r),
  q AS (SELECT *, greatest(0.0e0, mid - 0.5e0) AS lo, least(n, mid + 0.5e0) AS hi FROM p), w AS (SELECT *, CASE WHEN pt THEN CASE WHEN hi <= lo THEN greatest(0.0e0, n - 1) ELSE lo END ELSE s1 END AS s2, CASE WHEN pt THEN CASE WHEN hi <= lo THEN n ELSE hi END ELSE e1 END AS e2 FROM q),
  v AS (SELECT *, s2 < 0 OR e2 <= s2 OR e2 > n + 0.05e0 AS bad FROM w)
  SELECT event_id, round(CASE WHEN bad THEN 0.0e0 ELSE greatest(s2, 0.0e0) END, 3) AS "start", round(CASE WHEN bad THEN n ELSE least(e2, n) END, 3) AS "end",
    CASE WHEN ab THEN 'absolute_to_relative' ELSE 'relative' END || CASE WHEN pt THEN '|point_to_window' ELSE '' END || CASE WHEN bad THEN '|invalid_to_full_scene' ELSE '' END AS basis, CASE WHEN bad THEN 'high' WHEN pt THEN 'medium' ELSE 'low' END AS uncertainty FROM v
""",
)
def interval_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Made-up intervals in scenes: absolute, points, relative and impossible ones."""
    rows = table(spark, d, "events").selectExpr("event_id", "10D + event_id % 7 AS a", "10D + event_id % 7 + 2 + event_id % 5 AS b", "CASE event_id % 4 WHEN 0 THEN 10D + event_id % 7 + 1 WHEN 1 THEN 1D WHEN 2 THEN 2D ELSE event_id % 23 - 3D END AS s")
    rows = rows.selectExpr("*", "CASE event_id % 4 WHEN 0 THEN s + 0.5D WHEN 1 THEN 1.02D WHEN 2 THEN 3.5D ELSE s + event_id % 3 END AS e")
    x = timeline.normalised_interval(F.col("s"), F.col("e"), F.col("a"), F.col("b"))
    return rows.select("event_id", x.alias("x")).select("event_id", F.round("x.start", 3).alias("start"), F.round("x.end", 3).alias("end"), "x.basis", timeline.raised_uncertainty(F.lit("low"), F.col("x.basis")).alias("uncertainty"))


@query(
    "caption_labels",
    """
  SELECT p_partkey, array_to_string(list_filter(['Visual summary: ' || trim(p_name || ' '), '视觉摘要: ' || p_brand, 'Visible product: ' || p_name, CASE WHEN p_size % 3 <> 0 THEN 'Visible components: ' || p_type || CASE WHEN p_size % 2 = 0 THEN '; bolt' ELSE '' END END,
    CASE WHEN p_size % 5 = 0 THEN 'Visible warnings: hot' END], lambda x: x IS NOT NULL), chr(10)) AS text FROM part
""",
)
def caption_labels(spark: SparkSession, d: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    caption = F.struct(
        F.concat("p_name", F.lit(" ")).alias("summary_en"), F.col("p_brand").alias("summary_zh"), F.array("p_name").alias("product_name"),
        F.when(F.col("p_size") % 3 != 0, F.array("p_type", F.when(F.col("p_size") % 2 == 0, "bolt ").otherwise(" "))).otherwise(empty).alias("visible_components"),
        empty.alias("visible_actions"), F.array(F.lit("")).alias("visible_states"), F.when(F.col("p_size") % 5 == 0, F.array(F.lit("hot"))).otherwise(empty).alias("safety_or_warning_text"), empty.alias("uncertainty"),
    )
    return table(spark, d, "part").select("p_partkey", media.caption_labels(caption).alias("text"))


@query(
    "words_json",
    """
  WITH w AS (SELECT user_id, list({'s': round_even(abs(value), 3), 'e': round_even(abs(value) + 0.25, 3), 'w': event_type, 'p': round_even(abs(value) / 1000, 6)} ORDER BY event_id)[1:4] AS w FROM events GROUP BY user_id)
  SELECT user_id, len(w) AS words, round(list_sum(list_transform(w, lambda x: x.s + x.e)), 3) AS seconds, array_to_string(list_transform(w, lambda x: x.w), ',') AS said FROM w
""",
)
def words_json(spark: SparkSession, d: str) -> DataFrame:
    """Timed words written as JSON and read back."""
    word = F.struct(F.abs("value").alias("start"), (F.abs("value") + 0.25).alias("end"), F.col("event_type").alias("word"), (F.abs("value") / 1000).alias("probability"))
    rows = table(spark, d, "events").groupBy("user_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("event_id", word.alias("w")))), lambda x: x["w"]), 1, 4).alias("w"))
    back = F.from_json(media.words_json(F.col("w")), "array<struct<start:double,end:double,word:string,probability:double>>")
    rows = rows.select("user_id", back.alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x["start"] + x["end"])
    return rows.select("user_id", F.size("w").cast("long").alias("words"), F.round(total, 3).alias("seconds"), F.array_join(F.transform("w", lambda x: x["word"]), ",").alias("said"))


@query(
    "sampled_timeline",
    f"""
  WITH g AS (SELECT user_id, event_id // 500 AS tm, event_type AS frame, list(event_type || ' "' || CAST(event_id AS VARCHAR) || '"' ORDER BY event_id) AS texts FROM events GROUP BY ALL)
  SELECT user_id, sha256('{media.SAMPLED}' || chr(10) || string_agg('{{"timestamp_seconds": ' || CAST(tm AS BIGINT) || '.0, "frame_id": "' || frame || '", "texts": [' || array_to_string(list_transform(texts, lambda x: '"' || replace(x, '"', '\\"') || '"'), ', ') || ']}}', chr(10) ORDER BY tm, frame)) AS mark FROM g GROUP BY user_id
""",
)
def sampled_timeline(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat("event_type", F.lit(' "'), F.col("event_id").cast("string"), F.lit('"'))
    rows = table(spark, d, "events").select("user_id", F.floor(F.col("event_id") / 500).cast("double").alias("at"), F.col("event_type").alias("frame"), "event_id", said.alias("text"))
    groups = timeline.frame_groups(rows, "user_id", "at", "frame", "event_id", "text", "event_id")
    return media.sampled_lines(groups, ["user_id"], "at", "frame", "texts").select("user_id", tx.digest(F.col("timeline")).alias("mark"))


MANIFEST_SQL = f"""
  WITH {EVENTS_SQL},
  al AS (SELECT record, scene, "start", "end" FROM sc), rg AS (SELECT record, min("start") AS a, max("end") AS b FROM al GROUP BY record),
  sp AS (SELECT user_id AS record, event_id AS segment, tt AS "start", tt + 30 AS "end", 'word ' || (event_id % 9) AS text, -(event_id % 5) / 4e0 AS lp FROM e JOIN al ON al.record = e.user_id AND tt + 15 >= al."start" AND tt + 15 < al."end" WHERE event_type = 'click'),
  fr AS (SELECT user_id AS record, event_id AS observation, tt + 1 AS tm, (event_id % 7) / 7e0 AS confidence FROM e JOIN al ON al.record = e.user_id AND tt + 1 >= al."start" AND tt + 1 < al."end" WHERE event_type = 'view'),
  ss AS (SELECT al.scene, sp.segment, sp.text, sp.lp FROM al JOIN sp ON sp.record = al.record AND al."start" < sp."end" AND al."end" > sp."start"),
  sf AS (SELECT al.scene, fr.observation, fr.tm, fr.confidence FROM al JOIN fr ON fr.record = al.record AND ((fr.tm >= al."start" AND fr.tm < al."end") OR abs(fr.tm - al."end") <= greatest(0.001, 1e-9 * greatest(abs(fr.tm), abs(al."end"))))),
  sa AS (SELECT scene, string_agg(text, ' ' ORDER BY o) AS said FROM (SELECT scene, lower(text) AS k, min(segment) AS o, min_by(text, segment) AS text FROM ss GROUP BY ALL) GROUP BY scene),
  cf AS (SELECT scene, round(avg(c), 6) AS confidence FROM (SELECT scene, least(1, exp(lp)) AS c FROM ss UNION ALL SELECT scene, confidence FROM sf) GROUP BY scene)
  SELECT al.record, 0 AS kind_order, 'video_scene' AS evidence_type, CAST(al.scene AS VARCHAR) AS evidence_id, round(al."start", 3) AS "start", round(al."end", 3) AS "end", coalesce(said, '') AS said, cf.confidence,
    coalesce((SELECT string_agg(CAST(segment AS VARCHAR), '|' ORDER BY segment) FROM ss WHERE ss.scene = al.scene), '') AS speech_ids, coalesce((SELECT string_agg(CAST(observation AS VARCHAR), '|' ORDER BY tm, observation) FROM sf WHERE sf.scene = al.scene), '') AS frame_ids
  FROM al LEFT JOIN sa USING (scene) LEFT JOIN cf USING (scene)
  UNION ALL SELECT record, 1, 'speech_segment', CAST(segment AS VARCHAR), round("start", 3), round("end", 3), '', round(least(1, exp(lp)), 6), CAST(segment AS VARCHAR), '' FROM sp
  UNION ALL SELECT record, 2, 'frame_text', CAST(observation AS VARCHAR), round(tm, 3), round(tm, 3), '', round(confidence, 6), '', CAST(observation AS VARCHAR) FROM fr
"""


@query("evidence_manifest", MANIFEST_SQL)
def evidence_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Scenes between a user's events, clicks as speech and views as frame texts in them."""
    s, e = scenes(spark, d), events(spark, d)
    inside = lambda rows, at: timeline.containing_scene(s, rows.withColumnRenamed("user_id", "record").withColumn("at", at), "record", "event_id", "start")
    keep = lambda rows, at: rows.join(inside(rows.select("user_id", "event_id", "at"), at).select("event_id").distinct(), "event_id", "left_semi")
    # a moment at a last scene's very end isn't taken
    bound = s.groupBy("record").agg(F.max("end").alias("last"))
    open_ = lambda rows, at: rows.join(bound.select(F.col("record").alias("user_id"), "last"), "user_id").filter(at < F.col("last")).drop("last")
    clicks, views = e.filter("event_type = 'click'"), e.filter("event_type = 'view'")
    speech = open_(keep(clicks, F.col("at") + 15), F.col("at") + 15).select(F.col("user_id").alias("record"), F.col("event_id").alias("segment"), F.col("event_id").alias("order"), F.col("at").alias("start"), (F.col("at") + 30).alias("end"), F.concat(F.lit("word "), (F.col("event_id") % 9).cast("string")).alias("text"), (-(F.col("event_id") % 5) / 4.0).alias("log_probability"))
    frames = open_(keep(views, F.col("at") + 1), F.col("at") + 1).select(F.col("user_id").alias("record"), F.col("event_id").alias("observation"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("frame"), (F.col("at") + 1).alias("at"), F.lit("seen").alias("text"), ((F.col("event_id") % 7) / 7.0).alias("confidence"))
    captions = s.select("scene", F.lit("A scene.").alias("text"))
    described = s.select("record").distinct().select("record", F.lit(3600.0).alias("interval"), F.lit(500).alias("frames"), F.lit("frames").alias("folder"))
    out = media.evidence_manifest(s, speech, frames, captions, described)
    said = F.when(F.col("evidence_type") == "video_scene", F.regexp_extract("text", r"^ASR: ([^\n]*)", 1)).otherwise("")
    return out.select("record", "kind_order", "evidence_type", "evidence_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), said.alias("said"), F.round("confidence", 6).alias("confidence"), "speech_ids", "frame_ids")


@query("picture_context", "SELECT p_size AS picture, max_by(p_brand, p_partkey) AS product, max_by(p_name, p_partkey) AS heading FROM part GROUP BY p_size")
def picture_context(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_size").alias("picture"), "p_partkey", F.col("p_brand").alias("product"), F.col("p_name").alias("heading"))
    return media.picture_context(rows, "picture", "p_partkey", ["product", "heading"])


@query("section_summaries", "SELECT p_partkey, s.summary FROM part LEFT JOIN (SELECT s_suppkey, s_name AS summary FROM supplier WHERE s_suppkey % 4 <> 0) s ON s.s_suppkey = p_partkey % 150")
def section_summaries(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 150).alias("s_suppkey"))
    found = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("__ERROR__ "), "s_name")).otherwise(F.col("s_name")).alias("summary"))
    return media.with_summaries(parts, found, ["s_suppkey"]).select("p_partkey", "summary")


@query("scene_inventory", "SELECT l_orderkey, l_linenumber, l_partkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey")
def scene_inventory(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return media.with_inventory(items, table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "p_name")


@query(
    "class_text",
    "WITH a AS (SELECT p_type, string_agg(DISTINCT p_brand, ' ' ORDER BY p_brand) AS a FROM part WHERE p_type <> 'SMALL' GROUP BY p_type) SELECT p_partkey, trim(concat_ws(' ', p.p_type, a.a, p_name)) AS searchable FROM part p LEFT JOIN a USING (p_type)",
)
def class_text(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    aliases = parts.filter("p_type <> 'SMALL'").select("p_type", F.col("p_brand").alias("place"), F.col("p_brand").alias("alias")).distinct()
    return media.class_text(parts.select("p_partkey", "p_type", "p_name"), aliases, "p_type", "p_name").select("p_partkey", "searchable")


@query(
    "tree_inputs",
    "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n > 3 OR n = 3 OR length(text) > 600",
)
def tree_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Of the last three turns the third isn't shown, and long ones are offloaded."""
    rows = table(spark, d, "conversations")
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    shown = rows.withColumn("n", place).filter("n < 3").select("conv_id", "turn", (F.length("text") > 600).alias("offloaded"))
    return media.tree_inputs(rows, shown, "conv_id", "turn", 3).select("conv_id", "turn")
