"""Timeline queries: the events of a user stand for timed observations, their gaps for intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.operators import timeline
from weft.plans.catalog import query, table
from weft.sources import tables

#: e: events with seconds since the month's start; iv: purchase-to-next intervals of at most an hour and all others' next events.
EVENTS_SQL = """
  e AS (SELECT event_id, user_id, event_type, value, props, ts, epoch(ts) - 1704067200 AS tt FROM events),
  iv AS (SELECT event_id, user_id, event_type, tt AS "start", lead(tt) OVER (PARTITION BY user_id ORDER BY tt, event_id) AS "end" FROM e),
  sc AS (SELECT user_id AS record, event_id AS scene, "start", "end" FROM iv WHERE "end" > "start" AND event_type <> 'click')
"""


def events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 - 1704067200
    return e.withColumn("at", at)


def scenes(spark: SparkSession, d: str) -> DataFrame:
    end = F.lead("at").over(W.partitionBy("user_id").orderBy("at", "event_id"))
    rows = events(spark, d).select("event_id", "user_id", "event_type", F.col("at").alias("start"), end.alias("end"))
    return rows.filter("end > start AND event_type <> 'click'").select(F.col("user_id").alias("record"), F.col("event_id").alias("scene"), "start", "end")


def speech(spark: SparkSession, d: str) -> DataFrame:
    """Clicks, each lasting as many seconds as its value tells."""
    return events(spark, d).filter("event_type = 'click'").select(F.col("user_id").alias("record"), F.col("event_id").alias("segment"), F.col("at").alias("start"), (F.col("at") + F.abs("value") * 60 + 1).alias("end"), "value")


SPEECH_SQL = """sp AS (SELECT user_id AS record, event_id AS segment, tt AS "start", tt + abs(value) * 60 + 1 AS "end", value FROM e WHERE event_type = 'click')"""


@query(
    "interval_overlap",
    f"""WITH {EVENTS_SQL}, {SPEECH_SQL} SELECT s.record, s.scene, p.segment FROM sc s JOIN sp p ON s.record = p.record AND s."start" < p."end" AND s."end" > p."start" """,
)
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    return timeline.overlaps(scenes(spark, d), speech(spark, d), "record").select("record", "scene", F.col("r_segment").alias("segment"))


@query(
    "interval_overlap_binned",
    f"""WITH {EVENTS_SQL}, {SPEECH_SQL} SELECT s.record, s.scene, p.segment FROM sc s JOIN sp p ON s.record = p.record AND s."start" < p."end" AND s."end" > p."start" """,
)
def interval_overlap_binned(spark: SparkSession, d: str) -> DataFrame:
    """The same in the form for records that hold very many rows."""
    return timeline.overlaps(scenes(spark, d), speech(spark, d), "record", width=21_600.0).select("record", "scene", F.col("r_segment").alias("segment"))


@query(
    "point_in_scene",
    f"""WITH {EVENTS_SQL} SELECT s.record, s.scene, e.event_id FROM sc s JOIN e ON s.record = e.user_id AND ((e.tt >= s."start" AND e.tt < s."end") OR abs(e.tt - s."end") <= greatest(0.001, 1e-9 * greatest(abs(e.tt), abs(s."end"))))""",
)
def point_in_scene(spark: SparkSession, d: str) -> DataFrame:
    points = events(spark, d).select(F.col("user_id").alias("record"), "event_id", "at")
    return timeline.points_inside(scenes(spark, d), points, "record").select("record", "scene", "event_id")


@query(
    "containing_scene",
    f"""
  WITH {EVENTS_SQL}, {SPEECH_SQL}, m AS (SELECT record, segment, ("start" + "end") / 2 AS tt FROM sp),
  l AS (SELECT *, "start" = max("start") OVER (PARTITION BY record) AS last FROM sc),
  h AS (SELECT m.record, m.segment, l.scene, row_number() OVER (PARTITION BY m.record, m.segment ORDER BY l."start") AS n FROM m JOIN l ON m.record = l.record
        AND ((m.tt >= l."start" AND m.tt < l."end") OR (l.last AND abs(m.tt - l."end") <= greatest(0.001, 1e-9 * greatest(abs(m.tt), abs(l."end"))))))
  SELECT record, segment, scene FROM h WHERE n = 1
""",
)
def containing_scene(spark: SparkSession, d: str) -> DataFrame:
    points = speech(spark, d).select("record", "segment", timeline.midpoint(F.col("start"), F.col("end")).alias("at"))
    return timeline.containing_scene(scenes(spark, d), points, "record", "segment", "start").select("record", "segment", "scene")


@query(
    "scene_cuts",
    f"""
  WITH RECURSIVE {EVENTS_SQL},
  c AS (SELECT user_id, list(tt ORDER BY tt) AS c FROM e GROUP BY user_id),
  f AS (
    SELECT user_id, c, 1 AS i, CAST(0 AS DOUBLE) AS last, [CAST(0 AS DOUBLE)] AS b FROM c
    UNION ALL SELECT user_id, c, i + 1, CASE WHEN c[i] - last >= 21600 AND 2592000 - c[i] >= 21600 THEN c[i] ELSE last END, CASE WHEN c[i] - last >= 21600 AND 2592000 - c[i] >= 21600 THEN list_append(b, c[i]) ELSE b END FROM f WHERE i <= len(c)),
  d AS (SELECT user_id, list_append(b, CAST(2592000 AS DOUBLE)) AS b FROM f WHERE i = len(c) + 1),
  x AS (SELECT user_id, b, unnest(range(1, len(b))) AS n FROM d)
  SELECT user_id, CAST(n AS INTEGER) AS scene, round(b[n], 3) AS "start", round(b[n + 1], 3) AS "end" FROM x
""",
)
def scene_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Each user's days cut at events at least six hours apart."""
    e = events(spark, d).groupBy("user_id").agg(F.collect_list("at").alias("cuts"))
    found = timeline.scenes(e, "user_id", F.col("cuts"), F.lit(30 * 86400.0), 21_600.0)
    return found.select("user_id", "scene", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query(
    "adjacent_intervals",
    f"""WITH {EVENTS_SQL} SELECT user_id, tt AS "start", "end" FROM (SELECT user_id, tt, lead(tt) OVER (PARTITION BY user_id ORDER BY tt) AS "end" FROM (SELECT DISTINCT user_id, tt FROM e)) WHERE "end" IS NOT NULL""",
)
def adjacent_intervals(spark: SparkSession, d: str) -> DataFrame:
    return timeline.adjacent(events(spark, d).select("user_id", "at").distinct(), "user_id", "at")


@query(
    "keyframe_lookup",
    f"""WITH {EVENTS_SQL} SELECT scene, 'frames/' || record || '/frame_' || lpad(CAST(least(CAST(floor("start" / 3600) AS BIGINT), 499) AS VARCHAR), 6, '0') || '.jpg' AS path FROM sc""",
)
def keyframe_lookup(spark: SparkSession, d: str) -> DataFrame:
    path = timeline.keyframe(F.col("start"), F.lit(3600.0), F.lit(500), F.concat(F.lit("frames/"), F.col("record").cast("string")))
    return scenes(spark, d).select("scene", path.alias("path"))


@query(
    "evidence_union",
    f"""
  WITH {EVENTS_SQL}, {SPEECH_SQL},
  u AS (SELECT record, 0 AS kind_order, 'video_scene' AS evidence_type, CAST(scene AS VARCHAR) AS evidence_id, "start", "end", 'scene' AS text FROM sc
        UNION ALL SELECT record, 1, 'speech_segment', CAST(segment AS VARCHAR), "start", "end", 'speech' FROM sp
        UNION ALL SELECT user_id, 2, 'frame_text', CAST(event_id AS VARCHAR), tt, tt, props FROM e WHERE event_type = 'view')
  SELECT record, kind_order, evidence_type, evidence_id, round("start", 3) AS "start", round("end", 3) AS "end", text FROM u
""",
)
def evidence_union(spark: SparkSession, d: str) -> DataFrame:
    frames = events(spark, d).filter("event_type = 'view'").select(F.col("user_id").alias("record"), F.col("event_id").alias("evidence_id"), F.col("at").alias("start"), F.col("at").alias("end"), F.col("props").alias("text"))
    kinds = [
        ("video_scene", scenes(spark, d).select("record", F.col("scene").alias("evidence_id"), "start", "end", F.lit("scene").alias("text"))),
        ("speech_segment", speech(spark, d).select("record", F.col("segment").alias("evidence_id"), "start", "end", F.lit("speech").alias("text"))),
        ("frame_text", frames),
    ]
    out = timeline.evidence_rows(kinds)
    return out.withColumn("start", F.round("start", 3)).withColumn("end", F.round("end", 3))


@query(
    "mean_confidence",
    f"""
  WITH {EVENTS_SQL}, c AS (SELECT user_id, least(1.0, exp(-abs(value) / 100)) AS c FROM e WHERE event_type = 'click' UNION ALL SELECT user_id, least(1.0, abs(value) / 1000) FROM e WHERE event_type = 'view')
  SELECT user_id, round(avg(c), 6) AS confidence FROM c GROUP BY user_id
""",
)
def mean_confidence(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    logs = e.filter("event_type = 'click'").select("user_id", (-F.abs("value") / 100).alias("value"))
    scores = e.filter("event_type = 'view'").select("user_id", F.least(F.lit(1.0), F.abs("value") / 1000).alias("value"))
    return timeline.mean_confidence(logs, scores, ["user_id"])


@query(
    "manifest_diff",
    """
  WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND value > 50)
  SELECT user_id, 'missing' AS side FROM a ANTI JOIN b USING (user_id) UNION ALL SELECT user_id, 'extra' FROM b ANTI JOIN a USING (user_id)
""",
)
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return timeline.mismatches(e.filter("event_type = 'purchase'"), e.filter("event_type = 'click' AND value > 50"), "user_id")


@query(
    "incremental_reuse",
    """
  WITH s AS (SELECT doc_id, sha256(text) AS mark, n_chars FROM documents), r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN mark ELSE 'old' END AS mark, n_chars FROM s WHERE doc_id % 2 = 0)
  SELECT doc_id, mark FROM s ANTI JOIN r USING (doc_id, mark, n_chars)
""",
)
def incremental_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a finished run of the same id, digest and length (made-up earlier runs)."""
    s = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("mark"), "n_chars")
    runs = s.filter("doc_id % 2 = 0").withColumn("mark", F.when(F.col("doc_id") % 3 == 0, F.col("mark")).otherwise("old"))
    return timeline.to_process(s, runs, ["doc_id", "mark", "n_chars"]).select("doc_id", "mark")


@query(
    "frame_groups",
    """
  SELECT user_id, ts, event_type, string_agg(props, '|' ORDER BY event_id) AS texts, count(*) AS n FROM events GROUP BY user_id, ts, event_type
""",
)
def frame_groups(spark: SparkSession, d: str) -> DataFrame:
    g = timeline.frame_groups(table(spark, d, "events").withColumn("o", F.col("event_id")), "user_id", "ts", "event_type", "event_id", "props", "o")
    return g.select("user_id", "ts", "event_type", F.array_join("texts", "|").alias("texts"), F.size("ids").cast("long").alias("n"))


@query(
    "unique_text",
    """
  WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations),
  f AS (SELECT conv_id, lower(t) AS k, min((turn, t)) AS x FROM t WHERE t <> '' GROUP BY conv_id, lower(t))
  SELECT conv_id, string_agg(x[2], ' ' ORDER BY x) AS text FROM f GROUP BY conv_id
""",
)
def unique_text(spark: SparkSession, d: str) -> DataFrame:
    return timeline.unique_text(table(spark, d, "conversations"), ["conv_id"], "text", "turn")


@query("latest_per_key", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return tables.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query(
    "expand_ids",
    """
  WITH l AS (SELECT user_id, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY user_id), x AS (SELECT user_id, unnest(ids) AS event_id, generate_subscripts(ids, 1) - 1 AS pos FROM l)
  SELECT x.user_id, CAST(x.pos AS INTEGER) AS pos, CAST(x.event_id AS VARCHAR) AS event_id, e.event_type FROM x JOIN events e USING (event_id)
""",
)
def expand_ids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    lists = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), "|").alias("ids"))
    look = e.select(F.col("event_id").cast("string").alias("event_id"), "event_type")
    return timeline.expand_ids(lists, "user_id", "ids", look, "event_id").select("user_id", "pos", "event_id", "event_type")


@query(
    "normalised_intervals",
    """
  WITH x AS (SELECT event_id, CAST(event_id % 50 AS DOUBLE) AS s, CAST(event_id % 50 + event_id % 7 - 1 AS DOUBLE) AS e, CAST(event_id % 20 AS DOUBLE) AS a, CAST(event_id % 20 + 30 AS DOUBLE) AS b FROM events),
  y AS (SELECT *, b - a AS l, a - 0.05 <= s AND s < e AND e <= b + 0.05 AS moved FROM x),
  z AS (SELECT event_id, l, moved, CASE WHEN moved THEN s - a ELSE s END AS s, CASE WHEN moved THEN e - a ELSE e END AS e FROM y),
  p AS (SELECT event_id, l, moved, s >= 0 AND s <= l + 0.05 AND abs(e - s) <= 0.05 AS point, s, e, least(l, greatest(0, s)) AS mid FROM z),
  w AS (SELECT event_id, l, moved, point, CASE WHEN point THEN greatest(0, mid - 0.5) ELSE s END AS s, CASE WHEN point THEN least(l, mid + 0.5) ELSE e END AS e FROM p),
  v AS (SELECT *, s < 0 OR e <= s OR e > l + 0.05 AS bad FROM w)
  SELECT event_id, CASE WHEN bad THEN 0 ELSE greatest(s, 0) END AS "start", CASE WHEN bad THEN l ELSE least(e, l) END AS "end",
    CASE WHEN moved THEN 'absolute_to_relative' ELSE 'relative' END || CASE WHEN point THEN '|point_to_window' ELSE '' END || CASE WHEN bad THEN '|invalid_to_full_scene' ELSE '' END AS basis FROM v
""",
)
def normalised_intervals(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    x = timeline.normalised_interval((i % 50).cast("double"), (i % 50 + i % 7 - 1).cast("double"), (i % 20).cast("double"), (i % 20 + 30).cast("double"))
    return table(spark, d, "events").select("event_id", x.alias("x")).select("event_id", "x.start", "x.end", "x.basis")


@query(
    "frame_offsets",
    f"""
  WITH {EVENTS_SQL}, l AS (SELECT scene, ("end" - "start") / 600 AS d FROM sc), f AS (SELECT scene, d, unnest(CASE WHEN d < 3 THEN [0.5] WHEN d < 8 THEN [0.2, 0.8] ELSE [0.1, 0.5, 0.9] END) AS s FROM l)
  SELECT scene, round(least(greatest(d * s, 0.05), greatest(d - 0.05, 0.05)), 6) AS "at" FROM f
""",
)
def frame_offsets(spark: SparkSession, d: str) -> DataFrame:
    at = timeline.frame_offsets((F.col("end") - F.col("start")) / 600)
    return scenes(spark, d).select("scene", F.explode(at).alias("at")).select("scene", F.round("at", 6).alias("at"))
