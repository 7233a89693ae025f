"""Session queries over conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text as tx
from weft.operators import sessions, tree
from weft.plans.catalog import query, table
from weft.sources import tables

PAIRS_SQL = """
  m AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  p AS (SELECT conv_id, turn AS turn_id, text AS question, CASE WHEN nr = 'assistant' THEN nt ELSE '' END AS answer FROM m WHERE role = 'user')
"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return sessions.paired(table(spark, d, "conversations"))


@query("question_answer_pairs", f"WITH {PAIRS_SQL} SELECT * FROM p")
def question_answer_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d)


@query(
    "recent_window",
    f"""WITH {PAIRS_SQL}, u AS (SELECT conv_id, turn_id, sum(strlen(question) + strlen(answer) + 40) OVER w + 2 + 2 * (count(*) OVER w - 1) AS used FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn_id DESC))
  SELECT conv_id, turn_id, CAST(used AS BIGINT) AS used FROM u WHERE used <= 3000""",
)
def recent_window(spark: SparkSession, d: str) -> DataFrame:
    size = F.octet_length("question") + F.octet_length("answer") + 40
    return sessions.recent_window(pairs(spark, d), "conv_id", "turn_id", size, 3000, fixed=2, between=2).select("conv_id", "turn_id", "used")


@query("last_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 2")
def last_turns(spark: SparkSession, d: str) -> DataFrame:
    return sessions.last_n(table(spark, d, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn", "role")


@query(
    "archive_retention",
    f"""WITH {PAIRS_SQL}, r AS (SELECT conv_id, turn_id, row_number() OVER w AS n, sum(length(question) + length(answer)) OVER w AS s FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn_id DESC))
  SELECT conv_id, turn_id FROM r WHERE n <= 3 AND s <= 2000""",
)
def archive_retention(spark: SparkSession, d: str) -> DataFrame:
    rows = pairs(spark, d).withColumn("chars", F.length("question") + F.length("answer"))
    return sessions.retained(rows, "conv_id", "turn_id", "chars", 3, 2000).select("conv_id", "turn_id")


@query("lru_sessions", "SELECT user_id, accessed FROM (SELECT user_id, max(event_id) AS accessed FROM events GROUP BY user_id) ORDER BY accessed DESC, user_id DESC LIMIT 50")
def lru_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("accessed"))
    return sessions.least_recent(s, "accessed", "user_id", 50)


@query("ttl_expiry", "SELECT user_id FROM (SELECT user_id, max(epoch(ts)) AS updated FROM events GROUP BY user_id) WHERE updated > (SELECT max(epoch(ts)) FROM events) - 86400")
def ttl_expiry(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    s = table(spark, d, "events").groupBy("user_id").agg(F.max(seconds).alias("updated"))
    now = s.agg(F.max("updated")).first()[0]
    return (sessions.alive(s, "updated", now, 86400.0) if now is not None else s).select("user_id")


@query(
    "lexical_recall",
    f"""
  WITH {PAIRS_SQL}, z AS (SELECT conv_id, max(turn_id) AS last FROM p GROUP BY conv_id),
  t AS (SELECT conv_id, turn_id, list_distinct(regexp_extract_all(lower(question || ' ' || answer), '[a-z0-9][a-z0-9_-]+')) AS have FROM p),
  q AS (SELECT p.conv_id, list_distinct(regexp_extract_all(lower(question), '[a-z0-9][a-z0-9_-]+')) AS want FROM p JOIN z ON p.conv_id = z.conv_id AND turn_id = last),
  s AS (SELECT t.conv_id, turn_id, len(list_intersect(have, want)) AS shared FROM t JOIN q USING (conv_id) JOIN z USING (conv_id) WHERE turn_id <> last),
  r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY shared DESC, turn_id DESC) AS rank FROM s WHERE shared > 0)
  SELECT conv_id, turn_id, CAST(shared AS INTEGER) AS shared, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3
""",
)
def lexical_recall(spark: SparkSession, d: str) -> DataFrame:
    """Older turns that share most terms with a conversation's last question."""
    p = pairs(spark, d)
    last = sessions.last_n(p, "conv_id", "turn_id", 1)
    found = sessions.recall(p, last.select("conv_id", F.col("question").alias("q")), "conv_id", "turn_id", F.concat_ws(" ", "question", "answer"), "q", 3, last.select("conv_id", "turn_id"))
    return found.select("conv_id", "turn_id", "shared", "rank")


@query(
    "victim_eviction",
    """
  WITH x AS (SELECT conv_id, turn, length(text) + 32 AS s, row_number() OVER (PARTITION BY conv_id ORDER BY role = 'user', turn) AS n FROM conversations),
  y AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY n DESC) AS rest FROM x)
  SELECT conv_id, turn FROM y WHERE rest <= 2500
""",
)
def victim_eviction(spark: SparkSession, d: str) -> DataFrame:
    """Messages left after dropping assistants' first, oldest first, until 2500 characters remain."""
    rows = table(spark, d, "conversations")
    return sessions.evicted(rows, "conv_id", [F.col("role") == "user", F.col("turn")], F.length("text") + 32, 2500).select("conv_id", "turn")


@query(
    "newest_that_fit",
    """
  WITH RECURSIVE l AS (SELECT conv_id, list({'o': turn, 's': strlen(text)} ORDER BY turn DESC) AS l FROM conversations GROUP BY conv_id),
  f AS (
    SELECT conv_id, l, 1 AS i, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS kept FROM l
    UNION ALL SELECT conv_id, l, i + 1, CASE WHEN used + l[i].s <= 2000 THEN used + l[i].s ELSE used END, CASE WHEN used + l[i].s <= 2000 THEN list_append(kept, l[i].o) ELSE kept END FROM f WHERE i <= len(l))
  SELECT conv_id, unnest(kept) AS turn FROM f WHERE i = len(l) + 1
""",
)
def newest_that_fit(spark: SparkSession, d: str) -> DataFrame:
    """Messages taken newest first while they fit 2000 bytes; larger ones are skipped."""
    return sessions.newest_that_fit(table(spark, d, "conversations"), "conv_id", "turn", F.octet_length("text"), 2000).select("conv_id", "turn")


@query(
    "message_bytes",
    """SELECT conv_id, CAST(sum(strlen(CAST(to_json({'role': role, 'content': text}) AS VARCHAR))) + count(*) * 3 + 2 * (count(*) - 1) + 2 AS BIGINT) AS bytes FROM conversations GROUP BY conv_id""",
)
def message_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of each conversation's messages written as JSON with blanks after signs."""
    items = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(items.alias("m"))
    m = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return g.select("conv_id", tx.spaced_json_bytes(m, 2).cast("long").alias("bytes"))


@query(
    "streak_islands",
    """
  WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM c)
  SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) AS INTEGER) AS streak FROM i
""",
)
def streak_islands(spark: SparkSession, d: str) -> DataFrame:
    return sessions.streaks(table(spark, d, "events"), "user_id", "event_id", F.col("event_type")).select("user_id", "event_id", "streak")


def questions(spark: SparkSession, d: str) -> DataFrame:
    last = sessions.last_n(table(spark, d, "conversations").filter("role = 'user'"), "conv_id", "turn", 1)
    return last.select("conv_id", F.col("text").alias("question"))


@query("session_tree")
def session_tree(spark: SparkSession, d: str) -> DataFrame:
    return tree.session_trees(table(spark, d, "conversations")).drop("vec")


@query("tree_collapsed")
def tree_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return tree.collapsed(tree.searched(table(spark, d, "conversations"), questions(spark, d))).select("conv_id", "node", "level", "score", "rank")


@query("tree_traversal")
def tree_traversal(spark: SparkSession, d: str) -> DataFrame:
    """The nodes a beam passes; trees are built and scored once, as every level looks into them."""
    path = tables.scratch(spark, "trees")
    tree.searched(table(spark, d, "conversations"), questions(spark, d)).select("conv_id", "node", "level", "parent", "score").write.parquet(path)
    return tree.traversed(spark.read.parquet(path)).select("conv_id", "node", "level", "score", "rank")
