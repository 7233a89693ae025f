"""Rules over answers, and scenes in pieces: conversations and events stand for answers, their sources and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import expansion, rolling, rules, sessions
from weft.plans.catalog import query, table
from weft.plans.sessions import PAIRS_SQL
from weft.plans.timeline import events

#: Words that rules are made of by number: rule i asks for one, is anchored by two groups, kept by one of two, broken by another.
WORDS = "the of and to in a de is that der it for was la en on as with die be by er from und this que are an he es or le den von zu des".split()


def rule_rows() -> list[tuple[str, str, int, str]]:
    """A rule for each of WORDS, those of even number with a question part and those divisible by 3 with a `never` part."""
    w, out = lambda i: WORDS[i % len(WORDS)], []
    for i in range(len(WORDS)):
        name = f"R{i:02d}"
        out += [(name, "source", 1, w(i)), (name, "source", 2, w(i + 3)), (name, "source", 2, f"{w(i + 1)} {w(i + 2)}")]
        out += [(name, "claim", 1, w(i)), (name, "claim", 1, w(i + 5)), (name, "claim", 2, w(i + 2))]
        if i % 2 == 0:
            out.append((name, "question", 1, w(i + 4)))
        if i % 3 == 0:
            out.append((name, "never", 1, w(i + 7)))
    return out


RULES_SQL = "rules(rule, part, grp, phrase) AS (VALUES " + ", ".join(f"('{r}', '{p}', {g}, '{x}')" for r, p, g, x in rule_rows()) + ")"
PLAIN = r"(' ' || trim(regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ')"
SENTENCES = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(replace({}, chr(1), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), '[\n\x01]+'), lambda s: trim(s)), lambda s: s <> '')"


def met_sql(hits: str, part: str, by: str) -> str:
    return f"""(SELECT {by}, rule FROM {hits} JOIN rules USING (phrase) WHERE part = '{part}' GROUP BY {by}, rule
      HAVING count(DISTINCT grp) = any_value((SELECT count(DISTINCT grp) FROM rules n WHERE n.rule = rules.rule AND n.part = '{part}')))"""


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule_rows(), "rule string, part string, grp int, phrase string")


@query(
    "answer_omissions",
    f"""
  WITH {RULES_SQL}, need AS (SELECT rule, part, count(DISTINCT grp) AS n FROM rules GROUP BY rule, part), {PAIRS_SQL},
  q AS (SELECT conv_id, string_agg(question, chr(10) ORDER BY turn_id) AS question FROM p GROUP BY conv_id),
  qh AS (SELECT conv_id, rule, grp FROM q JOIN rules ON part = 'question' AND contains({PLAIN.format("question")}, ' ' || phrase || ' ')),
  asked AS (SELECT conv_id, rule FROM (SELECT conv_id, rule, count(DISTINCT grp) AS n FROM qh GROUP BY conv_id, rule) JOIN need USING (rule, n) WHERE part = 'question'),
  sh AS (SELECT conv_id, turn, rule, grp FROM conversations JOIN rules ON part = 'source' AND role <> 'assistant' AND contains({PLAIN.format("text")}, ' ' || phrase || ' ')),
  anchored AS (SELECT conv_id, turn, rule FROM (SELECT conv_id, turn, rule, count(DISTINCT grp) AS n FROM sh GROUP BY conv_id, turn, rule) JOIN need USING (rule, n) WHERE part = 'source'),
  applies AS (SELECT * FROM anchored WHERE rule NOT IN (SELECT rule FROM need WHERE part = 'question') OR (conv_id, rule) IN (SELECT (conv_id, rule) FROM asked)),
  s AS (SELECT conv_id, turn, unnest({SENTENCES.format("text")}) AS s, generate_subscripts({SENTENCES.format("text")}, 1) AS pos FROM conversations WHERE role = 'assistant'),
  ch AS (SELECT conv_id, turn, pos, rule, part, grp FROM s JOIN rules ON part IN ('claim', 'never') AND contains({PLAIN.format("s")}, ' ' || phrase || ' ')),
  said AS (
    SELECT conv_id, turn, rule FROM (SELECT conv_id, turn, pos, rule, count(DISTINCT grp) AS n FROM ch WHERE part = 'claim' GROUP BY conv_id, turn, pos, rule) JOIN need USING (rule, n)
    WHERE part = 'claim' AND (conv_id, turn, pos, rule) NOT IN (SELECT (conv_id, turn, pos, rule) FROM ch WHERE part = 'never')),
  kept AS (SELECT DISTINCT a.conv_id, a.rule FROM applies a JOIN said b ON a.conv_id = b.conv_id AND a.rule = b.rule AND a.turn < b.turn)
  SELECT conv_id, rule, min(turn) AS source, count(DISTINCT turn) AS sources FROM applies WHERE (conv_id, rule) NOT IN (SELECT (conv_id, rule) FROM kept) GROUP BY conv_id, rule
""",
)
def answer_omissions(spark: SparkSession, d: str) -> DataFrame:
    """Rules that a conversation's questions and earlier turns call for and no answer keeps: each answer cites the turns before it that aren't answers."""
    c = table(spark, d, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    asked = sessions.paired(c).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn_id", "question"))).alias("q"))
    answers = asked.select(F.col("conv_id").alias("answer"), F.array_join(F.col("q.question"), "\n").alias("question"))
    sources = c.filter("role <> 'assistant'").select(F.col("conv_id").alias("answer"), F.col("turn").alias("source"), "text")
    claims = c.filter("role = 'assistant'").select(F.col("conv_id").alias("answer"), F.col("turn").alias("claim"), "text", F.sequence(F.lit(0), F.greatest(F.col("turn") - 1, F.lit(0))).alias("cited"))
    return rules.omissions(answers, sources, claims, rules_table(spark)).withColumnRenamed("answer", "conv_id")


@query(
    "first_rule",
    f"""
  WITH {RULES_SQL}, need AS (SELECT rule, count(DISTINCT grp) AS n FROM rules WHERE part = 'claim' GROUP BY rule),
  s AS (SELECT doc_id, unnest({SENTENCES.format("text")}) AS s, generate_subscripts({SENTENCES.format("text")}, 1) AS pos FROM documents),
  h AS (SELECT doc_id, pos, rule, part, grp FROM s JOIN rules ON part IN ('claim', 'never') AND contains({PLAIN.format("s")}, ' ' || phrase || ' ')),
  m AS (SELECT doc_id, pos, rule FROM (SELECT doc_id, pos, rule, count(DISTINCT grp) AS n FROM h WHERE part = 'claim' GROUP BY doc_id, pos, rule) JOIN need USING (rule, n))
  SELECT doc_id, min(rule) AS rule FROM m WHERE (doc_id, pos, rule) NOT IN (SELECT (doc_id, pos, rule) FROM h WHERE part = 'never') GROUP BY doc_id
""",
)
def first_rule(spark: SparkSession, d: str) -> DataFrame:
    """The first rule, by name, that a sentence of a document meets."""
    made = rules_table(spark)
    order = made.select("rule", F.col("rule").alias("rule_order")).distinct()
    return rules.first_rules(table(spark, d, "documents"), "doc_id", "text", made, order)


#: Seconds of a scene, and the characters from which it is cut.
SCENE_S, CAP = 7 * 86_400, 240


@query(
    "expanded_scenes",
    f"""
  WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) - 1704067200 AS tt, event_type || ' ' || props AS t FROM events),
  f AS (
    SELECT CAST(user_id AS VARCHAR) || '-w' || CAST(CAST(floor(tt / {SCENE_S}) AS BIGINT) AS VARCHAR) AS scene, user_id, floor(tt / {SCENE_S}) * {SCENE_S} AS "start", tt, event_id,
      '[' || printf('%.3f', tt) || '] ' || t AS line FROM e),
  n AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY tt, event_id) AS place, count(*) OVER (PARTITION BY scene) AS total, sum(length(line) + 1) OVER (PARTITION BY scene) + {len(expansion.HEAD)} AS size FROM f),
  r AS (
    SELECT scene, place, total, 1 AS piece, length(line) AS used FROM n WHERE place = 1 AND size > {CAP}
    UNION ALL
    SELECT n.scene, n.place, n.total, CASE WHEN r.used + 1 + length(n.line) <= {CAP - len(expansion.HEAD) - 1} THEN r.piece ELSE r.piece + 1 END,
      CASE WHEN r.used + 1 + length(n.line) <= {CAP - len(expansion.HEAD) - 1} THEN r.used + 1 + length(n.line) ELSE length(n.line) END
    FROM r JOIN n ON n.scene = r.scene AND n.place = r.place + 1),
  w AS (SELECT scene, any_value(user_id) AS record, any_value("start") AS "start", count(*) AS frames, '{expansion.HEAD}' || chr(10) || string_agg(line, chr(10) ORDER BY place) AS text FROM n GROUP BY scene),
  c AS (SELECT r.scene, r.piece, count(*) AS frames, '{expansion.HEAD}' || chr(10) || string_agg(n.line, chr(10) ORDER BY n.place) AS text FROM r JOIN n ON n.scene = r.scene AND n.place = r.place GROUP BY r.scene, r.piece),
  k AS (SELECT scene, count(*) AS pieces FROM c GROUP BY scene)
  SELECT scene AS id, NULL AS parent, CASE WHEN length(text) > {CAP} THEN 'parent' ELSE 'scene' END AS kind, record, CAST("start" AS BIGINT) AS "start", NULL AS piece, NULL AS pieces, CAST(frames AS INTEGER) AS frames, sha256(text) AS text_sha256 FROM w
  UNION ALL
  SELECT c.scene || '-' || lpad(CAST(piece AS VARCHAR), 4, '0'), c.scene, 'piece', w.record, CAST(w."start" AS BIGINT), CAST(piece AS INTEGER), CAST(pieces AS INTEGER), CAST(c.frames AS INTEGER), sha256(c.text) FROM c JOIN w USING (scene) JOIN k USING (scene)
""",
)
def expanded_scenes(spark: SparkSession, d: str) -> DataFrame:
    """A user's week is a scene and each of its events a frame; scenes of over 240 characters are cut into pieces of whole frames."""
    e = events(spark, d)
    week = F.floor(F.col("at") / SCENE_S)
    f = e.select(F.col("event_id").alias("frame"), F.concat(F.col("user_id").cast("string"), F.lit("-w"), week.cast("string")).alias("scene"), F.col("user_id").alias("record"), (week * SCENE_S).alias("start"), "at", F.concat("event_type", F.lit(" "), "props").alias("text"))
    line = F.struct("at", "frame", expansion.frame_line(F.col("at"), F.col("text")).alias("line"))
    text = F.concat(F.lit(expansion.HEAD + "\n"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n"))
    scenes = f.groupBy("scene", "record", "start").agg(text.alias("text")).withColumn("end", F.col("start") + SCENE_S)
    out = expansion.expanded(scenes, f.select("frame", "scene", "record", "at", "text"), CAP)
    return out.select("id", "parent", "kind", "record", F.col("start").cast("long").alias("start"), "piece", "pieces", "frames", F.sha2("text", 256).alias("text_sha256"))


#: Turns of a block, turns kept back and bytes of a state, for the short conversations here.
FOLD = (2, 1, 160)


ROLLING_SQL = rf"""
  n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_id) AS nth, count(*) OVER (PARTITION BY conv_id) AS total FROM p),
  b AS (
    SELECT conv_id, (nth - 1) // {FOLD[0]} AS block, turn_id, CASE WHEN trim(regexp_replace(question, '\s+', ' ', 'g')) <> '' THEN '[turn=' || turn_id || '] ' || left(trim(regexp_replace(question, '\s+', ' ', 'g')), {rolling.SHOWN}) END AS line
    FROM n WHERE nth <= total - {FOLD[1]}),
  u AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY conv_id, block ORDER BY turn_id DESC) AS used FROM b),
  g AS (SELECT conv_id, block, list_filter(list(CASE WHEN used <= {FOLD[2] // 2} THEN line END ORDER BY turn_id), lambda x: x IS NOT NULL) AS l FROM u GROUP BY conv_id, block),
  f AS (
    SELECT conv_id, block, l AS state FROM g WHERE block = 0
    UNION ALL
    SELECT g.conv_id, g.block, list_concat(
      list_transform(list_filter(range(1, len(f.state) + 1), lambda i: list_sum(list_transform(f.state[i:], lambda x: strlen(x) + 1)) <= {FOLD[2]} - coalesce(list_sum(list_transform(g.l, lambda x: strlen(x) + 1)), 0)), lambda i: f.state[i]), g.l)
    FROM f JOIN g ON g.conv_id = f.conv_id AND g.block = f.block + 1)
"""


@query(
    "rolling_summary",
    f"""
  WITH RECURSIVE {PAIRS_SQL}, {ROLLING_SQL}
  SELECT conv_id, CAST(max(block) + 1 AS INTEGER) AS blocks, arg_max(array_to_string(state, chr(10)), block) AS text FROM f GROUP BY conv_id
""",
)
def rolling_summary(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's users' words but the last, folded two turns at a time into 160 bytes."""
    block, keep, budget = FOLD
    rows = rolling.lines(rolling.blocks(sessions.paired(table(spark, d, "conversations")), "conv_id", block, keep), budget)
    return rolling.summaries(rolling.folded(rows, budget=budget)).select(F.col("session").cast("long").alias("conv_id"), "blocks", "text")
