"""Provenance and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions import excerpts
from weft.functions import text as tx
from weft.operators import cases, evidence, ranking, requests
from weft.plans.catalog import query, table

CITE = "list_filter(list_distinct(regexp_extract_all(lower({}), '[a-z0-9]{{3,}}')), lambda x: NOT list_contains(['the', 'and', 'with', 'this', 'that', 'from', 'into', 'your', 'for', 'air', 'fryer', 'device', 'appliance', 'control', 'panel', 'button'], x))"
#: Synthetic evaluation rows: each labelled document is a case, its source the strategy.
ROWS_SQL = "r AS (SELECT l.doc_id AS case_, source AS strategy, lang AS category, quality = 1 AS passed, toxic = 1 AS degraded, CASE WHEN l.doc_id % 10 > 0 THEN CAST(n_chars AS DOUBLE) END AS ms FROM labels l JOIN documents USING (doc_id))"


def rows(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return r.select(
        F.col("doc_id").alias("case_"), F.col("source").alias("strategy"), F.col("lang").alias("category"), (F.col("quality") == 1).alias("passed"), (F.col("toxic") == 1).alias("degraded"), F.when(F.col("doc_id") % 10 > 0, F.col("n_chars").cast("double")).alias("ms")
    )


@query(
    "citation_support",
    f"""
  WITH t AS (SELECT doc_id, source, {CITE.format("text")} AS t FROM documents),
  n AS (SELECT *, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS after FROM t)
  SELECT a.doc_id, e.doc_id AS backed_by FROM n a JOIN t e ON e.doc_id = a.after
  WHERE len(a.t) > 0 AND len(list_intersect(a.t, e.t)) >= CASE WHEN len(a.t) <= 2 THEN 1 ELSE 2 END AND len(list_intersect(a.t, e.t)) >= 0.25 * len(a.t)
""",
)
def citation_support(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the next one of their source backs as a whole."""
    ids = table(spark, d, "documents").select("doc_id", F.lead("doc_id").over(W.partitionBy("source").orderBy("doc_id")).alias("after"))
    t = table(spark, d, "documents").select("doc_id", tx.citation_tokens(F.col("text")).alias("t"))
    e = t.select(F.col("doc_id").alias("after"), F.col("t").alias("e"))
    rows = ids.filter("after IS NOT NULL").join(t, "doc_id").join(e, "after")
    return rows.filter(evidence.supported(F.col("t"), F.col("e"))).select("doc_id", F.col("after").alias("backed_by"))


@query(
    "sentence_citations",
    rf"""
  WITH a AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
  x AS (SELECT conv_id, list_filter(list_transform(regexp_extract_all(answer, '[^.!?。！？\n]+(?:[.!?。！？](?:[ \t]*\[VID:[A-Za-z0-9._:-]+\])*)?'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM a),
  s AS (SELECT conv_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos FROM x), st AS (SELECT *, {CITE.format("sentence")} AS t FROM s), e AS (SELECT conv_id, turn, {CITE.format("text")} AS t FROM conversations WHERE role = 'user'),
  h AS (SELECT st.conv_id, pos, sentence, CASE WHEN len(st.t) > 0 AND len(list_intersect(st.t, e.t)) >= CASE WHEN len(st.t) <= 2 THEN 1 ELSE 2 END AND len(list_intersect(st.t, e.t)) >= 0.25 * len(st.t) THEN turn END AS turn FROM st LEFT JOIN e USING (conv_id))
  SELECT conv_id, CAST(pos AS INTEGER) AS pos, sentence, CAST(to_json(coalesce(list(DISTINCT turn ORDER BY turn) FILTER (turn IS NOT NULL), [])) AS VARCHAR) AS supports FROM h GROUP BY conv_id, pos, sentence
""",
)
def sentence_citations(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of assistants' answers with the user turns that back them."""
    c = table(spark, d, "conversations")
    a = c.filter("role = 'assistant'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("answer"))
    e = c.filter("role = 'user'").select("conv_id", "turn", "text")
    return evidence.citations(a, e, "conv_id", "answer", "turn", "text").select("conv_id", "pos", "sentence", F.to_json("supports").alias("supports"))


@query(
    "quote_containment",
    """
  WITH q AS (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN text[5:25] ELSE 'not said' END AS quote FROM conversations)
  SELECT q.conv_id, q.turn, q.role, q.quote, coalesce(contains(c.text, q.quote) AND trim(q.quote) <> '', FALSE) AS ok FROM q LEFT JOIN conversations c USING (conv_id, turn)
""",
)
def quote_containment(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    q = c.select("conv_id", "turn", "role", F.when(F.col("turn") % 2 == 0, F.substring("text", 5, 21)).otherwise("not said").alias("quote"))
    return evidence.quotes_hold(q, c, ["conv_id", "turn"], "quote", "text", "role")


@query(
    "strategy_summary",
    f"""
  WITH {ROWS_SQL}
  SELECT strategy, count(*) AS tasks, count(*) FILTER (passed) AS rule_passed, count(*) FILTER (passed AND NOT degraded) AS normal_passed, count(*) FILTER (passed AND degraded) AS degraded_passed,
    count(*) FILTER (degraded) AS degraded, count(*) FILTER (ms IS NULL) AS missing_ms, quantile_disc(ms, 0.5) AS p50_ms, quantile_disc(ms, 0.95) AS p95_ms, median(ms) AS median_ms FROM r GROUP BY strategy
""",
)
def strategy_summary(spark: SparkSession, d: str) -> DataFrame:
    return evidence.strategy_summary(rows(spark, d), ["strategy"])


@query(
    "category_summary",
    f"""
  WITH {ROWS_SQL}
  SELECT category, strategy, count(*) AS tasks, count(*) FILTER (passed) AS rule_passed, count(*) FILTER (passed AND NOT degraded) AS normal_passed, count(*) FILTER (passed AND degraded) AS degraded_passed,
    count(*) FILTER (degraded) AS degraded, count(*) FILTER (ms IS NULL) AS missing_ms, quantile_disc(ms, 0.5) AS p50_ms, quantile_disc(ms, 0.95) AS p95_ms, median(ms) AS median_ms FROM r GROUP BY category, strategy
""",
)
def category_summary(spark: SparkSession, d: str) -> DataFrame:
    return evidence.strategy_summary(rows(spark, d), ["category", "strategy"])


@query(
    "nearest_rank_percentile",
    f"""
  WITH {ROWS_SQL}, l AS (SELECT strategy, list(ms ORDER BY ms) FILTER (ms IS NOT NULL) AS l FROM r GROUP BY strategy)
  SELECT strategy, l[greatest(least(CAST(floor(len(l) * 0.95 + 0.999) AS INTEGER), len(l)), 1)] AS p95 FROM l
""",
)
def nearest_rank_percentile(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).groupBy("strategy").agg(evidence.nearest_rank("ms", 0.95).alias("p95"))


@query("majority_vote", "SELECT source, CAST(avg(toxic) >= 0.5 AS INTEGER) AS vote, count(toxic) AS valid FROM labels JOIN documents USING (doc_id) GROUP BY source")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return evidence.majority(table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id"), "source", "toxic")


@query(
    "grade_distribution",
    """
  WITH g AS (SELECT lang, CAST(quality + toxic AS INTEGER) AS grade FROM labels JOIN documents USING (doc_id)), k AS (SELECT DISTINCT lang, unnest([0, 1, 2, 3]) AS grade FROM g)
  SELECT k.lang, CAST(k.grade AS INTEGER) AS grade, count(g.grade) AS n FROM k LEFT JOIN g ON k.lang = g.lang AND k.grade = g.grade GROUP BY k.lang, k.grade
""",
)
def grade_distribution(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("lang", (F.col("quality") + F.col("toxic")).cast("int").alias("grade"))
    return evidence.grade_distribution(g, ["lang"], "grade")


@query(
    "rule_scores",
    r"""
  WITH p AS (SELECT doc_id, lower(regexp_replace(text, '\s+', '', 'g')) AS t FROM documents)
  SELECT doc_id, (contains(t, 'tion') OR contains(t, 'heit')) AND (contains(t, 'the') OR contains(t, 'der')) AND NOT contains(t, 'token=') AS passed FROM p
""",
)
def rule_scores(spark: SparkSession, d: str) -> DataFrame:
    """Answers that hold a term of each group and no forbidden one."""
    groups = F.array(F.array(F.lit("tion"), F.lit("heit")), F.array(F.lit("The"), F.lit("der")))
    return table(spark, d, "documents").select("doc_id", evidence.rule_score(F.col("text"), groups, F.array(F.lit("token ="))).alias("passed"))


@query(
    "paired_differences",
    f"""
  WITH {ROWS_SQL}, c AS (SELECT case_ % 97 AS case_, strategy, max(CAST(passed AS INTEGER)) AS v FROM r GROUP BY ALL)
  SELECT a.case_, CAST(a.v - b.v AS DOUBLE) AS difference FROM c a JOIN c b USING (case_) WHERE a.strategy = 'src1' AND b.strategy = 'src2'
""",
)
def paired_differences(spark: SparkSession, d: str) -> DataFrame:
    c = rows(spark, d).groupBy((F.col("case_") % 97).alias("case_"), "strategy").agg(F.max(F.col("passed").cast("int")).alias("v"))
    return evidence.paired_differences(c, "case_", "strategy", "v", "src1", "src2")


@query(
    "paired_cases",
    """
  WITH r AS (SELECT lang, source AS strategy, quality, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM documents JOIN labels USING (doc_id))
  SELECT a.lang || ':' || a.n AS case_, CAST(a.quality - b.quality AS DOUBLE) AS difference FROM r a JOIN r b USING (lang, n) WHERE a.strategy = 'src1' AND b.strategy = 'src2'
""",
)
def paired_cases(spark: SparkSession, d: str) -> DataFrame:
    """Two sources' labelled documents of a language, paired by their place: the cases grow with the documents."""
    r = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    r = ranking.ranked(r, ["lang", "source"], [F.col("doc_id")], "n")
    r = r.select(F.concat_ws(":", "lang", "n").alias("case_"), "source", "quality")
    return evidence.paired_differences(r, "case_", "source", "quality", "src1", "src2")


@query("paired_bootstrap")
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Resampled gains of each language's documents, quality against toxicity."""
    r = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    diffs = r.select("lang", F.col("doc_id").alias("case"), (F.col("quality") - F.col("toxic")).cast("double").alias("difference"))
    return evidence.paired_bootstrap(diffs, "lang", draws=2000)


@query("task_matrix", "SELECT item_id, strategy FROM benchmark, (SELECT unnest(['window', 'rolling', 'structured', 'collapsed', 'traversal']) AS strategy)")
def task_matrix(spark: SparkSession, d: str) -> DataFrame:
    return evidence.task_matrix(table(spark, d, "benchmark").select("item_id"), ["window", "rolling", "structured", "collapsed", "traversal"])


@query("blind_review", "SELECT doc_id, sha256('v1|' || doc_id || '|' || source)[1:24] AS blind_id FROM documents")
def blind_review(spark: SparkSession, d: str) -> DataFrame:
    return evidence.blind_ids(table(spark, d, "documents").select("doc_id", "source"), ["doc_id", "source"], "v1").select("doc_id", "blind_id")


@query(
    "journal_merge",
    """
  WITH j AS (SELECT doc_id, doc_id % 3 AS journal, quality AS sig FROM labels UNION ALL SELECT doc_id, 9, quality FROM labels WHERE doc_id % 11 = 0)
  SELECT 'missing' AS problem, CAST(doc_id AS VARCHAR) AS key FROM documents ANTI JOIN j USING (doc_id)
  UNION ALL SELECT 'shared', CAST(doc_id AS VARCHAR) FROM j GROUP BY doc_id HAVING count(DISTINCT journal) > 1
  UNION ALL SELECT 'signatures', CAST(count(DISTINCT sig) AS VARCHAR) FROM j HAVING count(DISTINCT sig) > 1
""",
)
def journal_merge(spark: SparkSession, d: str) -> DataFrame:
    """What keeps label journals (a third each, one overlapping) from being one complete pool."""
    lab = table(spark, d, "labels")
    j = lab.select("doc_id", (F.col("doc_id") % 3).alias("journal"), F.col("quality").alias("sig")).unionByName(lab.filter("doc_id % 11 = 0").select("doc_id", F.lit(9).cast("long").alias("journal"), F.col("quality").alias("sig")))
    return evidence.journal_problems(j, table(spark, d, "documents").select("doc_id"), "doc_id", "journal", "sig")


@query(
    "json_validate",
    """
  SELECT event_id, CASE WHEN NOT json_valid(props) THEN 'json' ELSE concat_ws(',', CASE WHEN NOT coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT) >= 10, FALSE) THEN 'small' END, CASE WHEN NOT coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0, FALSE) THEN 'odd' END) END AS violations FROM events
""",
)
def json_validate(spark: SparkSession, d: str) -> DataFrame:
    found = evidence.json_violations(tx.first_json(F.col("props")), "k bigint", [("small", lambda v: v["k"] >= 10), ("odd", lambda v: v["k"] % 2 == 0)])
    return table(spark, d, "events").select("event_id", F.array_join(found, ",").alias("violations"))


@query(
    "attempt_ledger",
    "SELECT lang, CAST(sum(len(string_split(text, chr(10))) + length(source)) AS BIGINT) AS attempts, sum(len(string_split(text, chr(10))) + length(source)) <= 2000 AS within FROM documents GROUP BY lang",
)
def attempt_ledger(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.create_map(F.lit("lines"), F.size(F.split("text", "\n")).cast("long"), F.lit("name"), F.length("source").cast("long"))
    return evidence.ledger(table(spark, d, "documents").select("lang", kinds.alias("kinds")), "lang", "kinds", 2000)


@query(
    "exclusion_rules",
    """
  WITH r(rule, rule_order, pattern) AS (VALUES ('license', 0, 'Licen[sc]e'), ('token', 1, 'token = '), ('digits', 2, '[0-9]{6}'))
  SELECT doc_id, arg_min(rule, rule_order) AS rule FROM documents JOIN r ON regexp_matches(text, pattern) GROUP BY doc_id
""",
)
def exclusion_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("license", 0, "Licen[sc]e"), ("token", 1, "token = "), ("digits", 2, "[0-9]{6}")], "rule string, rule_order int, pattern string")
    return evidence.first_exclusion(table(spark, d, "documents"), "doc_id", "text", rules)


@query(
    "scoped_claims",
    f"""
  WITH c AS (SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)license') THEN 'license' WHEN turn % 11 = 3 THEN 'turn' END AS reason, regexp_matches(text, '^[TA]') AS instruction FROM conversations),
  b AS (SELECT DISTINCT conv_id FROM c WHERE reason IS NOT NULL AND instruction)
  SELECT c.conv_id, turn, coalesce(reason, CASE WHEN b.conv_id IS NOT NULL THEN '{evidence.REVALIDATE}' END) AS reason FROM c LEFT JOIN b USING (conv_id)
""",
)
def scoped_claims(spark: SparkSession, d: str) -> DataFrame:
    """Turns as claims (with made-up reasons and instructions): a rejected instruction empties its conversation."""
    reason = F.when(F.col("text").rlike("(?i)license"), "license").when(F.col("turn") % 11 == 3, "turn")
    c = table(spark, d, "conversations").select("conv_id", "turn", reason.alias("reason"), F.col("text").rlike("^[TA]").alias("instruction"))
    return evidence.scoped_claims(c, "conv_id", "reason", "instruction").select("conv_id", "turn", "reason")


@query(
    "cited_scenes",
    rf"""
  WITH a AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[^.!?。！？\n]+'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM conversations WHERE role = 'assistant'),
  s AS (SELECT conv_id, turn, unnest(ss) AS body, generate_subscripts(ss, 1) - 1 AS pos FROM a),
  t AS (SELECT *, list_distinct([CAST(turn - 1 AS VARCHAR), CAST(pos % 3 AS VARCHAR)]) AS named, {CITE.format("body")} AS w FROM s),
  e AS (SELECT conv_id, CAST(turn AS VARCHAR) AS tag, {CITE.format("text")} AS w FROM conversations WHERE role = 'user'),
  n AS (SELECT conv_id, turn, pos, body, w, unnest(named) AS tag FROM t),
  h AS (SELECT n.conv_id, n.turn, n.pos, n.body, n.tag, len(n.w) > 0 AND len(list_intersect(n.w, e.w)) >= CASE WHEN len(n.w) <= 2 THEN 1 ELSE 2 END AND len(list_intersect(n.w, e.w)) >= 0.25 * len(n.w) AS ok FROM n LEFT JOIN e USING (conv_id, tag))
  SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, coalesce(string_agg(tag, ',' ORDER BY tag) FILTER (ok), '') AS cited FROM h GROUP BY conv_id, turn, pos
""",
)
def cited_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of assistants' answers, each tagged (made up) with the turn before the answer and one of the first three; user turns are the scenes."""
    c = table(spark, d, "conversations")
    a = c.filter("role = 'assistant'").select("conv_id", "turn", F.filter(F.transform(tx.matches(F.col("text"), r"[^.!?。！？\n]+"), lambda s: F.trim(s)), lambda s: s != "").alias("ss"))
    tag = lambda x: F.concat(F.lit(" [VID:"), x.cast("string"), F.lit("]"))
    told = F.array_join(F.transform("ss", lambda s, i: F.concat(s, F.lit("."), tag(F.col("turn") - 1), tag(i % 3))), "\n")
    key = F.struct("conv_id", "turn")
    answers = a.select(key.alias("at"), told.alias("answer"))
    users = c.filter("role = 'user'").select("conv_id", F.col("turn").alias("scene"), "text")
    scenes = a.select("conv_id", "turn").join(users, "conv_id").select(key.alias("at"), "scene", "text")
    return evidence.cited_scenes(answers, scenes, "at", "answer", "scene", "text").select("at.conv_id", "at.turn", "pos", F.array_join("cited", ",").alias("cited"))


@query(
    "bounded_evidence",
    """
  WITH f AS (SELECT * FROM (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS n FROM documents) WHERE n = 1),
  b AS (SELECT source, doc_id, text, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) - length(text) AS before FROM f)
  SELECT source, doc_id, sha256(text[1:CAST(6000 - before AS INTEGER)]) AS mark FROM b WHERE before < 6000 AND length(text) > 0
""",
)
def bounded_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Each source's different texts in order, cut at 6000 characters together."""
    hits = table(spark, d, "documents").select("source", "doc_id", "text").withColumn("key", F.col("text"))
    return evidence.bounded_evidence(hits, "source", ["key"], "doc_id", "text").select("source", "doc_id", tx.digest(F.col("text")).alias("mark"))


@query(
    "expanded_sections",
    """
  WITH h AS (SELECT user_id, event_id, event_type FROM events), c AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS r FROM h GROUP BY user_id, event_type)
  SELECT h.user_id, h.event_id, h.event_type, r <= 2 AS expanded FROM h JOIN c USING (user_id, event_type)
""",
)
def expanded_sections(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return evidence.expanded_sections(hits, "user_id", "event_type", "event_id").select("user_id", "event_id", "event_type", "expanded")


@query("text_excerpts")
def text_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Every document shortened to 400 characters by its ends, by its important sentences, and to 300 bytes."""
    t = F.col("text")
    cut = [excerpts.column(f, t, n).alias(name) for f, n, name in ((excerpts.excerpt, 400, "ends"), (excerpts.observe, 400, "sentences"), (excerpts.fit, 300, "bytes"))]
    return table(spark, d, "documents").select("doc_id", *cut)


#: A conversation as a request: every fourth turn makes a tool call that the next one answers.
MESSAGES_SQL = """
  m AS (
    SELECT conv_id AS request, turn AS pos, CASE turn % 4 WHEN 1 THEN 'assistant' WHEN 2 THEN 'tool' ELSE CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END END AS role, coalesce(text, '') AS text,
      CASE WHEN turn % 4 = 1 THEN 'c' || turn END AS call, CASE WHEN turn % 4 = 2 THEN 'c' || (turn - 1) END AS answers FROM conversations),
  z AS (SELECT *, strlen('{"role":"","content":""}') + strlen(role) + strlen(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't'))
      + CASE WHEN call IS NOT NULL THEN strlen(',"tool_calls":[""]') + strlen(call) ELSE 0 END + CASE WHEN answers IS NOT NULL THEN strlen(',"tool_call_id":""') + strlen(answers) ELSE 0 END + 1 AS bytes FROM m),
  u AS (SELECT request, arg_min(text, pos) AS a, arg_max(text, pos) AS b FROM z WHERE role = 'user' AND text <> '' GROUP BY request),
  k AS (SELECT z.*, coalesce(contains(text, a) OR contains(text, b), FALSE) AS kept FROM z LEFT JOIN u USING (request)),
  o0 AS (SELECT request, sum(bytes) AS before, sum(bytes) + 200 - 1500 AS over FROM k GROUP BY request)"""


@query(
    "request_budget",
    f"""
  WITH {MESSAGES_SQL},
  t AS (SELECT request, pos, lead(pos) OVER (PARTITION BY request ORDER BY pos) AS until, call, bytes, kept, max(CASE WHEN call IS NOT NULL THEN pos END) OVER (PARTITION BY request) AS last FROM k WHERE role = 'assistant'),
  e0 AS (SELECT t.request, t.pos AS call, r.pos AS reply, t.bytes + r.bytes AS freed FROM t JOIN k r ON r.request = t.request AND r.role = 'tool' AND r.answers = t.call AND r.pos > t.pos AND (until IS NULL OR r.pos < until) WHERE t.call IS NOT NULL AND t.pos < last AND NOT t.kept),
  e AS (SELECT * FROM (SELECT *, coalesce(sum(freed) OVER (PARTITION BY request ORDER BY call ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM e0) JOIN o0 USING (request) WHERE over - b > 0),
  gone AS (SELECT request, call AS pos FROM e UNION SELECT request, reply FROM e),
  o1 AS (SELECT request, before, o0.over AS was, o0.over - coalesce((SELECT sum(freed) FROM e WHERE e.request = o0.request), 0) AS over FROM o0),
  l0 AS (SELECT request, pos, length(text) AS chars, strlen(text) AS size FROM k WHERE role = 'tool' AND NOT kept AND (request, pos) NOT IN (SELECT (request, pos) FROM gone) AND strlen(text) > 512),
  l1 AS (SELECT *, coalesce(sum(size - 256) OVER (PARTITION BY request ORDER BY chars DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM l0),
  l AS (SELECT request, pos, size - greatest(256, size - (over - b) - 128) AS freed FROM l1 JOIN o1 USING (request) WHERE over - b > 0),
  o2 AS (SELECT request, before, was, over - coalesce((SELECT sum(freed) FROM l WHERE l.request = o1.request), 0) AS over FROM o1),
  p0 AS (SELECT request, pos, bytes AS freed FROM k WHERE role IN ('user', 'assistant') AND call IS NULL AND NOT kept AND (request, pos) NOT IN (SELECT (request, pos) FROM gone)),
  p AS (SELECT * FROM (SELECT *, coalesce(sum(freed) OVER (PARTITION BY request ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p0) JOIN o2 USING (request) WHERE over - b > 0),
  o3 AS (SELECT request, before, was, over - coalesce((SELECT sum(freed) FROM p WHERE p.request = o2.request), 0) AS over FROM o2)
  SELECT request AS conv_id, CAST(before AS BIGINT) AS before, CAST(before - (was - over) AS BIGINT) AS after, (SELECT count(*) FROM e WHERE e.request = o3.request) AS exchanges, (SELECT count(*) FROM l WHERE l.request = o3.request) AS results,
    (SELECT count(*) FROM p WHERE p.request = o3.request) AS messages, over <= 0 AS fits FROM o3
""",
)
def request_budget(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation as a request of 1,300 bytes and its reply; every fourth turn makes a tool call that the next one answers."""
    t = F.col("turn") % 4
    role = F.when(t == 1, "assistant").when(t == 2, "tool").when(F.col("role") == "assistant", "assistant").otherwise("user")
    calls = F.filter(F.array(F.concat(F.lit("c"), F.col("turn").cast("string"))), lambda _: t == 1)
    answers = F.when(t == 2, F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")))
    m = table(spark, d, "conversations").select(F.col("conv_id").alias("request"), F.col("turn").alias("pos"), role.alias("role"), "text", calls.alias("calls"), answers.alias("answers"), F.lit(0).alias("pictures"))
    r = m.select("request").distinct().select("request", F.lit(1500).alias("window"), F.lit(200).alias("reserve"), F.array().cast("array<string>").alias("protected"))
    _, report = requests.planned(m, r)
    return report.select(F.col("request").alias("conv_id"), "before", "after", F.col("exchanges").cast("long").alias("exchanges"), F.col("results").cast("long").alias("results"), F.col("messages").cast("long").alias("messages"), "fits")


@query(
    "case_scores",
    """
  SELECT c || '-' || s || '-' || n AS id, TRUE AS fact, TRUE AS citation, TRUE AS passed
  FROM (SELECT unnest(['goal', 'identifier', 'constraint', 'correction', 'symptom', 'action', 'unknown']) AS c), (SELECT 'development' AS s, unnest(range(2)) AS n UNION ALL SELECT 'test', unnest(range(8)))
""",
)
def case_scores(spark: SparkSession, d: str) -> DataFrame:
    """The synthetic evaluation set answered from its own gold, which must pass."""
    c = cases.dataset(spark)
    said = F.when(F.col("answerable"), F.col("expected")).otherwise("not known")
    value = F.to_json(F.struct(said.alias("answer"), F.col("sources").alias("sources")))
    visible = F.array_join(F.transform("records", lambda r: r["question"]), "\n")
    return cases.scores(c.select("id", value.alias("value"), visible.alias("visible")), c)
