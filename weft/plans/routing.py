"""Routing queries: questions made up from the rows of part, products its names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text as tx
from weft.operators import lexical, ranking, routing
from weft.plans.catalog import query, table
from weft.plans.retrieval import BM25_SQL, GRAMS, K, STOP, cosines, recalled

#: A question for each part, in words that Spark and DuckDB both understand.
QUESTION = """CASE p_partkey % 8 WHEN 0 THEN concat('How do I clean the ', p_name, '?') WHEN 1 THEN concat('Is the ', replace(p_name, ' ', ''), ' in stock, what is the price')
  WHEN 2 THEN concat(upper(p_name), ' jet tool for my smart phone') WHEN 3 THEN concat(p_brand, ' spare part: loop, winch') WHEN 4 THEN concat('where is the sound system of ', p_type)
  WHEN 5 THEN concat('产品', p_name, '故障 error') WHEN 6 THEN concat('jet tool or ring of size ', p_size) ELSE concat('order and refund of the cordless phone, ', p_type) END"""
PHONE = (r"\b(my|cell|smart|mobile)\s*phone|smartphone", "landline|cordless|handset|base station")
NICKNAMES = [("hot gear", r"\bjet tool\b"), ("small ring", r"\bjet\b"), ("small ring", r"\bfax machine\b")]
FUNCTIONAL = [(0, "sound system", "blue bolt"), (1, "stock", "hot gear")]
MANUALS = [("red widget", "The spare part loop winch of it, how to mount the thing"), ("hot gear", "The thing and the loop, how to mount"), ("blue bolt", "Loop and winch apart")]
WEAK, GENERIC = ["bolt"], ["ring", "phone"]
#: Products of the votes that an answer shows.
TOP = 3
QS = f"qs AS (SELECT p_partkey AS q, {QUESTION} AS question FROM part)"


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("q"), F.expr(QUESTION).alias("question"))


def names(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "part").select(F.col("p_name").alias("product"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("unless"), F.lit(None).cast("string").alias("but")).distinct()
    return own.unionByName(spark.createDataFrame([("Phone", "Phone", *PHONE), ("产品手册", "产品", None, None)], own.schema))


def aliases(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "part").select(F.col("p_name").alias("product"), F.array(F.split("p_name", " ")[1]).alias("given")).distinct()
    return own.unionByName(spark.createDataFrame([("Phone", ["电话 ", ""]), ("空调手册", ["制冷", "AC Unit"])], own.schema))


NAMES_SQL = f"""
  names AS (SELECT DISTINCT p_name AS product, p_name AS name, CAST(NULL AS VARCHAR) AS un, CAST(NULL AS VARCHAR) AS but FROM part UNION ALL VALUES {values([("Phone", "Phone", *PHONE), ("产品手册", "产品", None, None)])}),
  disp AS (
    SELECT q, product, max(len) AS length FROM (
      SELECT q, product, CASE WHEN regexp_matches(lower(name), '[一-鿿]') THEN CASE WHEN contains(question, name) THEN length(name) END
        WHEN regexp_matches(lower(question), '(^|[^a-z0-9])' || regexp_escape(lower(name)) || '($|[^a-z0-9])') THEN length(name)
        WHEN contains(name, ' ') AND regexp_matches(lower(question), '(^|[^a-z0-9])' || regexp_escape(replace(lower(name), ' ', '')) || '($|[^a-z0-9])') THEN length(replace(name, ' ', '')) END AS len
      FROM qs, names WHERE NOT coalesce(regexp_matches(lower(question), un) AND NOT coalesce(regexp_matches(lower(question), but), FALSE), FALSE)) WHERE len IS NOT NULL GROUP BY q, product)
"""
ALIAS_SQL = """
  given AS (SELECT DISTINCT p_name AS product, [string_split(p_name, ' ')[2]] AS g FROM part UNION ALL VALUES ('Phone', ['电话 ', '']), ('空调手册', ['制冷', 'AC Unit'])),
  al AS (
    SELECT DISTINCT product, unnest([a, lower(a)]) AS alias FROM (
      SELECT product, product AS a FROM given UNION ALL SELECT product, regexp_extract(product, '^(.*)手册$', 1) FROM given UNION ALL SELECT product, trim(unnest(g)) FROM given) WHERE a <> '')
"""


@query("product_aliases", f"WITH {ALIAS_SQL} SELECT product, string_agg(alias, '|' ORDER BY length(alias) DESC, alias) AS aliases, trim(product || chr(10) || string_agg(alias, ' ' ORDER BY length(alias) DESC, alias) || chr(10) || string_agg(alias, ' ' ORDER BY length(alias) DESC, alias)) AS doc, trim(replace(lower(product), '手册', '')) AS plain FROM al GROUP BY product")
def product_aliases(spark: SparkSession, d: str) -> DataFrame:
    rows = aliases(spark, d).withColumn("a", routing.alias_list(F.col("product"), F.col("given")))
    return rows.select("product", F.array_join("a", "|").alias("aliases"), routing.alias_document(F.col("product"), F.col("a")).alias("doc"), routing.normalised_name(F.col("product")).alias("plain"))


@query("display_match", f"WITH {QS}, {NAMES_SQL} SELECT q, product, CAST(length AS INTEGER) AS length FROM disp")
def display_match(spark: SparkSession, d: str) -> DataFrame:
    return routing.display_matches(questions(spark, d), names(spark, d))


NICK_SQL = f"nick AS (SELECT q, product, max(length(regexp_extract(lower(question), pattern, 0))) AS length FROM qs JOIN (VALUES {values(NICKNAMES)}) n(product, pattern) ON regexp_matches(lower(question), pattern) GROUP BY q, product)"


@query("nickname_match", f"WITH {QS}, {NICK_SQL} SELECT q, product, CAST(length AS INTEGER) AS length FROM nick")
def nickname_match(spark: SparkSession, d: str) -> DataFrame:
    return routing.nickname_matches(questions(spark, d), spark.createDataFrame(NICKNAMES, "product string, pattern string"))


NAMED_SQL = f"""
  a AS (SELECT DISTINCT product, lower(alias) AS alias FROM al WHERE lower(alias) NOT IN ({", ".join(f"'{w}'" for w in WEAK)})),
  named AS (
    SELECT q, product, alias, length(alias) AS length, alias = lower(product) AS exact FROM (
      SELECT q, product, alias, row_number() OVER (PARTITION BY q, product ORDER BY length(alias) DESC, alias DESC) AS n FROM qs JOIN a ON contains(lower(question), alias)) WHERE n = 1)
"""


@query("alias_match", f"WITH {QS}, {ALIAS_SQL}, {NAMED_SQL} SELECT q, product, alias, CAST(length AS INTEGER) AS length, exact FROM named")
def alias_match(spark: SparkSession, d: str) -> DataFrame:
    return routing.alias_matches(questions(spark, d), alias_rows(spark, d), WEAK)


def alias_rows(spark: SparkSession, d: str) -> DataFrame:
    return aliases(spark, d).select("product", F.explode(routing.alias_list(F.col("product"), F.col("given"))).alias("alias"))


def voted(spark: SparkSession, d: str) -> DataFrame:
    """Made-up votes of the content: parts of a size and brand that the question's number names. Questions that name the same have the same votes, so those that can be shown are picked before the join."""
    part = table(spark, d, "part").groupBy("p_size", "p_brand", F.col("p_name").alias("product")).agg(F.count("*").alias("votes"))
    part = routing.dimension(ranking.top_k(part, ["p_size", "p_brand"], "votes", "product", TOP), "merge")
    asked = questions(spark, d).filter("q % 3 = 0").select("q", (F.col("q") % 50 + 1).cast("int").alias("p_size"), F.concat(F.lit("Brand#"), (F.col("q") % 5).cast("string")).alias("p_brand"))
    return asked.join(part, ["p_size", "p_brand"]).select("q", "product", "votes")


def grepped(spark: SparkSession, d: str) -> DataFrame:
    manuals = spark.createDataFrame(MANUALS, "product string, text string")
    asked = questions(spark, d).select("q", F.explode(lexical.phrases(F.col("question"), STOP)).alias("p")).filter("p LIKE '% %' OR length(p) >= 5")
    held = manuals.select("product", F.explode(lexical.phrases(F.col("text"))).alias("p")).distinct()
    asked = asked.join(F.broadcast(held.select("p").distinct()), "p", "left_semi")  # three manuals, whatever is asked
    return lexical.routed(asked, held, "q", "product").select("q", "product")


ROUTE_SQL = f"""
  WITH {QS}, {NAMES_SQL}, {NICK_SQL}, {ALIAS_SQL}, {NAMED_SQL},
  func AS (SELECT q, min_by(product, place) AS product FROM qs JOIN (VALUES {values(FUNCTIONAL)}) f(place, phrase, product) ON contains(lower(question), phrase) GROUP BY q),
  mw AS (SELECT product, regexp_extract_all(lower(text), '[a-z]{{2,}}') AS w FROM (VALUES {values(MANUALS)}) m(product, text)),
  qw AS (SELECT q, list_filter(regexp_extract_all(lower(question), '[a-z]{{2,}}'), lambda x: NOT list_contains({STOP!r}, x)) AS w FROM qs),
  mg AS (SELECT DISTINCT product, unnest({GRAMS}) AS p FROM mw), qg AS (SELECT q, unnest({GRAMS}) AS p FROM qw),
  uniq AS (SELECT p, min(product) AS product FROM mg GROUP BY p HAVING count(*) = 1),
  gv AS (SELECT q, product, sum(2 * len(string_split(p, ' ')) + 1) AS weight FROM qg JOIN uniq USING (p) WHERE contains(p, ' ') OR length(p) >= 5 GROUP BY q, product),
  gr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY weight DESC, product) AS n, lead(weight, 1, 0) OVER (PARTITION BY q ORDER BY weight DESC, product) AS second FROM gv),
  grep AS (SELECT q, product FROM gr WHERE n = 1 AND weight >= 20 AND weight >= 3 * greatest(second, 1)),
  votes AS (SELECT q, b.p_name AS product, count(*) AS votes FROM qs JOIN part b ON b.p_size = q % 50 + 1 AND b.p_brand = 'Brand#' || (q % 5) WHERE q % 3 = 0 GROUP BY q, b.p_name),
  s AS (
    SELECT qs.q, (SELECT list(product ORDER BY length DESC, product) FROM disp x WHERE x.q = qs.q) AS shown, (SELECT product FROM func x WHERE x.q = qs.q) AS other,
      (SELECT list(product ORDER BY length DESC, product) FROM nick x WHERE x.q = qs.q) AS nick, (SELECT product FROM grep x WHERE x.q = qs.q) AS grep,
      (SELECT list(product ORDER BY exact DESC, length DESC, product) FROM named x WHERE x.q = qs.q) AS names, (SELECT list(alias ORDER BY exact DESC, length DESC, product)[1] FROM named x WHERE x.q = qs.q) AS by_,
      (SELECT list(product ORDER BY votes DESC, product)[1:3] FROM votes x WHERE x.q = qs.q) AS content FROM qs),
  r AS (
    SELECT q, CASE WHEN shown IS NOT NULL AND other IS NOT NULL AND other <> shown[1] THEN 'display_vs_functional_divergence' WHEN shown IS NOT NULL THEN 'explicit_product_name' WHEN other IS NOT NULL THEN 'functional_alias'
        WHEN nick IS NOT NULL THEN 'explicit_product_nickname' WHEN grep IS NOT NULL THEN 'phrase_grep_unique'
        WHEN names IS NOT NULL AND content IS NOT NULL AND list_contains(content, names[1]) AND by_ IN ({", ".join(f"'{g}'" for g in GENERIC)}) THEN 'generic_alias_agree'
        WHEN names IS NOT NULL AND content IS NOT NULL AND list_contains(content, names[1]) THEN 'name_and_content_agree' WHEN names IS NOT NULL AND content IS NOT NULL THEN 'name_vs_content_divergence'
        WHEN names IS NOT NULL THEN 'alias_or_name_match' WHEN content IS NOT NULL THEN 'content_vote_only' ELSE 'no_positive_score' END AS reason, shown, other, nick, grep, names, content FROM s)
  SELECT q, reason, CASE WHEN reason = 'no_positive_score' THEN 'none' WHEN reason IN ('explicit_product_name', 'explicit_product_nickname', 'phrase_grep_unique', 'name_and_content_agree', 'alias_or_name_match') THEN 'high' ELSE 'medium' END AS confidence,
    array_to_string(CASE reason WHEN 'display_vs_functional_divergence' THEN [shown[1], other] WHEN 'explicit_product_name' THEN [shown[1]] WHEN 'functional_alias' THEN [other] WHEN 'explicit_product_nickname' THEN [nick[1]]
      WHEN 'phrase_grep_unique' THEN [grep] WHEN 'generic_alias_agree' THEN list_filter([names[1]] || list_filter(content, lambda x: x <> names[1]), lambda x: TRUE)[1:3] WHEN 'name_and_content_agree' THEN [names[1]]
      WHEN 'name_vs_content_divergence' THEN ([names[1]] || content[1:2])[1:3] WHEN 'alias_or_name_match' THEN names[1:3] WHEN 'content_vote_only' THEN content ELSE [] END, '|') AS products,
    CASE WHEN reason IN ('explicit_product_name', 'explicit_product_nickname') THEN coalesce(shown[1], nick[1]) END AS locked FROM r
"""


@query("route_cascade", ROUTE_SQL)
def route_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The decision for every question, stage by stage."""
    qs = questions(spark, d)
    display = routing.display_matches(qs, names(spark, d))
    functional = routing.phrase_matches(qs, spark.createDataFrame(FUNCTIONAL, "place int, phrase string, product string"))
    nicknames = routing.nickname_matches(qs, spark.createDataFrame(NICKNAMES, "product string, pattern string"))
    named = routing.alias_matches(qs, alias_rows(spark, d), WEAK)
    out = routing.route(qs, display, functional, nicknames, grepped(spark, d), named, voted(spark, d), GENERIC, top=TOP)
    return out.select("q", "reason", "confidence", F.array_join("products", "|").alias("products"), routing.locked_product(F.col("reason"), F.col("products")).alias("locked"))


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("q"), F.col("text").alias("question"))


def source_documents(spark: SparkSession, d: str) -> DataFrame:
    """A short text for each source: the first 40 characters of its documents with the least ids."""
    near = ranking.ranked(table(spark, d, "documents").select("source", "doc_id", "text"), ["source"], [F.col("doc_id")], "n").filter("n <= 5")
    said = F.transform(F.array_sort(F.collect_list(F.struct("n", F.left("text", F.lit(40)).alias("t")))), lambda x: x["t"])
    return near.groupBy(F.col("source").alias("product")).agg(F.array_join(said, " ").alias("text"))


TOKEN_LIST = "regexp_extract_all(lower({}), '[a-z0-9][a-z0-9._+/-]*|[一-鿿]+')"
ROUTER_SQL = f"""
  docs AS (SELECT source AS product, string_agg(text[1:40], ' ' ORDER BY doc_id) AS text FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 5 GROUP BY source),
  dt AS (SELECT product, {TOKEN_LIST.format("text")} AS t FROM docs), qt AS (SELECT item_id AS q, {TOKEN_LIST.format("text")} AS t FROM benchmark),
  d AS (SELECT product, len, term, count(*) AS tf FROM (SELECT product, len(t) AS len, unnest(t) AS term FROM dt) GROUP BY ALL), qq AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest(t) AS term FROM qt) GROUP BY ALL),
  s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM dt), w0 AS (SELECT term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS w FROM d, s GROUP BY term),
  w AS (SELECT term, CASE WHEN w < 0 THEN 0.25 * (SELECT avg(w) FROM w0) ELSE w END AS idf FROM w0),
  bm AS (SELECT q, product, sum(times * (idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl)))) AS score FROM d JOIN w USING (term) JOIN qq USING (term), s GROUP BY q, product),
  sh AS (SELECT q, product, count(*) AS n, max(length(term)) AS longest FROM (SELECT DISTINCT product, term FROM d) JOIN (SELECT q, term FROM qq) USING (term) GROUP BY q, product HAVING count(*) >= 2 OR max(length(term)) >= 3),
  sc AS (SELECT q, product, round(score + 0.35 * n, 6) AS score FROM bm JOIN sh USING (q, product) WHERE round(score + 0.35 * n, 6) > 0)
"""


@query("router_bm25", f"WITH {ROUTER_SQL} SELECT q, product, score FROM sc")
def router_bm25(spark: SparkSession, d: str) -> DataFrame:
    return routing.router_scores(items(spark, d), source_documents(spark, d), tx.scene_tokens)


@query(
    "router_decision",
    f"""
  WITH {ROUTER_SQL},
  l AS (SELECT q, list({{'p': product, 's': score}} ORDER BY score DESC, product)[1:3] AS s FROM sc GROUP BY q),
  b AS (SELECT q, s, coalesce(s[1].s, 0) AS best, coalesce(s[1].s, 0) - coalesce(s[2].s, 0) AS gap, s[len(s)].s AS last FROM l),
  v AS (SELECT *, len(s) >= 2 AND best - last < 1.5 AND best < 5 AS vague FROM b)
  SELECT q, CASE WHEN vague THEN 'none' WHEN best >= 3 AND gap >= 1 THEN 'high' WHEN best >= 1.5 THEN 'medium' ELSE 'none' END AS confidence,
    array_to_string(CASE WHEN vague THEN [] WHEN best >= 3 AND gap >= 1 THEN [s[1].p] WHEN best >= 1.5 THEN list_transform(list_filter(s, lambda x: x.s >= greatest(1.0, best * 0.7)), lambda x: x.p) ELSE [] END, '|') AS products, round(best, 6) AS best, round(gap, 6) AS gap FROM v
""",
)
def router_decision(spark: SparkSession, d: str) -> DataFrame:
    out = routing.router_decision(routing.router_scores(items(spark, d), source_documents(spark, d), tx.scene_tokens))
    return out.select("q", "confidence", F.array_join("products", "|").alias("products"), "best", "gap")


CLASS_ALIASES = [("en", "the and"), ("fr", "de la"), ("es", "los las"), ("de", "der die")]
CONTENT_STOP = ["in", "on", "to", "un", "en"]
CONTENT_SQL = f"""
  cl AS (SELECT item_id AS q, product FROM benchmark JOIN (VALUES {values(CLASS_ALIASES)}) a(product, alias) ON contains(lower(text), string_split(alias, ' ')[1])),
  nm AS (SELECT DISTINCT q, unnest({TOKEN_LIST.format("product || ' ' || alias")}) AS term FROM cl JOIN (VALUES {values(CLASS_ALIASES)}) a(product, alias) USING (product)),
  qt AS (SELECT item_id AS q, unnest({TOKEN_LIST.format("text")}) AS term FROM benchmark WHERE item_id IN (SELECT q FROM cl)),
  qq AS (SELECT q, term, count(*) AS times FROM qt WHERE term NOT IN ({", ".join(f"'{s}'" for s in CONTENT_STOP)}) AND (q, term) NOT IN (SELECT (q, term) FROM nm) GROUP BY q, term),
  dt AS (SELECT doc_id AS doc, lang, {TOKEN_LIST.format("text")} AS t FROM documents), d AS (SELECT doc, len, term, count(*) AS tf FROM (SELECT doc, len(t) AS len, unnest(t) AS term FROM dt) GROUP BY ALL),
  s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM dt), w0 AS (SELECT term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS w FROM d, s GROUP BY term),
  w AS (SELECT term, CASE WHEN w < 0 THEN 0.25 * (SELECT avg(w) FROM w0) ELSE w END AS idf FROM w0),
  c AS (
    SELECT q, lang AS product, doc, round(sum(times * (idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl)))), 6) AS score
    FROM d JOIN w USING (term) JOIN qq USING (term) JOIN (SELECT doc, lang FROM dt) USING (doc), s WHERE (q, lang) IN (SELECT (q, product) FROM cl) GROUP BY q, lang, doc)
"""


def content(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("lang").alias("product"), "text")
    known = spark.createDataFrame(CLASS_ALIASES, "product string, alias string")
    asked = items(spark, d)
    classes = asked.join(F.broadcast(known), F.expr("contains(lower(question), split(alias, ' ')[0])")).select("q", "product")
    return routing.content_scores(asked, docs, classes, known, tx.scene_tokens, CONTENT_STOP)


@query("content_relevance", f"WITH {CONTENT_SQL} SELECT q, max(score) AS best, count(*) AS documents FROM c GROUP BY q")
def content_relevance(spark: SparkSession, d: str) -> DataFrame:
    """The best score of each question's words that aren't its products' names, over these products' documents."""
    return content(spark, d).groupBy("q").agg(F.max("score").alias("best"), F.count("*").alias("documents"))


@query("content_gate", f"WITH {CONTENT_SQL} SELECT q, doc, score, best FROM (SELECT *, max(score) OVER (PARTITION BY q) AS best FROM c) WHERE best >= 20 AND score >= greatest(0.25, best * 0.6)")
def content_gate(spark: SparkSession, d: str) -> DataFrame:
    return ranking.relevance_gate(content(spark, d), ["q"], "score", least_best=20.0, relative=0.6).select("q", "doc", "score", "best")


SERVICE, TECHNICAL = "(?i)order|refund|price|stock", "(?i)clean|replace|error|cordless"
INTENT, NO_INTENT = r"(?i)\b(how|what|where|clean|error)\b|(故障|如何)", r"(?i)\b(refund|order|price)\b|(退款)"


@query(
    "question_predicates",
    rf"""
  WITH {QS}
  SELECT q, CASE WHEN regexp_matches(question, '{SERVICE}') AND NOT regexp_matches(question, '{TECHNICAL}') THEN 'service' ELSE 'tech' END AS route,
    regexp_matches(question, '{INTENT}') AND NOT regexp_matches(question, '{NO_INTENT}') AS intent, regexp_matches(lower(question), 'compare|difference|vs|versus|区别|对比|分别|各自|哪种') AS comparison,
    regexp_matches(lower(question), 'size|system|part') AS structure, regexp_matches(lower(trim(question)), 'safety|hazard|regulatory|legal|fcc|warning') AS safety, regexp_replace(lower(trim(question)), '\s+', ' ', 'g') AS heading_key,
    coalesce(q >= 64, TRUE) AS technical FROM qs
""",
)
def question_predicates(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("question")
    return questions(spark, d).select(
        "q", routing.rule_route(q, SERVICE, TECHNICAL).alias("route"), tx.gated(q, INTENT, NO_INTENT).alias("intent"), tx.asks_comparison(q).alias("comparison"),
        tx.names_any(q, ["size", "system", "part"]).alias("structure"), tx.is_safety_heading(q).alias("safety"), tx.heading_key(q).alias("heading_key"), tx.is_technical(F.col("q")).alias("technical"),
    )


@query(
    "dual_rerank",
    f"""
  WITH {BM25_SQL},
  c AS (SELECT * FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm25) WHERE rank <= 20),
  k AS (SELECT c.*, CASE WHEN n_chars % 3 <> 0 THEN CAST(n_chars % 101 AS DOUBLE) END AS a, CASE WHEN n_chars % 4 <> 0 AND query % 3 <> 0 THEN CAST(n_chars % 97 AS DOUBLE) END AS b, source || lang AS parent FROM c JOIN documents ON doc = doc_id),
  l AS (
    SELECT query, doc, parent, row_number() OVER (PARTITION BY query ORDER BY a DESC NULLS LAST, rank) AS place, 6 AS most, 0 AS base FROM k
    UNION ALL SELECT query, doc, parent, row_number() OVER (PARTITION BY query ORDER BY b DESC NULLS LAST, rank), 4, 6 FROM k WHERE query % 3 <> 0),
  f AS (SELECT query, parent, min(base + place) AS first, min_by(doc, base + place) AS doc FROM l WHERE place <= most GROUP BY query, parent)
  SELECT query, doc, CAST(place AS INTEGER) AS place FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY first) AS place FROM f) WHERE place <= 8
""",
)
def dual_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Made-up scores of two rerankers' calls over the lexical candidates; a parent is a source and language."""
    near = recalled(spark, d, 20).drop("score")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "n_chars", F.concat("source", "lang").alias("parent"))
    rows = near.join(docs, "doc")
    a = rows.filter("n_chars % 3 <> 0").select("query", "doc", (F.col("n_chars") % 101).cast("double").alias("score"))
    b = rows.filter("n_chars % 4 <> 0 AND query % 3 <> 0").select("query", "doc", (F.col("n_chars") % 97).cast("double").alias("score"))
    return routing.dual_rerank(near, a, b, docs.select("doc", "parent"))


@query(
    "keyword_recall",
    f"""
  WITH {BM25_SQL},
  kw AS (SELECT query, term, times, row_number() OVER (PARTITION BY query ORDER BY term) AS place FROM q),
  k AS (
    SELECT kw.query, kw.place, d.doc, round(w.idf * d.tf * 2.5 / (d.tf + 1.5 * (0.25 + 0.75 * d.len / s.avgdl)), 6) AS score FROM kw JOIN d USING (term) JOIN w USING (term), s WHERE kw.place <= 4),
  n AS (SELECT query, doc, place, row_number() OVER (PARTITION BY query, place ORDER BY score DESC, doc) AS nth FROM k),
  f AS (SELECT query, doc, min((place, nth)) AS first FROM n WHERE nth <= 5 GROUP BY query, doc)
  SELECT query, doc, CAST(row_number() OVER (PARTITION BY query ORDER BY first, doc) AS INTEGER) AS pos FROM f
""",
)
def keyword_recall(spark: SparkSession, d: str) -> DataFrame:
    """Five documents for each of an item's first four words, each word a query of its own."""
    found = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.slice(F.array_sort(F.array_distinct(tx.scene_tokens(F.col("text")))), 1, 4)).alias("keyword"))
    found = ranking.ranked(found, ["query"], [F.col("keyword")], "place")
    words = found.select("keyword").distinct().withColumn("word", F.array("keyword"))
    scores = lexical.bm25(table(spark, d, "documents"), words, tx.scene_tokens(F.col("text")), F.col("word"), query_id="keyword")
    rows = found.join(scores.select(F.col("query").alias("keyword"), "doc", F.round("score", 6).alias("score")), "keyword")
    return routing.keyword_recall(rows)


@query("fresh_hits", "SELECT source AS session, min(doc_id) AS doc_id FROM documents GROUP BY source, lang, sha256(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))")
def fresh_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("source").alias("session"), "doc_id", "lang", F.lit("").alias("heading"), "text")
    return routing.fresh_hits(rows, "session", "doc_id", "doc_id", "lang", "heading", "text").select("session", "doc_id")


@query(
    "parent_lookup",
    """
  WITH c AS (SELECT doc_id, source AS product, doc_id % 10 AS parent_section_id, text[1:60] AS text FROM documents),
  s AS (SELECT source AS product, doc_id % 10 AS section_id, min(text[1:90]) AS text FROM documents WHERE doc_id % 20 < 7 GROUP BY ALL)
  SELECT c.doc_id, sha256(coalesce(s.text, c.text)) AS mark FROM c LEFT JOIN s ON s.product = c.product AND s.section_id = c.parent_section_id
""",
)
def parent_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Chunks (a document's beginning) with the text of their section, made up from some documents; their own where it is missing."""
    from weft.operators import sections

    docs = table(spark, d, "documents")
    chunks = docs.select("doc_id", F.col("source").alias("product"), (F.col("doc_id") % 10).alias("parent_section_id"), F.left("text", F.lit(60)).alias("text"))
    own = docs.filter("doc_id % 20 < 7").groupBy(F.col("source").alias("product"), (F.col("doc_id") % 10).alias("section_id")).agg(F.min(F.left("text", F.lit(90))).alias("text"))
    return sections.with_parent(chunks, own).select("doc_id", tx.digest(F.col("result_text")).alias("mark"))


@query(
    "effective_modes",
    """
  WITH r AS (
    SELECT doc_id, ['bm25', 'dense', 'visual', 'hybrid', 'visual_hybrid', 'tri_hybrid'][doc_id % 6 + 1] AS requested,
      doc_id IN (SELECT vec_id FROM embeddings) AS d, doc_id IN (SELECT page_id FROM pages) AS v FROM documents)
  SELECT doc_id, requested, CASE requested WHEN 'dense' THEN CASE WHEN d THEN 'dense' ELSE 'bm25' END WHEN 'visual' THEN CASE WHEN v THEN 'visual' ELSE 'bm25' END WHEN 'hybrid' THEN CASE WHEN d THEN 'hybrid' ELSE 'bm25' END
    WHEN 'visual_hybrid' THEN CASE WHEN v THEN 'visual_hybrid' ELSE 'bm25' END WHEN 'tri_hybrid' THEN CASE WHEN d AND v THEN 'tri_hybrid' WHEN d THEN 'hybrid' WHEN v THEN 'visual_hybrid' ELSE 'bm25' END ELSE 'bm25' END AS effective FROM r
""",
)
def effective_modes(spark: SparkSession, d: str) -> DataFrame:
    """What a mode, asked for in turn, becomes for each document: it has a dense modality with a vector, a visual one with a page of its number."""
    docs = table(spark, d, "documents").select("doc_id")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("dense")).distinct()
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit(True).alias("visual")).distinct()
    requested = F.get(F.array(*map(F.lit, ("bm25", "dense", "visual", "hybrid", "visual_hybrid", "tri_hybrid"))), (F.col("doc_id") % 6).cast("int"))
    rows = docs.join(vectors, "doc_id", "left").join(pages, "doc_id", "left").withColumn("requested", requested)
    return rows.select("doc_id", "requested", ranking.effective_modes(F.col("requested"), F.col("dense"), F.col("visual")).alias("effective"))
