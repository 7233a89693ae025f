"""Retrieval queries over documents, embeddings and benchmark items (as questions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text as tx
from weft.operators import blocks, lexical, ranking, scoring, vectors
from weft.plans.catalog import SQL, query, table
from weft.sources.tables import kept, scratch

K = 10
TOKENS = "regexp_extract_all(lower({}), '[a-z0-9][a-z0-9._+/-]*|[一-鿿]+')"
#: CTE for the oracles: q(query, term, times), d(doc, term, tf, len), s(n, avgdl), w(term, df, idf), bm25(query, doc, score).
BM25_SQL = f"""
  dt AS (SELECT doc_id AS doc, {TOKENS.format("text")} AS t FROM documents),
  qt AS (SELECT item_id AS query, unnest({TOKENS.format("text")}) AS term FROM benchmark),
  q AS (SELECT query, term, count(*) AS times FROM qt GROUP BY ALL),
  d AS (SELECT doc, term, len, count(*) AS tf FROM (SELECT doc, len(t) AS len, unnest(t) AS term FROM dt) GROUP BY ALL),
  s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM dt),
  w0 AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS w FROM d, s GROUP BY term),
  w AS (SELECT term, df, CASE WHEN w < 0 THEN 0.25 * (SELECT avg(w) FROM w0) ELSE w END AS idf FROM w0),
  bm25 AS (
    SELECT q.query, d.doc, round(sum(q.times * (w.idf * d.tf * 2.5 / (d.tf + 1.5 * (0.25 + 0.75 * d.len / s.avgdl)))), 6) AS score
    FROM d JOIN w USING (term) JOIN q USING (term), s GROUP BY q.query, d.doc)
"""
COS_SQL = """
  v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
  cos AS (
    SELECT a.vec_id AS query, b.vec_id AS doc, round(list_dot_product(a.e, b.e) / greatest(sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)), 1e-12), 6) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id JOIN benchmark i ON i.item_id = a.vec_id)
"""


def bm25_scores(spark: SparkSession, d: str, **options) -> DataFrame:
    """query, doc, score of items and documents; options: among, keep, group of lexical.bm25()."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    tokens = tx.scene_tokens(F.col("text"))
    return lexical.bm25(docs, items, tokens, tokens, query_id="item_id", places=6, **options)


def best(spark: SparkSession, d: str, k: int, rank: str = "rank") -> DataFrame:
    """query, doc, score, rank: the k best documents of each item."""
    return ranking.top_k(bm25_scores(spark, d, keep=scoring.best(k)), ["query"], "score", "doc", k, rank)


def recalled(spark: SparkSession, d: str, k: int, rank: str = "rank") -> DataFrame:
    """best(), made once and kept: what reads it several times, or joins it with documents, finds a small table."""
    return kept(best(spark, d, k, rank), "recalled")


def cosines(spark: SparkSession, d: str, **parts: int | None) -> DataFrame:
    """query, doc, score (or a column for each of parts) for the items that have a vector under their id (a synthetic pairing), against all other vectors."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = v.join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id").withColumnRenamed("vec_id", "query")
    parts = parts or {"score": None}
    rows = vectors.cosine_columns(v, q, parts, query_id="query")
    return rows.select("query", F.col("vec_id").alias("doc"), *[F.round(p, 6).alias(p) for p in parts])


@query("bm25_topk", f"WITH {BM25_SQL} SELECT * FROM (SELECT query, doc, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM bm25) WHERE rank <= {K}")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return best(spark, d, K)


@query("stored_topk", SQL["bm25_topk"])
def stored_topk(spark: SparkSession, d: str) -> DataFrame:
    """bm25_topk from an index that is written first: its blocks' greatest impacts decide which postings are scored."""
    docs, path = table(spark, d, "documents"), scratch(spark, "blocks")
    tokens = tx.scene_tokens(F.col("text"))
    blocks.save(lexical.postings(docs, tokens), lexical.lengths(docs, tokens), path)
    return blocks.top_k(spark, path, table(spark, d, "benchmark"), tokens, K, query_id="item_id")


@query("dense_topk", f"WITH {COS_SQL} SELECT * FROM (SELECT query, doc, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM cos) WHERE rank <= {K}")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = v.join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id").withColumnRenamed("vec_id", "query")
    found = vectors.similarities(v, q, K, query_id="query")
    # equal scores after rounding may order otherwise, so the tasks' best are cut with room and ranked again
    return found.select("query", F.col("vec_id").alias("doc"), F.round("score", 6).alias("score"), "rank")


HYBRID_SQL = f"""
  WITH {BM25_SQL}, {COS_SQL},
  both_ AS (SELECT b.query, b.doc, b.score AS bm25, c.score AS dense FROM bm25 b JOIN cos c USING (query, doc)),
  r AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY bm25 DESC, doc) AS br, row_number() OVER (PARTITION BY query ORDER BY dense DESC, doc) AS dr FROM both_),
  f AS (SELECT query, doc, round(0.45 / (60 + br) + 0.55 / (60 + dr), 9) AS score FROM r)
  SELECT * FROM (SELECT query, doc, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM f) WHERE rank <= {K}
"""


def fused(spark: SparkSession, d: str, mode: str) -> DataFrame:
    """Items' candidates (a shared term, and a vector under the document's id), the best by their ranks in each modality of a mode."""
    parts = {"dense": None, "visual": 32} if "tri" in mode else {"dense": None}
    # weights are of all documents; only those with a vector are scored
    docs = table(spark, d, "documents")
    among = docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    rows = bm25_scores(spark, d, among=among).withColumnRenamed("score", "bm25").join(cosines(spark, d, **parts), ["query", "doc"])
    weights = dict(zip(["bm25", *parts], ranking.MODES[mode], strict=False))
    return ranking.fused_top_k(rows, ["query"], "doc", weights, K)


@query("hybrid_rrf", HYBRID_SQL)
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d, ranking.effective_mode("hybrid", True, False))


@query(
    "tri_rrf",
    f"""
  WITH {BM25_SQL}, {COS_SQL},
  half AS (
    SELECT a.vec_id AS query, b.vec_id AS doc, round(list_dot_product(a.e[1:32], b.e[1:32]) / greatest(sqrt(list_dot_product(a.e[1:32], a.e[1:32])) * sqrt(list_dot_product(b.e[1:32], b.e[1:32])), 1e-12), 6) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id JOIN benchmark i ON i.item_id = a.vec_id),
  all_ AS (SELECT b.query, b.doc, b.score AS bm25, c.score AS dense, h.score AS visual FROM bm25 b JOIN cos c USING (query, doc) JOIN half h USING (query, doc)),
  r AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY bm25 DESC, doc) AS br, row_number() OVER (PARTITION BY query ORDER BY dense DESC, doc) AS dr, row_number() OVER (PARTITION BY query ORDER BY visual DESC, doc) AS vr FROM all_),
  f AS (SELECT query, doc, round(0.30 / (60 + br) + 0.35 / (60 + dr) + 0.35 / (60 + vr), 9) AS score FROM r)
  SELECT * FROM (SELECT query, doc, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM f) WHERE rank <= {K}
""",
)
def tri_rrf(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d, ranking.effective_mode("tri_hybrid", True, True))


@query(
    "capped_topk",
    f"""
  WITH {BM25_SQL},
  r AS (SELECT query, doc, source, score, row_number() OVER (PARTITION BY query, source ORDER BY score DESC, doc) AS n FROM bm25 JOIN documents ON doc = doc_id)
  SELECT * FROM (SELECT query, doc, source, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM r WHERE n <= 2) WHERE rank <= {K}
""",
)
def capped_topk(spark: SparkSession, d: str) -> DataFrame:
    found = bm25_scores(spark, d, keep=scoring.best(2, grouped=True), group="source")
    return ranking.capped(found, ["query"], "source", "score", "doc", 2, K).select("query", "doc", "source", "score", "rank")


@query(
    "scoped_topk",
    f"""
  WITH {BM25_SQL}
  SELECT * FROM (SELECT query, doc, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM bm25 JOIN documents ON doc = doc_id WHERE lang IN ('fr', 'es')) WHERE rank <= {K}
""",
)
def scoped_topk(spark: SparkSession, d: str) -> DataFrame:
    """The allow-list filters the documents before any rank; the corpus weights stay those of all documents."""
    allowed = table(spark, d, "documents").filter(F.col("lang").isin("fr", "es"))
    return ranking.top_k(bm25_scores(spark, d, among=allowed, keep=scoring.best(K)), ["query"], "score", "doc", K).select("query", "doc", "score", "rank")


@query(
    "relevance_gate",
    f"""
  WITH {BM25_SQL},
  g AS (SELECT query, doc, score, max(score) OVER (PARTITION BY query) AS best FROM bm25)
  SELECT query, doc, score, best FROM g WHERE best >= 40 AND score >= greatest(0.25, best * 0.5)
""",
)
def relevance_gate(spark: SparkSession, d: str) -> DataFrame:
    # dealt once, so that the best scores and the gate read the same rows
    near = bm25_scores(spark, d, keep=scoring.near(0.25, 0.5)).repartition("query", "doc")
    return ranking.relevance_gate(near, ["query"], "score", least_best=40.0, relative=0.5).select("query", "doc", "score", "best")


@query(
    "ordered_union_recall",
    f"""
  WITH {BM25_SQL}, {COS_SQL},
  l AS (
    SELECT query, doc, 0 AS list, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS pos FROM bm25
    UNION ALL SELECT query, doc, 1, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) FROM cos),
  f AS (SELECT query, doc, min((list, pos)) AS place FROM l WHERE pos <= 20 GROUP BY query, doc),
  n AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY place, doc) AS rank FROM f),
  x AS (SELECT n.*, lang IS DISTINCT FROM 'en' AS other FROM n LEFT JOIN documents ON doc = doc_id WHERE rank <= 30)
  SELECT query, doc, CAST(rank AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY query ORDER BY other, rank) AS INTEGER) AS reordered FROM x
""",
)
def ordered_union_recall(spark: SparkSession, d: str) -> DataFrame:
    """Lexical then dense recall, first occurrences, cut at 30, English documents first."""
    sparse = best(spark, d, 20, "pos")
    dense = ranking.top_k(cosines(spark, d), ["query"], "score", "doc", 20, "pos")
    union = ranking.ordered_union([sparse, dense], ["query"], "doc", "pos", 30)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "lang")
    return ranking.language_first(union.join(docs, "doc", "left"), ["query"], F.coalesce(F.col("lang") == "en", F.lit(False)), "rank").select("query", "doc", "rank", "reordered")


@query(
    "rerank_fallback",
    f"""
  WITH {BM25_SQL},
  c AS (SELECT * FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS pos FROM bm25) WHERE pos <= 20),
  g AS (SELECT c.*, CASE WHEN n_chars % 3 = 0 THEN CAST(n_chars % 101 AS DOUBLE) END AS given FROM c JOIN documents ON doc = doc_id),
  r AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY given DESC NULLS LAST, pos) AS n FROM g)
  SELECT query, doc, CAST(n AS INTEGER) AS final_rank, round(1.0 / n, 6) AS display_score FROM r WHERE n <= 6
""",
)
def rerank_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A reranker that answers for a third of the candidates (a made-up score); the others follow in recall order."""
    near = recalled(spark, d, 20, "pos").drop("score")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "n_chars")
    given = near.join(docs, "doc").filter("n_chars % 3 = 0").select("query", "doc", (F.col("n_chars") % 101).cast("double").alias("score"))
    out = ranking.rerank_or_fallback(near, given, ["query"], "doc", "pos", 6)
    return out.select("query", "doc", "final_rank", F.round("display_score", 6).alias("display_score"))


@query(
    "content_vote",
    f"""
  WITH {BM25_SQL},
  c AS (SELECT * FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm25) WHERE rank <= 30),
  f AS (SELECT query, source, doc % 7 AS section, min(rank) AS rank FROM c JOIN documents ON doc = doc_id GROUP BY ALL),
  p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS place FROM f)
  SELECT query, source, CAST(sum(CASE WHEN rank = 1 THEN 4 WHEN rank <= 3 THEN 3 WHEN rank <= 8 THEN 2 ELSE 1 END) AS BIGINT) AS votes FROM p WHERE place <= 18 GROUP BY query, source
""",
)
def content_vote(spark: SparkSession, d: str) -> DataFrame:
    near = recalled(spark, d, 30)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source", (F.col("doc_id") % 7).alias("section"))
    return ranking.rank_votes(near.join(docs, "doc"), ["query"], "section", "source", "rank")


@query(
    "tfidf_terms",
    f"""
  WITH d AS (SELECT DISTINCT doc_id, unnest({TOKENS.format("text")}) AS term FROM documents)
  SELECT term, count(*) AS df, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1, 6) AS idf FROM d GROUP BY term
""",
)
def tfidf_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    posts = lexical.postings(docs, tx.scene_tokens(F.col("text")))
    return lexical.tfidf_terms(posts, docs.agg(F.count("*").alias("n"))).select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    "mean_pool",
    """
  WITH x AS (SELECT label, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
  m AS (SELECT label, pos, avg(x) AS x, count(*) AS n FROM x GROUP BY label, pos),
  k AS (SELECT label, sqrt(sum(x * x)) AS norm FROM m GROUP BY label)
  SELECT m.label, CAST(m.pos - 1 AS INTEGER) AS pos, round(m.x / greatest(k.norm, 1e-12), 6) AS x, m.n AS parts FROM m JOIN k USING (label)
""",
)
def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    pooled = vectors.mean_pool(table(spark, d, "embeddings"), "label")
    return pooled.select("label", F.posexplode("pooled").alias("pos", "x"), "parts").select("label", "pos", F.round("x", 6).alias("x"), "parts")


@query(
    "ndcg_mrr_recall",
    f"""
  WITH {BM25_SQL},
  j AS (SELECT query, doc, quality AS gain FROM bm25 JOIN labels ON doc = doc_id),
  t AS (SELECT * FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm25 SEMI JOIN labels ON doc = doc_id) WHERE rank <= 10),
  g AS (SELECT t.query, sum((pow(2, gain) - 1) / log2(rank + 1)) AS dcg, min(CASE WHEN gain > 0 THEN rank END) AS first, count(*) FILTER (gain > 0) AS hits FROM t JOIN j USING (query, doc) GROUP BY t.query),
  p AS (SELECT query, gain, row_number() OVER (PARTITION BY query ORDER BY gain DESC) AS place FROM j),
  i AS (SELECT query, sum((pow(2, gain) - 1) / log2(place + 1)) FILTER (place <= 10) AS idcg, count(*) FILTER (gain > 0) AS total FROM p GROUP BY query)
  SELECT query, round(coalesce(dcg / idcg, 0), 6) AS ndcg, round(coalesce(1.0 / first, 0), 6) AS mrr, round(coalesce(hits / total, 0), 6) AS recall FROM i LEFT JOIN g USING (query) WHERE total > 0
""",
)
def ndcg_mrr_recall(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    among = table(spark, d, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    judged = bm25_scores(spark, d, among=among).join(labels.select(F.col("doc_id").alias("doc"), F.col("quality").alias("gain")), "doc")
    ranks = ranking.ranked(judged, ["query"], [F.desc("score"), F.col("doc")])
    m = ranking.graded(ranks, ["query"], "gain", "rank", judged)
    return m.select("query", *[F.round(c, 6).alias(c) for c in ("ndcg", "mrr", "recall")])


@query(
    "contamination_scan",
    "SELECT item_id, count(*) AS documents, min(doc_id) AS first_doc FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id HAVING count(DISTINCT d.doc_id) >= 1",
)
def contamination_scan(spark: SparkSession, d: str) -> DataFrame:
    """Items whose text stands in a document: they meet by an inner word, then the texts are compared."""
    rows = lexical.containing(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")
    rows = rows.withColumnsRenamed({"item": "item_id", "doc": "doc_id"})
    return rows.groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


@query(
    "query_expansion",
    r"""
  WITH r(o, pattern, word) AS (VALUES (0, ' the ', 'article'), (1, ' der ', 'artikel'), (2, 'tion', 'noun'), (3, ' que ', 'relative')),
  m AS (SELECT item_id, o, word FROM benchmark JOIN r ON regexp_matches(lower(text), pattern))
  SELECT item_id, coalesce(string_agg(word, ' ' ORDER BY o), '') AS added FROM benchmark LEFT JOIN m USING (item_id) GROUP BY item_id
""",
)
def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Words that a table of concepts adds to each item, in its order."""
    rules = spark.createDataFrame([(0, " the ", "article"), (1, " der ", "artikel"), (2, "tion", "noun"), (3, " que ", "relative")], "o int, pattern string, word string")
    items = table(spark, d, "benchmark")
    hits = items.join(F.broadcast(rules), F.expr("lower(text) RLIKE pattern"), "left")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("o", "word")))), lambda x: x["word"]), " ")
    return hits.groupBy("item_id").agg(words.alias("added"))


@query(
    "alias_detect",
    """
  WITH a(class, alias) AS (VALUES ('paper', 'CC BY'), ('code', 'General-Public'), ('token', 'token = '), ('shop', 'das_der'))
  SELECT class, count(*) AS n, min(doc_id) AS first_doc FROM documents JOIN a ON contains(regexp_replace(lower(text), '[-_/]+', ' ', 'g'), regexp_replace(lower(alias), '[-_/]+', ' ', 'g')) GROUP BY class
""",
)
def alias_detect(spark: SparkSession, d: str) -> DataFrame:
    """Documents that name one of a class's aliases, signs between words and case aside."""
    aliases = spark.createDataFrame([("paper", "CC BY"), ("code", "General-Public"), ("token", "token = "), ("shop", "das_der")], "class string, alias string")
    plain = lambda c: F.regexp_replace(F.lower(c), "[-_/]+", " ")
    rows = table(spark, d, "documents").select("doc_id", plain(F.col("text")).alias("t")).join(F.broadcast(aliases.select("class", plain(F.col("alias")).alias("a"))), F.contains("t", "a"))
    return rows.groupBy("class").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(
    "most_common_source",
    "SELECT lang, source, n FROM (SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, min(doc_id)) AS r FROM documents GROUP BY lang, source) WHERE r = 1",
)
def most_common_source(spark: SparkSession, d: str) -> DataFrame:
    return ranking.most_common(table(spark, d, "documents"), ["lang"], "source", "doc_id")


@query("first_per_section", "SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY source, lang")
def first_per_section(spark: SparkSession, d: str) -> DataFrame:
    return ranking.first_per_key(table(spark, d, "documents").select("source", "lang", "doc_id"), [], ["source", "lang"], [F.col("doc_id")])


@query("pool_shard", "SELECT item_id, text FROM benchmark WHERE item_id % 4 = 1")
def pool_shard(spark: SparkSession, d: str) -> DataFrame:
    return ranking.shard(table(spark, d, "benchmark"), "item_id", 4, 1)


STOP = "how the to do if is are of on in a an for what when this my i you and or can should want would be it that with your use using before".split()
GRAMS = "list_distinct(flatten(list_transform(range(1, 5), lambda n: list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')))))"


@query(
    "phrase_route",
    f"""
  WITH d AS (SELECT source, regexp_extract_all(lower(text), '[a-z]{{2,}}') AS w FROM documents),
  q AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z]{{2,}}'), lambda x: NOT list_contains({STOP!r}, x)) AS w FROM benchmark),
  g AS (SELECT DISTINCT source, unnest({GRAMS}) AS p FROM d), qg AS (SELECT item_id, unnest({GRAMS}) AS p FROM q),
  k AS (SELECT item_id, p, len(string_split(p, ' ')) AS n FROM qg WHERE contains(p, ' ') OR length(p) >= 5),
  u AS (SELECT p, min(source) AS source FROM g WHERE p IN (SELECT p FROM k) GROUP BY p HAVING count(*) = 1),
  v AS (SELECT item_id, source, CAST(sum(2 * n + 1) AS BIGINT) AS weight FROM k JOIN u USING (p) GROUP BY item_id, source),
  r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, source) AS n, lead(weight, 1, 0) OVER (PARTITION BY item_id ORDER BY weight DESC, source) AS second FROM v)
  SELECT item_id, source, weight FROM r WHERE n = 1 AND weight >= 20 AND weight >= 3 * greatest(second, 1)
""",
)
def phrase_route(spark: SparkSession, d: str) -> DataFrame:
    """Items routed to a source by phrases that only it holds: the winner needs 20 points and three times the second's.

    Phrases are runs of 2 to 4 words without stop words, and words of 5 letters; they are looked up as whole words.
    """
    items, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    asked = items.select("item_id", F.explode(lexical.phrases(F.col("text"), STOP)).alias("p")).filter("p LIKE '% %' OR length(p) >= 5")
    held = docs.select("source", F.explode(lexical.phrases(F.col("text"))).alias("p")).join(asked.select("p").distinct(), "p", "left_semi").distinct()
    return lexical.routed(asked, held, "item_id", "source")
