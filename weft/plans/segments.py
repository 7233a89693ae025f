"""Queries on parts of texts: words of unspaced runs, pictures of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text as tx
from weft.operators import anchors, chunking, segmentation
from weft.plans.catalog import query, table

_RUN = r"regexp_replace(x, '[^\p{L}]+', '', 'g')"


@query(
    "segmented_runs",
    rf"""
  WITH RECURSIVE w AS (SELECT unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS word FROM documents),
  l AS (SELECT word, count(*) AS n FROM w GROUP BY word), a AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM l),
  v AS (SELECT word, CAST(floor(1000 * ln(n / total)) AS BIGINT) AS weight FROM l, a), z AS (SELECT CAST(floor(1000 * ln(1 / total)) AS BIGINT) AS unknown FROM a),
  x AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[^.,\n]+')) AS x, generate_subscripts(regexp_extract_all(lower(text), '[^.,\n]+'), 1) AS pos FROM conversations),
  r AS (SELECT conv_id, turn, pos, {_RUN} AS run FROM x WHERE {_RUN} <> ''), d AS MATERIALIZED (SELECT row_number() OVER () AS id, run FROM (SELECT DISTINCT run FROM r)),
  s AS (SELECT id, run, unnest(range(length(run))) AS b FROM d), f AS (SELECT id, b, b + k AS e, run[b + 1:b + k] AS word FROM s, (SELECT DISTINCT length(word) AS k FROM l) WHERE b + k <= length(run)),
  e AS (SELECT id, b, e, weight FROM f JOIN v USING (word) UNION ALL SELECT id, b, b + 1, unknown FROM s, z), g AS MATERIALIZED (SELECT id, e, list({{'b': b, 'w': weight}}) AS es FROM e GROUP BY id, e),
  p AS (
    SELECT id, CAST(0 AS BIGINT) AS i, [{{'w': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 'b': CAST(0 AS BIGINT)}}] AS best FROM d
    UNION ALL SELECT p.id, i + 1, list_append(best, list_reverse_sort(list_transform(es, lambda o: {{'w': best[o.b + 1].w + o.w, 'n': best[o.b + 1].n - 1, 'b': -o.b}}))[1]) FROM p JOIN g ON g.id = p.id AND g.e = p.i + 1),
  q AS (
    SELECT d.id, run, i, best, CAST([] AS VARCHAR[]) AS words FROM d JOIN p ON p.id = d.id AND i = length(run)
    UNION ALL SELECT id, run, -best[i + 1].b, best, list_prepend(run[1 - best[i + 1].b:i], words) FROM q WHERE i > 0),
  o AS (SELECT run, words FROM q WHERE i = 0)
  SELECT conv_id, turn, count(run) AS n_runs, CAST(coalesce(sum(len(words)), 0) AS BIGINT) AS n_words, sha256(coalesce(string_agg(array_to_string(words, ' '), chr(10) ORDER BY pos), '')) AS words_sha256
  FROM (SELECT conv_id, turn FROM conversations) c LEFT JOIN (SELECT * FROM r JOIN o USING (run)) USING (conv_id, turn) GROUP BY conv_id, turn
""",
)
def segmented_runs(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of all conversations, their blanks taken out, parted by the words of all documents."""
    words = table(spark, d, "documents").select(F.explode(tx.matches(F.lower("text"), r"\p{L}+")).alias("word")).groupBy("word").agg(F.count("*").alias("count"))
    sentences = F.transform(tx.matches(F.lower("text"), r"[^.,\n]+"), lambda x: F.regexp_replace(x, r"[^\p{L}]+", ""))
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.filter(sentences, lambda x: x != "").alias("runs"))
    parted = segmentation.segment(turns, "runs", segmentation.lexicon(words))
    said = F.array_join(F.transform("words", lambda w: F.array_join(w, " ")), "\n")
    return parted.select("conv_id", "turn", F.size("runs").cast("long").alias("n_runs"), F.size(F.flatten("words")).cast("long").alias("n_words"), tx.digest(said).alias("words_sha256"))


def pictured(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a mark at every line's end and one at the start; of some the last two have no name."""
    marked = F.concat(F.lit("<PIC>"), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "<PIC>\n"))
    n = F.size(F.split(marked, "<PIC>")) - 1
    named = F.when(F.col("doc_id") % 5 == 0, F.greatest(n - 2, F.lit(0))).otherwise(n)
    names = F.transform(F.sequence(F.lit(1), F.greatest(named, F.lit(1))), lambda k: F.concat(F.lit("p"), k.cast("string")))
    return table(spark, d, "documents").select("doc_id", marked.alias("text"), F.slice(names, F.lit(1), named).alias("names"))


@query(
    "chunk_pictures",
    r"""
  WITH m AS (SELECT doc_id, '<PIC>' || replace(coalesce(text, ''), chr(10), '<PIC>' || chr(10)) AS text FROM documents),
  n AS (SELECT *, (length(text) - length(replace(text, '<PIC>', ''))) // 5 AS marks FROM m),
  d AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN greatest(marks - 2, 0) ELSE marks END AS named FROM n),
  c AS (SELECT *, unnest(range(0, length(text), 400)) AS a FROM d), s AS (SELECT *, least(a + 600, length(text)) AS b FROM c),
  k AS (SELECT *, text[1:a + 4] AS before, text[a + 1:b] AS inside FROM s),
  o AS (SELECT *, (length(before) - length(replace(before, '<PIC>', ''))) // 5 AS f, (length(inside) - length(replace(inside, '<PIC>', ''))) // 5 AS h FROM k)
  SELECT doc_id, a // 400 AS chunk, a AS "start", CAST(b AS BIGINT) AS "end", array_to_string(list_transform(range(f + 1, least(f + h, named) + 1), lambda x: 'p' || x), ',') AS pics FROM o
""",
)
def chunk_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 600 characters, 200 of them shared with the next, over documents with picture marks."""
    docs = pictured(spark, d)
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(400))
    chunks = docs.select("doc_id", F.length("text").alias("n"), F.explode(starts).alias("start"))
    chunks = chunks.select("doc_id", (F.col("start") / 400).cast("long").alias("chunk"), F.col("start").cast("long").alias("start"), F.least(F.col("start") + 600, "n").cast("long").alias("end"))
    found = anchors.anchors(docs, "doc_id", "text", "names")
    return anchors.chunk_pictures(chunks, found, "doc_id", "chunk").withColumn("pics", F.array_join("pics", ","))


@query("sentence_pictures")
def sentence_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of sliding windows of whole sentences over the same texts."""
    docs = pictured(spark, d)
    chunks = chunking.spans(docs.select("doc_id", "text"), "text", chunking.sliding, with_text=False)
    found = anchors.anchors(docs, "doc_id", "text", "names")
    return anchors.chunk_pictures(chunks, found, "doc_id", "chunk")
