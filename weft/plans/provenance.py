"""Provenance queries: passages and the claims bound to them, spans, and SQL for folds over sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text as tx
from weft.operators import evidence
from weft.plans.catalog import query, table

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
PASSAGES_SQL = rf"""
  RECURSIVE p AS (
    SELECT source, doc_id, 0 AS pos, CAST('' AS VARCHAR) AS quote, {STRIP.format("text")} AS rest FROM documents
    UNION ALL SELECT source, doc_id, pos + 1, {STRIP.format("rest[1:size]")}, {STRIP.format("rest[size + 1:]")} FROM (
      SELECT *, CASE WHEN length(rest) <= 2800 THEN length(rest) WHEN contains(w, chr(10) || chr(10)) AND length(regexp_extract(w, '(?s)^(.*)\n\n', 1)) > 0 THEN length(regexp_extract(w, '(?s)^(.*)\n\n', 1))
        WHEN length(regexp_extract(w, '(?s)^(.*)[\n ]', 1)) > 0 THEN length(regexp_extract(w, '(?s)^(.*)[\n ]', 1)) ELSE 2800 END AS size FROM (SELECT *, rest[1:2800] AS w FROM p) WHERE rest <> '')),
  c AS (SELECT source, doc_id, quote, 'E' || row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) AS passage FROM p WHERE quote <> '')
"""


def catalog(spark: SparkSession, d: str) -> DataFrame:
    return evidence.passages(table(spark, d, "documents").select("source", "doc_id", "text"), "source", "doc_id", "text").withColumnRenamed("doc_id", "source_id")


@query("passage_catalog", f"WITH {PASSAGES_SQL} SELECT source, doc_id, passage, sha256(quote) AS mark FROM c")
def passage_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Passages of every document, numbered within its source."""
    return catalog(spark, d).select("source", F.col("source_id").alias("doc_id"), "passage", tx.digest(F.col("quote")).alias("mark"))


def claims(spark: SparkSession, d: str) -> DataFrame:
    """A claim for each document: two passages of its source, of which some are unknown, repeated or of one document."""
    n = F.col("doc_id") % 40
    second = F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") % 40 + 1).when(F.col("doc_id") % 5 == 0, F.lit(1_000_000)).otherwise(F.col("doc_id") % 40 + 3)
    ids = F.array(F.concat(F.lit("E"), (n + 1).cast("string")), F.concat(F.lit("E"), second.cast("string")))
    return table(spark, d, "documents").select("source", F.col("doc_id").alias("claim_id"), ids.alias("passage_ids"))


CLAIMS_SQL = """
  k AS (SELECT source, doc_id AS claim_id, ['E' || (doc_id % 40 + 1), 'E' || CASE WHEN doc_id % 7 = 0 THEN doc_id % 40 + 1 WHEN doc_id % 5 = 0 THEN 1000000 ELSE doc_id % 40 + 3 END] AS ids FROM documents),
  u AS (SELECT source, claim_id, unnest(ids) AS passage, generate_subscripts(ids, 1) AS pos FROM k), j AS (SELECT u.*, c.doc_id, c.quote FROM u LEFT JOIN c USING (source, passage)),
  h AS (SELECT source, claim_id, count(passage) = count(doc_id) AND count(DISTINCT passage) = count(*) AS known, count(doc_id) = count(DISTINCT doc_id) AS one_each FROM j GROUP BY ALL)
"""


@query("claim_passages", f"WITH {PASSAGES_SQL}, {CLAIMS_SQL} SELECT * FROM h")
def claim_passages(spark: SparkSession, d: str) -> DataFrame:
    return evidence.claims_hold(claims(spark, d), catalog(spark, d), "source")


@query("bound_claims", f"WITH {PASSAGES_SQL}, {CLAIMS_SQL} SELECT source, claim_id, sha256(string_agg(doc_id || ':' || quote, '|' ORDER BY pos)) AS mark FROM j JOIN h USING (source, claim_id) WHERE known AND one_each GROUP BY ALL")
def bound_claims(spark: SparkSession, d: str) -> DataFrame:
    out = evidence.bound_claims(claims(spark, d), catalog(spark, d), "source")
    said = F.array_join(F.transform("evidence", lambda x: F.concat(x["source_id"].cast("string"), F.lit(":"), x["quote"])), "|")
    return out.select("source", "claim_id", tx.digest(said).alias("mark"))


@query(
    "claim_spans",
    """
  WITH a AS (SELECT p_partkey, p_name || ' is one. ' || p_brand || ' is two. Third here.' AS answer FROM part)
  SELECT p_partkey, CAST(pos AS INTEGER) AS pos, CASE WHEN pos < 2 THEN 7 END AS claim_no FROM a, (SELECT unnest([0, 1, 2]) AS pos)
""",
)
def claim_spans(spark: SparkSession, d: str) -> DataFrame:
    """A claim that covers the first two of an answer's three sentences."""
    first = F.concat("p_name", F.lit(" is one. "), "p_brand", F.lit(" is two."))
    part = table(spark, d, "part")
    answers = part.select("p_partkey", F.concat(first, F.lit(" Third here.")).alias("answer"))
    said = part.select("p_partkey", F.lit(7).alias("claim_no"), first.alias("claim"))
    return evidence.spans_of_claims(answers, said, "p_partkey", "answer", "claim").select("p_partkey", "pos", "claim_no")


@query(
    "picture_lines",
    """
  WITH c AS (SELECT p_brand AS product, p_partkey AS pic, p_size, p_name, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos FROM part),
  k AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY pos) AS n FROM c WHERE p_size % 4 <> 0)
  SELECT product, string_agg('- [[PIC:' || pic || ']] ' || p_name || ': ' || CASE WHEN p_size % 3 = 0 THEN repeat(p_type, 60)[1:260] || '...' ELSE p_type END, chr(10) ORDER BY n) AS lines FROM k WHERE n <= 8 GROUP BY product
""",
)
def picture_lines(spark: SparkSession, d: str) -> DataFrame:
    """Captions of a brand's parts; every fourth size is noise, some contents are long."""
    part = table(spark, d, "part").withColumn("pic", F.col("p_partkey").cast("string"))
    pics = part.select(F.lit(1).alias("one"), F.col("p_brand").alias("product"), F.col("p_partkey").alias("pos"), "pic")
    long = F.when(F.col("p_size") % 3 == 0, F.repeat("p_type", F.lit(60))).otherwise(F.col("p_type"))
    captions = part.select(F.col("p_brand").alias("product"), "pic", F.when(F.col("p_size") % 4 == 0, "noise").otherwise("part_view").alias("category"), F.lit(None).cast("string").alias("section_fit"), F.col("p_name").alias("short_caption"), long.alias("content"))
    return evidence.picture_lines(pics.withColumn("by", F.col("product")).drop("one"), captions, "by").select(F.col("by").alias("product"), "lines")
