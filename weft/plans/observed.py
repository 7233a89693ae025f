"""Queries on search results as a tool writes them, read back from their text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text as tx
from weft.operators import observations
from weft.plans.catalog import query, table
from weft.plans.retrieval import BM25_SQL, K, recalled
from weft.sources.tables import kept

HITS_SQL = rf"""
  {BM25_SQL}, top AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm25),
  h AS (SELECT query, rank, source AS product, lang || ' ' || doc AS heading, doc, regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '\s+$', '')), chr(10)), '^\s+|\s+$', '', 'g') AS content
    FROM top JOIN documents ON doc_id = doc WHERE rank <= {K})
"""


def written(spark: SparkSession, d: str) -> DataFrame:
    """query, text: the ten best documents of each benchmark item as a tool's output."""
    docs = table(spark, d, "documents")
    found = recalled(spark, d, K).join(docs.withColumnRenamed("doc_id", "doc"), "doc")
    rows = found.select("query", "rank", F.col("source").alias("product"), F.concat("lang", F.lit(" "), F.col("doc").cast("string")).alias("heading"), F.col("doc").alias("section_id"), F.col("text").alias("content"))
    return observations.rendered(rows, "query")


@query("parsed_hits", f"WITH {HITS_SQL} SELECT query, rank, product, heading, CAST(doc AS VARCHAR) AS section_id, sha256(content) AS mark FROM h")
def parsed_hits(spark: SparkSession, d: str) -> DataFrame:
    """The hits of bm25_topk, written and read back whole."""
    return observations.hits(written(spark, d), "query", "text").select("query", "rank", "product", "heading", "section_id", tx.digest(F.col("content")).alias("mark"))


@query(
    "observed_results",
    f"""
  WITH {HITS_SQL}, c AS (SELECT query, product, count(*) AS n, min(rank) AS first FROM h GROUP BY query, product),
  t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, first) AS place FROM c), a AS (SELECT query, CAST(sum(n) AS BIGINT) AS products FROM c GROUP BY query), o AS (SELECT query, product AS stated FROM h WHERE rank = 1)
  SELECT query, FALSE AS no_result, products, products AS headings, product AS dominant_product, n AS dominant_count, n >= 2 AND stated <> product AS conflict FROM t JOIN a USING (query) JOIN o USING (query) WHERE place = 1
""",
)
def observed_results(spark: SparkSession, d: str) -> DataFrame:
    """Whether the source that most hits are of is that of the best one, which stands for the product asked for."""
    texts = kept(written(spark, d), "written")
    stated = observations.hits(texts, "query", "text").filter("rank = 1").select("query", F.col("product").alias("stated"))
    out = observations.observed(texts.join(stated, "query", "left"), "query", "text", "stated")
    return out.select("query", "no_result", "products", "headings", "dominant_product", "dominant_count", "conflict")
