"""Store queries: tables written in the library's formats and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text as tx
from weft.operators import lexical, vectors
from weft.plans.catalog import query, table
from weft.sources import tables


@query("manifest_round_trip", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name || ', \"quoted\"' AS name, '' AS empty FROM nation")
def manifest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A CSV manifest: all cells are strings, nulls empty, commas and quotes kept."""
    path = tables.scratch(spark, "manifest")
    rows = table(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit(', "quoted"')).alias("name"), F.lit(None).cast("string").alias("empty"))
    tables.write_manifest(rows, path, ["n_nationkey", "name", "empty"])
    return tables.read_manifest(spark, path)


@query("journal_round_trip", "SELECT s_suppkey AS key, max(n) AS n, arg_max(name, n) AS name FROM (SELECT s_suppkey, 1 AS n, s_name AS name FROM supplier UNION ALL SELECT s_suppkey, 2, upper(s_name) FROM supplier WHERE s_suppkey % 3 = 0) GROUP BY s_suppkey")
def journal_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Two appends to a journal; the last row of each key counts."""
    path = tables.scratch(spark, "journal")
    s = table(spark, d, "supplier")
    tables.append_journal(s.select(F.col("s_suppkey").alias("key"), F.lit(1).alias("n"), F.col("s_name").alias("name")), path)
    tables.append_journal(s.filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("key"), F.lit(2).alias("n"), F.upper("s_name").alias("name")), path)
    return tables.latest(tables.read_journal(spark, path, "key long, n int, name string"), "key", "n")


@query("json_store", "SELECT doc_id, source AS product, lang AS heading, sha256(text) AS mark, CAST(len(string_split(text, ' ')) AS INTEGER) AS words FROM documents")
def json_store(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as JSON and read back under their schema."""
    path = tables.scratch(spark, "chunks")
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("product"), F.col("lang").alias("heading"), "text", F.split("text", " ").alias("tags"))
    tables.save_chunks(rows, path)
    back = tables.load_chunks(spark, path, "doc_id long, product string, heading string, text string, tags array<string>", ["doc_id", "text"])
    return back.select("doc_id", "product", "heading", tx.digest(F.col("text")).alias("mark"), F.size("tags").alias("words"))


@query("vector_store", "WITH x AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT vec_id, len(e) AS width, round(list_sum(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))), 6) AS total FROM x")
def vector_store(spark: SparkSession, d: str) -> DataFrame:
    """Unit vectors stored, and loaded under the manifest that they belong to."""
    path = tables.scratch(spark, "vectors")
    unit = table(spark, d, "embeddings").select("vec_id", vectors.normalised_strict(F.col("embedding")).alias("v"))
    tables.save_vectors(unit, path, "vec_id", "v")
    back = tables.load_vectors(spark, path, table(spark, d, "embeddings").select("vec_id"), "vec_id", "v")
    return back.select("vec_id", F.size("v").cast("long").alias("width"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(
    "index_store",
    "WITH t AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9._+/-]*|[一-鿿]+')) AS term FROM documents) SELECT doc, term, count(*) AS tf FROM t WHERE term IN ('the', 'heen', 'absent') GROUP BY ALL",
)
def index_store(spark: SparkSession, d: str) -> DataFrame:
    """An index that is made once and found the second time; a query reads the parts of its terms."""
    path = tables.scratch(spark, "index")
    make = lambda: lexical.postings(table(spark, d, "documents"), tx.scene_tokens(F.col("text")))
    for _ in range(2):
        tables.ensure_index(spark, path, make)
    return tables.load_postings(spark, path, ["the", "heen", "absent"]).select("doc", "term", "tf")


@query(
    "verify_digests",
    "SELECT 'f' || s_suppkey AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'missing' WHEN s_suppkey % 7 = 0 THEN 'changed' END AS problem FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 UNION ALL SELECT 'extra', 'unknown'",
)
def verify_digests(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    name = F.concat(F.lit("f"), F.col("s_suppkey").cast("string"))
    manifest = s.select(name.alias("name"), tx.digest(F.col("s_name")).alias("sha256"))
    found = s.filter("s_suppkey % 5 <> 0").select(name.alias("name"), tx.digest(F.when(F.col("s_suppkey") % 7 == 0, F.upper(F.col("s_name").substr(2, 99))).otherwise(F.col("s_name"))).alias("sha256"))
    return tables.verify_digests(found.unionByName(spark.createDataFrame([("extra", "0")], "name string, sha256 string")), manifest)


@query("aligned_index", "SELECT TRUE AS aligned, CAST(NULL AS VARCHAR) AS reason, 'whole' AS index UNION ALL SELECT FALSE, 'order', 'turned' UNION ALL SELECT FALSE, 'rows', 'part'")
def aligned_index(spark: SparkSession, d: str) -> DataFrame:
    """An index against the order and digest of its manifest: as it is, in another order, and with rows missing."""
    v = table(spark, d, "embeddings").select("vec_id").withColumn("pos", F.col("vec_id"))
    mark = vectors.order_digest(v, "vec_id", "pos")
    forms = {"whole": v, "turned": v.withColumn("pos", -F.col("pos")), "part": v.filter("vec_id % 10 <> 3")}
    out = None
    for name, rows in forms.items():
        part = vectors.alignment(rows, mark, "vec_id", "pos").withColumn("index", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
