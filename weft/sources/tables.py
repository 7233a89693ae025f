"""Sources and sinks: manifests, manuals, journals, indexes and vectors."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV manifest with a header; every cell is a string, a byte order mark before the first name is dropped."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("﻿") for c in df.columns]).na.fill("")


def write_manifest(df: DataFrame, path: str, fields: list[str]) -> None:
    """A CSV manifest in a fixed order of fields, visible only once complete (Spark's commit)."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields]).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def read_manuals(spark: SparkSession, folder: str) -> DataFrame:
    """product (file name without extension) and text of a folder's Markdown files; an empty folder raises."""
    df = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md")
    df = df.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.md$", 1).alias("product"), F.col("value").alias("text"))
    df = df.withColumn("product", F.url_decode(F.replace("product", F.lit("+"), F.lit("%2B"))))
    if df.isEmpty():
        raise FileNotFoundError(f"no Markdown file in {folder}")
    return df


def append_journal(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines journal; a line that can't be parsed raises when it is read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def latest(journal: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in journal.columns if c != key]
    return journal.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def save_vectors(df: DataFrame, path: str, id_col: str, vec_col: str) -> None:
    """Vectors as Parquet; an empty, zero or uneven one raises before anything is visible."""
    n = F.size(vec_col)
    bad = df.agg(F.count_if(F.col(id_col).isNull() | F.col(vec_col).isNull() | (n < 1)).alias("missing"), F.count_distinct(n).alias("widths"), F.count_if(~F.exists(vec_col, lambda x: (x != 0) & ~F.isnan(x))).alias("zero"), (F.count("*") - F.count_distinct(id_col)).alias("twice")).first()
    if bad["missing"] or bad["widths"] > 1 or bad["zero"] or bad["twice"]:
        raise ValueError(f"vectors are not valid: {bad.asDict()}")
    df.select(id_col, vec_col).write.mode("overwrite").parquet(path)


def save_index(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Postings as Parquet, parted by a hash of the term, so that a query reads the parts of its terms only."""
    postings.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(buckets))).repartition("part").sortWithinPartitions("term", "doc").write.mode("overwrite").partitionBy("part").parquet(path)


def load_postings(spark: SparkSession, path: str, terms: list[str], buckets: int = 64) -> DataFrame:
    """Postings of a query's terms; other parts aren't read."""
    df = spark.read.parquet(path)
    if not terms:
        return df.limit(0).drop("part")
    parts = [r[0] for r in spark.range(1).select(F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)) for t in terms]))).collect()]
    return df.filter(F.col("part").isin(parts) & F.col("term").isin(terms)).drop("part")


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), bytes and sha256 of every file."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return df.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_digests(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """name and problem: files that are missing, unknown or changed."""
    both = manifest.select("name", F.col("sha256").alias("want")).join(found.select("name", F.col("sha256").alias("have")), "name", "full")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unknown").when(F.col("want") != F.col("have"), "changed")
    return both.withColumn("problem", problem).filter("problem IS NOT NULL").select("name", "problem")


def contained(root: str, path: str) -> str:
    """The real path of something below a root; anything outside raises."""
    base, full = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if os.path.commonpath([base, full]) != base:
        raise ValueError(f"{path} lies outside {root}")
    return full


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """df, which raises when read if a key is null, empty or repeated."""
    n = F.count("*").over(W.partitionBy(key))
    ok = F.col(key).isNotNull() & (F.col(key).cast("string") != "") & (n == 1)
    return df.withColumn(key, F.when(ok, F.col(key)).otherwise(F.raise_error(F.lit(f"{key} is empty or repeated")).cast(df.schema[key].dataType)))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which all machines share; in local mode, without the setting, in a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.gettempdir() + "/weft-scratch"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to a new scratch path and read back: made once, whatever reads it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_chunks(df: DataFrame, path: str) -> None:
    """Chunks, sections or catalogs as JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load_chunks(spark: SparkSession, path: str, schema: str, needed: list[str]) -> DataFrame:
    """JSON lines under a schema; a broken line, or one without a needed field, raises when it is read."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for c in needed:
        df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"a row without {c}")).cast(df.schema[c].dataType)))
    return df


def load_vectors(spark: SparkSession, path: str, manifest: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Stored vectors; raises if they aren't one for each id of the manifest, or a zero one is among them."""
    df = spark.read.parquet(path)
    both = manifest.select(id_col).withColumn("__m", F.lit(1)).join(df.select(id_col, vec_col).withColumn("__v", F.lit(1)), id_col, "full")
    zero = F.col("__v").isNotNull() & ~F.exists(vec_col, lambda x: (x != 0) & ~F.isnan(x))
    bad = both.agg(F.count_if(F.col("__m").isNull() | F.col("__v").isNull()).alias("unmatched"), F.count_if(zero).alias("zero"), (F.count("*") - F.count_distinct(id_col)).alias("twice")).first()
    if any(bad):
        raise ValueError(f"vectors don't fit their manifest: {bad.asDict()}")
    return df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written completely."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def ensure_index(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> None:
    """Build and save an index's postings unless they are there already."""
    if not exists(spark, path):
        save_index(make(), path)
