"""The corpus pipeline: five stages over documents, each on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import decontaminate, language_id, lines, neardup, spm
from weft.llm.common import discard, materialize, temporary, tokenizer_path

#: Ids that may be broadcast to drop documents by; beyond it the join shuffles.
MAX_BROADCAST = 2_000_000
#: Languages whose documents are kept.
LANGUAGES = ("de", "en", "es", "fr")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted language is one of LANGUAGES; a missing lang becomes the predicted one.

    Those without a letter, of which nothing can be told, go with those of other languages. It is
    learned from the documents that aren't held out.
    """
    profiles = language_id.fit(docs.filter(~language_id.held_out()))
    kept = language_id.identify(docs, profiles).filter(F.col("lang_pred").isin(*LANGUAGES))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less lines that an earlier one nearly equals, or equals if they are short; documents of which only white space stays go."""
    left = lines.dedup(docs)
    left = left.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates (five-word shingles, Jaccard 0.8)."""
    found = neardup.near_duplicates(docs, width=5, percent=80)
    gone = materialize(found.filter("NOT kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    small = F.broadcast if gone.count() <= MAX_BROADCAST else (lambda x: x)
    return docs.join(small(gone), F.col("doc_id") == F.col("gone"), "left_anti")


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), in_words=True)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their SentencePiece ids, checked against the library and decoded again."""
    return spm.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate_benchmark),
    ("sentencepiece", encode_pieces),
]
#: The stages are models, near-duplicate searches and tokenizers, which SQL can't express; a test holds them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage but the last returns is written to the shared folder, and removed once the next one is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with temporary():
            kept = materialize(stage(spark, docs, sf_dir), name, keep=True)
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
