"""Queries on what ways of keeping a session's memory show of its gold sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.functions import text as tx
from weft.operators import coverage, sessions, tree
from weft.plans.catalog import query, table
from weft.plans.checks import FOLD, ROLLING_SQL
from weft.plans.sessions import PAIRS_SQL, pairs, questions
from weft.sources import tables

WINDOW, SMALL, LIMIT = 2000, 900, 4000

_SIZE = "coalesce(strlen(question), 0) + coalesce(strlen(answer), 0) + 40"
_SQUEEZED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
CASES_SQL = rf"""
  RECURSIVE {PAIRS_SQL}, {ROLLING_SQL},
  gold AS (SELECT conv_id, turn_id AS gold_turn, substr({_SQUEEZED.format("coalesce(question, '')")}, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 61 END, 40) AS quote FROM n WHERE nth = 1 + conv_id % total),
  k AS (SELECT conv_id, turn_id, concat_ws(chr(10), question, answer) AS text, {_SIZE} AS size, total - nth + 1 AS back FROM n),
  r AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn_id DESC) + 2 * back AS used FROM k),
  fit AS (
    SELECT conv_id, turn_id, back, CASE WHEN size <= {WINDOW} THEN size ELSE 0 END AS held, size <= {WINDOW} AS stays FROM k WHERE back = 1
    UNION ALL SELECT k.conv_id, k.turn_id, k.back, CASE WHEN held + size <= {WINDOW} THEN held + size ELSE held END, held + size <= {WINDOW} FROM fit JOIN k ON k.conv_id = fit.conv_id AND k.back = fit.back + 1),
  terms AS (SELECT conv_id, turn_id, list_distinct(regexp_extract_all(lower(concat_ws(' ', question, answer)), '[a-z0-9][a-z0-9_-]+')) AS have FROM p),
  asked AS (SELECT conv_id, list_distinct(regexp_extract_all(lower(arg_max(text, turn)), '[a-z0-9][a-z0-9_-]+')) AS want FROM conversations WHERE role = 'user' GROUP BY conv_id),
  hit AS (SELECT conv_id, turn_id, len(list_intersect(have, want)) AS shared FROM terms JOIN asked USING (conv_id) JOIN r USING (conv_id, turn_id) WHERE used > {SMALL}),
  best AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY shared DESC, turn_id DESC) AS rank FROM hit WHERE shared > 0),
  visible AS (
    SELECT 'whole' AS strategy, conv_id, turn_id, text, TRUE AS base FROM k
    UNION ALL SELECT 'window', conv_id, turn_id, text, TRUE FROM r WHERE used <= {WINDOW}
    UNION ALL SELECT 'fitting', conv_id, turn_id, text, TRUE FROM k JOIN fit USING (conv_id, turn_id) WHERE stays
    UNION ALL SELECT 'rolling', conv_id, NULL, arg_max(array_to_string(state, chr(10)), block), TRUE FROM f GROUP BY conv_id
    UNION ALL SELECT 'rolling', conv_id, turn_id, text, TRUE FROM k WHERE back <= {FOLD[1]}
    UNION ALL SELECT 'recall', conv_id, turn_id, text, TRUE FROM r WHERE used <= {SMALL}
    UNION ALL SELECT 'recall', conv_id, turn_id, text, FALSE FROM k JOIN best USING (conv_id, turn_id) WHERE rank <= 3),
  shown AS (SELECT *, quote <> '' AND (turn_id IS NULL OR turn_id = gold_turn) AND contains({_SQUEEZED.format("text")}, quote) AS shows
    FROM (SELECT * FROM gold, (SELECT unnest(['whole', 'window', 'fitting', 'rolling', 'recall']) AS strategy)) LEFT JOIN visible USING (conv_id, strategy)),
  c AS (
    SELECT conv_id, strategy, coalesce(bool_or(shows), FALSE) AS covered, coalesce(bool_or(shows AND base), FALSE) AS memory_covered, count(base) AS pieces, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes, any_value(quote) = '' AS nothing FROM shown GROUP BY conv_id, strategy),
  o AS (SELECT conv_id, strategy, covered, memory_covered, pieces, bytes, CASE WHEN nothing THEN 'quote' WHEN NOT covered THEN 'not visible' WHEN bytes > {LIMIT} THEN 'budget' END AS problem FROM c)
"""


def gold(spark: SparkSession, d: str) -> DataFrame:
    """For each conversation one of its turns, by its number, and 40 characters of what the user said there: of even ones the first, of odd ones from the 61st on."""
    w = W.partitionBy("conv_id")
    p = pairs(spark, d).withColumn("nth", F.row_number().over(w.orderBy("turn_id"))).withColumn("total", F.count("*").over(w))
    said = tx.squeeze(F.coalesce("question", F.lit("")))
    return p.filter("nth = 1 + conv_id % total").select("conv_id", "turn_id", F.substring(said, F.when(F.col("conv_id") % 2 == 0, 1).otherwise(61), F.lit(40)).alias("quote"))


def rated(spark: SparkSession, d: str) -> DataFrame:
    turns, block, keep, budget = pairs(spark, d), *FOLD
    asked = questions(spark, d).withColumnRenamed("question", "q")
    ways = {
        "whole": coverage.whole(turns, "conv_id"),
        "window": coverage.window(turns, "conv_id", WINDOW),
        "fitting": coverage.fitting(turns, "conv_id", WINDOW),
        "rolling": coverage.rolled(turns, "conv_id", block, keep, budget),
        "recall": coverage.recalled(turns, asked, "conv_id", SMALL),
    }
    return coverage.cases(gold(spark, d), ways, "conv_id", LIMIT)


@query("memory_cases", f"WITH {CASES_SQL} SELECT * FROM o")
def memory_cases(spark: SparkSession, d: str) -> DataFrame:
    """Five ways to keep every conversation's memory, held against its gold source."""
    return rated(spark, d)


@query(
    "memory_coverage",
    f"""WITH {CASES_SQL} SELECT strategy, count(*) AS cases, count(*) FILTER (covered) AS covered, count(*) FILTER (memory_covered) AS memory_covered, count(*) FILTER (bytes <= {LIMIT}) AS within,
  count(*) FILTER (problem IS NULL) AS accepted, CAST(sum(pieces) AS BIGINT) AS pieces, CAST(sum(bytes) AS BIGINT) AS bytes FROM o GROUP BY strategy""",
)
def memory_coverage(spark: SparkSession, d: str) -> DataFrame:
    return coverage.counters(rated(spark, d), LIMIT)


@query("tree_coverage")
def tree_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The two searches in a conversation's tree against the same gold sources."""
    path = tables.scratch(spark, "trees")
    tree.searched(table(spark, d, "conversations"), questions(spark, d)).write.parquet(path)
    ways = coverage.trees(spark.read.parquet(path))
    return coverage.counters(coverage.cases(gold(spark, d), ways, "conv_id", LIMIT), LIMIT)
