"""Queries on releases: results published with their raw rows, and checked by making them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.plans.catalog import query, table
from weft.sources import release, tables


def by_customer(raw: release.Raw) -> DataFrame:
    return raw["orders"].groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("cents").cast("long").alias("cents"))


def by_status(raw: release.Raw) -> DataFrame:
    return raw["orders"].groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("cents").cast("long").alias("cents"), F.max("o_orderkey").alias("last"))


AGGREGATES: release.Aggregates = {"by_customer": by_customer, "by_status": by_status}
_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"


@query(
    "release_differences",
    f"""
  WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus, {_CENTS} AS cents FROM orders),
  b AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 97 = 0 THEN cents + 1 ELSE cents END AS cents FROM a WHERE o_orderkey % 89 <> 0),
  p AS (SELECT 'by_customer' AS aggregate, CAST(to_json({{'o_custkey': o_custkey, 'n': count(*), 'cents': CAST(sum(cents) AS BIGINT)}}) AS VARCHAR) AS row FROM a GROUP BY o_custkey
    UNION ALL SELECT 'by_status', CAST(to_json({{'o_orderstatus': o_orderstatus, 'n': count(*), 'cents': CAST(sum(cents) AS BIGINT), 'last': max(o_orderkey)}}) AS VARCHAR) FROM a GROUP BY o_orderstatus),
  r AS (SELECT 'by_customer' AS aggregate, CAST(to_json({{'o_custkey': o_custkey, 'n': count(*), 'cents': CAST(sum(cents) AS BIGINT)}}) AS VARCHAR) AS row FROM b GROUP BY o_custkey
    UNION ALL SELECT 'by_status', CAST(to_json({{'o_orderstatus': o_orderstatus, 'n': count(*), 'cents': CAST(sum(cents) AS BIGINT), 'last': max(o_orderkey)}}) AS VARCHAR) FROM b GROUP BY o_orderstatus)
  SELECT aggregate, 'published' AS side, row, CAST(1 AS BIGINT) AS n FROM (FROM p EXCEPT FROM r) UNION ALL SELECT aggregate, 'recomputed', row, 1 FROM (FROM r EXCEPT FROM p)
""",
)
def release_differences(spark: SparkSession, d: str) -> DataFrame:
    """Orders published with their totals; then raw rows are changed and lost, and the manifest made to fit: the totals made again differ."""
    path = tables.scratch(spark, "release")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    release.publish(spark, path, {"orders": orders}, AGGREGATES)
    changed = orders.filter("o_orderkey % 89 <> 0").withColumn("cents", F.when(F.col("o_orderkey") % 97 == 0, F.col("cents") + 1).otherwise(F.col("cents")))
    changed.write.mode("overwrite").parquet(f"{path}/raw/orders")
    release.seal(spark, path)
    return release.differences(spark, path, ["orders"], AGGREGATES)
