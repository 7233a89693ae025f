"""Arrow batches of bounded bytes on their way to Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch: without a bound, ten thousand rows of long texts go at once, with several copies of them in every worker.
BYTES = 4 << 20


def bounded(spark: SparkSession | None = None) -> None:
    """Lowers the session's bytes of an Arrow batch to BYTES; a lower setting stays. One row of more goes alone."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None and int(str(spark.conf.get(CONF)).rstrip("b")) > BYTES:
        spark.conf.set(CONF, str(BYTES))
