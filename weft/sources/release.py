"""Published results that anyone can check again: raw rows, the aggregates made from them, digests of all files.

A release is a new folder with `raw/<table>` and `aggregates/<name>` in Parquet and `manifest` (name, bytes and
sha256 of every other file). Nothing is written if a string in the raw rows holds what may not be published, or
links to a host outside the allowed ones; files appear under their folder only when complete, the manifest last.

It is verified in two ways. `changed_files` holds the digests of the files against the manifest. `differences`
makes every aggregate again from the raw rows and returns the rows that only one side has, so that a release
whose manifest was made to fit a changed row is found too. Aggregates are compared exactly: make them of
integers, decimals or rounded values, since sums of doubles depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import text as tx
from weft.sources import tables

Raw = dict[str, DataFrame]
Aggregates = dict[str, Callable[[Raw], DataFrame]]


def refused(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """column, problem, n: string columns whose values may not be published, with the number of rows."""
    strings = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
    bad = lambda c: {"private": tx.unsafe(c), "link": F.size(tx.foreign_links(c, allowed)) > 0}
    counts = [F.struct(F.lit(c).alias("column"), F.lit(kind).alias("problem"), F.count_if(hit).alias("n")) for c in strings for kind, hit in bad(F.col(f"`{c}`")).items()]
    kind = "array<struct<column: string, problem: string, n: bigint>>"
    found = rows.agg((F.array(*counts) if counts else F.array().cast(kind)).alias("x"))
    return found.select(F.inline("x")).filter("n > 0")


def publish(spark: SparkSession, path: str, raw: Raw, aggregates: Aggregates, allowed: list[str] | None = None) -> None:
    """Write a release into a new folder. Raises, before anything is written, if raw rows may not be published or a release is there."""
    if tables.exists(spark, f"{path}/manifest"):
        raise FileExistsError(f"{path} holds a release")
    for name, rows in raw.items():
        found = refused(rows, allowed or []).collect()  # two rows a column at most
        if found:
            raise ValueError(f"{name} may not be published: {[r.asDict() for r in found]}")
    for name, rows in raw.items():
        rows.write.parquet(f"{path}/raw/{name}")
    kept = _read(spark, path, "raw", raw)
    for name, make in aggregates.items():
        make(kept).write.parquet(f"{path}/aggregates/{name}")
    seal(spark, path)


def seal(spark: SparkSession, path: str) -> None:
    """Write the manifest of the files as they are."""
    digests(spark, path).write.mode("overwrite").json(f"{path}/manifest")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """name (below the folder), bytes, sha256 of a release's files but the manifest. A file must be under 2 GB."""
    out = None
    for part in ("raw", "aggregates"):
        df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/{part}")
        name = F.regexp_extract("path", f"/({part}/[^/]+/[^/]+)$", 1)
        df = df.select(name.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        out = df if out is None else out.unionByName(df)
    return out


def changed_files(spark: SparkSession, path: str) -> DataFrame:
    """name and problem: files that are missing, unknown or changed against the manifest."""
    manifest = spark.read.schema("name string, bytes long, sha256 string").option("mode", "FAILFAST").json(f"{path}/manifest")
    return tables.verify_digests(digests(spark, path), manifest)


def _read(spark: SparkSession, path: str, kind: str, names) -> Raw:
    return {name: spark.read.parquet(f"{path}/{kind}/{name}") for name in names}


def differences(spark: SparkSession, path: str, raw: list[str], aggregates: Aggregates) -> DataFrame:
    """aggregate, side, row (JSON), n: rows that are published and not made again, or the other way round, each with how many times more."""
    given, published, out = _read(spark, path, "raw", raw), _read(spark, path, "aggregates", aggregates), None
    for name, make in aggregates.items():
        row = F.to_json(F.struct(*[f"`{c}`" for c in published[name].columns]), {"ignoreNullFields": "false"})
        both = published[name].select(row.alias("row"), F.lit(1).alias("d")).unionByName(make(given).select(row.alias("row"), F.lit(-1).alias("d")))
        n = both.groupBy("row").agg(F.sum("d").alias("d")).filter("d <> 0")
        part = n.select(F.lit(name).alias("aggregate"), F.when(F.col("d") > 0, "published").otherwise("recomputed").alias("side"), "row", F.abs("d").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def verify(spark: SparkSession, path: str, raw: list[str], aggregates: Aggregates) -> None:
    """Raises if a file differs from the manifest, else if an aggregate differs from what its raw rows give."""
    files = changed_files(spark, path).orderBy("name").limit(5).collect()
    if files:
        raise ValueError(f"files differ: {[tuple(r) for r in files]}")
    rows = differences(spark, path, raw, aggregates).orderBy("aggregate", "row").limit(5).collect()
    if rows:
        raise ValueError(f"aggregates differ: {[tuple(r) for r in rows]}")
