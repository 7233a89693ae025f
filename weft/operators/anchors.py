"""Picture anchors in texts, and the pictures of chunks cut from them.

The n-th anchor of a text stands for the n-th name of its list; anchors beyond the list stand for none. A
chunk has the pictures whose anchors lie wholly in its span, in order; chunks that overlap share them, and an
anchor that a chunk's border cuts belongs to neither side. Spans are counted in characters from 0, ends exclusive.

Anchors have one bin of WIDTH characters each, chunks those they touch; so anchors meet only chunks near
them, and a long text is dealt over its bins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.batches import bounded

MARK = "<PIC>"
WIDTH = 4096


def anchors(texts: DataFrame, key: str, text: str, names: str, mark: str = MARK) -> DataFrame:
    """key, n (from 0), start, end, name: the named anchors of every text. `key` is unique; null texts and lists have none."""
    bounded(texts.sparkSession)
    sign = re.compile(re.escape(mark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, n, start, name = [], [], [], []
            for i, (t, named) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for k, (m, x) in enumerate(zip(sign.finditer(t or ""), named or ())):  # noqa: B905
                    if x is not None:
                        row.append(i), n.append(k), start.append(m.start()), name.append(x)
            at = pa.array(start, pa.int64())
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(n, pa.int32()), at, pc.add(at, len(mark)), pa.array(name, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    fields = [texts.schema[key], *[T.StructField(c, kind) for c, kind in (("n", T.IntegerType()), ("start", T.LongType()), ("end", T.LongType()), ("name", T.StringType()))]]
    return texts.select(key, text, names).mapInArrow(run, T.StructType(fields))


def chunk_pictures(chunks: DataFrame, found: DataFrame, key: str, chunk: str, start: str = "start", end: str = "end", out: str = "pics", width: int = WIDTH) -> DataFrame:
    """chunks with the names of the anchors inside each, in order. (key, chunk) is unique; chunks without a picture have an empty list."""
    bins = F.when(F.col(end) > F.col(start), F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)))
    # the chunks' one use: those of a text are cut anew for each
    spans = chunks.withColumn("__bin", F.explode_outer(bins))
    marks = found.select(key, F.col("start").alias("__s"), F.col("end").alias("__e"), "name", F.floor(F.col("start") / width).alias("__bin"))
    inside = (marks["__s"] >= spans[start]) & (marks["__e"] <= spans[end])
    both = spans.join(marks, (spans[key] == marks[key]) & (spans["__bin"] == marks["__bin"]) & inside, "left").select(spans["*"], "__s", "name").drop("__bin")
    rest = [c for c in chunks.columns if c not in (key, chunk)]
    lists = both.groupBy(key, chunk).agg(*[F.first(c).alias(c) for c in rest], F.array_sort(F.collect_list(F.when(F.col("__s").isNotNull(), F.struct("__s", "name")))).alias("__x"))
    return lists.select(*chunks.columns, F.transform("__x", lambda x: x["name"]).alias(out))
