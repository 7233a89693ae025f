"""What the operators of this subpackage share: tables, scratch space and Arrow plumbing."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Upper bound of text handled at once inside a Python worker, in characters.
CHUNK_CHARS = 2_000_000
#: Bytes of an Arrow batch on its way to a worker (the session's setting is lowered to it), and of the slices it is worked off in.
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES, SLICE_BYTES = 4 << 20, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode a temporary one if the setting is absent."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = getattr(spark.sparkContext, "_weft_scratch", None)
    if own is None:
        own = spark.sparkContext._weft_scratch = "file://" + tempfile.mkdtemp(prefix="weft-")
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weft/{name}-{uuid.uuid4().hex}"


#: Tables made in each open temporary() block, the innermost last.
_scopes: list[list[DataFrame]] = []


def materialize(df: DataFrame, name: str, keep: bool = False, **options) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there.

    Within temporary() the table goes when the block ends; with keep, when the block around that one does.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    if len(_scopes) > keep:
        _scopes[-1 - keep].append(out)
    return out


@contextmanager
def temporary() -> Iterator[None]:
    """Remove the tables that are made in the block when it ends. What is read after it must be kept."""
    _scopes.append([])
    try:
        yield
    finally:
        discard(*_scopes.pop())


def discard(*tables: DataFrame) -> None:
    """Remove tables that materialize() wrote, once nothing reads them any more."""
    for df in tables:
        path = df.__dict__.pop("_weft_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns an operator is about to add, so that clashing names are replaced."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Strings of a column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def chunks(texts: list[str], limit: int = CHUNK_CHARS, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Slices of texts with at most `limit` characters (or one text) and `rows` rows each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and (size + len(t) > limit or i - start >= rows):
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `limit` bytes of text or binary, or one row each if that is longer."""
    size = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    if not len(size) or size.sum() <= limit:
        yield batch
        return
    part = (np.cumsum(size) - size) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def release() -> None:
    """Give memory that a finished task has freed back to the system: workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow with bounded batches on both sides of the pipe, and memory given back at the end of each task."""
    conf = df.sparkSession.conf
    if int(str(conf.get(BATCH_CONF)).rstrip("b")) > BATCH_BYTES:
        conf.set(BATCH_CONF, str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(x for batch in batches for x in slices(batch))
        finally:
            release()

    return df.mapInArrow(bounded, schema)


def append_columns(
    df: DataFrame, text_col: str, new: T.StructType, make: Callable[[], Callable[[list[str]], dict[str, pa.Array]]]
) -> DataFrame:
    """df plus columns computed from one text column, batch by batch on Arrow.

    make() runs once a task and returns a function from texts to the new columns.
    """
    base = without(df, *new.names)
    if text_col not in base.columns:
        raise ValueError(f"no column {text_col}")
    schema = T.StructType(base.schema.fields + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            texts = texts_of(batch.column(batch.schema.get_field_index(text_col)))
            for a, b in chunks(texts):
                part = batch.slice(a, b - a)
                cols = apply(texts[a:b])
                yield pa.RecordBatch.from_arrays([*part.columns, *[cols[n] for n in new.names]], names=[*part.schema.names, *new.names])

    return map_arrow(base, run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def tokenizer_path(name: str) -> str:
    """A public tokenizer file; WEFT_TOKENIZERS names another folder."""
    folder = os.environ.get("WEFT_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
