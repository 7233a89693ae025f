"""Exact top-k by inner product with MaxScore pruning.

Components are integers floor(scale * x). A shard is what one task holds of the vectors; in it
a dimension is a term whose posting of a vector weighs the component's distance from the
shard's least one (for a positive query weight) or its greatest one (for a negative weight), so
that every contribution is at least 0 and a query's score is a constant of the shard plus the
sum of its terms' contributions. The greatest contribution bounds a term. Terms are ordered by
bound; those at the end whose bounds together can't lift a vector over the query's k-th best
score so far are non-essential. The essential terms' postings are traversed first; the others
are probed one group after another, only for vectors that still can compete. Vectors whose
upper bound equals the threshold stay, for ties go to smaller ids. Each task keeps a query's k
best over all its batches; the tasks' results are merged by query.

Queries go to the tasks in blocks of bounded size; the result of each block is a table in the
shared folder.

Defined results: vectors that are null, empty, or hold a null, NaN or infinite component, and
rows with a null id, take no part, as query or as candidate. A vector is compared with queries
of its own length only. Scores beyond a long's range are held at its ends. Rows that repeat an id are separate candidates (none of them is a
candidate of a query with that id); a repeated query id is answered once for each distinct
vector. An empty table, or one without a query, gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.common import map_arrow, scratch_path

K = 10
SCALE = 1024
#: Bytes of query vectors that go to the tasks at once.
BLOCK_BYTES = 8 << 20
#: Vectors compared at once, and terms probed at once.
ROWS, STEP = 4096, 8
RESULT = "query_id long, query_no long, vec_id long, score long"


LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); as Python integers if that leaves the range of doubles."""
    with np.errstate(over="ignore"):
        out = np.floor(values * scale)
    if np.isfinite(out).all():
        return out
    return np.array([[int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in row] for row in values.tolist()], dtype=object)


def exact_scores(mat: np.ndarray, vec: np.ndarray) -> np.ndarray:
    """Inner products by Python integers, held at the ends of a long's range."""
    mine = [int(x) for x in vec]
    return np.array([max(LONG_MIN, min(LONG_MAX, sum(int(a) * b for a, b in zip(row, mine, strict=True)))) for row in mat], dtype=np.int64)


def floored(batch_ids: pa.Array, batch_vecs: pa.Array, scale: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and integer matrix of the usable vectors, one pair for each length."""
    found: dict[int, tuple[list, list]] = {}
    if isinstance(batch_vecs, pa.ChunkedArray):
        batch_vecs = batch_vecs.combine_chunks()
    flat, offsets = batch_vecs.values, batch_vecs.offsets.to_numpy()
    null = np.asarray(batch_vecs.is_null()) | np.asarray(batch_ids.is_null())
    holes = np.asarray(flat.is_null())
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(holes | ~np.isfinite(values))])
    lengths = offsets[1:] - offsets[:-1]
    use = ~null & (lengths > 0) & (bad[offsets[1:]] == bad[offsets[:-1]])
    ids = batch_ids.fill_null(0).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[use]):
        rows = np.flatnonzero(use & (lengths == n))
        found[int(n)] = (ids[rows].astype(np.int64), whole(values[offsets[rows][:, None] + np.arange(n)], scale))
    return list(found.values())


@dataclass
class Block:
    """Queries of one length: their numbers, ids and integer vectors, and their best so far."""

    no: np.ndarray
    ids: np.ndarray
    vecs: np.ndarray
    best: list = field(default_factory=list)

    def start(self, k: int) -> None:
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in self.ids]
        self.k, self.scored = k, 0

    def offer(self, ids: np.ndarray, mat: np.ndarray) -> None:
        """Compare a batch of the shard with all queries. What sums might leave the integers that doubles hold is added up by Python's own."""
        limit = math.isqrt(2**52 // mat.shape[1])
        calm = (np.abs(mat) < limit).all(axis=1).astype(bool)
        if not calm.all():
            for q, (qid, vec) in enumerate(zip(self.ids, self.vecs, strict=True)):
                self._take(q, exact_scores(mat[~calm], vec), ids[~calm], ids[~calm] != qid)
            self.scored += int((~calm).sum()) * self.vecs.size
            ids, mat = ids[calm], mat[calm].astype(np.float64)
            if not len(ids):
                return
        low, high = mat.min(axis=0), mat.max(axis=0)
        for q, (qid, vec) in enumerate(zip(self.ids, self.vecs, strict=True)):
            if not (np.abs(vec) < limit).all():
                self._take(q, exact_scores(mat, vec), ids, ids != qid)
                self.scored += len(ids) * len(vec)
                continue
            vec = vec.astype(np.float64)
            have = self.best[q]
            threshold = max(-(2**53), min(2**53, int(have[0][-1]))) if len(have[0]) == self.k else None
            base = np.where(vec > 0, vec * low, vec * high)
            bound = np.where(vec > 0, vec * high, vec * low) - base
            order = np.argsort(-bound, kind="stable")
            rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # bounds of the terms from each place on
            total = float(base.sum())
            rows = np.arange(len(ids))
            if threshold is None:
                score = mat @ vec
                self.scored += len(ids) * len(vec)
            else:
                essential = int((total + rest[:-1] >= threshold).sum())
                if not essential:
                    continue
                first = order[:essential]
                start = min(essential, STEP)
                score = total + mat[:, first[:start]] @ vec[first[:start]] - base[first[:start]].sum()
                self.scored += len(ids) * start
                at = start
                while at < len(order):
                    keep = score + rest[at] >= threshold
                    if not keep.all():
                        rows, score = rows[keep], score[keep]
                    if not len(rows):
                        break
                    more = order[at : at + STEP]
                    score = score + mat[np.ix_(rows, more)] @ vec[more] - base[more].sum()
                    self.scored += len(rows) * len(more)
                    at += STEP
                if not len(rows):
                    continue
            own = ids[rows] != qid
            if threshold is not None:
                own &= score >= threshold
            elif int(own.sum()) > 4 * self.k:
                own &= score >= np.partition(score[own], -self.k)[-self.k]
            self._take(q, score.astype(np.int64), ids[rows], own)

    def _take(self, q: int, score: np.ndarray, ids: np.ndarray, use: np.ndarray) -> None:
        """Merge the rows in use with the best of a query."""
        if use.any():
            s, i = np.concatenate([self.best[q][0], score[use]]), np.concatenate([self.best[q][1], ids[use]])
            top = np.lexsort((i, ~s))[: self.k]
            self.best[q] = (s[top], i[top])


def _blocks(queries: DataFrame, id_col: str, vec_col: str, scale: int, limit: int) -> Iterator[dict[int, Block]]:
    """The queries, in blocks of at most `limit` bytes, by length of vector."""
    held: dict[int, list] = {}
    size = no = 0

    def done():
        return {n: Block(np.array([x[0] for x in rows]), np.array([x[1] for x in rows]), np.array([x[2] for x in rows])) for n, rows in held.items()}

    for row in queries.select(F.col(id_col).cast("long"), F.col(vec_col)).distinct().toLocalIterator():
        one = pa.array([row[1]], pa.list_(pa.float64()))
        for ids, mat in floored(pa.array([row[0]], pa.int64()), one, scale):
            held.setdefault(mat.shape[1], []).append((no, int(ids[0]), mat[0]))
            no, size = no + 1, size + mat.nbytes
        if size >= limit:
            yield done()
            held, size = {}, 0
    if held:
        yield done()


def search(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    out = scratch_path(spark, "topk")
    empty = spark.createDataFrame([], RESULT)
    empty.write.parquet(out)
    best = W.partitionBy("query_no").orderBy(F.desc("score"), "vec_id")
    for block in _blocks(vectors.filter(is_query & F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()), id_col, vec_col, scale, block_bytes):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = {n: Block(b.no, b.ids, b.vecs) for n, b in sent.value.items()}
            for b in own.values():
                b.start(k)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    for ids, mat in floored(part.column(0), part.column(1), scale):
                        if mat.shape[1] in own:
                            own[mat.shape[1]].offer(ids, mat)
            for b in own.values():
                counts = [len(s) for s, _ in b.best]
                if sum(counts):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(b.ids, counts), pa.int64()),
                            pa.array(np.repeat(b.no, counts), pa.int64()),
                            pa.array(np.concatenate([i for _, i in b.best]), pa.int64()),
                            pa.array(np.concatenate([s for s, _ in b.best]), pa.int64()),
                        ],
                        names=["query_id", "query_no", "vec_id", "score"],
                    )

        found = map_arrow(rows, run, RESULT)
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank").write.mode("append").parquet(out)
        sent.unpersist()
    merged = spark.read.schema(RESULT).parquet(out)
    return merged.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score")
