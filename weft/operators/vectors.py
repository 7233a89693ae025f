"""Dense vectors: normalising, similarity, pooling and bounded clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of query vectors that may be sent to every task.
MAX_QUERY_BYTES = 64 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column, floor: float = 1e-12) -> Column:
    n = F.greatest(norm(v), F.lit(floor))
    return F.transform(v, lambda x: x.cast("double") / n)


def normalised_strict(v: Column) -> Column:
    """Normalised; a zero or non-finite vector raises."""
    return F.when((norm(v) > 0) & ~F.isnan(norm(v)) & (norm(v) < float("inf")), normalised(v)).otherwise(F.raise_error(F.lit("a vector that is zero or not finite")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def _query_blocks(queries: DataFrame, query_id: str, vec_col: str, most: int = MAX_QUERY_BYTES):
    """Ids and matrices of the queries, by length of vector, in blocks of at most `most` bytes."""
    held: dict[int, list] = {}
    size = 0
    pack = lambda: {n: (np.array([i for i, _ in rows], dtype=np.int64), np.stack([v for _, v in rows])) for n, rows in held.items()}
    for row in queries.select(query_id, vec_col).filter(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).toLocalIterator():
        v = np.asarray(row[1], dtype=np.float64)
        held.setdefault(len(v), []).append((row[0], v))
        size += v.nbytes
        if size >= most:
            yield pack()
            held, size = {}, 0
    if held:
        yield pack()


def _matrices(pdf: pd.DataFrame, id_col: str, vec_col: str):
    """Ids and matrix of the vectors of each length."""
    pdf = pdf[pdf[vec_col].notna()]
    size = pdf[vec_col].map(len)
    for n in sorted(size.unique()):
        own = pdf[size == n]
        if n:
            yield int(n), own[id_col].to_numpy(), np.stack(own[vec_col].to_numpy()).astype(np.float64)


def similarities(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", query_id: str = "query_id", other_only: bool = True) -> DataFrame:
    """query_id, id_col, score, rank: each query's k most similar vectors of its own length by cosine.

    Each task keeps its own k best of every query (NumPy blocks), so what is shuffled is k rows a
    query and task. The queries are sent to the tasks if they take at most MAX_QUERY_BYTES; more
    are worked off in blocks of that size.
    """
    spark, out = vectors.sparkSession, None
    schema = f"{query_id} long, {id_col} long, score double"
    for block in [*_query_blocks(queries, query_id, vec_col)] or [{}]:
        sent = spark.sparkContext.broadcast({n: (ids, unit_rows(mat)) for n, (ids, mat) in block.items()})

        def search(batches, sent=sent):
            best: dict[int, pd.DataFrame] = {}
            for pdf in batches:
                for n, own, v in _matrices(pdf, id_col, vec_col):
                    ids, mat = sent.value.get(n, (np.zeros(0, np.int64), np.zeros((0, n))))
                    score = np.round(mat @ unit_rows(v).T, 9)
                    for q, qid in enumerate(ids.tolist()):
                        s, i = score[q], own
                        if other_only:
                            s, i = s[i != qid], i[i != qid]
                        new = pd.DataFrame({query_id: qid, id_col: i, "score": s})
                        new = pd.concat([best[qid], new]) if qid in best else new
                        best[qid] = new.sort_values(["score", id_col], ascending=[False, True]).head(k)
            yield from best.values()

        found = vectors.select(F.col(id_col).cast("long").alias(id_col), vec_col).mapInPandas(search, schema)
        out = found if out is None else out.unionByName(found)
    best = W.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def cosine_columns(vectors: DataFrame, queries: DataFrame, parts: dict[str, int | None], id_col: str = "vec_id", vec_col: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """query_id, id_col and a cosine for each of parts: a name and how many of the first components count (null: all).

    A stated set of queries against all other vectors of their length, block by block in NumPy: every norm is made once,
    and all parts in one pass.
    """
    spark, out = vectors.sparkSession, None
    schema = f"{query_id} long, {id_col} long, " + ", ".join(f"{name} double" for name in parts)
    for block in [*_query_blocks(queries, query_id, vec_col)] or [{}]:
        sent = spark.sparkContext.broadcast(block)

        def score(batches, sent=sent):
            for pdf in batches:
                for n, own, v in _matrices(pdf, id_col, vec_col):
                    ids, mat = sent.value.get(n, (np.zeros(0, np.int64), np.zeros((0, n))))
                    if not len(ids):
                        continue
                    for a in range(0, len(own), 4096):
                        near = own[a : a + 4096]
                        other = ids[:, None] != near[None, :]
                        cols = {query_id: np.broadcast_to(ids[:, None], other.shape)[other], id_col: np.broadcast_to(near, other.shape)[other]}
                        for name, width in parts.items():
                            cols[name] = (unit_rows(mat[:, :width]) @ unit_rows(v[a : a + 4096, :width]).T)[other]
                        yield pd.DataFrame(cols)

        found = vectors.select(F.col(id_col).cast("long").alias(id_col), vec_col).mapInPandas(score, schema)
        out = found if out is None else out.unionByName(found)
    return out


def mean_pool(vectors: DataFrame, owner: str, vec_col: str = "embedding") -> DataFrame:
    """Each owner's normalised mean vector (`pooled`) and number of parts; partial sums come before the shuffle."""
    parts = vectors.filter(F.col(vec_col).isNotNull()).select(owner, F.posexplode(vec_col).alias("pos", "x"))
    means = parts.groupBy(owner, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    rows = means.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"), F.max("n").alias("parts"))
    return rows.select(owner, "parts", normalised(F.transform("v", lambda p: p["x"])).alias("pooled"))


def index_aligned(index: DataFrame, manifest: DataFrame, id_col: str) -> DataFrame:
    """aligned, missing, extra: whether an index holds just the manifest's ids."""
    both = index.select(F.col(id_col)).withColumn("i", F.lit(1)).join(manifest.select(id_col).withColumn("m", F.lit(1)), id_col, "full")
    out = both.agg(F.count_if(F.col("i").isNull()).alias("missing"), F.count_if(F.col("m").isNull()).alias("extra"))
    return out.withColumn("aligned", (F.col("missing") == 0) & (F.col("extra") == 0))


def order_digest(rows: DataFrame, id_col: str, pos: str) -> DataFrame:
    """n and digest, one row, of ids in an order: each id with its place, hashed and added up, so that no list of them is made."""
    place = F.xxhash64(F.col(id_col).cast("string"), F.col(pos).cast("long"))
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(place.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("digest"))


def alignment(index: DataFrame, expected: DataFrame, id_col: str, pos: str) -> DataFrame:
    """aligned and reason (rows, order; null if aligned): an index against the digest of its manifest; if it isn't aligned, it isn't to be used."""
    both = order_digest(index, id_col, pos).crossJoin(F.broadcast(expected.toDF("want_n", "want")))  # a row either side
    reason = F.when(F.col("n") != F.col("want_n"), "rows").when(F.col("digest") != F.col("want"), "order")
    return both.select(reason.isNull().alias("aligned"), reason.alias("reason"))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)


def far_apart(vectors: np.ndarray, k: int) -> list[int]:
    """k places, each the least like all before it; the first vector is the first."""
    picked, nearest = [0], vectors @ vectors[0]
    for _ in range(k - 1):
        nearest[picked[-1]] = np.inf
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, vectors @ vectors[picked[-1]])
    return picked


def allotted(score: np.ndarray, size: int) -> np.ndarray:
    """The cluster of each point if every one asks for its best cluster, and clusters asked by more than `size` turn the least sure ones away to their next.

    All clusters prefer the same points (those whose best and worst score lie furthest apart), so
    the outcome doesn't depend on the order of asking: the surest point gets its first wish, and so on.
    """
    n = len(score)
    wishes = np.argsort(-score, axis=1, kind="stable")
    standing = np.empty(n, np.int64)
    standing[np.argsort(score.min(axis=1) - score.max(axis=1), kind="stable")] = np.arange(n)
    wish = np.zeros(n, np.int64)
    while True:
        asked = wishes[np.arange(n), wish]
        order = np.lexsort((standing, asked))
        queue = np.arange(n) - np.searchsorted(asked[order], asked[order])
        away = order[queue >= size]
        if not len(away):
            return asked
        wish[away] += 1


def bounded_clusters(vectors: np.ndarray, size: int, rounds: int = 8) -> list[list[int]]:
    """Spherical k-means with at most `size` members a cluster; seeds lie far apart. Deterministic: ties go to the lower place."""
    if not len(vectors):
        return []
    centres, groups = vectors[far_apart(vectors, -(-len(vectors) // size))], None
    for _ in range(rounds):
        home = allotted(vectors @ centres.T, size)
        _, home = np.unique(home, return_inverse=True)  # empty clusters go
        if groups is not None and np.array_equal(home, groups):
            break
        groups = home
        sums = np.zeros((home.max() + 1, vectors.shape[1]))
        np.add.at(sums, home, vectors)
        centres = unit_rows(sums / np.bincount(home)[:, None])
    return [np.flatnonzero(groups == c).tolist() for c in range(groups.max() + 1)]
