"""BM25 from a stored inverted index whose postings lie in blocks with their greatest impact.

A posting's impact is what its count is worth in a document of its length, before the term's weight. A block
holds a term's postings of documents of like length (CLASSES to a doubling), so that its greatest impact says
something of all of them. Two tables are stored: heads (term, block, n, best), a row a block, and postings, written by the
tasks that count them, so that none travel to make the index; those of lexical.postings() come in runs sorted by term,
of which a query reads the pages of its terms only.

A search keeps few scores: (1) blocks that promise most are read until they hold some postings, and the k-th best
of these partial scores is a threshold that k documents reach; (2) terms whose bounds together stay below it can't
lift a document alone, so only the other terms' postings, and of these only blocks that can still reach the threshold
with all other terms' bounds, make candidates; (3) candidates that can't reach it with what is missing go; (4) the rest get the other terms' postings
joined. Where the heads that a search is about fit a task (MAX_HEADS), (2) to (4) are made document by document: of the
postings of all terms that any query asks for, each travels once, not once a query, and of pairs only a task's k best. Rows are as without a store: thresholds are kept SLACK below, for scores are rounded before they are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators import lexical, ranking, scoring
from weft.operators.batches import bounded
from weft.operators.lexical import EPSILON, K1, B
from weft.sources.tables import kept

CLASSES = 8
#: Heads, each query's counted, that are sent to every task; of more, postings are joined by shuffle.
MAX_HEADS = 2_000_000
#: Postings that the first look of a query reads, for each document that is asked for.
FIRST = 40
SLACK = 2e-6


def save(posts: DataFrame, size: DataFrame, path: str) -> None:
    """posts and size as lexical.postings() and lexical.corpus() make them."""
    size.write.mode("overwrite").parquet(f"{path}/size")
    read = posts.sparkSession.read
    # one row of corpus figures
    rows = posts.join(F.broadcast(read.parquet(f"{path}/size").select("avgdl")))
    tf = F.col("tf").cast("double")
    impact = F.col("tf") * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    rows.select("term", F.floor(F.log2(F.col("len")) * CLASSES).cast("int").alias("block"), "doc", impact.alias("impact")).write.mode("overwrite").parquet(f"{path}/postings")
    heads = read.parquet(f"{path}/postings").groupBy("term", "block").agg(F.count("*").alias("n"), F.max("impact").alias("best"))
    heads.write.mode("overwrite").parquet(f"{path}/heads")


def weights(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """query, term, w: weights of the queries' terms that documents hold; idf and its mean are made of the heads. terms: query, term, times."""
    df = spark.read.parquet(f"{path}/heads").groupBy("term").agg(F.sum("n").alias("df"))
    w = df.join(F.broadcast(spark.read.parquet(f"{path}/size").select("n"))).select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("w"))
    mean = w.agg(F.avg("w").alias("mean"))
    idf = w.join(F.broadcast(mean)).select("term", F.when(F.col("w") < 0, EPSILON * F.col("mean")).otherwise(F.col("w")).alias("idf"))
    return idf.join(_small(terms, lexical.MAX_TERMS), "term").select("query", "term", (F.col("idf") * F.col("times")).alias("w"))


def _small(df: DataFrame, most: int) -> DataFrame:
    """df, sent to every task of a join if it has no more rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


class Search:
    """The steps of a search; each is a DataFrame, so that what they read and keep can be counted."""

    def __init__(self, spark: SparkSession, path: str, terms: DataFrame, k: int):
        self.k = k
        self.postings = spark.read.parquet(f"{path}/postings")
        w = kept(weights(spark, path, terms), "weights")
        heads = spark.read.parquet(f"{path}/heads").join(_small(w, lexical.MAX_TERMS), "term").select("query", "term", "w", "block", "best", "n", F.greatest(F.col("w") * F.col("best"), F.lit(0.0)).alias("bound"), F.least(F.col("w") * F.col("best"), F.lit(0.0)).alias("loss"))
        # read by all steps: as many rows as the queries' terms have blocks
        self.heads = heads = kept(heads, "heads")
        self.few = heads.count() <= MAX_HEADS
        w_all = W.partitionBy("query")
        by = w_all.orderBy(F.desc("bound"), "term", "block").rowsBetween(W.unboundedPreceding, -1)
        near = heads.filter("w > 0").withColumn("before", F.coalesce(F.sum("n").over(by), F.lit(0))).filter(F.col("before") < FIRST * k)
        partial = self._scores(near).groupBy("query", "doc").agg(F.sum("s").alias("s"))
        kth = ranking.top_k(partial, ["query"], "s", "doc", k).groupBy("query").agg(F.min("s").alias("s"), F.count("*").alias("c"))
        lists = heads.groupBy("query", "term").agg(F.max("bound").alias("bound"), F.min("loss").alias("loss"))
        # where most terms are common, weights may be negative: such a term lifts no document, and may cost each of the k as much as its greatest impact
        lost = lists.groupBy("query").agg(F.sum("loss").alias("lost"))
        none = F.lit(float("-inf"))
        least = kth.join(lost, "query").select("query", F.when(F.col("c") == k, F.col("s") + F.col("lost") - SLACK).otherwise(none).alias("least"))
        up = w_all.orderBy("bound", "term").rowsBetween(W.unboundedPreceding, 0)
        lists = lists.withColumn("upto", F.sum("bound").over(up)).withColumn("all", F.sum("bound").over(w_all)).join(least, "query", "left").withColumn("least", F.coalesce("least", none))
        lists = lists.withColumn("must", F.col("upto") >= F.col("least"))
        lists = lists.withColumn("spare", F.coalesce(F.sum(F.when(~F.col("must"), F.col("bound"))).over(w_all), F.lit(0.0)))
        self.lists = lists.join(w, ["query", "term"]).select("query", "term", "w", F.col("bound").alias("most"), "all", "least", "must", "spare")
        marked = heads.join(self.lists.drop("w"), ["query", "term"])
        self.essential = marked.filter("must AND all - most + bound >= least")
        self.others = marked.filter("NOT must")
        self.candidates = self._scores(self.essential).groupBy("query", "doc").agg(F.sum("s").alias("s")).join(self.lists.select("query", "spare", "least").distinct(), "query").filter("s + spare >= least").select("query", "doc", "s")

    def _scores(self, heads: DataFrame) -> DataFrame:
        """query, doc, s: a row for each posting of these blocks."""
        asked = heads.select("query", "term", "block", "w")
        return self.postings.join(F.broadcast(asked) if self.few else asked, ["term", "block"]).select("query", "doc", (F.col("w") * F.col("impact")).alias("s"))

    def scores(self) -> DataFrame:
        """query, doc, score in full, of all documents that can be among the k best; blocks of a needed term that were passed over count too."""
        passed = self.heads.join(self.lists.drop("w").filter("must"), ["query", "term"]).filter("all - most + bound < least")
        rest = self._scores(self.others.select("query", "term", "block", "w").unionByName(passed.select("query", "term", "block", "w")))
        more = rest.join(self.candidates.select("query", "doc"), ["query", "doc"])
        return self.candidates.unionByName(more).groupBy("query", "doc").agg(F.sum("s").alias("score"))

    def best(self, places: int) -> DataFrame:
        """query, doc, score (to some places): scores() of documents with integer ids, but for those that are not among a task's k best. For few heads."""
        spark = self.heads.sparkSession
        bounded(spark)
        plan = Plan(self.lists.orderBy("term", "query").toArrow(), self.heads.select("term", "block", "best").distinct().toArrow())
        codes = spark.createDataFrame(list(enumerate(plan.terms)), "code int, term string")
        rows = self.postings.join(F.broadcast(codes), "term").select(F.col("doc").cast("long").alias("doc"), "code", "block", "impact")
        sent, k = spark.sparkContext.broadcast(plan), self.k
        fields = [self.heads.schema["query"], T.StructField("doc", T.LongType()), T.StructField("score", T.DoubleType())]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            pick = scoring.Best(len(own.queries), k, False)

            def out(parts):
                for q, d, s, _ in parts:
                    if len(q):
                        yield pa.RecordBatch.from_arrays([own.queries.take(pa.array(q)), pa.array(d, pa.int64(), mask=d == scoring.NO_ID), pa.array(s)], names=[f.name for f in fields])

            for columns in whole(batches):
                for q, d, s in own.scores(*columns):
                    yield from out(pick.take(q, d, scoring.rounded(s, places), np.zeros(len(q), np.int64)))
            yield from out(pick.rest())

        return rows.repartition(F.xxhash64("doc")).sortWithinPartitions("doc").mapInArrow(run, T.StructType(fields))

    def work(self) -> dict[str, int]:
        """Postings of all terms of all queries, those that made candidates, candidates, and documents with any score."""
        total, read = self.heads.agg(F.sum("n")).first()[0] or 0, self.essential.agg(F.sum("n")).first()[0] or 0
        return {"postings": total, "essential": read, "candidates": self.candidates.count()}


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of batches sorted by the first, of which no value stands in two of those that are given back; a null is NO_ID."""
    rest: list[np.ndarray] = []
    for batch in batches:
        new = [pc.fill_null(batch.column(0), scoring.NO_ID).to_numpy(zero_copy_only=False), *[batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, batch.num_columns)]]
        rest = [np.concatenate(x) for x in zip(rest, new, strict=True)] if rest else new
        end = int(np.searchsorted(rest[0], rest[0][-1])) if len(rest[0]) else 0
        if end:
            yield [x[:end] for x in rest]
            rest = [x[end:] for x in rest]
    if rest and len(rest[0]):
        yield rest


class Plan:
    """What a search knows before it scores: of each term the queries with their weights and thresholds, of each block its greatest impact.

    lists: rows of Search.lists by term and query; blocks: term, block, best.
    """

    def __init__(self, lists: pa.Table, blocks: pa.Table):
        of = lambda table, name: table.column(name).combine_chunks()
        terms, queries = (of(lists, name).dictionary_encode() for name in ("term", "query"))
        self.terms, self.queries = terms.dictionary.to_pylist(), queries.dictionary
        code, self.query = (x.indices.to_numpy().astype(np.int64) for x in (terms, queries))
        self.start = np.searchsorted(code, np.arange(len(self.terms) + 1))
        self.weight, all_, most, least, spare = (of(lists, name).to_numpy() for name in ("w", "all", "most", "least", "spare"))
        # a block of this bound at least makes candidates; of the other terms none does
        self.cut = np.where(of(lists, "must").to_numpy(zero_copy_only=False), least - all_ + most, np.inf)
        self.least = np.full(len(self.queries), -np.inf)
        self.least[self.query] = least - spare
        at = pc.index_in(of(blocks, "term"), value_set=terms.dictionary).to_numpy().astype(np.int64)
        block = of(blocks, "block").to_numpy().astype(np.int64)
        self.low, self.width = (int(block.min()), int(block.max() - block.min()) + 1) if len(block) else (0, 1)
        self.bound = np.zeros(len(self.terms) * self.width)
        self.bound[at * self.width + block - self.low] = of(blocks, "best").to_numpy()

    def scores(self, doc: np.ndarray, term: np.ndarray, block: np.ndarray, impact: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """query (its place), document and full score of all candidates. doc is sorted and whole."""
        n = len(self.queries)
        ids, at = np.unique(doc, return_inverse=True)
        most = self.bound[term.astype(np.int64) * self.width + block - self.low]
        each = (self.start[1:] - self.start[:-1])[term]
        upto, step, a = np.concatenate([[0], np.cumsum(each)]), max(1, scoring.CELLS // n), 0
        while a < len(doc):
            # whole documents, as many as a block of cells holds
            full = int(np.searchsorted(upto, upto[a] + scoring.CELLS, side="right")) - 1
            first, last = at[a], at[full] if full < len(at) else at[-1] + 1
            z = int(np.searchsorted(at, max(first + 1, min(first + step, last))))
            post = np.repeat(np.arange(a, z), each[a:z])
            pos = np.arange(upto[a], upto[z]) - upto[post] + self.start[term[post]]
            cells = (int(at[z - 1] - first) + 1) * n
            cell, s, w = (at[post] - first) * n + self.query[pos], self.weight[pos] * impact[post], self.weight[pos]
            leads = np.maximum(w * most[post], 0.0) >= self.cut[pos]
            partial, hit = np.bincount(cell[leads], s[leads], cells), np.zeros(cells, bool)
            hit[cell[leads]] = True
            hit &= partial >= np.tile(self.least, cells // n)
            more = hit[cell] & ~leads
            score, found = partial + np.bincount(cell[more], s[more], cells), np.flatnonzero(hit)
            yield found % n, ids[found // n + first], score[found]
            a = z


def top_k(spark: SparkSession, path: str, queries: DataFrame, tokens, k: int, query_id: str = "query_id") -> DataFrame:
    """query, doc, score (to 6 places), rank: the k best documents of each query."""
    search = Search(spark, path, lexical.query_terms(queries, tokens, query_id), k)
    if search.few and isinstance(search.postings.schema["doc"].dataType, T.IntegralType):
        found = search.best(6)
    else:
        found = search.scores().withColumn("score", F.round("score", 6))
    return ranking.top_k(found, ["query"], "score", "doc", k)
