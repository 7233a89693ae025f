"""Ranking, fusion and list merging. Every order has an explicit last tie-break."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60
# Weights of the lexical, dense and visual ranks in each mode.
MODES = {"bm25": (1.0, 0.0, 0.0), "dense": (0.0, 1.0, 0.0), "visual": (0.0, 0.0, 1.0), "hybrid": (0.45, 0.55, 0.0), "visual_hybrid": (0.45, 0.0, 0.55), "tri_hybrid": (0.30, 0.35, 0.35)}


def nan_last(score: Column) -> Column:
    """A score with NaN as minus infinity (Spark itself sorts NaN first in descending order)."""
    return F.when(F.isnan(score), F.lit(float("-inf"))).otherwise(score)


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, by: list[str], score: str, tie: str, k: int, name: str = "rank") -> DataFrame:
    """The k best rows of each group: score down, tie up, NaN last; k below 1 gives none."""
    return ranked(df, by, [nan_last(F.col(score)).desc_nulls_last(), F.col(tie)], name).filter(F.col(name) <= k)


def effective_mode(requested: str, dense: bool, visual: bool, strict: bool = False) -> str:
    """The mode that the available modalities allow; strict raises where it differs."""
    got = requested
    if got == "tri_hybrid" and not (dense and visual):
        got = "hybrid" if dense else "visual_hybrid" if visual else "bm25"
    if got in ("hybrid", "dense") and not dense or got in ("visual", "visual_hybrid") and not visual:
        got = "bm25"
    if strict and got != requested:
        raise ValueError(f"mode {requested} is unavailable; {got} would be used")
    return got


def effective_modes(requested: Column, dense: Column, visual: Column) -> Column:
    """effective_mode for rows, each with the modalities that it has; null counts as absent."""
    d, v = F.coalesce(dense, F.lit(False)), F.coalesce(visual, F.lit(False))
    two = F.when(d, "hybrid").when(v, "visual_hybrid").otherwise("bm25")
    got = F.when((requested == "tri_hybrid") & ~(d & v), two).otherwise(requested)
    return F.when(got.isin("hybrid", "dense") & ~d, "bm25").when(got.isin("visual", "visual_hybrid") & ~v, "bm25").otherwise(got)


def rrf(ranks: DataFrame, mode: str, k: int = RRF_K) -> DataFrame:
    """score: weighted reciprocal ranks of columns bm25_rank, dense_rank, visual_rank; a missing rank adds nothing."""
    parts = [F.coalesce(F.lit(w) / (k + F.col(c)), F.lit(0.0)) for w, c in zip(MODES[mode], ("bm25_rank", "dense_rank", "visual_rank"), strict=True) if w]
    score = parts[0]
    for p in parts[1:]:
        score = score + p
    return ranks.withColumn("score", score)


def fused_top_k(df: DataFrame, by: list[str], item: str, scores: dict[str, float], k: int, places: int = 9, rrf_k: int = RRF_K) -> DataFrame:
    """by, item, score, rank: the k best of each group by weighted reciprocal ranks, as if all its rows were ranked by each of `scores` (name: weight).

    No task ranks a whole group. The k best of the heaviest score set a floor, so that whatever reaches it is among the `depth`
    best of some score; these are found by partial limits. Those that can't reach the floor even at the best ranks left to them
    go. The exact ranks of the rest, `depth` times the scores a group at most, are counts of the rows before them, summed
    within the tasks. Null and NaN scores come last; items must be unique in a group.
    """
    heavy = max(scores.values())
    depth = math.floor(sum(scores.values()) * (rrf_k + k) / heavy - rrf_k) + 2
    rows = df.select(*by, item, *[nan_last(F.coalesce(F.col(c).cast("double"), F.lit(float("-inf")))).alias(c) for c in scores])
    at = None
    for c in scores:
        part = ranked(rows, by, [F.desc(c), F.col(item)], "__at").filter(F.col("__at") <= depth)
        part = part.select(*by, item, *scores, *[(F.col("__at") if x == c else F.lit(None).cast("int")).alias(f"__{x}") for x in scores])
        at = part if at is None else at.unionByName(part)
    at = at.groupBy(*by, item, *scores).agg(*[F.min(f"__{c}").alias(f"__{c}") for c in scores])
    sure, most = F.lit(0.0), F.lit(0.0)
    for c, w in scores.items():
        sure = sure + F.coalesce(F.lit(w) / (rrf_k + F.col(f"__{c}")), F.lit(0.0))
        most = most + F.lit(w) / (rrf_k + F.coalesce(F.col(f"__{c}"), F.lit(depth + 1)))
    kth = ranked(at.select(*by, item, sure.alias("__sure"), most.alias("__most"), *scores), by, [F.desc("__sure"), F.col(item)], "__n")
    floor = F.min(F.when(F.col("__n") <= k, F.col("__sure"))).over(W.partitionBy(*by))
    kept = kth.withColumn("__floor", floor).filter(F.col("__most") >= F.col("__floor") - 10.0**-places).select(*[F.col(b).alias(f"__{b}") for b in by], F.col(item).alias("__item"), *[F.col(c).alias(f"__{c}") for c in scores])
    # a row counts for every kept item that it comes before, or is
    before = lambda c: (F.col(c) > F.col(f"__{c}")) | ((F.col(c) == F.col(f"__{c}")) & (F.col(item) <= F.col("__item")))
    same = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]
    counts = rows.join(kept, same).groupBy(*[f"__{b}" for b in by], "__item").agg(*[F.count_if(before(c)).alias(f"__{c}") for c in scores])
    score = F.lit(0.0)
    for c, w in scores.items():
        score = score + F.lit(w) / (rrf_k + F.col(f"__{c}"))
    out = counts.select(*[F.col(f"__{b}").alias(b) for b in by], F.col("__item").alias(item), F.round(score, places).alias("score"))
    return top_k(out, by, "score", item, k)


def capped(df: DataFrame, by: list[str], cap_on: str, score: str, tie: str, cap: int, k: int) -> DataFrame:
    """At most cap rows of each record, then the k best of each group."""
    kept = ranked(df, [*by, cap_on], [F.desc(score), F.col(tie)], "of_record").filter(F.col("of_record") <= cap)
    return ranked(kept, by, [F.desc(score), F.col(tie)]).filter(F.col("rank") <= k).drop("of_record")


def relevance_gate(df: DataFrame, by: list[str], score: str, least_best: float = 2.0, absolute: float = 0.25, relative: float = 0.10) -> DataFrame:
    """Groups whose best score reaches least_best, and of these the rows that reach max(absolute, relative * best)."""
    # bests are found by partial aggregation: a window would sort all rows of a group in one task
    best = df.groupBy(*by).agg(F.max(score).alias("best")).filter(F.col("best") >= least_best).select(*[F.col(b).alias(f"__{b}") for b in by], "best")
    rows = df.join(best, [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by])
    return rows.filter(F.col(score) >= F.greatest(F.lit(absolute), F.col("best") * relative)).drop(*[f"__{b}" for b in by])


def ordered_union(lists: list[DataFrame], by: list[str], item: str, pos: str, most: int = 80) -> DataFrame:
    """Lists one after another, first occurrences only, cut at `most`; columns by, item, rank."""
    rows = None
    for n, df in enumerate(lists):
        part = df.select(*by, item, F.lit(n).alias("list"), F.col(pos).alias("pos"))
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy(*by, item).agg(F.min(F.struct("list", "pos")).alias("at"))
    return ranked(first, by, [F.col("at"), F.col(item)]).filter(F.col("rank") <= most).drop("at")


def first_per_key(df: DataFrame, by: list[str], key: list[str], order: list[Column]) -> DataFrame:
    return ranked(df, [*by, *key], order, "nth").filter("nth = 1").drop("nth")


def language_first(df: DataFrame, by: list[str], same: Column, rank: str) -> DataFrame:
    """Rows of the wanted language first, otherwise as they were."""
    return ranked(df.withColumn("other", (~same).cast("int")), by, [F.col("other"), F.col(rank)], "reordered").drop("other")


def rerank_or_fallback(candidates: DataFrame, scores: DataFrame | None, by: list[str], item: str, rank: str, k: int) -> DataFrame:
    """Candidates by a reranker's score where it gave one, then the others in their own order; without a reranker, their own order."""
    rows = candidates.withColumn("given", F.lit(None).cast("double")) if scores is None else candidates.join(scores.withColumnRenamed("score", "given"), [*by, item], "left")
    out = ranked(rows, by, [F.desc_nulls_last("given"), F.col(rank)], "final_rank").filter(F.col("final_rank") <= k)
    return out.withColumn("display_score", 1.0 / F.col("final_rank")).drop("given")


def rank_votes(df: DataFrame, by: list[str], section: str, product: str, rank: str, depth: int = 30, sections: int = 18) -> DataFrame:
    """Votes for products by their best chunks: one vote a section, of 4 for rank 1, 3 to rank 3, 2 to rank 8, else 1; `sections` sections at most."""
    near = df.filter(F.col(rank) <= depth)
    first = first_per_key(near, by, [product, section], [F.col(rank)])
    placed = ranked(first, by, [F.col(rank)], "place").filter(F.col("place") <= sections)
    weight = F.when(F.col(rank) == 1, 4).when(F.col(rank) <= 3, 3).when(F.col(rank) <= 8, 2).otherwise(1)
    return placed.groupBy(*by, product).agg(F.sum(weight).alias("votes"))


def most_common(df: DataFrame, by: list[str], value: str, pos: str) -> DataFrame:
    """Each group's most frequent value; of equals the one seen first."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return ranked(counts, by, [F.desc("n"), F.col("first")], "nth").filter("nth = 1").select(*by, value, "n")


def shard(df: DataFrame, pos: str, n: int, i: int) -> DataFrame:
    return df.filter(F.pmod(F.col(pos), F.lit(n)) == i)


def feedback_first(df: DataFrame, by: list[str], priority: str, pos: str) -> DataFrame:
    """Rows with a priority in its order first, the others in theirs."""
    return ranked(df, by, [F.col(priority).isNull(), F.col(priority), F.col(pos)], "rank")


def graded(ranks: DataFrame, by: list[str], gain: str, rank: str, positives: DataFrame, k: int = 10) -> DataFrame:
    """ndcg, mrr, recall at k of each query. Gain 2**g - 1, discount log2(rank + 1); positives: by, gain for all judged rows."""
    near = ranks.filter(F.col(rank) <= k)
    value = lambda r: (F.pow(F.lit(2.0), F.col(gain)) - 1) / F.log2(r + 1.0)
    got = near.groupBy(*by).agg(F.sum(value(F.col(rank))).alias("dcg"), F.min(F.when(F.col(gain) > 0, F.col(rank))).alias("first"), F.count_if(F.col(gain) > 0).alias("hits"))
    # of equal gains only as many rows are ranked as can be among the k best, so that no task ranks all rows of a query
    counts = positives.groupBy(*by, gain).agg(F.count("*").alias("__n"))
    totals = counts.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col(gain) > 0, F.col("__n"))), F.lit(0)).alias("total"))
    ideal = ranked(counts.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.least("__n", F.lit(k).cast("long"))))), by, [F.desc(gain)], "place")
    best = ideal.groupBy(*by).agg(F.sum(F.when(F.col("place") <= k, value(F.col("place")))).alias("idcg"))
    rows = totals.filter("total > 0").join(best, by).join(got, by, "left")
    return rows.select(
        *by,
        F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)).alias("ndcg"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.col("hits") / F.col("total"), F.lit(0.0)).alias("recall"),
    )
