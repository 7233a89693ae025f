"""Session history in batch form: windows by budget, retention, recall and eviction.

Loops that stop at the first overflow are running sums; those that skip and go on are folds
over the session's array (`newest_that_fit`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions import text as tx


def paired(messages: DataFrame, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Question-answer turns: each user message with the next assistant message, if one follows before the next user."""
    w = W.partitionBy(session).orderBy(turn)
    rows = messages.filter(F.col("role").isin("user", "assistant"))
    nxt = F.struct(F.lead("role").over(w).alias("role"), F.lead("text").over(w).alias("text"))
    rows = rows.withColumn("next", nxt).filter("role = 'user'")
    answer = F.when(F.col("next.role") == "assistant", F.col("next.text")).otherwise("")
    return rows.select(session, F.col(turn).alias("turn_id"), F.col("text").alias("question"), answer.alias("answer"))


def last_n(df: DataFrame, session: str, order: str, n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(session).orderBy(F.desc(order)))).filter(F.col("__n") <= n).drop("__n")


def recent_window(df: DataFrame, session: str, order: str, size: Column, budget: int, fixed: int = 0, between: int = 0) -> DataFrame:
    """Newest rows until the next one would exceed the budget; `fixed` bytes enclose the list, `between` part its rows."""
    w = W.partitionBy(session).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    used = F.sum(size).over(w) + fixed + between * (F.count("*").over(w) - 1)
    return df.withColumn("used", used).filter(F.col("used") <= budget)


def retained(df: DataFrame, session: str, order: str, chars: str, turns: int = 200, total: int = 2_000_000) -> DataFrame:
    """The newest turns up to a number and a sum of characters; the first one over either goes with all older ones."""
    w = W.partitionBy(session).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("nth", F.row_number().over(W.partitionBy(session).orderBy(F.desc(order)))).withColumn("sum", F.sum(chars).over(w)).filter((F.col("nth") <= turns) & (F.col("sum") <= total))


def least_recent(sessions: DataFrame, accessed: str, tie: str, keep: int) -> DataFrame:
    """The `keep` sessions accessed last, by two steps: each task's best, then the best of these."""
    return sessions.orderBy(F.desc(accessed), F.desc(tie)).limit(keep)


def alive(sessions: DataFrame, updated: str, now: float, ttl: float) -> DataFrame:
    """Sessions updated after now - ttl; one updated just then is gone."""
    return sessions.filter(F.col(updated) > now - ttl)


def recall(turns: DataFrame, questions: DataFrame, session: str, turn: str, text: Column, question: str, k: int = 3, visible: DataFrame | None = None) -> DataFrame:
    """Each session's k turns that share most terms with its question; ties to later turns; visible turns left out."""
    rows = turns if visible is None else turns.join(visible, [session, turn], "left_anti")
    rows = rows.select(session, turn, tx.session_terms(text).alias("have")).join(questions.select(session, tx.session_terms(F.col(question)).alias("want")), session)
    rows = rows.withColumn("shared", F.size(F.array_intersect("have", "want"))).filter("shared > 0").drop("have", "want")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(session).orderBy(F.desc("shared"), F.desc(turn)))).filter(F.col("rank") <= k)


def best_sentence(text: Column, terms: Column) -> Column:
    """The first sentence with most of the terms; null if none has any."""
    scored = F.transform(tx.sentences(text), lambda s, i: F.struct(F.size(F.array_intersect(tx.session_terms(s), terms)).alias("n"), (-i).alias("at"), s.alias("s")))
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["s"])


def evicted(items: DataFrame, session: str, order: list[Column], size: Column, budget: int) -> DataFrame:
    """What is left after dropping items in the given order until the sizes' sum fits the budget."""
    w = W.partitionBy(session).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rest = F.sum(size).over(W.partitionBy(session)) - F.sum(size).over(w) + size  # with this item and all after it
    return items.withColumn("__rest", rest).filter(F.col("__rest") <= budget).drop("__rest")


def drop_oldest_until_fits(df: DataFrame, session: str, order: str, size: Column, budget: int) -> DataFrame:
    """Complete oldest rows go until the rest fits: the longest suffix within the budget."""
    return recent_window(df, session, order, size, budget).drop("used")


def newest_that_fit(df: DataFrame, session: str, order: str, size: Column, budget: int) -> DataFrame:
    """Rows taken newest first, each if it still fits; one that doesn't is skipped, not the end. A fold over the session's sizes."""
    rows = df.withColumn("__size", size.cast("long"))
    arr = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__size").alias("s"))), asc=False)
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{dict(df.dtypes)[order]}>").alias("kept"))
    fold = lambda a, x: F.when(a["used"] + x["s"] <= budget, F.struct((a["used"] + x["s"]).alias("used"), F.concat(a["kept"], F.array(x["o"])).alias("kept"))).otherwise(a)
    kept = rows.groupBy(session).agg(F.aggregate(arr, start, fold)["kept"].alias("kept")).select(session, F.explode("kept").alias(order))
    return rows.drop("__size").join(kept, [session, order], "left_semi")


def streaks(df: DataFrame, by: str, order: str, value: Column, counts: Column | None = None) -> DataFrame:
    """streak: how many rows running up to this one have the same value (null resets to 0); with counts, rows where it is false reset."""
    w = W.partitionBy(by).orderBy(order)
    ok = value.isNotNull() if counts is None else value.isNotNull() & counts
    rows = df.withColumn("__v", F.when(ok, value.cast("string"))).withColumn("__ok", ok)
    change = (~F.col("__v").eqNullSafe(F.lag("__v").over(w))).cast("int")
    rows = rows.withColumn("__c", change).withColumn("__island", F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    streak = F.when(F.col("__ok"), F.row_number().over(W.partitionBy(by, "__island").orderBy(order))).otherwise(0)
    return rows.withColumn("streak", streak).drop("__v", "__ok", "__c", "__island")


def cleared(df: DataFrame, session: str, ids: list) -> DataFrame:
    return df.filter(~F.col(session).isin(ids))
