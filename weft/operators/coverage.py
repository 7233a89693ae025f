"""How well ways to keep a session's memory show what a question needs.

A strategy gives, for every session, the pieces of its past that stay visible: rows of (session, turn_id,
text, base). turn_id is null for a piece made of several turns (a summary, a tree's node); base tells the memory
itself from what a search added to it. Gold has one row a session: the turn that the question needs and a
quote from it. All strategies are made from the same turns, which travel by session once; each is reduced to
one light row a session where its pieces are, and only these rows are put together and counted.

White space counts as one blank on both sides. An empty quote is never visible; a session without pieces has a row all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import text as tx
from weft.operators import rolling, sessions, tree

PIECES = ["turn_id", "text", "base"]


def _text() -> Column:
    return F.concat_ws("\n", "question", "answer")


def _bytes() -> Column:
    return F.coalesce(F.octet_length("question"), F.lit(0)) + F.coalesce(F.octet_length("answer"), F.lit(0)) + 40


def _pieces(turns: DataFrame, session: str, base: bool = True) -> DataFrame:
    return turns.select(session, "turn_id", _text().alias("text"), F.lit(base).alias("base"))


def whole(turns: DataFrame, session: str) -> DataFrame:
    """All turns: what no budget could show more of."""
    return _pieces(turns, session)


def window(turns: DataFrame, session: str, budget: int) -> DataFrame:
    """The newest turns up to the first that doesn't fit."""
    return _pieces(sessions.recent_window(turns, session, "turn_id", _bytes(), budget, fixed=2, between=2), session)


def fitting(turns: DataFrame, session: str, budget: int) -> DataFrame:
    """The newest turns of those that fit; larger ones are skipped."""
    return _pieces(sessions.newest_that_fit(turns, session, "turn_id", _bytes(), budget), session)


def rolled(turns: DataFrame, session: str, block: int, keep: int, budget: int) -> DataFrame:
    """The rolling summary of older turns and the `keep` newest turns."""
    states = rolling.summaries(rolling.folded(rolling.lines(rolling.blocks(turns, session, block, keep), budget), budget=budget))
    said = states.select(F.col("session").cast(turns.schema[session].dataType).alias(session), F.lit(None).cast(turns.schema["turn_id"].dataType).alias("turn_id"), "text", F.lit(True).alias("base"))
    return said.unionByName(_pieces(sessions.last_n(turns, session, "turn_id", keep), session))


def recalled(turns: DataFrame, questions: DataFrame, session: str, budget: int, k: int = 3) -> DataFrame:
    """A window and the k turns outside it that share most terms with the question."""
    near = sessions.recent_window(turns, session, "turn_id", _bytes(), budget, fixed=2, between=2)
    hits = sessions.recall(turns, questions, session, "turn_id", F.concat_ws(" ", "question", "answer"), "q", k, near.select(session, "turn_id"))
    return _pieces(near, session).unionByName(_pieces(turns.join(hits.select(session, "turn_id"), [session, "turn_id"], "left_semi"), session, base=False))


def nodes(found: DataFrame, session: str) -> DataFrame:
    """The nodes that a tree search returned."""
    return found.select(session, F.col("turn_id").cast("long").alias("turn_id"), "text", F.lit(False).alias("base"))


def trees(scored: DataFrame, session: str = "conv_id", k: int = 3) -> dict[str, DataFrame]:
    """The two searches in sessions' trees, `collapsed` over all levels and `traversal` from the root. scored: rated nodes, read by both, and by the second once a level: best a written table."""
    return {"collapsed": nodes(tree.collapsed(scored, k, session), session), "traversal": nodes(tree.traversed(scored, k, session=session), session)}


def cases(gold: DataFrame, strategies: dict[str, DataFrame], session: str, limit: int) -> DataFrame:
    """session, strategy, covered, memory_covered, pieces, bytes, problem: a row for each session of gold and strategy. gold: session (unique), turn_id, quote.

    problem: `quote` where it is empty, `not visible` where no piece shows it, `budget` where the pieces take more than `limit` bytes.
    """
    asked = gold.select(session, F.col("turn_id").alias("__turn"), F.coalesce("quote", F.lit("")).alias("__quote"))
    out = None
    for name, visible in strategies.items():
        rows = asked.join(visible.select(session, *PIECES), session, "left")
        own = F.col("turn_id").isNull() | (F.col("turn_id") == F.col("__turn"))
        shows = F.coalesce((F.col("__quote") != "") & own & tx.squeeze(F.col("text")).contains(F.col("__quote")), F.lit(False))
        one = rows.groupBy(session).agg(
            F.max(shows).alias("covered"),
            F.max(shows & F.col("base")).alias("memory_covered"),
            F.count("base").alias("pieces"),
            F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("bytes"),
            F.max(F.col("__quote") == "").alias("__empty"),
        )
        problem = F.when(F.col("__empty"), "quote").when(~F.col("covered"), "not visible").when(F.col("bytes") > limit, "budget")
        one = one.select(session, F.lit(name).alias("strategy"), "covered", F.coalesce("memory_covered", F.lit(False)).alias("memory_covered"), "pieces", "bytes", problem.alias("problem"))
        out = one if out is None else out.unionByName(one)
    return out


def counters(rows: DataFrame, limit: int) -> DataFrame:
    """A row for each strategy: cases, covered, memory_covered, within (the limit of bytes), accepted (no problem), pieces, bytes."""
    return rows.groupBy("strategy").agg(
        F.count("*").alias("cases"),
        F.count_if("covered").alias("covered"),
        F.count_if("memory_covered").alias("memory_covered"),
        F.count_if(F.col("bytes") <= limit).alias("within"),
        F.count_if(F.col("problem").isNull()).alias("accepted"),
        F.sum("pieces").alias("pieces"),
        F.sum("bytes").cast("long").alias("bytes"),
    )
