"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn is rendered as `<s>[INST]role[/INST]text</s>`. Inside roles and texts every backslash is
doubled and a backslash is put behind the first character of each of `<s>`, `</s>`, `[INST]`,
`[/INST]`, so none of these can stand in a text; taking the backslash away before any character
undoes it.

A turn's tokens are a quarter of its rendered bytes, rounded up. Prefix sums over a conversation
place the turns on a grid of `step` tokens, where step is the budget less the system turn and
the history: turns that end in a cell and begin in it form a window; one that begins before it
forms a window of its own. New turns of a window thus take at most step tokens, unless one turn
alone is longer; turns are never cut. A window after the first begins with the system turn
(the first turn, if its role is `system`) and the turns right before it that fit the history
budget. Targets are the texts of assistant turns where they are new; repeated ones are masked.

Defined results: null roles and texts are empty, null ids one conversation; turns with the same
number (or null, which comes first) are ordered by role and text, repeated rows are all kept; an
empty table gives no window; other columns aren't carried over. A system turn of over three
quarters of the budget leaves step at a quarter of it, so such windows exceed the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUDGET = 2048
HISTORY = 256
TURN = r"(?s)<s>\[INST\](.*?)\[/INST\](.*?)</s>"


def escape(x: Column) -> Column:
    x = F.regexp_replace(x, r"\\", r"\\\\")
    x = F.regexp_replace(x, r"<(/?s>)", r"<\\$1")
    return F.regexp_replace(x, r"\[(/?INST\])", r"[\\$1")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window (from 0), n_turns, n_context (leading repeated turns), n_tokens, text, targets (spans of code points)."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "body")
    head = F.concat(F.lit("<s>[INST]"), escape(F.col("role")), F.lit("[/INST]"))
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("body"))
    t = t.select(*t.columns, head.alias("head"), escape(F.col("body")).alias("esc"))
    t = t.withColumn("rendered", F.concat("head", "esc", F.lit("</s>"))).withColumn("tokens", F.ceil(F.octet_length("rendered") / 4))
    t = t.select(
        "conv_id",
        "rendered",
        "tokens",
        (F.col("role") == "assistant").alias("answer"),
        F.length("head").alias("from"),
        F.length("esc").alias("long"),
        F.row_number().over(order).alias("pos"),
        F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("end"),
        F.first(F.when(F.col("role") == "system", F.struct("rendered", "tokens"))).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("sys"),
    )
    t = t.withColumn("start", F.col("end") - F.col("tokens")).withColumn("step", F.greatest(budget - history - F.coalesce("sys.tokens", F.lit(0)), F.lit(budget // 4)))
    t = t.withColumn("cell", F.floor((F.col("end") - 1) / F.col("step")))
    t = t.withColumn("part", F.col("cell") * 2 + (F.col("start") >= F.col("cell") * F.col("step")).cast("int"))
    by = W.partitionBy("conv_id").orderBy("pos")
    t = t.withColumn("opens", F.coalesce(F.lag("part").over(by) != F.col("part"), F.lit(False)))
    # every turn takes a token at least, so turns that start in the history's range before this one also end before it
    back = W.partitionBy("conv_id").orderBy("start").rangeBetween(-history, -1)
    piece = F.struct("rendered", "tokens", "pos")
    rows = t.select(
        "conv_id",
        "pos",
        "rendered",
        "tokens",
        "answer",
        "from",
        "long",
        "opens",
        "sys",
        F.sum(F.col("opens").cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)).alias("window"),
        (F.sum(F.length("rendered")).over(by.rowsBetween(W.unboundedPreceding, 0)) - F.length("rendered")).alias("before"),
        F.collect_list(piece).over(back).alias("old"),
    )
    old = F.filter("old", lambda x: (x["pos"] > 1) | F.col("sys").isNull())
    system = F.when(F.col("sys").isNotNull(), F.array(F.struct(F.col("sys.rendered").alias("rendered"), F.col("sys.tokens").alias("tokens"), F.lit(1).alias("pos"))))
    context = F.when(F.col("opens"), F.concat(F.coalesce(system, F.slice("old", 1, 0)), F.array_sort(old, lambda x, y: x["pos"] - y["pos"])))
    # grouping by conversation and window needs no further shuffle: the rows already lie by conversation
    rows = rows.withColumn("context", context).groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("pos", "rendered", "answer", "from", "long", "before"))).alias("t"),
        F.sum("tokens").alias("n"),
        F.first("context", ignorenulls=True).alias("c"),
    )
    context = F.coalesce(F.array_join(F.col("c.rendered"), ""), F.lit(""))
    rows = rows.select("*", context.alias("opening"), F.coalesce(F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x["tokens"]), F.lit(0)).alias("repeated"))
    at = F.length("opening") - F.col("t")[0]["before"]
    spans = F.transform(F.filter("t", lambda x: x["answer"]), lambda x: F.struct((at + x["before"] + x["from"]).alias("start"), (at + x["before"] + x["from"] + x["long"]).alias("end")))
    count = F.coalesce(F.size("c"), F.lit(0))
    return rows.select(
        "conv_id",
        "window",
        (F.size("t") + F.greatest(count, F.lit(0))).alias("n_turns"),
        F.greatest(count, F.lit(0)).alias("n_context"),
        (F.col("n") + F.col("repeated")).alias("n_tokens"),
        F.concat("opening", F.array_join(F.col("t.rendered"), "")).alias("text"),
        spans.alias("targets"),
    )


def parsed(formatted: DataFrame) -> DataFrame:
    """formatted plus turns (role and text of the new turns) and learned (the text under the loss mask), read from its texts."""
    turns = F.arrays_zip(F.regexp_extract_all("text", F.lit(TURN), 1).alias("role"), F.regexp_extract_all("text", F.lit(TURN), 2).alias("text"))
    fresh = F.slice(turns, F.col("n_context") + 1, F.size(turns))
    fresh = F.transform(fresh, lambda x: F.struct(unescape(x["role"]).alias("role"), unescape(x["text"]).alias("text")))
    cut = F.transform("targets", lambda s: unescape(F.substring(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("*", fresh.alias("turns"), F.array_join(cut, "").alias("learned"))


def digests(formatted: DataFrame) -> DataFrame:
    """A row for each conversation with counts and digests of what its windows hold."""
    rows = parsed(formatted)
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    rows = rows.select("conv_id", "window", said.alias("said"), "learned", F.size("turns").alias("n"), F.length("text").alias("chars"))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "said", "learned"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    said, learned = F.array_join(F.col("w.said"), ""), F.array_join(F.col("w.learned"), "")
    return rows.select(
        "conv_id", "n_turns", F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned.cast("binary"), 256).alias("loss_sha256"), "formatted_chars"
    )
