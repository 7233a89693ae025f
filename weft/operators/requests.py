"""Requests cut down until they fit a window, planned as rows.

A request is its messages. What goes, and in which order, is a matter of running sums over a request's
light rows (place, bytes, links), so no step looks at a text again: each kind of candidate is ordered,
and one goes while what went before it doesn't yet bring the request within its window. In this order:

1. old tool exchanges as units: a call and all its answers before the next call's message, oldest first, never the last,
2. long results, longest first, each to what would bring the request within its window, 256 bytes at least,
3. optional fragments, those of the highest number first, wherever they stand outside system messages,
4. plain messages of users and assistants, from the end backwards.

A message that holds a protected text stays whole; without any named, the request's first and last user texts are protected.
A cut result counts by the bytes it is to have; its text is made afterwards, of no more.

messages: request, pos, role, text, calls (ids of tool calls it makes), answers (id of the call it answers), pictures (a count).
requests: request, window, reserve (bytes kept for the reply and safety), protected (texts, null or empty: none named).
fragments: request, number, fragment. Null texts are empty; rows with a null request or place take no part.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.operators.contracts import OLD_LEFT_OUT, RESULT_FROM, RESULT_SLACK, RESULT_TO, compact_results

#: Bytes reserved for an encoded picture.
PICTURE = 8192


def bytes_of(m: DataFrame) -> Column:
    """Bytes of a message in a list as JSON, with its comma, and a reserve for its pictures."""
    body = F.struct("role", F.col("text").alias("content"), F.when(F.size("calls") > 0, F.col("calls")).alias("tool_calls"), F.col("answers").alias("tool_call_id"))
    return (F.octet_length(F.to_json(body)) + 1).cast("long") + F.col("pictures") * PICTURE


def _before(value: str, *order: Column) -> Column:
    """Sum of the rows of a request that come earlier."""
    return F.coalesce(F.sum(value).over(W.partitionBy("request").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def _left(over: DataFrame, gone: DataFrame) -> DataFrame:
    """over less what has gone (rows of request and freed)."""
    g = gone.groupBy("request").agg(F.sum("freed").alias("g"))
    return over.join(g, "request", "left").select("request", (F.col("over") - F.coalesce("g", F.lit(0))).alias("over"))


def _prepared(messages: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with bytes and kept (holds a protected text); requests with what they are over by."""
    m = messages.filter("request IS NOT NULL AND pos IS NOT NULL").select("request", "pos", "role", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("calls", F.array().cast("array<string>")).alias("calls"), "answers", F.coalesce("pictures", F.lit(0)).alias("pictures"))
    m = m.withColumn("bytes", bytes_of(m))
    users = m.filter("role = 'user' AND text <> ''").groupBy("request").agg(F.array_distinct(F.array(F.min_by("text", "pos"), F.max_by("text", "pos"))).alias("own"))
    r = requests.filter("request IS NOT NULL").join(users, "request", "left")
    named = F.when(F.size("protected") > 0, F.col("protected")).otherwise(F.coalesce("own", F.array().cast("array<string>")))
    r = r.select("request", "window", "reserve", named.alias("protected"))
    m = m.join(r.select("request", "protected"), "request")
    m = m.withColumn("kept", F.exists("protected", lambda p: F.contains(F.col("text"), p)))
    total = m.groupBy("request").agg(F.sum("bytes").alias("total"))
    return m, r.join(total, "request").select("request", "protected", (F.col("total") + F.col("reserve") - F.col("window")).alias("over"), F.col("total").alias("before"))


def _exchanges(m: DataFrame) -> DataFrame:
    """request, call (its place), pos (a message of the exchange), bytes: complete exchanges that may go."""
    light = m.select("request", "pos", "role", "calls", "answers", "bytes", "kept")
    turns = light.filter("role = 'assistant'").withColumn("until", F.lead("pos").over(W.partitionBy("request").orderBy("pos")))
    calls = turns.filter(F.size("calls") > 0).withColumn("last", F.max("pos").over(W.partitionBy("request"))).filter("pos < last AND NOT kept")
    ids = calls.select("request", F.col("pos").alias("call"), "until", F.size(F.array_distinct("calls")).alias("need"), F.col("bytes").alias("own"), F.explode(F.array_distinct("calls")).alias("answers"))
    hit = ids.join(light.filter("role = 'tool'").select("request", "answers", "pos", "bytes"), ["request", "answers"]).filter("pos > call AND (until IS NULL OR pos < until)")
    whole = hit.groupBy("request", "call").agg(F.count_distinct("answers").alias("have"), F.first("need").alias("need")).filter("have = need").select("request", "call")
    mine = hit.select("request", "call", "pos", "bytes").unionByName(ids.select("request", "call", F.col("call").alias("pos"), F.col("own").alias("bytes")).distinct())
    return mine.join(whole, ["request", "call"])


def planned(messages: DataFrame, requests: DataFrame, fragments: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What becomes of each message (request, pos, action, target, fragments) and of each request (request, before, after, exchanges, results, optional, messages, fits).

    action is kept, exchange, cut or message; target are the bytes of a cut text; fragments are those to leave out.
    """
    m, r = _prepared(messages, requests)
    over = r.select("request", "over")
    units = _exchanges(m)
    e = units.groupBy("request", "call").agg(F.sum("bytes").alias("freed"))
    e = e.withColumn("b", _before("freed", F.col("call"))).join(over, "request").filter("over - b > 0").select("request", "call", "freed")
    over = _left(over, e)
    gone = units.join(e.select("request", "call"), ["request", "call"]).select("request", "pos").distinct()
    m = m.join(gone.withColumn("gone", F.lit(True)), ["request", "pos"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    long = m.filter("role = 'tool' AND NOT gone AND NOT kept").select("request", "pos", F.length("text").alias("chars"), F.octet_length("text").cast("long").alias("size")).filter(F.col("size") > RESULT_FROM)
    long = long.withColumn("room", F.col("size") - RESULT_TO).withColumn("b", _before("room", F.desc("chars"), F.col("pos"))).join(over, "request").filter("over - b > 0")
    long = long.withColumn("target", F.greatest(F.lit(RESULT_TO).cast("long"), F.col("size") - (F.col("over") - F.col("b")) - RESULT_SLACK)).select("request", "pos", "target", (F.col("size") - F.col("target")).alias("freed"))
    over = _left(over, long)
    empty = m.select("request", "pos").filter("false")
    used, opt = empty.select("request", F.lit(0).alias("n")), empty.select("request", "pos", F.array().cast("array<string>").alias("fragments"))
    if fragments is not None:
        f = fragments.filter("fragment <> ''").join(r.select("request", "protected"), "request")
        f = f.filter(~F.exists("protected", lambda p: F.contains(p, F.col("fragment")) | F.contains(F.col("fragment"), p))).select("request", "number", "fragment")
        stands = m.filter("role <> 'system' AND NOT gone").select("request", "pos", "text").join(f, "request").filter(F.contains("text", "fragment"))
        times = (F.length("text") - F.length(F.replace("text", F.col("fragment"), F.lit("")))) / F.length("fragment")
        stands = stands.select("request", "pos", "number", "fragment", (times.cast("long") * (F.octet_length("fragment") - len(OLD_LEFT_OUT.encode()))).alias("freed"))
        f = stands.groupBy("request", "number", "fragment").agg(F.sum("freed").alias("freed"))
        f = f.withColumn("b", _before("freed", F.desc("number"), F.col("fragment"))).join(over, "request").filter("over - b > 0").select("request", "number", "fragment", "freed")
        over = _left(over, f)
        used = f.groupBy("request").agg(F.count("*").cast("int").alias("n"))
        each = stands.select("request", "pos", "number", "fragment").join(f.select("request", "number", "fragment"), ["request", "number", "fragment"])
        opt = each.groupBy("request", "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("number", "fragment")), asc=False), lambda x: x["fragment"]).alias("fragments"))
    plain = m.filter("role IN ('user', 'assistant') AND NOT gone AND NOT kept AND pictures = 0").filter(F.size("calls") == 0).select("request", "pos", F.col("bytes").alias("freed"))
    plain = plain.withColumn("b", _before("freed", F.desc("pos"))).join(over, "request").filter("over - b > 0").select("request", "pos", "freed")
    over = _left(over, plain)
    rows = m.select("request", "pos", "gone").join(plain.select("request", "pos", F.lit(True).alias("dropped")), ["request", "pos"], "left").join(long.select("request", "pos", "target"), ["request", "pos"], "left").join(opt, ["request", "pos"], "left")
    action = F.when(F.col("gone"), "exchange").when(F.col("dropped"), "message").when(F.col("target").isNotNull(), "cut").otherwise("kept")
    rows = rows.select("request", "pos", action.alias("action"), F.when(action == "cut", F.col("target")).alias("target"), F.when(action.isin("kept", "cut"), F.col("fragments")).alias("fragments"))
    n = lambda df, name: df.groupBy("request").agg(F.count("*").cast("int").alias(name))
    out = r.select("request", "before", F.col("over").alias("was")).join(over, "request")
    for df, name in ((n(e, "exchanges"), "exchanges"), (n(long, "results"), "results"), (used.withColumnRenamed("n", "optional"), "optional"), (n(plain, "messages"), "messages")):
        out = out.join(df, "request", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    out = out.select("request", "before", (F.col("before") - (F.col("was") - F.col("over"))).alias("after"), "exchanges", "results", "optional", "messages", (F.col("over") <= 0).alias("fits"))
    return rows, out


def carried_out(messages: DataFrame, plan: DataFrame, asked: DataFrame) -> DataFrame:
    """request, pos, role, text of the messages that a plan keeps, cut as it says; asked: request, question (which result blocks are held against)."""
    rows = messages.join(plan.filter("action IN ('kept', 'cut')"), ["request", "pos"]).join(asked, "request", "left").withColumn("text", F.coalesce("text", F.lit("")))

    @F.pandas_udf("string")
    def compacted(text: pd.Series, target: pd.Series, question: pd.Series) -> pd.Series:
        return pd.Series([compact_results(t, int(n), q or "")[0] for t, n, q in zip(text, target, question, strict=True)])

    cut = rows.filter("action = 'cut'").withColumn("text", compacted("text", "target", "question"))
    rows = rows.filter("action = 'kept'").unionByName(cut)
    left = F.aggregate(F.coalesce("fragments", F.array().cast("array<string>")), F.col("text"), lambda t, f: F.replace(t, f, F.lit(OLD_LEFT_OUT)))
    return rows.select("request", "pos", "role", left.alias("text"))
