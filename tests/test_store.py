"""The session store over restarts, against the batch operators."""

import time

from pyspark.sql import functions as F

from weft.operators import sessions
from weft.streaming import store


def turns(spark, path, rows):
    spark.createDataFrame([(s, "turn", t, float(at), q, a) for s, t, at, q, a in rows], store.EVENTS).coalesce(1).write.mode("append").parquet(path)


def trigger(spark, folder, **limits):
    stream = spark.readStream.schema(store.EVENTS).parquet(f"{folder}/in")
    q = store.run(spark, stream, folder, **{"most_sessions": 10, **limits}).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    if q.exception():
        raise q.exception()


def held(spark, folder):
    """session to its turns, in the last snapshot."""
    last = store.latest_epoch(spark, f"{folder}/snapshots")
    return {} if last is None else {r["session"]: [tuple(t) for t in r["turns"]] for r in store.snapshot(spark, f"{folder}/snapshots", last).collect()}


def test_store_equals_batch_over_restarts(spark, tmp_path):
    folder = str(tmp_path)
    first = [("a", t, t, f"question {t}", "x" * t) for t in range(6)] + [("b", 1, 2, None, "only")]
    second = [("a", 9, 20, "new", "y"), ("b", 1, 21, "again", "same turn"), ("c", 4, 22, "z" * 50, ""), ("c", 5, 23, "z", "")]
    turns(spark, f"{folder}/in", first)
    trigger(spark, folder, most_turns=4, most_chars=40)
    assert sorted(held(spark, folder)["b"]) == [(1, "", "only")]
    turns(spark, f"{folder}/in", [*second, (None, 1, 1, "q", "a"), ("d", None, 1, "q", "a")])
    trigger(spark, folder, most_turns=4, most_chars=40)
    rows = [r for r in first + second if (r[0], r[1], r[3]) != ("b", 1, None) and r[0] != "c"]
    frame = spark.createDataFrame([(s, t, q or "", a or "") for s, t, _, q, a in rows], "session string, turn long, question string, answer string").withColumn("chars", F.length("question") + F.length("answer"))
    want = {}
    for r in sessions.retained(frame, "session", "turn", "chars", 4, 40).orderBy("turn").collect():
        want.setdefault(r["session"], []).append((r["turn"], r["question"], r["answer"]))
    got = held(spark, folder)
    assert {s: got[s] for s in want} == want
    assert [t for t, *_ in got["c"]] == [5] or [t for t, *_ in got["c"]] == [4, 5]
    assert all(len(q) + len(a) <= 40 for _, q, a in got["c"]) and set(got) == {"a", "b", "c"}


def test_least_recent_sessions_are_cleared(spark, tmp_path):
    folder = str(tmp_path)
    turns(spark, f"{folder}/in", [("a", 1, 1, "q", "a"), ("b", 1, 2, "q", "b"), ("c", 1, 3, "q", "c")])
    trigger(spark, folder, most_sessions=2)
    assert set(held(spark, folder)) == {"b", "c"}
    turns(spark, f"{folder}/in", [("a", 2, 9, "q", "new")])
    trigger(spark, folder, most_sessions=2)  # the clear of a is older than its new turn, or comes before it
    got = held(spark, folder)
    assert set(got) == {"a", "c"} and (2, "q", "new") in got["a"]
    turns(spark, f"{folder}/in", [("b", 7, 10, "q", "back")])
    trigger(spark, folder, most_sessions=2)
    assert held(spark, folder)["b"] == [(7, "q", "back")]  # what was cleared doesn't come back


def test_sessions_expire(spark, tmp_path):
    folder = str(tmp_path)
    turns(spark, f"{folder}/in", [("a", 1, 1, "q", "a")])
    stream = spark.readStream.schema(store.EVENTS).parquet(f"{folder}/in")
    q = store.run(spark, stream, folder, 10, ttl_ms=20_000).trigger(processingTime="1 second").start()
    seen = set()
    try:
        for _ in range(120):
            seen.add(tuple(sorted(held(spark, folder))))
            if ("a",) in seen and () in seen and not held(spark, folder):
                break
            time.sleep(1)
    finally:
        q.stop()
    assert ("a",) in seen and held(spark, folder) == {}
