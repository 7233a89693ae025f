"""Streaming forms: session memory as keyed state, and incremental runs by micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weft.operators.timeline import to_process

OUT = "session string, turns long, chars long, oldest long, newest long, expired boolean"
STATE = "turns array<long>, chars array<long>"


def session_memory(events: DataFrame, session: str, turn: str, chars: str, most_turns: int = 200, most_chars: int = 2_000_000, ttl_ms: int | None = None) -> DataFrame:
    """A row for each session and trigger with what its archive holds: the newest turns up to a number and a sum of characters.

    With ttl_ms a session without new turns for so long (processing time) is forgotten and reported as expired.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(str(key[0]), 0, 0, None, None, True)], columns=["session", "turns", "chars", "oldest", "newest", "expired"])
            return
        have = dict(zip(*state.get, strict=True)) if state.exists else {}
        for pdf in batches:
            have |= {int(t): int(c) for t, c in zip(pdf[turn], pdf[chars], strict=True)}
        kept, total = [], 0
        for t in sorted(have, reverse=True):
            total += have[t]
            if len(kept) >= most_turns or total > most_chars:
                break
            kept.append(t)
        kept.reverse()
        state.update((kept, [have[t] for t in kept]))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame([(str(key[0]), len(kept), sum(have[t] for t in kept), kept[0] if kept else None, kept[-1] if kept else None, False)], columns=["session", "turns", "chars", "oldest", "newest", "expired"])

    rows = events.select(F.col(session).alias("k"), F.col(turn), F.col(chars))
    return rows.groupBy("k").applyInPandasWithState(step, OUT, STATE, "update", timeout)


def incremental(stream: DataFrame, spark: SparkSession, done_path: str, signature: list[str], work, checkpoint: str):
    """Starts a query that hands each micro-batch's sources without a finished run to work(df), whose rows join the finished runs."""

    def batch(df: DataFrame, epoch: int) -> None:
        done = spark.read.parquet(done_path)
        todo = to_process(df.dropDuplicates(signature), done, signature)
        work(todo).select(done.columns).write.mode("append").parquet(done_path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
