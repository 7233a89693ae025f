"""A session store as keyed state: turns with their texts, retention, time to live, and least recent sessions evicted.

Each session's turns lie in two map states of the RocksDB state store: sizes by turn, which retention
reads, and texts by turn, which are touched only where a turn is written, dropped or handed out.
A timer per session forgets it when nothing came for its time to live. All changes of a trigger commit
with the stream's checkpoint, so that a restart goes on from the last complete trigger.

Which sessions are the most recent is known only across keys: the sink keeps a snapshot of what each trigger
left, takes the best `most` of it, and writes the others as `clear` events to a folder that the stream reads, so that the
state follows one trigger later. A clear names the access that it saw; a session used since then stays. Both are
written per epoch and overwritten when an epoch is done again.

Events: session, kind (`turn` or `clear`), turn, at (seconds), question, answer. A turn number that comes again
replaces the turn; null texts are empty; rows with a null session, or a turn without a number, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weft.functions.excerpts import excerpt
from weft.operators.sessions import least_recent
from weft.sources.tables import exists

EVENTS = "session string, kind string, turn long, at double, question string, answer string"
KEPT = "session string, state string, accessed double, chars long, turns array<struct<turn:long,question:string,answer:string>>"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sessions(StatefulProcessor):
    """One session's archive: its newest turns up to a number and a sum of characters."""

    def __init__(self, most_turns: int, most_chars: int, ttl_ms: int | None):
        self.most_turns, self.most_chars, self.ttl_ms = most_turns, most_chars, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sizes = handle.getMapState("sizes", "turn long", "chars long")
        self.texts = handle.getMapState("texts", "turn long", "question string, answer string")
        self.used = handle.getValueState("used", "accessed double, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "turn"], kind="stable")
        accessed, timer = self.used.get() if self.used.exists() else (None, 0)
        came, cleared = False, False
        sizes = {k[0]: v[0] for k, v in self.sizes.iterator()} if self.sizes.exists() else {}
        for e in events.itertuples(index=False):
            if e.kind == "clear":
                if accessed is not None and accessed <= e.at:
                    self._forget()
                    sizes, accessed, came, cleared = {}, None, False, True
                continue
            question, answer = e.question or "", e.answer or ""
            if len(question) + len(answer) > self.most_chars:
                question, answer = excerpt(question, self.most_chars // 2), excerpt(answer, self.most_chars // 2)
            turn = int(e.turn)
            sizes[turn] = len(question) + len(answer)
            self.texts.updateValue((turn,), (question, answer))
            self.sizes.updateValue((turn,), (sizes[turn],))
            accessed, came, cleared = e.at if accessed is None else max(accessed, e.at), True, False
        if cleared and not came:
            yield self._row(key, "cleared", None, {})
            return
        if not came:
            return
        total, kept = 0, {}
        for n, turn in enumerate(sorted(sizes, reverse=True)):
            total += sizes[turn]
            if n >= self.most_turns or total > self.most_chars:
                break
            kept[turn] = sizes[turn]
        for turn in sizes.keys() - kept.keys():
            self.sizes.removeKey((turn,))
            self.texts.removeKey((turn,))
        if self.ttl_ms:
            if timer:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms
            self.handle.registerTimer(timer)
        self.used.update((accessed, timer))
        yield self._row(key, "open", accessed, kept)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._forget()
        yield self._row(key, "expired", None, {})

    def _forget(self) -> None:
        if self.used.exists() and (timer := self.used.get()[1]):
            self.handle.deleteTimer(timer)
        for state in (self.sizes, self.texts, self.used):
            state.clear()

    def _row(self, key, state: str, accessed: float | None, kept: dict[int, int]) -> pd.DataFrame:
        turns = [{"turn": t, **dict(zip(("question", "answer"), self.texts.getValue((t,)), strict=True))} for t in sorted(kept)]
        return pd.DataFrame([(str(key[0]), state, accessed, sum(kept.values()), turns)], columns=["session", "state", "accessed", "chars", "turns"])

    def close(self) -> None:
        pass


def stored(events: DataFrame, most_turns: int = 200, most_chars: int = 2_000_000, ttl_ms: int | None = None) -> DataFrame:
    """Rows of KEPT: what each session that an event or its timer touched holds at the end of a trigger. The session's state store becomes RocksDB."""
    events.sparkSession.conf.set(PROVIDER, ROCKSDB)
    rows = events.filter("session IS NOT NULL AND at IS NOT NULL AND (kind = 'clear' OR turn IS NOT NULL)").select(*[f.split()[0] for f in EVENTS.split(", ")])
    return rows.groupBy("session").transformWithStateInPandas(Sessions(most_turns, most_chars, ttl_ms), KEPT, "update", "ProcessingTime" if ttl_ms else "None")


def _version(path: str, epoch: int) -> str:
    return f"{path}/epoch={epoch}"


def latest_epoch(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    """The last epoch that was written completely, of those below a number."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    epochs = sorted((int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch=")), reverse=True)
    return next((e for e in epochs if (below is None or e < below) and exists(spark, _version(path, e))), None)


def snapshot(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    """What the store holds after an epoch."""
    return spark.read.schema(KEPT).parquet(_version(path, epoch))


def run(spark: SparkSession, turns: DataFrame, folder: str, most_sessions: int, **limits):
    """Starts the store on a stream of EVENTS; snapshots and clears lie below the folder. Each trigger leaves the most_sessions used last, later names first among equals."""
    saved, clears = f"{folder}/snapshots", f"{folder}/clears"
    spark.createDataFrame([], EVENTS).write.mode("append").parquet(clears)

    def commit(batch: DataFrame, epoch: int) -> None:
        s = batch.sparkSession
        if batch.isEmpty():  # timers make triggers without data: then the last snapshot stands
            return
        last = latest_epoch(s, saved, epoch)
        now = batch.filter("state = 'open'")
        if last is not None:
            now = now.unionByName(snapshot(s, saved, last).join(batch.select("session"), "session", "left_anti"))
        kept = least_recent(now.select("session", "accessed"), "accessed", "session", most_sessions).select("session")
        now.join(kept, "session", "left_semi").write.mode("overwrite").parquet(_version(saved, epoch))
        gone = now.join(kept, "session", "left_anti").select("session", F.lit("clear").alias("kind"), F.lit(None).cast("long").alias("turn"), F.col("accessed").alias("at"), F.lit(None).cast("string").alias("question"), F.lit(None).cast("string").alias("answer"))
        gone.write.mode("overwrite").parquet(f"{clears}/at={epoch}")

    both = turns.unionByName(spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(clears))
    return stored(both, **limits).writeStream.foreachBatch(commit).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
