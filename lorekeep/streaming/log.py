"""Structured Streaming forms of the log operators. Event time is `ts`; rows later than the watermark are dropped by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lorekeep.operators.timeline import SECOND


def stream_turns(spark: SparkSession, path: str, ddl: str, watermark: str = "1 hour") -> DataFrame:
    """The conversation log as a stream; offsets are the checkpoint's, so each row is read once."""
    return spark.readStream.schema(ddl).parquet(path).withWatermark("ts", watermark)


def spawn_once(candidates: DataFrame) -> DataFrame:
    """Never two candidates for one (source, trigger, action) within the watermark."""
    return candidates.dropDuplicatesWithinWatermark(["source", "trigger", "action"])


def session_windows(log: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """(speaker, first, last, n): sessions that end after a gap."""
    w = F.session_window("ts", gap)
    return log.groupBy(w, "source_id").agg(F.count("*").alias("n")).select("source_id", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("last"), "n")


def open_exchange(messages: DataFrame, log: DataFrame, window: int = 600, floor: float = 0.9, me: int = 0) -> DataFrame:
    """(id, channel, source_id, ts, opened): messages with each row of the window before that opens their exchange: the author addressed the agent in
    the channel, or the agent spoke to the author there. A stream-stream join on event time; a message with several has a row for each."""
    row = lambda person: F.struct(person.alias("person"))
    ways = F.filter(F.array(F.when(F.col("directedness") >= floor, row(F.col("source_id"))), F.when(F.col("source_id") == me, row(F.col("target_id")))), lambda x: x.isNotNull())
    a = log.select(F.col("channel").alias("c"), F.col("ts").alias("opened"), F.explode(ways).alias("w")).select("c", "opened", F.col("w.person").alias("s"))
    near = (F.col("channel") == F.col("c")) & (F.col("source_id") == F.col("s")) & (F.col("opened") < F.col("ts")) & (F.col("opened") >= F.col("ts") - F.expr(f"INTERVAL {window} SECONDS"))
    return messages.join(a, near, "inner").select("id", "channel", "source_id", "ts", "opened")


#: Streams with timers keep their state in this store; set it as spark.sql.streaming.stateStore.providerClass.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_state(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "EventTime")


def _forget_timers(handle: StatefulProcessorHandle) -> None:
    for at in list(handle.listTimers()):
        handle.deleteTimer(at)


def _schema(rows: DataFrame, keys: list[str], *more: str) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join([f"`{k}` {kinds[k]}" for k in keys] + list(more))


class Throttle(StatefulProcessor):
    """Keeps the time of a key's last kept action, until the watermark says that any further action may follow it."""

    def __init__(self, keys: list[str], seconds: int) -> None:
        self.keys, self.wait = keys, seconds * SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        frame = pd.concat(list(rows)).sort_values(["us", "id"])
        kept = []
        for us, i in zip(frame["us"].tolist(), frame["id"].tolist(), strict=True):
            if last is None or us - last >= self.wait:
                last = us
                kept.append((*key, us, i))
        if kept:
            self.last.update((last,))
            _forget_timers(self.handle)
            self.handle.registerTimer((last + self.wait) // 1000 + 1)
        yield pd.DataFrame(kept, columns=[*self.keys, "us", "id"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        yield pd.DataFrame([], columns=[*self.keys, "us", "id"])

    def close(self) -> None:
        pass


def throttle(actions: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """The actions (keys, us, id, ts) kept when each must be so many seconds after the last one kept of its key: (keys, us, id).

    A key's state is one number, the time of its last kept action, and goes when the watermark on `ts` is past its wait; a batch's
    actions of a key are taken in order of (us, id). Needs STORE.
    """
    return _with_state(actions.select(*keys, "us", "id", "ts"), keys, Throttle(keys, seconds), _schema(actions, keys, "us bigint", "id bigint"))


class Digest(StatefulProcessor):
    """Keeps whether a key has posted, its next chapter, the time of its last conclusion, and what waits for the chapter to fill."""

    def __init__(self, cap: int, seconds: int) -> None:
        self.cap, self.gap = cap, seconds * SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "chapter int, last bigint")
        self.waiting = handle.getListState("waiting", "id bigint")

    def _flush(self, key: tuple, waiting: list[int], chapter: int) -> list[tuple]:
        return [(i, key[0], "buffer", chapter) for i in waiting]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        chapter, last = self.head.get() if self.head.exists() else (None, None)
        waiting = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        frame = pd.concat(list(rows)).sort_values(["us", "id"])
        out = []
        for us, i in zip(frame["us"].tolist(), frame["id"].tolist(), strict=True):
            if chapter is None:
                chapter = 0
                out.append((i, key[0], "post", None))
            else:
                if waiting and us - last > self.gap:
                    out += self._flush(key, waiting, chapter)
                    waiting, chapter = [], chapter + 1
                waiting.append(i)
                if len(waiting) == self.cap:
                    out += self._flush(key, waiting, chapter)
                    waiting, chapter = [], chapter + 1
            last = us
        self.head.update((chapter, last))
        self.waiting.put([(i,) for i in waiting]) if waiting else self.waiting.clear()
        _forget_timers(self.handle)
        if waiting:
            self.handle.registerTimer((last + self.gap) // 1000 + 1)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        if self.waiting.exists():
            chapter, last = self.head.get()
            out = self._flush(key, [r[0] for r in self.waiting.get()], chapter)
            self.waiting.clear()
            self.head.update((chapter + 1, last))
        yield self._frame(out)

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["id", "key", "role", "chapter"])
        return frame.astype({"chapter": "Int32"})

    def close(self) -> None:
        pass


def digest(theorems: DataFrame, cap: int = 40, seconds: int = 3600) -> DataFrame:
    """(id, key, role, chapter) of conclusions (key, us, id, ts): the first of a key posts, repeats wait and are flushed in chapters of
    `cap`, or when the key's session ends: that is when nothing came for so many seconds, told by a timer on the watermark.

    What waits is at most `cap` ids a key and is empty after each flush; of a key its next chapter and last time stay, as a key posts
    once for ever. Rows as operators.timeline.digest gives them for sessions with that gap. Needs STORE.
    """
    return _with_state(theorems.select("key", "us", "id", "ts"), ["key"], Digest(cap, seconds), f"id bigint, {_schema(theorems, ['key'])}, role string, chapter int")


class SessionState(StatefulProcessor):
    """Keeps the time of a user's last event and of the first one of its day; timers tell what the user's silence turns into."""

    COLUMNS = ["user_id", "us", "event_id", "state"]

    def __init__(self, tired: int, quiet: int, fruitless: int) -> None:
        self.tired, self.quiet, self.fruitless = tired * SECOND, quiet * SECOND, fruitless * SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last bigint, first bigint")

    def _turns(self, last: int, first: int) -> dict[str, int]:
        """When silence after the last event becomes which state; a day that is over tires nobody."""
        asleep, awake = max(last + self.quiet, first + self.tired) + 1, last + self.fruitless + 1
        if asleep // (86400 * SECOND) != first // (86400 * SECOND):
            return {"wondering": awake}
        return {"sleeping": asleep} | ({"wondering": awake} if awake < asleep else {})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, first = self.seen.get() if self.seen.exists() else (None, None)
        frame = pd.concat(list(rows)).sort_values(["us", "event_id"])
        out = []
        for us, i in zip(frame["us"].tolist(), frame["event_id"].tolist(), strict=True):
            if first is None or us // (86400 * SECOND) != first // (86400 * SECOND):
                first = us
            gap = None if last is None else us - last
            asleep = gap is not None and us - first > self.tired and gap > self.quiet
            out.append((key[0], us, i, "sleeping" if asleep else "wondering" if gap is not None and gap > self.fruitless else "thinking"))
            last = us
        self.seen.update((last, first))
        _forget_timers(self.handle)
        for at in set(self._turns(last, first).values()):
            self.handle.registerTimer(at // 1000 + 1)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        turns = self._turns(*self.seen.get())
        yield self._frame([(key[0], at, None, state) for state, at in turns.items() if at // 1000 + 1 == due])

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=self.COLUMNS).astype({"us": "int64", "event_id": "Int64"})

    def close(self) -> None:
        pass


def session_state(events: DataFrame, tired: int = 7200, quiet: int = 60, fruitless: int = 600) -> DataFrame:
    """(user_id, us, event_id, state) of events (user_id, us, event_id, ts): a row for each event as operators.timeline.session_state
    gives it, and one without event_id when the watermark shows that a silent user fell asleep or began to wonder, at that time.

    A user's state is two numbers, which stay: the next event asks how long ago the last one was. Timers are at most two a user. Needs STORE.
    """
    return _with_state(events.select("user_id", "us", "event_id", "ts"), ["user_id"], SessionState(tired, quiet, fruitless), f"{_schema(events, ['user_id'])}, us bigint, event_id bigint, state string")


def trust_refold(log_batch: DataFrame, batch_id: int, trail_path: str, publish) -> None:
    """For foreachBatch: writes a batch's episodes to the trail and publishes the refolded trust of the people it touches.

    A batch has a folder of its own, which a repeated attempt overwrites, so its episodes count once.
    """
    from lorekeep.operators.ledger import trust_fold

    log_batch.write.mode("overwrite").parquet(f"{trail_path}/batch={batch_id}")
    trail = log_batch.sparkSession.read.parquet(trail_path)
    publish(trust_fold(trail.join(log_batch.select("stakeholder").distinct(), "stakeholder", "left_semi")))
