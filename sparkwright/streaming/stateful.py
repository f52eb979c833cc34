"""Operators on streams with state of their own (transformWithState): turns, rolling sums, ages of peaks.

State is kept by key, is bounded for each, and ends: a timer on event time clears it once the watermark says that no row
can come that it would matter for. Times are microseconds in rows and state alike. Such queries need the RocksDB state
store (``use_rocksdb``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkwright.sources.rollouts import rank

HOURS = (3, 6, 24, 168)
HOUR = 3_600_000_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def renewed(handle: StatefulProcessorHandle, at: int) -> None:
    """One timer, at ``at``."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(-(-at // 1000))


def dated(out: DataFrame, *names: str) -> DataFrame:
    return out.withColumns({n: F.timestamp_micros(n) for n in names})


TURN = "session_id string, turn_id string, start_time long, end_time long, status string, input_tokens long, output_tokens long, cached_tokens long, events long"


class Turns(StatefulProcessor):
    """A session's open turn: its id, start, last row and sums."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "turn_id string, start long, last long, tokens array<long>")

    def ended(self, key, turn, end: int, status: str) -> Row:
        turn_id, start, _, tokens = turn
        return Row(session_id=key[0], turn_id=turn_id, start_time=start, end_time=end, status=status, input_tokens=tokens[0], output_tokens=tokens[1], cached_tokens=tokens[2], events=tokens[3])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        turn = tuple(self.open.get()) if self.open.exists() else None
        for row in sorted(rows, key=lambda r: (r["us"], r["rank"])):
            if row["rank"] == 0:
                if turn:
                    yield self.ended(key, turn, turn[2], "error")
                turn = (row["turn_id"], row["us"], row["us"], [0, 0, 0, 1])
            elif turn:
                tokens = [a + (b or 0) for a, b in zip(turn[3], (row["input_tokens"], row["output_tokens"], row["cached_tokens"], 1), strict=True)]
                turn = (turn[0], turn[1], row["us"], tokens)
                if row["rank"] == 2:
                    yield self.ended(key, turn, row["us"], "success")
                    turn = None
        if turn:
            self.open.update(turn)
            renewed(self.handle, turn[2] + self.idle)
        else:
            self.open.clear()
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.open.exists():
            turn = tuple(self.open.get())
            self.open.clear()
            yield self.ended(key, turn, turn[2], "error")

    def close(self) -> None:
        pass


def turn_stream(events: DataFrame, late: str = "10 minutes", idle: dt.timedelta = dt.timedelta(hours=6)) -> DataFrame:
    """The turns of a stream of rollout rows (session_id, timestamp, type, payload): what ``rollouts.turns`` finds in a batch.

    A turn comes out when it is completed, when the next one starts, or, incomplete, once the watermark is ``idle`` past
    its last row. Rows of a session come in order but for those within one micro-batch.
    """
    use_rocksdb(events.sparkSession)
    token = (F.col("type") == "event_msg") & (F.col("payload.type") == "token_count")
    used = lambda c: F.when(token, F.col(f"payload.info.last_token_usage.{c}"))
    rows = events.select("session_id", "timestamp", F.unix_micros("timestamp").alias("us"), rank().alias("rank"), F.col("payload.turn_id").alias("turn_id"), used("input_tokens").alias("input_tokens"), used("output_tokens").alias("output_tokens"), used("cached_input_tokens").alias("cached_tokens"))
    out = rows.withWatermark("timestamp", late).groupBy("session_id").transformWithState(Turns(idle // dt.timedelta(microseconds=1)), TURN, "append", "EventTime")
    return dated(out, "start_time", "end_time")


class Rolling(StatefulProcessor):
    """A key's counts of its last hours, oldest first: no more than the longest sum spans."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.buffer = handle, handle.getListState("buffer", "us long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = [(r[0], r[1]) for r in self.buffer.get()]
        for row in sorted(rows, key=lambda r: r["us"]):
            us = row["us"]
            if held and us <= held[-1][0]:
                continue  # an hour that was there: its sums are out
            held = [h for h in held if us - h[0] < HOURS[-1] * HOUR] + [(us, row["n"])]
            sums = [sum(n for t, n in held if us - t < h * HOUR) for h in HOURS]
            yield Row(key=key[0], hour=us, n=row["n"], **{f"sum_{h}": s for h, s in zip(HOURS, sums, strict=True)})
        self.buffer.put(held)
        renewed(self.handle, held[-1][0] + HOURS[-1] * HOUR)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.buffer.clear()
        return iter(())

    def close(self) -> None:
        pass


def rolling_sums(hours: DataFrame, late: str = "2 hours") -> DataFrame:
    """key, hour, n and the sums over the last 3, 6, 24 and 168 hours (this one included; hours that lack count 0) of a
    stream (key, hour, n), whose hours come in order but for those within one micro-batch; a repeated hour is passed over.
    """
    use_rocksdb(hours.sparkSession)
    out = "key string, hour long, n long, " + ", ".join(f"sum_{h} long" for h in HOURS)
    rows = hours.select("key", "hour", F.unix_micros("hour").alias("us"), "n").withWatermark("hour", late)
    return dated(rows.groupBy("key").transformWithState(Rolling(), out, "append", "EventTime"), "hour")


class PeakAges(StatefulProcessor):
    """A key's last hour and how many hours up to it have been peaks."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "us long, age long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, age = self.last.get() if self.last.exists() else (None, 0)
        for row in sorted(rows, key=lambda r: r["us"]):
            follows = last is not None and row["us"] - last == HOUR
            last, age = row["us"], (age + 1 if follows else 1) if row["is_peak"] else 0
            yield Row(key=key[0], hour=last, age=age)
        self.last.update((last, age))
        renewed(self.handle, last + 2 * HOUR)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()  # the next hour can't come any more, and a later one starts anew
        return iter(())

    def close(self) -> None:
        pass


def peak_ages(hours: DataFrame, late: str = "2 hours") -> DataFrame:
    """key, hour, age: for each hour of a stream (key, hour, is_peak), how many hours in a row have been peaks."""
    use_rocksdb(hours.sparkSession)
    rows = hours.select("key", "hour", F.unix_micros("hour").alias("us"), "is_peak").withWatermark("hour", late)
    return dated(rows.groupBy("key").transformWithState(PeakAges(), "key string, hour long, age long", "append", "EventTime"), "hour")
