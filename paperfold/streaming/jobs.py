"""Streaming forms of the job reports; each has a batch twin in operators.jobs.

The status feed and the trailing rate keep state per key and go by event time: a row
waits in the state until the watermark has passed it, so rows that arrive late,
but within the allowed delay, take their place, and the stream gives the rows of
its batch twin. A trigger puts the rows of a key into the state in lists, and one timer
per key wakes them: what a trigger asks of the state follows the keys, not the rows.
Both need the RocksDB state store (`use_state_store`).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from paperfold.operators.browse import TERMINAL
from paperfold.operators.jobs import QUOTA_MARGIN, batch_completion

DELAY = "1 hour"
# Rows of a key that go into the state together.
STATE_ROWS = 10_000
# How long a feed that has ended is remembered, so that stragglers do not open it again.
REMEMBERED_SECONDS = 86_400


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


class InOrder(StatefulProcessor):
    """Holds rows until the watermark has passed them, then works them in order.

    Rows have `at` (microseconds), `number` (breaks ties) and what `_work` reads. A row
    whose key is null only moves the watermark.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at bigint, number bigint{self.held}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0] is not None and self._wanted():
            first = None
            while some := [(row.at, row.number, *self._keep(row)) for row in islice(rows, STATE_ROWS)]:
                self.waiting.appendList(some)
                least = min(row[0] for row in some)
                first = least if first is None else min(first, least)
            if first is not None:
                self._wake(first)
        return iter(())

    def _wake(self, at: int) -> None:
        # Timers go by milliseconds; a row is due when its whole millisecond has passed.
        self.handle.registerTimer(at // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # All that the watermark has passed is complete, not only what this timer was set for.
        due = timerValues.getCurrentWatermarkInMs() * 1000
        # The same row twice is one row.
        held = {(at, number): tuple(kept) for at, number, *kept in self.waiting.get()}
        ready = sorted((k, v) for k, v in held.items() if k[0] < due)
        later = [(*k, *v) for k, v in held.items() if k[0] >= due]
        if ready:
            self.waiting.clear()
            for start in range(0, len(later), STATE_ROWS):
                self.waiting.appendList(later[start : start + STATE_ROWS])
            if later:
                self._wake(min(row[0] for row in later))
        yield from self._work(key[0], ready, due)

    def close(self) -> None:
        pass


class StatusFeed(InOrder):
    """Status changes of a job until its first terminal status. A feed that has ended
    is a single value; that goes too when it has been remembered long enough."""

    held = ", status string"

    def __init__(self, remembered_seconds: int):
        self.remembered = remembered_seconds * 1_000_000

    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "status string, ended_at bigint")

    def _wanted(self) -> bool:
        told = self.last.get()
        return told is None or told[1] is None

    def _keep(self, row) -> tuple:
        return (row.status,)

    def _work(self, job_id, ready, due) -> Iterator[Row]:
        told = self.last.get()
        last, ended = told or (None, None)
        fresh = told is None
        if ended is not None:
            if due > ended + self.remembered:
                self.last.clear()
                self.waiting.clear()
            return
        for (at, number), (status,) in ready:
            if fresh or status != last:
                yield Row(job_id=job_id, at=at, event_id=number, status=status)
            last, fresh = status, False
            if status in TERMINAL:
                self.last.update((last, at))
                self.waiting.clear()
                self.handle.registerTimer((at + self.remembered) // 1000 + 2)
                return
        if not fresh:
            self.last.update((last, None))


def status_change_stream(updates: DataFrame, delay: str = DELAY, remembered_seconds: int = REMEMBERED_SECONDS) -> DataFrame:
    """Status changes per job (job_id, ts, event_id, status), ending at a terminal status.

    Updates later than `delay` are dropped. What arrives for a feed that has ended is
    dropped too, for `remembered_seconds` of event time after its end.
    """
    timed = updates.withWatermark("ts", delay)
    rows = timed.select("job_id", "ts", F.unix_micros("ts").alias("at"), F.col("event_id").alias("number"), "status")
    found = rows.groupBy("job_id").transformWithState(
        StatusFeed(remembered_seconds), "job_id bigint, at bigint, event_id bigint, status string", "Append", "EventTime"
    )
    return found.select("job_id", F.timestamp_micros("at").alias("ts"), "event_id", "status")


class TrailingRate(InOrder):
    """Requests of a key in the window that ends with each request. The state is the
    queue of the times in the window; older ones leave it."""

    held = ""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle) -> None:
        super().init(handle)
        self.recent = handle.getListState("recent", "at bigint, n bigint")

    def _wanted(self) -> bool:
        return True

    def _keep(self, row) -> tuple:
        return ()

    def _work(self, key, ready, due) -> Iterator[Row]:
        if not ready:
            return
        queue = [tuple(x) for x in self.recent.get()]
        total = sum(n for _, n in queue)
        start = 0
        while start < len(ready):
            # Requests of one moment see each other.
            at, end = ready[start][0][0], start
            while end < len(ready) and ready[end][0][0] == at:
                end += 1
            queue.append((at, end - start))
            total += end - start
            gone = 0
            while queue[gone][0] <= at - self.width:
                total -= queue[gone][1]
                gone += 1
            queue = queue[gone:]
            for (_, number), _ in ready[start:end]:
                yield Row(request_id=number, key=key, at=at, in_window=total)
            start = end
        self.recent.put(queue)


def trailing_rate_stream(requests: DataFrame, seconds: int, limit: int, margin: float = QUOTA_MARGIN, delay: str = DELAY) -> DataFrame:
    """Per request: requests of its key in the trailing window, open at exactly `seconds`,
    capacity and over_quota, as `operators.jobs.request_rate` gives them.

    requests: key, ts, request_id (bigints). Requests later than `delay` are dropped.
    """
    capacity = max(1, int(limit * margin))
    rows = requests.withWatermark("ts", delay).select("key", "ts", F.unix_micros("ts").alias("at"), F.col("request_id").alias("number"))
    found = rows.groupBy("key").transformWithState(
        TrailingRate(seconds * 1_000_000), "request_id bigint, key bigint, at bigint, in_window bigint", "Append", "EventTime"
    )
    return found.select(
        "request_id", "key", F.timestamp_micros("at").alias("ts"), "in_window", F.lit(capacity).alias("capacity"), (F.col("in_window") > capacity).alias("over_quota")
    )


def request_rate_stream(requests: DataFrame, width: str, slide: str, delay: str = "1 hour") -> DataFrame:
    """Requests per key and sliding window; late data within `delay` still counts."""
    return (
        requests.withWatermark("ts", delay)
        .groupBy("key", F.window("ts", width, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .select("key", F.col("w.start").alias("window_start"), "requests")
    )


def latest_status_stream(updates: DataFrame) -> DataFrame:
    """The latest status of each job so far: batch_id, job_id, at (ts, event_id), status.

    Update mode: a trigger gives the jobs it moved. A job's status is the one of
    its latest update, however many came before and in whatever order they arrive.
    """
    at = F.struct("ts", "event_id")
    return updates.groupBy("batch_id", "job_id").agg(F.max(at).alias("at"), F.max_by("status", at).alias("status"))


def keep_changes(folder: str):
    """Writes each trigger's rows to a folder of its own, so a repeated trigger repeats itself."""

    def keep(rows: DataFrame, trigger: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/trigger={trigger}")

    return keep


def completion(changes: DataFrame) -> DataFrame:
    """Open jobs per batch from the kept changes of `latest_status_stream`."""
    return batch_completion(
        changes.groupBy("batch_id", "job_id").agg(F.max_by("status", "at").alias("status"))
    )
