"""Crawl states by event time: events may come in any order within a delay, and failures are taken up again by timers.

Each key keeps its state, when it failed, and the events that the watermark has not passed.
One timer of a key stands at its earliest waiting event or at the end of its wait before a
retry; when the watermark passes it, all that is due is applied in the order of (time, id)
and the timer moves on. So the result depends on the events alone, not on the files or
batches that bring them, and a batch calls a key once, however many events wait.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern import scratch
from quern.operators import crawl
from quern.streaming.incremental import fresh_name

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "user_id long, state string, n long, at long"
#: The key that only moves the watermark.
TICK = -1
#: (state, n, failed, timer) of a key that has not been seen.
_NEW = (crawl.PENDING, 0, None, None)


def replay(state: str, failed: int | None, events: list[tuple[int, int, str]], until: int, retry: int) -> tuple[str, int | None]:
    """(state, when it failed) after events(micros, id, happened) in order and what time itself does up to ``until``: a failure is pending again after ``retry``."""
    for at, happened in [*((at, h) for at, _, h in sorted(events)), (until, "")]:
        if state == crawl.FAILED and failed is not None and failed + retry <= at:
            state, failed = crawl.PENDING, None
        after = crawl.follow(state, [happened])
        failed = at if after == crawl.FAILED != state else failed if after == crawl.FAILED else None
        state = after
    return state, failed


class States(StatefulProcessor):
    """States of keys; ``retry`` microseconds after a failure a key is pending again."""

    def __init__(self, retry: int) -> None:
        self.retry = retry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "state string, n long, failed long, timer long")
        self.waiting = handle.getListState("waiting", "micros long, event_id long, happened string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        settled = timerValues.getCurrentWatermarkInMs() * 1000
        held: list[tuple[int, int, str]] = []
        for batch in rows:
            # What lies before the watermark has been settled without this event.
            held += [(int(at), int(i), str(h)) for at, i, h in batch.loc[batch["micros"] >= settled, ["micros", "event_id", "happened"]].itertuples(index=False, name=None)]
        if held:
            self.waiting.appendList(held)
            state, n, failed, timer = self.known.get() if self.known.exists() else _NEW
            first = self._timer(min(held)[0])
            if timer is None or first < timer:
                self._move(timer, first)
                self.known.update((state, n, failed, first))
        yield from ()

    def _move(self, timer: int | None, to: int | None) -> None:
        if timer is not None:
            self.handle.deleteTimer(timer)
        if to is not None:
            self.handle.registerTimer(to)

    @staticmethod
    def _timer(micros: int) -> int:
        """The first millisecond at or after a time."""
        return -(-micros // 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # All that the watermark has passed is settled; a timer set for a time before it would wait for another batch.
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        events = [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
        due, later = [e for e in events if e[0] <= until], [e for e in events if e[0] > until]
        state, n, failed, _ = self.known.get() if self.known.exists() else _NEW
        after, since = replay(state, failed, due, until, self.retry)
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        ahead = [*([min(later)[0]] if later else []), *([since + self.retry] if since is not None else [])]
        timer = self._timer(min(ahead)) if ahead else None
        self._move(None, timer)  # the one that has expired goes by itself
        self.known.update((after, n + len(due), since, timer))
        if key[0] != TICK:
            yield pd.DataFrame({"user_id": [key[0]], "state": [after], "n": [n + len(due)], "at": [until]})

    def close(self) -> None:
        pass


def states_by_time(spark: SparkSession, events: DataFrame, delay: str, retry_hours: int) -> DataFrame:
    """(user_id, state, n): the last state of every key of the streamed ``events``(user_id long, ts timestamp, event_id long, happened string).

    Events that come later than ``delay`` after the newest seen are dropped, as a watermark
    does. The stream ends when its source is read; what the watermark has not passed by then
    stays unapplied, so a source closes with a row of the key TICK that lies far enough ahead.
    """
    out = f"{scratch.scratch_dir(spark)}/{fresh_name('by-time')}"
    rows = events.withColumn("micros", F.unix_micros("ts")).withWatermark("ts", delay)
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        found = rows.groupBy("user_id").transformWithStateInPandas(States(retry_hours * 3_600_000_000), SCHEMA, "Append", "EventTime")
        put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/data/batch={number}")
        found.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    return spark.read.schema(f"{SCHEMA}, batch long").parquet(f"{out}/data").groupBy("user_id").agg(F.max_by(F.struct("state", "n"), F.struct("at", "n")).alias("s")).select("user_id", "s.*")


def write_out_of_order(events: DataFrame, folder: str, jitter: int, parts: int = 5) -> None:
    """Write ``events`` as files in the order in which they would come if each were up to ``jitter`` seconds late, closed by a TICK a year ahead."""
    spark = events.sparkSession
    arrival = F.unix_seconds("ts") + F.pmod(F.xxhash64("event_id"), F.lit(jitter))
    held = scratch.save(events.withColumn("_arrival", arrival), "arrivals")
    low, high = held.agg(F.min("_arrival"), F.max("_arrival")).first()
    if low is None:
        return
    step = (high - low) // parts + 1
    for k in range(parts):
        held.where((F.col("_arrival") >= low + k * step) & (F.col("_arrival") < low + (k + 1) * step)).drop("_arrival").coalesce(1).write.mode("append").parquet(folder)
    tick = spark.range(1).select(F.lit(TICK).cast("long").alias("user_id"), F.timestamp_seconds(F.lit(high + 366 * 86_400)).alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit("").alias("happened"))
    tick.write.mode("append").parquet(folder)
