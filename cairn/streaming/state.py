"""Keyed state on streams: the same results as the batch plans, event by event.

State is kept per key in the RocksDB state store (``configure``) as a few numbers, so a key's history is never gathered.
It lives by event time: a timer clears it once the watermark has passed the time from which it no longer matters. Events
later than the watermark are left out. What a key has in one micro-batch is put into the order of time first; a source's
rate option (such as ``maxFilesPerTrigger``) bounds that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Ordered(StatefulProcessor):
    """Rows (key, id, us) of a key in time order; ``state`` is (level or count, time of the last event)."""

    fields: tuple[str, str] = ("a", "at")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"{self.fields[0]} bigint, {self.fields[1]} bigint")

    #: Microseconds of silence after which the state of a key says no more than none.
    matters_us: int = 0

    def step(self, state: tuple[int, int] | None, us: int) -> tuple[tuple[int, int], int]:
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.state.clear()
        return iter(())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        state = self.state.get() if self.state.exists() else None
        state = None if state is None else (int(state[0]), int(state[1]))
        batch = pd.concat(list(rows)).sort_values(["us", "id"])
        out = []
        for i, us in zip(batch["id"], batch["us"], strict=True):
            state, result = self.step(state, int(us))
            out.append((key[0], i, result))
        self.state.update(state)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer((state[1] + self.matters_us) // 1000 + 1)
        yield pd.DataFrame(out, columns=["key", "id", "result"])

    def close(self) -> None:
        pass


class HandoffCounter(_Ordered):
    """Counts signals, each of which refreshes the time to live; fires and starts anew at ``fires_at``."""

    def __init__(self, ttl_us: int, fires_at: int = 3):
        self.ttl_us, self.fires_at, self.matters_us = ttl_us, fires_at, ttl_us

    def step(self, state: tuple[int, int] | None, us: int) -> tuple[tuple[int, int], int]:
        count = 0 if state is None or us - state[1] >= self.ttl_us else state[0] % self.fires_at
        return (count + 1, us), count + 1


class TokenBucket(_Ordered):
    """One token every ``per_us``, at most ``burst``; result 1 where an event finds one."""

    def __init__(self, per_us: int, burst: int):
        self.per_us, self.full, self.matters_us = per_us, per_us * burst, per_us * burst

    def step(self, state: tuple[int, int] | None, us: int) -> tuple[tuple[int, int], int]:
        level = self.full if state is None else min(self.full, state[0] + max(0, us - state[1]))
        allowed = level >= self.per_us
        return (level - self.per_us if allowed else level, us), int(allowed)


def run_keyed(stream: DataFrame, key: str, ts: str, order: str, processor: StatefulProcessor, late: str = "1 hour") -> DataFrame:
    """(key, id, result bigint) of each event of the stream; events later than ``late`` are left out."""
    at = F.col(ts).cast("timestamp")
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(order).cast("bigint").alias("id"), F.unix_micros(at).alias("us"), at.alias("at")).withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(processor, "key string, id bigint, result bigint", "append", "eventTime")


def windowed_counts(stream: DataFrame, ts: str, label: str, width: str, late: str) -> DataFrame:
    """Counts per window and label; events later than ``late`` are left out."""
    t = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return t.groupBy(F.window("__ts", width), label).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), label, "n")
