"""The retained volume history as keyed state: one small state per pool, in the stream's own state store.

A pool's state is the bucket being formed (a value) and the finalised entries before it (a list of at most `keep`).
A batch reads and writes the pools it touches and no others; the RocksDB store uploads changed files only, so a
checkpoint grows with the traffic, not with the pools ever seen. A restart continues from the last checkpoint,
and a batch that died is done again from the state before it.

A skipped bucket needs no visit of its own: the next sample of the pool adds the empty entries. What does need
a clock is forgetting: with `idle_ms`, a timer drops the state of a pool that had no sample for that long.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FORMING = "bucket bigint, volume string, blocks bigint"
ENTRY = "volume string, blocks bigint"
OUTPUT = "pool string, window_id bigint, history_len bigint, history_volume string, history_blocks bigint, late boolean"
WIDEST = 10**38


def added(a: str | None, b: str | None) -> str | None:
    """Sum of two integer texts, exact at any width; unknown if either is."""
    return None if a is None or b is None else str(int(a) + int(b))


def fold(forming: tuple | None, entries: list[tuple], bucket: int, volume: str | None, blocks: int, keep: int, per_bucket: int) -> tuple[tuple, list[tuple], bool]:
    """(forming, entries, late) after one sample. Empty buckets are filled in only while the history isn't full."""
    if forming is None or bucket == forming[0]:
        old = (bucket, "0", 0) if forming is None else forming
        return (bucket, added(old[1], volume), old[2] + blocks), entries, False
    if bucket < forming[0]:
        return forming, entries, True
    empty = max(0, min(bucket - forming[0] - 1, keep - 1 - len(entries)))
    done = [*entries, (forming[1], forming[2]), *[("0", per_bucket)] * empty]
    return (bucket, volume, blocks), done[-keep:], False


def totals(entries: list[tuple]) -> tuple[int, str | None, int]:
    """Length, volume and blocks of a history; no volume where one is unknown or the total leaves 38 digits."""
    known = all(v is not None for v, _ in entries)
    volume = sum(int(v) for v, _ in entries) if known else None
    return len(entries), None if volume is None or abs(volume) >= WIDEST else str(volume), sum(b for _, b in entries)


class VolumeHistory(StatefulProcessor):
    """Each sample (window_id, bucket, volume, window_blocks) of a pool with the history it finds, itself included."""

    def __init__(self, keep: int, per_bucket: int, idle_ms: int | None):
        self.keep, self.per_bucket, self.idle_ms = keep, per_bucket, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.forming = handle.getValueState("forming", FORMING)
        self.entries = handle.getListState("entries", ENTRY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows))
        forming = self.forming.get() if self.forming.exists() else None
        entries = list(self.entries.get()) if self.entries.exists() else []
        before, out = entries, []
        samples = zip(batch["window_id"], batch["bucket"], batch["volume"], batch["window_blocks"], strict=True)
        for window, bucket, volume, blocks in sorted(samples, key=lambda r: r[:2]):
            volume = None if volume is None or pd.isna(volume) else str(int(Decimal(volume)))
            forming, entries, late = fold(forming, entries, int(bucket), volume, int(blocks), self.keep, self.per_bucket)
            out.append((key[0], int(window), *totals(entries), late))
        self.forming.update(forming)
        if entries is not before:
            self.entries.put(entries)
        if self.idle_ms is not None:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")]).astype({"history_volume": object})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.forming.clear()
        self.entries.clear()
        return iter([])

    def close(self) -> None:
        pass


def history_stream(samples: DataFrame, blocks_per_bucket: int, keep: int = 24, idle_ms: int | None = None) -> DataFrame:
    """A stream of samples (pool, window_id, bucket, volume_anchor, window_blocks) with their histories."""
    slim = samples.select("pool", "window_id", "bucket", F.col("volume_anchor").cast("string").alias("volume"), "window_blocks")
    return slim.groupBy("pool").transformWithStateInPandas(
        statefulProcessor=VolumeHistory(keep, blocks_per_bucket, idle_ms),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )


@contextmanager
def keyed_store(spark: SparkSession):
    """While a query is started: keyed state lives in RocksDB, with changelogs instead of whole snapshots per batch."""
    wanted = {PROVIDER: ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start_history(
    samples: DataFrame, path: str, checkpoint: str, blocks_per_bucket: int, keep: int = 24,
    idle_ms: int | None = None, poll_seconds: float | None = None,
) -> StreamingQuery:
    """Start the history over a stream of samples; the file sink's own log makes each batch's rows appear once.

    poll_seconds=None works off what is there and stops. Timers never come to an end, so `idle_ms` needs polling.
    """
    if idle_ms is not None and poll_seconds is None:
        raise ValueError("idle_ms needs a stream that keeps running: set poll_seconds")
    out = history_stream(samples, blocks_per_bucket, keep, idle_ms)
    writer = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    with keyed_store(samples.sparkSession):
        if poll_seconds is None:
            return writer.trigger(availableNow=True).start()
        return writer.trigger(processingTime=f"{poll_seconds} seconds").start()
