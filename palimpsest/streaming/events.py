"""Event-log streams: windows with watermarks, sessions, a limiter with state, and the file sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor


def read(spark: SparkSession, path: str, schema, ts: str = "ts") -> DataFrame:
    """A stream of Parquet files; the time column as a timestamp, which watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", ts: str = "ts", failed: str = "event_type = 'error'") -> DataFrame:
    """Counts and failures of each window and type; rows later than the watermark are dropped. Runs on streams and tables."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(failed).cast("long")).alias("errors"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "errors")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """Sessions of each key that end after a gap."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class _Limiter(StatefulProcessor):
    """The times of a key's allowed hits in the window. A timer at the end of the last one's window clears them."""

    def __init__(self, most: int, window_seconds: int, key: str, ts: str, event: str):
        self.most, self.span, self.key, self.ts, self.event = most, window_seconds * 1_000_000, key, ts, event

    def init(self, handle) -> None:
        self.handle = handle
        self.hits = handle.getValueState("hits", "us array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        hits = list(self.hits.get()[0]) if self.hits.exists() else []
        pdf = pd.concat([p[[self.key, self.event, self.ts]] for p in rows]).sort_values([self.ts, self.event])
        out = []
        for us in pdf[self.ts].astype("datetime64[us]").astype("int64"):
            hits = [h for h in hits if us - h < self.span]
            out.append(len(hits) < self.most)
            if out[-1]:
                hits.append(int(us))
        self.hits.update((hits,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if hits:
            self.handle.registerTimer((max(hits) + self.span) // 1000 + 1)
        yield pdf[[self.key, self.event]].assign(allowed=out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.hits.clear()
        yield from ()

    def close(self) -> None:
        pass


def rate_limited(events: DataFrame, most: int, window_seconds: int, key: str = "user_id", ts: str = "ts", event: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """(key, event, allowed), as the batch operator of the same rule, for each key's hits in the order in which batches bring them.

    The state of a key is the times of its allowed hits in the window, ``most`` at most; it goes when the watermark has passed
    the window. Hits later than the watermark are dropped. Needs the RocksDB state store, which ``session`` sets.
    """
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, event)}
    rows = events.select(key, event, ts).withWatermark(ts, late).groupBy(key)
    schema = f"{key} {kinds[key]}, {event} {kinds[event]}, allowed boolean"
    return rows.transformWithStateInPandas(_Limiter(most, window_seconds, key, ts, event), schema, "Append", "EventTime")


def append(events: DataFrame, path: str, checkpoint: str, every: str = "15 seconds", once: bool = False):
    """The event log's sink: Parquet files, none lost or twice after a restart."""
    writer = events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
