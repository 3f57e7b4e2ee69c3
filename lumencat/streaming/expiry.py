"""Stream form of the keyed values with expiry (G1, G3): event-time timers remove expired entries."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lumencat.schemas import CACHE_TABLE

# Executors need not have this package installed: the processor travels with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Instants travel through Python as microseconds, free of time zones.
_ENTRY = "value string, expires_us long, write_us long, seq long"
_INPUT = "key string, value string, expires_us long, write_ts timestamp, write_us long, seq long"
_OUTPUT = "event string, key string, value string, expires_us long, write_us long, seq long"
EVENTS = T.StructType([T.StructField("event", T.StringType()), *CACHE_TABLE.fields])


def _newest_per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keep the newest write per key of every Arrow batch, so that a busy key is thinned out
    before the shuffle; later writes always win, so nothing that counts is lost."""
    for rows in batches:
        yield rows.sort_values(["write_us", "seq"]).drop_duplicates("key", keep="last")


def _due(expires_us: int) -> int:
    """The first millisecond that is strictly after the expiry."""
    return expires_us // 1000 + 1


def _event(event: str, key, value, expires_us, write_us, seq) -> Row:
    return Row(event=event, key=key[0], value=value, expires_us=expires_us, write_us=write_us, seq=seq)


class _Expiry(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", _ENTRY)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        current = self.entry.get()
        newest = max(rows, key=lambda r: (r.write_us, r.seq))
        if current is not None and (newest.write_us, newest.seq) <= (current[2], current[3]):
            return
        if current is not None and current[1] is not None:
            self.handle.deleteTimer(_due(current[1]))
        self.entry.update((newest.value, newest.expires_us, newest.write_us, newest.seq))
        if newest.expires_us is not None:
            self.handle.registerTimer(_due(newest.expires_us))
        yield _event("put", key, newest.value, newest.expires_us, newest.write_us, newest.seq)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        entry = self.entry.get()
        self.entry.clear()
        yield _event("purge", key, *entry)

    def close(self) -> None:
        pass


def maintain_cache(
    entries: DataFrame, path: str, checkpoint: str, lateness: str = "1 hour", trigger: dict | None = None,
) -> StreamingQuery:
    """G1 + G3: append a 'put' row per accepted write and a 'purge' row per expired entry.

    The clock is the watermark: the newest write time seen, less ``lateness``. It only moves the
    timers: writes carry no event time of their own, so none is dropped for being late; whether one
    counts is decided against the entry that is stored. Needs the RocksDB state store. ``trigger``
    defaults to all that is there.
    """
    numbered = entries.select(
        "key", "value", F.unix_micros("expires_at").alias("expires_us"), "write_ts",
        F.unix_micros("write_ts").alias("write_us"), "seq",
    )
    # Beside every write goes a tick that moves the clock and ends here.
    thinned = numbered.mapInPandas(_newest_per_batch, _INPUT)
    clock = F.explode(F.array(F.lit(None).cast("timestamp"), F.col("write_ts"))).alias("clock")
    events = (
        thinned.select("key", "value", "expires_us", "write_us", "seq", clock)
        .withWatermark("clock", lateness)
        .where("clock IS NULL")
        .groupBy("key")
        .transformWithState(
            statefulProcessor=_Expiry(), outputStructType=_OUTPUT, outputMode="Append", timeMode="EventTime",
        )
        .select(
            "event", "key", "value", F.timestamp_micros("expires_us").alias("expires_at"),
            F.timestamp_micros("write_us").alias("write_ts"), "seq",
        )
    )
    return (
        events.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def live_entries(events: DataFrame) -> DataFrame:
    """The table that the event rows amount to: last put per key, unless it was purged."""
    purged = F.max(F.when(F.col("event") == "purge", F.struct("write_ts", "seq"))).alias("purged")
    put = F.max(F.when(F.col("event") == "put", F.struct("write_ts", "seq", "value", "expires_at"))).alias("put")
    return (
        events.groupBy("key").agg(put, purged)
        .where("purged IS NULL OR purged < struct(put.write_ts, put.seq)")
        .select("key", "put.value", "put.expires_at", "put.write_ts", "put.seq")
    )
