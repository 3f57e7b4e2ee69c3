"""The streaming operators run to the end of the driver tables, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumencat import schemas
from lumencat.operators import audit, cache
from lumencat.plans import tables
from lumencat.sources.storage import SnapshotTable, append, fresh_path, scan_stream
from lumencat.streaming import change_log, expiry, folds
from lumencat.streaming.age_parts import AgeParts

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_stream(spark, f"{sf_dir}/events.parquet", tables.read(spark, sf_dir, "events").schema)


def _feed(label: str, *parts: DataFrame) -> DataFrame:
    """Write the parts one after the other and read them back as a stream in that order."""
    spark, schema = parts[0].sparkSession, parts[0].schema
    path = fresh_path(spark, label)
    for part in parts:
        append(part, path)
    return scan_stream(spark, path, schema)


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4 as a stream: all changes from nothing to the old and on to the new snapshot."""
    old, new = tables.snapshots(spark, sf_dir)
    changes = _feed(
        "changes",
        audit.snapshot_changes(old.limit(0), old, tables.AS_OF),
        audit.snapshot_changes(old, new, tables.AS_OF),
    )
    stored = SnapshotTable(spark, fresh_path(spark, "stream-counts"), schemas.ASSET_COUNTS)
    folds.maintain_counts(changes, stored, fresh_path(spark, "checkpoint")).awaitTermination()
    return stored.read()


def stream_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 + G3 as a stream: what is left when the clock has reached the last write less an hour."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    written = cache.entries(tables.cache_puts(_events(spark, sf_dir)))
    path = fresh_path(spark, "cache-events")
    expiry.maintain_cache(written, path, fresh_path(spark, "checkpoint"), "1 hour").awaitTermination()
    live = expiry.live_entries(spark.read.schema(expiry.EVENTS).parquet(path))
    return live.select("key", F.get_json_object("value", "$.k").cast("long").alias("k"), "seq")


def stream_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1 + H2 as a stream: every message with who got it, in which turn and micro-batch, if anyone."""
    messages = tables.messages(_events(spark, sf_dir))
    pending = AgeParts(spark, fresh_path(spark, "pending"), width=86_400)
    claims = fresh_path(spark, "claims")
    folds.hand_out(messages, pending, claims, fresh_path(spark, "checkpoint"), 50, 4).awaitTermination()
    given = spark.read.parquet(claims).select("id", "worker", "turn", F.col("batch").cast("long").alias("batch"))
    none = F.lit(None)
    waiting = pending.read().select("id", none.cast("int").alias("worker"), none.cast("long").alias("turn"), none.cast("long").alias("batch"))
    return given.unionByName(waiting)


def _audited(spark: SparkSession, sf_dir: str, *feed: DataFrame) -> DataFrame:
    """The log of a feed of whole rows with seq, deleted and at, a micro-batch per part."""
    log = fresh_path(spark, "log")
    columns = [c for c in feed[0].columns if c not in ("seq", "deleted", "at")]
    change_log.log_changes(_feed("writes", *feed), columns, log, fresh_path(spark, "checkpoint")).awaitTermination()
    return change_log.read_changes(spark, log)


def stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1 + I3 as a stream: the old snapshot arrives, then what the new one deletes and writes; the
    logged images must amount to the new snapshot."""
    old, new = tables.snapshots(spark, sf_dir)
    gone = old.join(new.select("id"), "id", "left_anti")

    def writes(rows: DataFrame, seq: int, deleted: bool, at: str) -> DataFrame:
        return rows.select(
            "*", F.lit(deleted).alias("deleted"), F.lit(seq).alias("seq"), F.lit(at).cast("timestamp").alias("at")
        )

    logged = _audited(
        spark, sf_dir, writes(old, 0, False, "2024-01-01"),
        writes(gone, 1, True, "2024-01-16").unionByName(writes(new, 1, False, "2024-01-16")),
    )
    return audit.replay(logged.withColumnRenamed("seq", "id"), tables.AS_OF, old.schema)


def stream_audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1 as a stream: every event writes the row of its user, views delete it; all changes, in order."""
    events = tables.read(spark, sf_dir, "events")
    writes = events.select(
        F.col("user_id").alias("id"), F.col("event_type").alias("name"), F.get_json_object("props", "$.k").cast("long").alias("k"),
        (F.col("event_type") == "view").alias("deleted"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"),
    )
    late = F.col("seq") > events.agg(F.avg("event_id")).first()[0]
    logged = _audited(spark, sf_dir, writes.where(~late), writes.where(late))

    def k(image: str):
        return F.get_json_object(image, "$.k").cast("long")

    return logged.select("record_id", "action", k("old_data").alias("old_k"), k("new_data").alias("new_k"), "seq")
