"""Claimable work table (H)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumencat.operators.ordered import next_id, rank_rows


def enqueue(queue: DataFrame, payloads: DataFrame, as_of: datetime | Column, order: Sequence[str]) -> DataFrame:
    """H1: the new messages, pending, with ids after the highest one in the total order ``order``."""
    created = as_of if isinstance(as_of, Column) else F.lit(as_of)
    if "created_at" in payloads.columns:
        created = F.coalesce(F.col("created_at"), created)
    numbered = rank_rows(payloads, order, "id", start=next_id(queue))
    return numbered.select(
        "id", "payload", F.lit("pending").alias("status"), created.cast("timestamp").alias("created_at")
    )


def claim(queue: DataFrame, claims: DataFrame, per_worker: int, workers: int = 1, batch_id: int = 0) -> DataFrame:
    """H2: hand the oldest pending messages out, ``per_worker`` to each worker.

    Returns (id, payload, worker, turn, batch_id); workers take turns in age order, and a message
    in ``claims`` is never handed out again. ``claims`` must hold no row of this ``batch_id``, so
    that a retried batch repeats its own claims.
    """
    total = per_worker * workers
    pending = queue.where(F.col("status") == "pending").join(claims.select("id"), "id", "left_anti")
    age = [F.asc_nulls_last("created_at"), F.asc("id")]
    # Only ids and times of the claimed messages meet in one task; payloads join them afterwards.
    oldest = pending.select("id", "created_at").orderBy(*age).limit(total)
    ranked = oldest.select("id", F.row_number().over(Window.orderBy(*age)).alias("__rank"))
    place = F.col("__rank") - 1
    return queue.select("id", "payload").join(ranked, "id").select(
        "id", "payload",
        F.pmod(place, F.lit(workers)).cast("int").alias("worker"),
        (F.floor(place / workers) + 1).cast("long").alias("turn"),
        F.lit(batch_id).cast("long").alias("batch_id"),
    )


def mark_claimed(queue: DataFrame, claims: DataFrame) -> DataFrame:
    """H2: the queue with claimed messages in processing."""
    taken = claims.select("id").distinct().withColumn("__taken", F.lit(True))
    status = F.when(F.col("__taken"), F.lit("processing")).otherwise(F.col("status"))
    return queue.join(taken, "id", "left").withColumn("status", status).drop("__taken")


def backlog(queue: DataFrame) -> DataFrame:
    """H3: messages per status with the oldest creation time."""
    return queue.groupBy("status").agg(
        F.count(F.lit(1)).alias("messages"), F.min("created_at").alias("oldest")
    )
