"""Keyed values with expiry (G): the last write of a key counts, then its expiry."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from lumencat.operators.merge import latest, upsert_latest
from lumencat.operators.ordered import carry_forward
from lumencat.sources.storage import materialize


def _instant(as_of: datetime | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def _live(expires_at: Column, as_of: Column) -> Column:
    return expires_at.isNull() | (expires_at >= as_of)


def entries(puts: DataFrame) -> DataFrame:
    """Puts (key, value, write_ts, seq, ttl_seconds) as cache rows; a NULL ttl never expires."""
    expires_at = F.col("write_ts") + F.make_dt_interval(secs=F.col("ttl_seconds").cast("decimal(18,6)"))
    return puts.select("key", "value", expires_at.alias("expires_at"), "write_ts", "seq")


def put(table: DataFrame, puts: DataFrame) -> DataFrame:
    """G1: the table after a batch of puts."""
    return upsert_latest(table, entries(puts), ["key"], ["write_ts", "seq"])


def purge(table: DataFrame, as_of: datetime | Column) -> DataFrame:
    """The table without expired rows."""
    return table.where(_live(F.col("expires_at"), _instant(as_of)))


def get(table: DataFrame, keys: DataFrame, as_of: datetime | Column) -> DataFrame:
    """(key, value) for every asked key, NULL when absent or expired at ``as_of``.

    ``table`` may hold all puts so far; those after ``as_of`` are not seen.
    """
    as_of = _instant(as_of)
    asked = materialize(keys.select("key").distinct(), "asked")
    seen = table.where(F.col("write_ts") <= as_of).join(asked, "key", "left_semi")
    newest = latest(seen, ["key"], ["write_ts", "seq"])
    return purge(newest, as_of).select("key", "value").join(asked, "key", "right")


def get_many(puts: DataFrame, gets: DataFrame) -> DataFrame:
    """G2 for many (key, as_of) pairs, each with a unique ``get_id``: (get_id, key, as_of, value).

    Puts and gets are laid out in one order of (key, time), and the last put is carried forward;
    no range join, and a busy key is spread over many tasks.
    """
    written = entries(puts).select(
        F.col("key"), F.col("write_ts").alias("at"), F.lit(0).alias("kind"), F.col("seq").alias("tie"),
        F.struct("value", "expires_at").alias("entry"),
    )
    asked = gets.select(
        F.col("key"), F.col("as_of").alias("at"), F.lit(1).alias("kind"), F.col("get_id").alias("tie"),
        F.lit(None).cast(written.schema["entry"].dataType).alias("entry"),
    )
    filled = carry_forward(written.unionByName(asked), "key", ["at", "kind", "tie"], "entry", "found")
    return filled.where("kind = 1").select(
        F.col("tie").alias("get_id"), "key", F.col("at").alias("as_of"),
        F.when(_live(F.col("found.expires_at"), F.col("at")), F.col("found.value")).alias("value"),
    )
