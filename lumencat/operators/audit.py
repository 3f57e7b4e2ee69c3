"""Change rows from snapshots, the change log and its replay (I)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lumencat.functions.documents import json_document
from lumencat.operators.ordered import next_id, rank_rows


def _change_rows(
    changes: DataFrame, table: str, key: str, as_of: datetime | Column, changed_by: str,
) -> DataFrame:
    """Change rows of (old, new) row structs, either of which may be NULL."""
    action = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE").otherwise("UPDATE")
    return changes.select(
        F.lit(table).alias("table_name"),
        F.coalesce(F.col("new")[key], F.col("old")[key]).cast("long").alias("record_id"),
        action.alias("action"),
        F.when(F.col("old").isNotNull(), json_document(F.col("old"))).alias("old_data"),
        F.when(F.col("new").isNotNull(), json_document(F.col("new"))).alias("new_data"),
        (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast("timestamp").alias("changed_at"),
        F.lit(changed_by).alias("changed_by"),
    )


def snapshot_changes(
    old: DataFrame, new: DataFrame, as_of: datetime | Column, *,
    table: str = "assets", key: str = "id", changed_by: str = "spark",
) -> DataFrame:
    """A change row per inserted, updated or deleted record between two snapshots.

    The images become JSON only after unchanged rows are gone.
    """
    columns = new.columns
    before = old.select(F.col(key), F.struct(*columns).alias("old"))
    after = new.select(F.col(key), F.struct(*columns).alias("new"))
    changed = before.join(after, key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return _change_rows(changed, table, key, as_of, changed_by)


def feed_changes(
    feed: DataFrame, as_of: datetime | Column, *,
    table: str = "assets", key: str = "id", changed_by: str = "spark",
) -> DataFrame:
    """I1 from an explicit feed of (old, new) structs; updates that change nothing are kept."""
    return _change_rows(feed, table, key, as_of, changed_by)


def append_log(
    log: DataFrame, changes: DataFrame, order: Sequence[str] = ("changed_at", "record_id"),
) -> DataFrame:
    """The change rows with log ids that continue ``log``; ``order`` must be total for the batch."""
    numbered = rank_rows(changes, order, "id", start=next_id(log))
    return numbered.select("id", *changes.columns)


def replay(log: DataFrame, as_of: datetime | Column, schema: T.StructType) -> DataFrame:
    """The table as it stood at ``as_of``, from the newest image of every record."""
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of)
    newest = (
        log.where(F.col("changed_at") <= as_of)
        .groupBy("record_id")
        .agg(F.max_by(F.struct("action", "new_data"), F.struct("changed_at", "id")).alias("__last"))
        .where(F.col("__last.action") != "DELETE")
    )
    return newest.select(F.from_json("__last.new_data", schema).alias("__row")).select("__row.*")
