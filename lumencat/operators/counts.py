"""Counts per asset type: live, fixed-column, refreshed and incremental (E)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lumencat.schemas import ASSET_TYPES
from lumencat.sources.storage import SnapshotTable


def count_by_type(assets: DataFrame) -> DataFrame:
    """(asset_type, count); absent types are absent."""
    return assets.groupBy("asset_type").agg(F.count("id").alias("count"))


def count_map(assets: DataFrame) -> DataFrame:
    """E1 as one map {type: n}."""
    pairs = F.sort_array(F.collect_list(F.struct("asset_type", "count")))
    return count_by_type(assets).agg(F.map_from_entries(pairs).alias("counts"))


def count_columns(assets: DataFrame, domain: Sequence[str] = ASSET_TYPES) -> DataFrame:
    """One row, one column per type of ``domain``, 0 for absent types."""
    return assets.agg(*[F.count_if(F.col("asset_type") == t).alias(t) for t in domain])


def refresh_counts(assets: DataFrame, table: SnapshotTable, version: int | None = None) -> int:
    """Recompute the stored counts; readers keep the old version until the new one is whole."""
    return table.commit(count_by_type(assets), version)


def count_changes(changes: DataFrame) -> DataFrame:
    """(asset_type, delta) of a batch of change rows, from their old and new images."""
    old = F.get_json_object("old_data", "$.asset_type")
    new = F.get_json_object("new_data", "$.asset_type")
    steps = F.array(
        F.struct(old.alias("asset_type"), F.lit(-1).alias("n")),
        F.struct(new.alias("asset_type"), F.lit(1).alias("n")),
    )
    return (
        changes.where(~old.eqNullSafe(new))
        .select(F.inline(steps))
        .where("asset_type IS NOT NULL")
        .groupBy("asset_type")
        .agg(F.sum("n").alias("delta"))
    )


def apply_count_changes(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """The stored counts after a batch of changes; groups that reach 0 disappear."""
    return (
        counts.select("asset_type", F.col("count").alias("n"))
        .unionByName(count_changes(changes).withColumnRenamed("delta", "n"))
        .groupBy("asset_type")
        .agg(F.sum("n").alias("count"))
        .where(F.col("count") != 0)
    )
