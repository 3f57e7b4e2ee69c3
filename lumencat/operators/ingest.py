"""Loading rows and nested records into the catalog tables (A2, A3, A4)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from lumencat import schemas
from lumencat.functions.geo import point
from lumencat.operators.audit import feed_changes
from lumencat.operators.counts import apply_count_changes
from lumencat.operators.merge import get_or_create_tags
from lumencat.operators.ordered import next_id, rank_rows
from lumencat.operators.search import build_index
from lumencat.sources.storage import materialize


def _instant(as_of: datetime | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def insert_assets(
    assets: DataFrame, rows: DataFrame, as_of: datetime | Column, order: Sequence[str],
) -> DataFrame:
    """A2: the new asset rows, with dense ids after the highest one and defaulted timestamps.

    ``order`` must be a total order of ``rows``; ids follow it.
    """
    numbered = rank_rows(rows, order, "id", start=next_id(assets))
    for name in ("created_at", "updated_at"):
        given = F.col(name) if name in rows.columns else F.lit(None)
        numbered = numbered.withColumn(name, F.coalesce(given, _instant(as_of)))
    for name in ("lon", "lat"):
        if name not in rows.columns:
            numbered = numbered.withColumn(name, F.lit(None))
    return numbered.select(*[F.col(f.name).cast(f.dataType) for f in schemas.ASSETS])


def ingest(
    records: DataFrame,
    assets: DataFrame,
    tags: DataFrame,
    as_of: datetime | Column,
    order: Sequence[str],
) -> dict[str, DataFrame]:
    """A3: fan a batch of nested records out to the new rows of the five tables.

    Ids are assigned and written once; every table is then a projection of that one result. Locations
    off the earth are loaded as NULL and reported as ``rejected_locations``.
    """
    numbered = rank_rows(records, order, "asset_id", start=next_id(assets))
    place = point(F.col("location.longitude"), F.col("location.latitude"))
    new_assets = numbered.select(
        F.col("asset_id").alias("id"), "asset_type", "file_name", "file_path", "file_size",
        _instant(as_of).cast("timestamp").alias("created_at"),
        _instant(as_of).cast("timestamp").alias("updated_at"),
        place["lon"].alias("lon"), place["lat"].alias("lat"),
    )
    named = numbered.select("asset_id", F.explode("tags").alias("name")).where("name IS NOT NULL")
    all_tags, created = get_or_create_tags(tags, named)
    ids = all_tags.select(F.col("id").alias("tag_id"), "name")
    links = named.distinct().join(ids, "name").select("asset_id", "tag_id")
    return {
        "assets": new_assets,
        "asset_dimensions": numbered.where("dimensions IS NOT NULL").select(
            "asset_id", "dimensions.width", "dimensions.height"
        ),
        "tags": created,
        "asset_tags": links,
        "asset_metadata": numbered.where("metadata IS NOT NULL").select("asset_id", "metadata"),
        "rejected_locations": numbered.where(F.col("location").isNotNull() & place.isNull()).select(
            "asset_id", "location.latitude", "location.longitude"
        ),
    }


def write_job(
    records: DataFrame, assets: DataFrame, tags: DataFrame, counts: DataFrame, as_of: datetime | Column,
    order: Sequence[str], config: str = "simple",
) -> dict[str, DataFrame]:
    """A3 + B1 + B2 + F1 + I1 + E4: all that one loaded batch adds, from one assignment of ids.

    Beside the outputs of ``ingest``: ``postings`` of the new assets, ``audit_log`` rows and the
    ``asset_counts`` afterwards. The new rows are written first, so what is derived agrees with them.
    """
    made = {name: materialize(rows, name) for name, rows in ingest(records, assets, tags, as_of, order).items()}
    known = tags.select("id", "name").unionByName(made["tags"])
    changes = feed_changes(made["assets"].select(
        F.lit(None).cast(made["assets"].schema).alias("old"), F.struct(*made["assets"].columns).alias("new")), as_of)
    changes = materialize(changes, "audit_log")
    return made | {
        "postings": build_index(made["assets"], made["asset_tags"], known, config),
        "audit_log": changes,
        "asset_counts": apply_count_changes(counts, changes),
    }
