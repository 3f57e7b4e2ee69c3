"""Write-side operators (B): state and changes in, new state out.

A batch of changes is reduced to what counts and written once; it is then measured and joined more
than once without being worked out again.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lumencat.operators.ordered import next_id, rank_rows
from lumencat.sources.storage import materialize

PATCHABLE = ("asset_type", "file_name", "file_path", "file_size", "lon", "lat")


def get_or_create_tags(tags: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B1: (all tags, created tags) after every name of ``names`` (column ``name``) has an id.

    New ids follow the highest one in name order, so a rerun gives the same ids.
    """
    wanted = materialize(names.select("name").where(F.col("name").isNotNull()).distinct(), "names")
    missing = wanted.join(tags.select("name"), "name", "left_anti")
    created = rank_rows(missing, ["name"], "id", start=next_id(tags)).select("id", "name")
    return tags.select("id", "name").unionByName(created), created


def insert_or_ignore(state: DataFrame, changes: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """B2: (new state, inserted rows); rows whose key exists, or repeats, are ignored."""
    keys = list(keys)
    changes = materialize(changes.dropDuplicates(keys), "changes")
    inserted = changes.join(state.select(*keys), keys, "left_anti")
    return state.unionByName(inserted), inserted


def split_by_parent(
    rows: DataFrame, parent: DataFrame, column: str, parent_column: str = "id",
) -> tuple[DataFrame, DataFrame]:
    """(rows whose parent exists, rejected rows): one join, written once and read twice."""
    parents = parent.select(F.col(parent_column).alias(column)).distinct().withColumn("__parent", F.lit(True))
    flagged = materialize(rows.join(parents, column, "left"), "flagged")
    found = F.col("__parent").isNotNull()
    return flagged.where(found).drop("__parent"), flagged.where(~found).drop("__parent")


def add_tags(
    assets: DataFrame, tags: DataFrame, links: DataFrame, requests: DataFrame,
) -> dict[str, DataFrame]:
    """B1 + B2 + B3 over a batch of (asset_id, name).

    Repeated requests collapse before any join, so one busy asset counts once per tag name.
    """
    requests = requests.select("asset_id", "name").distinct()
    accepted, rejected = split_by_parent(requests, assets, "asset_id")
    all_tags, created = get_or_create_tags(tags, accepted)
    by_name = all_tags.select(F.col("id").alias("tag_id"), "name")
    wanted = accepted.join(by_name, "name").select("asset_id", "tag_id")
    new_links, inserted = insert_or_ignore(links, wanted, ["asset_id", "tag_id"])
    return {
        "tags": all_tags, "created": created, "links": new_links, "inserted": inserted,
        "rejected": rejected,
    }


def _folded(patches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per id and column: whether a patch names it, and the value of the last that does."""
    named = {c: F.array_contains("set_fields", c) for c in columns}
    return patches.groupBy("id").agg(
        *[F.max(named[c]).alias(f"__has_{c}") for c in columns],
        *[F.max_by(c, F.when(named[c], F.col("seq"))).alias(f"__new_{c}") for c in columns],
    )


def patch(
    state: DataFrame, patches: DataFrame, as_of: datetime | Column, columns: Sequence[str] = PATCHABLE,
) -> DataFrame:
    """B4 + B5: apply partial updates; only columns named in ``set_fields`` change.

    Patches of one id (columns id, seq, set_fields and the patched columns) fold per column to the
    one with the highest ``seq``; an explicitly set NULL overwrites. Every patched row gets
    ``updated_at``. Patches to unknown ids change nothing.
    """
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of)
    folded = _folded(patches, columns).withColumn("__patched", F.lit(True))
    changed = {c: F.when(F.col(f"__has_{c}"), F.col(f"__new_{c}")).otherwise(F.col(c)) for c in columns}
    changed["updated_at"] = F.when(F.col("__patched"), as_of).otherwise(F.col("updated_at"))
    return state.join(materialize(folded, "patches"), "id", "left").select(
        *[changed[c].alias(c) if c in changed else F.col(c) for c in state.columns]
    )


def patch_side(
    side: DataFrame, owners: DataFrame, patches: DataFrame, columns: Sequence[str], key: str = "asset_id",
) -> tuple[DataFrame, DataFrame]:
    """B4 for a side table such as dimensions or metadata: (rows after the patches, rejects), as (key, columns).

    A missing row is inserted, an explicitly set NULL clears, what is not named stays, and a row with
    nothing left goes. All columns of a side table are NOT NULL: where the patches of an id would
    leave only some of them, its row stays as it was, and what it would have become is a reject.
    Patches to ids that ``owners`` (column id) lacks change nothing.
    """
    known = patches.join(owners.select("id"), "id", "left_semi")
    folded = _folded(known, columns).withColumnRenamed("id", key)
    after = [F.when(F.col(f"__has_{c}"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    merged = side.select(key, *columns).join(materialize(folded, "patches"), key, "full_outer").select(
        key, F.struct(*columns).alias("__was"), F.struct(*after).alias("__now"))
    missing = sum((F.col(f"__now.{c}").isNull().cast("int") for c in columns), F.lit(0))
    half = (missing > 0) & (missing < len(columns))
    kept = merged.select(key, F.when(half, F.col("__was")).otherwise(F.col("__now")).alias("row"))
    kept = kept.where(F.coalesce(*[F.col(f"row.{c}").cast("string") for c in columns]).isNotNull())
    return kept.select(key, "row.*"), merged.where(half).select(key, "__now.*")


def patch_tags(
    links: DataFrame, tags: DataFrame, owners: DataFrame, patches: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """B4 for tags: (links, tags) after patches whose ``tags`` array replaces what an asset has.

    NULL or [] takes all tags away; names without an id get one; repeated names count once. Patches
    to ids that ``owners`` lacks change nothing.
    """
    known = patches.join(owners.select("id"), "id", "left_semi")
    folded = materialize(_folded(known, ["tags"]).where("__has_tags"), "patches")
    wanted = folded.select(F.col("id").alias("asset_id"), F.explode("__new_tags").alias("name")).where("name IS NOT NULL").distinct()
    all_tags, _ = get_or_create_tags(tags, wanted)
    kept = links.select("asset_id", "tag_id").join(folded.select(F.col("id").alias("asset_id")), "asset_id", "left_anti")
    made = wanted.join(all_tags.select(F.col("id").alias("tag_id"), "name"), "name").select("asset_id", "tag_id")
    return kept.unionByName(made), all_tags


def delete(state: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(kept rows, deleted rows); unknown ids delete nothing."""
    ids = ids.select(key).distinct()
    return state.join(ids, key, "left_anti"), state.join(ids, key, "left_semi")


def delete_restricted(
    state: DataFrame, ids: DataFrame, children: Sequence[tuple[DataFrame, str]], key: str = "id",
) -> dict[str, DataFrame]:
    """B6 behind B7: ids that child rows still point to are blocked and reported.

    Only children of the asked ids are looked at, and their keys are made distinct before they
    travel, so an id with very many children costs one row per task.
    """
    ids = materialize(ids.select(key).distinct(), "ids")
    referenced = reduce(
        DataFrame.unionByName,
        [child.select(F.col(fk).alias(key)).join(ids, key, "left_semi") for child, fk in children],
    ).distinct()
    referenced = materialize(referenced, "referenced")
    kept, deleted = delete(state, ids.join(referenced, key, "left_anti"), key)
    blocked = state.select(key).join(referenced, key, "left_semi")
    return {"kept": kept, "deleted": deleted, "blocked": blocked}


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last in ``order``; combines before the shuffle."""
    keys = list(keys)
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
        .select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in rows.columns])
    )


def upsert_latest(
    state: DataFrame, writes: DataFrame, keys: Sequence[str], order: Sequence[str],
) -> DataFrame:
    """Insert or overwrite by key; the last write in ``order`` wins."""
    return latest(state.unionByName(writes.select(*state.columns)), keys, order)
