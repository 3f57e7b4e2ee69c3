"""Catalog queries (D)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lumencat.functions.documents import json_document, json_with, with_variant


def tag_names(links: DataFrame, tags: DataFrame) -> DataFrame:
    """Sorted tag names per asset (asset_id, tags).

    Repeated links collapse in the map-side set, so an asset never gathers more than the
    dictionary has names.
    """
    names = tags.select(F.col("id").alias("tag_id"), "name")
    return (
        links.select("asset_id", "tag_id").join(names, "tag_id")
        .groupBy("asset_id")
        .agg(F.sort_array(F.collect_set("name")).alias("tags"))
    )


def asset_details(
    assets: DataFrame, dimensions: DataFrame, links: DataFrame, tags: DataFrame, metadata: DataFrame,
) -> DataFrame:
    """One row per asset with size, tag array and metadata; an asset without tags has []."""
    return (
        assets.select("id", "asset_type", "file_name", "file_path", "file_size")
        .join(dimensions.withColumnRenamed("asset_id", "id"), "id", "left")
        .join(tag_names(links, tags).withColumnRenamed("asset_id", "id"), "id", "left")
        .join(metadata.withColumnRenamed("asset_id", "id"), "id", "left")
        .select(
            "id", "asset_type", "file_name", "file_path", "file_size", "width", "height",
            F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "metadata",
        )
    )


def records(
    assets: DataFrame, dimensions: DataFrame, links: DataFrame, tags: DataFrame, metadata: DataFrame,
) -> DataFrame:
    """The nested record of each of ``assets``: its columns without lon and lat, then location,
    dimensions, tags and metadata.

    ``assets`` may be what D2, D3, D4 or F5 found; the sides are cut to it before they are joined.
    Location and dimensions are NULL where the asset has none; tags are [] then.
    """
    owners = assets.select(F.col("id").alias("asset_id")).distinct()
    links, dimensions, metadata = (side.join(owners, "asset_id", "left_semi") for side in (links, dimensions, metadata))
    sized = dimensions.select(F.col("asset_id").alias("id"), F.struct("width", "height").alias("dimensions"))
    described = metadata.select(F.col("asset_id").alias("id"), "metadata")
    own = [c for c in assets.columns if c not in ("lon", "lat")]
    location = F.when(
        F.col("lon").isNotNull() & F.col("lat").isNotNull(),
        F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")),
    )
    return (
        assets.join(sized, "id", "left")
        .join(tag_names(links, tags).withColumnRenamed("asset_id", "id"), "id", "left")
        .join(described, "id", "left")
        .select(
            *own, location.alias("location"), "dimensions",
            F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "metadata",
        )
    )


def lookup(assets: DataFrame, asset_id: int) -> DataFrame:
    """One asset by id; the comparison reaches the Parquet scan."""
    return assets.where(F.col("id") == F.lit(asset_id))


def lookup_batch(assets: DataFrame, ids: DataFrame) -> DataFrame:
    """D2 for many ids (column ``id``): every asked id once, with a ``found`` flag."""
    ids = ids.select("id").distinct()
    found = assets.join(ids, "id", "left_semi").withColumn("found", F.lit(True))
    return found.join(ids, "id", "right").withColumn("found", F.coalesce("found", F.lit(False)))


def page(assets: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    """D3: one page in id order."""
    return assets.orderBy("id").offset(skip).limit(limit)


def page_after(assets: DataFrame, last_id: int, limit: int = 100) -> DataFrame:
    """D3 for deep pages: continue after the last id seen instead of skipping rows."""
    return assets.where(F.col("id") > F.lit(last_id)).orderBy("id").limit(limit)


def substring_pattern(query: str, literal: bool = False) -> str:
    """``%query%``; with ``literal`` the wildcards of ``query`` stand for themselves."""
    if literal:
        for c in ("\\", "%", "_"):
            query = query.replace(c, "\\" + c)
    return f"%{query}%"


def substring_search(
    assets: DataFrame, links: DataFrame, tags: DataFrame, query: str, literal: bool = False,
) -> DataFrame:
    """Assets whose file name, type or any tag name contains ``query``, ignoring case."""
    pattern = substring_pattern(query, literal)
    hit_tags = tags.where(F.col("name").ilike(pattern)).select(F.col("id").alias("tag_id"))
    tagged = (
        links.select("asset_id", "tag_id").join(hit_tags, "tag_id", "left_semi")
        .select(F.col("asset_id").alias("id"))
        .distinct()
        .withColumn("__tagged", F.lit(True))
    )
    own = F.col("file_name").ilike(pattern) | F.col("asset_type").ilike(pattern)
    return assets.join(tagged, "id", "left").where(own | F.col("__tagged").isNotNull()).drop("__tagged")


def asset_json(
    assets: DataFrame, dimensions: DataFrame, links: DataFrame, tags: DataFrame, metadata: DataFrame,
    ids: DataFrame | None = None,
) -> DataFrame:
    """(id, document) for all assets or the given ids.

    ``dimensions`` is always an object; ``tags`` is null, not [], for an asset without tags. Metadata
    are the stored text, so numbers and repeated members stay as they are.
    """
    if ids is not None:
        wanted = ids.select("id").distinct()
        assets = assets.join(wanted, "id", "left_semi")
        owners = wanted.withColumnRenamed("id", "asset_id")
        links = links.join(owners, "asset_id", "left_semi")
        dimensions, metadata = (side.join(owners, "asset_id", "left_semi") for side in (dimensions, metadata))
    joined = (
        assets.select("id", "asset_type", "file_name")
        .join(dimensions.withColumnRenamed("asset_id", "id"), "id", "left")
        .join(tag_names(links, tags).withColumnRenamed("asset_id", "id"), "id", "left")
        .join(metadata.withColumnRenamed("asset_id", "id"), "id", "left")
    )
    document = F.struct(
        "id", F.col("asset_type").alias("type"), "file_name",
        F.struct("width", "height").alias("dimensions"), "tags",
    )
    return joined.select("id", json_with(json_document(document), "metadata", F.col("metadata")).alias("document"))


def recent(rows: DataFrame, order: str = "changed_at", tie: str = "id", n: int = 10) -> DataFrame:
    """The last ``n`` rows, newest first, NULL times ahead of all others."""
    return rows.orderBy(F.desc_nulls_first(order), F.desc(tie)).limit(n)


def table_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Exact row count per table, largest first."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, counts).orderBy(F.desc_nulls_first("row_count"), "table_name")


def _all(tests: list[Column]) -> Column:
    return reduce(Column.__and__, tests, F.lit(True))


def _has_element(items: Column, value: object) -> Column:
    return F.exists(items, lambda x: F.coalesce(_holds(x, "$", value), F.lit(False)))


def _member_holds(document: Column, path: str, name: str, value: object) -> Column:
    """Whether the member ``name`` of the object at ``path`` contains ``value``; any name, quotes included."""
    if name and "'" not in name:
        return _holds(document, f"{path}['{name}']", value)
    members = F.try_variant_get(document, path, "map<string,variant>")
    return _holds(F.try_element_at(members, F.lit(name)), "$", value)


def _digits(number: Column) -> Column:
    """A decimal as text without zeros at its end, so that equal numbers are equal texts."""
    short = F.regexp_replace(F.regexp_replace(number, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(short == "-0", "0").otherwise(short)


def _equals_number(document: Column, path: str, kind: Column, value: int | float | Decimal) -> Column:
    """Equal by value: exactly for what is written with up to 38 digits, else as double precision."""
    exact = Decimal(repr(value)) if isinstance(value, float) else Decimal(value)
    plain = format(exact, "f")
    plain = (plain.rstrip("0").rstrip(".") if "." in plain else plain) if exact else "0"
    double = kind.startswith("DOUBLE") & (F.try_variant_get(document, path, "double") == F.lit(float(exact)))
    return double | (kind.rlike("^(BIGINT|DECIMAL)") & (_digits(F.try_variant_get(document, path, "string")) == plain))


def _holds(document: Column, path: str, value: object) -> Column:
    """Whether the value at ``path`` contains ``value``: equal type and value, member by member."""
    kind = F.schema_of_variant(F.try_variant_get(document, path, "variant"))
    if isinstance(value, Mapping):
        return kind.startswith("OBJECT") & _all([_member_holds(document, path, k, v) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        items = F.try_variant_get(document, path, "array<variant>")
        return kind.startswith("ARRAY") & _all([_has_element(items, v) for v in value])
    if value is None:
        return kind == "VOID"
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(document, path, "boolean") == F.lit(value))
    if isinstance(value, str):
        return (kind == "STRING") & (F.try_variant_get(document, path, "string") == F.lit(value))
    return _equals_number(document, path, kind, value)


def metadata_contains_many(
    metadata: DataFrame, tests: Sequence[Mapping[str, object]], column: str = "metadata", name: str = "test",
) -> DataFrame:
    """D8 for many tests at once: a row for each row and test that its document passes, its number as ``name``.

    A document is parsed once for all tests. One that names a member twice counts with the last one, in
    any session.
    """
    document = F.col("__document")
    passed = []
    for n, members in enumerate(tests):
        parts = []
        for path, value in members.items():
            for key in reversed(path.split(".")):
                value = {key: value}
            parts.append(_holds(document, "$", value))
        passed.append(F.when(_all(parts), F.lit(n)))
    if not passed:
        return metadata.withColumn(name, F.lit(0)).where(F.lit(False))
    own = [F.col(f"`{c}`") for c in metadata.columns]
    held = with_variant(metadata, column, "__document").select(*own, F.array(*passed).alias("__passed"))
    # Exploded, not filtered: a filter would be taken below the parsing, which each test would repeat then.
    return held.select(*own, F.explode_outer("__passed").alias(name)).where(F.col(name).isNotNull())


def metadata_contains(metadata: DataFrame, members: Mapping[str, object], column: str = "metadata") -> DataFrame:
    """Rows whose document contains ``members``: objects by member, arrays by element, the rest by
    type and value; numbers are equal by value. A name such as ``exif.iso`` goes down into objects.

    A document that names a member twice counts with the last one, in any session.
    """
    return metadata_contains_many(metadata, [members], column, "__test").drop("__test")


def metadata_has_key(metadata: DataFrame, key: str, column: str = "metadata") -> DataFrame:
    """Rows whose document has the top-level member ``key``."""
    return metadata.where(F.array_contains(F.json_object_keys(column), key))


def metadata_keys(metadata: DataFrame, column: str = "metadata") -> DataFrame:
    """Number of documents per top-level member name (key, documents)."""
    return (
        metadata.select(F.explode(F.json_object_keys(column)).alias("key"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("documents"))
    )
