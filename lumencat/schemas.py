"""Typed schemas of the catalog tables and the constraints that hold on them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Asset kinds, name limits and change actions of the catalog.
ASSET_TYPES = ("image", "video")
FILE_NAME_LIMIT = 255
TAG_NAME_LIMIT = 50


def _schema(*cols: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in cols])


_LONG, _INT, _STR, _TS, _DBL = (
    T.LongType(), T.IntegerType(), T.StringType(), T.TimestampType(), T.DoubleType(),
)

ASSETS = _schema(
    ("id", _LONG, False), ("asset_type", _STR, False), ("file_name", _STR, False),
    ("file_path", _STR, False), ("file_size", _LONG, False),
    ("created_at", _TS, True), ("updated_at", _TS, True),
    ("lon", _DBL, True), ("lat", _DBL, True),
)
ASSET_DIMENSIONS = _schema(("asset_id", _LONG, False), ("width", _INT, False), ("height", _INT, False))
TAGS = _schema(("id", _LONG, False), ("name", _STR, False))
ASSET_TAGS = _schema(("asset_id", _LONG, False), ("tag_id", _LONG, False))
ASSET_METADATA = _schema(("asset_id", _LONG, False), ("metadata", _STR, False))
ASSET_COUNTS = _schema(("asset_type", _STR, True), ("count", _LONG, False))
CACHE_PUTS = _schema(
    ("key", _STR, False), ("value", _STR, True), ("write_ts", _TS, False),
    ("seq", _LONG, False), ("ttl_seconds", _LONG, True),
)
CACHE_TABLE = _schema(
    ("key", _STR, False), ("value", _STR, True), ("expires_at", _TS, True),
    ("write_ts", _TS, False), ("seq", _LONG, False),
)
MESSAGE_QUEUE = _schema(
    ("id", _LONG, False), ("payload", _STR, True), ("status", _STR, True), ("created_at", _TS, True),
)
AUDIT_LOG = _schema(
    ("id", _LONG, False), ("table_name", _STR, False), ("record_id", _LONG, False),
    ("action", _STR, False), ("old_data", _STR, True), ("new_data", _STR, True),
    ("changed_at", _TS, True), ("changed_by", _STR, True),
)
ASSET_RECORDS = T.StructType([
    T.StructField("asset_type", _STR), T.StructField("file_name", _STR),
    T.StructField("file_path", _STR), T.StructField("file_size", _LONG),
    T.StructField("location", _schema(("latitude", _DBL, True), ("longitude", _DBL, True))),
    T.StructField("dimensions", _schema(("width", _INT, True), ("height", _INT, True))),
    T.StructField("tags", T.ArrayType(_STR)), T.StructField("metadata", _STR),
])


@dataclass(frozen=True)
class TableRules:
    """Constraints of one table; ``foreign`` maps a column to (parent table, parent column)."""

    schema: T.StructType
    primary: tuple[str, ...]
    unique: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    foreign: dict[str, tuple[str, str]] = field(default_factory=dict)
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    lengths: dict[str, int] = field(default_factory=dict)


TABLES: dict[str, TableRules] = {
    "assets": TableRules(
        ASSETS, ("id",), not_null=("asset_type", "file_name", "file_path", "file_size"),
        domains={"asset_type": ASSET_TYPES},
        lengths={"file_name": FILE_NAME_LIMIT, "file_path": FILE_NAME_LIMIT},
    ),
    "asset_dimensions": TableRules(
        ASSET_DIMENSIONS, ("asset_id",), not_null=("width", "height"),
        foreign={"asset_id": ("assets", "id")},
    ),
    "tags": TableRules(TAGS, ("id",), unique=("name",), not_null=("name",), lengths={"name": TAG_NAME_LIMIT}),
    "asset_tags": TableRules(
        ASSET_TAGS, ("asset_id", "tag_id"),
        foreign={"asset_id": ("assets", "id"), "tag_id": ("tags", "id")},
    ),
    "asset_metadata": TableRules(
        ASSET_METADATA, ("asset_id",), not_null=("metadata",), foreign={"asset_id": ("assets", "id")},
    ),
    "cached_asset_counts": TableRules(ASSET_COUNTS, ("asset_type",), unique=("asset_type",)),
    "cache_table": TableRules(CACHE_TABLE, ("key",)),
    "message_queue": TableRules(MESSAGE_QUEUE, ("id",)),
    "audit_log": TableRules(AUDIT_LOG, ("id",), not_null=("table_name", "record_id", "action")),
}
