"""The catalog tables as read from a folder of driver tables.

Orders play the assets, parts the tag dictionary, line items the links, labels the dimensions,
events the metadata, cache writes and messages, customers and suppliers the places.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lumencat import schemas
from lumencat.session import bound_tasks
from lumencat.sources.storage import scan, spread

NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)
AS_OF = dt.datetime(2024, 1, 16, tzinfo=dt.timezone.utc)
# Asset kinds of the stand-in tables.
KINDS = ("F", "O", "P")
# The two snapshots: orders placed before NEW_FROM are gone from the new one, those placed on or
# after OLD_UNTIL are not yet in the old one.
NEW_FROM, OLD_UNTIL = "1996-01-01", "2000-07-01"
# The place of the single-centre searches.
CENTRE_LON, CENTRE_LAT, NEAR_METRES = 10.25, 48.5, 2_000_000
BATCH_METRES = 500_000


_SCHEMAS: dict[str, T.StructType] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its footer is looked at once, not once per use."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    bound_tasks(spark)
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return scan(spark, path, _SCHEMAS[path])


def _date(day: str) -> Column:
    return F.lit(day).cast("timestamp_ntz")


def _place(key: Column) -> tuple[Column, Column]:
    lon = (key * 7919 % 36000) / F.lit(100.0) - 180
    lat = (key * 104729 % 17800) / F.lit(100.0) - 89
    return lon, lat


def assets(spark: SparkSession, sf_dir: str, placed: Column | None = None) -> DataFrame:
    """Orders as assets; ``placed`` is a condition on the stored order date, so that it reaches the scan."""
    lon, lat = _place(F.col("o_custkey"))
    placed_at = F.col("o_orderdate").cast("timestamp")
    orders = read(spark, sf_dir, "orders")
    return (orders if placed is None else orders.where(placed)).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("asset_type"),
        F.col("o_orderpriority").alias("file_name"),
        F.concat_ws("/", F.lit(""), "o_orderstatus", "o_orderkey").alias("file_path"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("file_size"),
        placed_at.alias("created_at"), placed_at.alias("updated_at"),
        lon.alias("lon"), lat.alias("lat"),
    )


def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("asset_id"), F.col("quality").alias("width"), F.col("toxic").alias("height")
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("asset_id"), F.col("props").alias("metadata")
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part names; the lowest part key of a name is its id."""
    return (
        read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name"))
        .agg(F.min("p_partkey").alias("id")).select("id", "name")
    )


def catalog_rules() -> dict[str, schemas.TableRules]:
    """The rules of the five tables of the catalog."""
    names = ("assets", "asset_dimensions", "tags", "asset_tags", "asset_metadata")
    return {name: schemas.TABLES[name] for name in names}


def order_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, name) per line item, repeats included."""
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("asset_id"), F.col("l_partkey").alias("p_partkey")
    )
    parts = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    return lines.join(parts, "p_partkey").select("asset_id", "name")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, tag_id), one row per pair; parts turn into tags before they meet the line items."""
    parts = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    ids = tags(spark, sf_dir).withColumnRenamed("id", "tag_id")
    part_tags = parts.join(ids, "name").select("p_partkey", "tag_id")
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("asset_id"), F.col("l_partkey").alias("p_partkey")
    )
    return lines.join(part_tags, "p_partkey").select("asset_id", "tag_id").distinct()


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as located assets (id, file_name, lon, lat)."""
    lon, lat = _place(F.col("c_custkey"))
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("file_name"), lon.alias("lon"), lat.alias("lat")
    )


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as search centres, off the customers' grid of places."""
    lon, lat = _place(F.col("s_suppkey") * 31 + 7)
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("centre_id"), (lon + 0.123).alias("lon"), (lat + 0.057).alias("lat")
    )


def cache_puts(events: DataFrame) -> DataFrame:
    """Every event writes its payload under its user; the value gives hours to live.

    Error events are written without expiry.
    """
    hours = F.when(F.col("event_type") != "error", F.floor(F.col("value")).cast("long"))
    return events.select(
        F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"),
        F.col("ts").cast("timestamp").alias("write_ts"), F.col("event_id").alias("seq"),
        (hours * 3600).alias("ttl_seconds"),
    )


def cache_gets(events: DataFrame) -> DataFrame:
    """Every event reads its user's entry six hours later; error events read the next user's."""
    key = F.when(F.col("event_type") == "error", F.col("user_id") + 1).otherwise(F.col("user_id"))
    return events.select(
        F.col("event_id").alias("get_id"), key.cast("string").alias("key"),
        (F.col("ts").cast("timestamp") + F.expr("INTERVAL 6 HOURS")).alias("as_of"),
    )


def messages(events: DataFrame) -> DataFrame:
    """Events as messages; views have been taken already."""
    taken = F.when(F.col("event_type") == "view", "processing").otherwise("pending")
    return events.select(
        F.col("event_id").alias("id"), F.col("props").alias("payload"), taken.alias("status"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, weight, text): the whole document as class A, language and source as class B."""
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    fields = F.array(
        F.struct(F.lit("A").alias("weight"), "text"),
        F.struct(F.lit("B").alias("weight"), F.concat_ws(" ", "lang", "source").alias("text")),
    )
    return docs.select(F.col("doc_id").alias("id"), F.inline(fields))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nested ingest records; labelled ones have dimensions."""
    labels = read(spark, sf_dir, "labels")
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lon, lat = _place(F.col("doc_id"))
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.col("lang").alias("asset_type"),
        F.concat_ws("-", "source", "doc_id").alias("file_name"),
        F.concat_ws("/", F.lit(""), "lang", "source", "doc_id").alias("file_path"),
        F.col("n_chars").alias("file_size"),
        F.struct(lat.alias("latitude"), lon.alias("longitude")).alias("location"),
        F.when(F.col("quality").isNotNull(), F.struct(F.col("quality").alias("width"), F.col("toxic").alias("height"))).alias("dimensions"),
        F.array("lang", "source", F.col("lang")).alias("tags"),
        F.when(F.col("quality") == 1, F.to_json(F.struct("lang", "n_chars"))).alias("metadata"),
    )


def customer_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rows to insert, without ids and timestamps."""
    return read(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("asset_type"), F.col("c_name").alias("file_name"),
        F.concat_ws("/", F.lit(""), "c_mktsegment", "c_name").alias("file_path"),
        F.round(F.abs("c_acctbal") * 100).cast("long").alias("file_size"),
    )


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial updates: events first, documents after them.

    A click renames and resizes, an error clears the location, every other event resizes; a
    document renames the asset of its number.
    """
    kind, none = F.col("event_type"), F.lit(None)
    events = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_id").alias("seq"),
        F.when(kind == "click", F.array(F.lit("file_name"), F.lit("file_size")))
        .when(kind == "error", F.array(F.lit("lon"), F.lit("lat")))
        .otherwise(F.array(F.lit("file_size"))).alias("set_fields"),
        kind.alias("file_name"), F.floor("value").cast("long").alias("file_size"),
    )
    documents = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), (F.col("doc_id") + F.lit(1 << 40)).alias("seq"),
        F.array(F.lit("file_name")).alias("set_fields"),
        F.col("source").alias("file_name"), none.cast("long").alias("file_size"),
    )
    return events.unionByName(documents).select(
        "*", none.cast("string").alias("asset_type"), none.cast("string").alias("file_path"),
        none.cast("double").alias("lon"), none.cast("double").alias("lat"),
    )


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ingest records, many of them out of shape: latitudes up to 490, a missing height,
    a missing path, and payloads that are no object."""
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        "event_id", kind.alias("asset_type"), F.lit("f").alias("file_name"),
        F.when(kind != "view", kind).alias("file_path"), F.col("event_id").alias("file_size"),
        F.struct(F.col("value").alias("latitude"), (F.col("user_id") - 60).cast("double").alias("longitude")).alias("location"),
        F.struct(F.lit(1).alias("width"), F.when(F.col("value") < 200, F.lit(1)).alias("height")).alias("dimensions"),
        F.when(F.col("value") < 20, F.concat(F.lit("["), "props", F.lit("]")))
        .when(F.col("value") > 300, F.concat(F.lit("x"), "props"))
        .otherwise(F.col("props")).alias("metadata"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(old, new) states of the orders: late ones arrive, early ones go, finished ones get the size
    that their line items add up to."""
    columns = ["id", "asset_type", "file_name", "file_size"]
    old = assets(spark, sf_dir, F.col("o_orderdate") < _date(OLD_UNTIL)).select(*columns)
    quantities = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("quantity")
    )
    finished = (F.col("asset_type") == "F") & F.col("quantity").isNotNull()
    new = (
        assets(spark, sf_dir, F.col("o_orderdate") >= _date(NEW_FROM))
        .join(quantities, "id", "left")
        .withColumn("asset_type", F.when(F.col("quantity") > 200, "P").otherwise(F.col("asset_type")))
        .withColumn("file_size", F.when(finished, F.col("quantity")).otherwise(F.col("file_size")))
        .select(*columns)
    )
    return old, new
