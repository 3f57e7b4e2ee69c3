"""Every operator as a query over a folder of driver tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lumencat import schemas
from lumencat.functions import geo
from lumencat.operators import (
    audit, cache, catalog, counts, history, index_upkeep, ingest, merge, nearby, nearby_sphere, quality,
    quality_upkeep, search, substrings, top_search, work_queue,
)
from lumencat.plans import streams, tables
from lumencat.sources.storage import SnapshotTable, fresh_path, materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
AS_OF = tables.AS_OF


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _text(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _k(column: str = "metadata") -> Column:
    return F.get_json_object(column, "$.k").cast("long").alias("k")


def _ranked(rows: DataFrame) -> DataFrame:
    """A short result with the place of each row in it, so that a wrong order shows."""
    return rows.select("*", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).alias("rank"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "events")


def _tag_text() -> Column:
    return F.array_join("tags", ",").alias("tags")


# --- A: scans and loads -------------------------------------------------------------------------

@query
def scan_assets(spark, sf_dir):
    """A1"""
    return tables.assets(spark, sf_dir).select(
        "id", "asset_type", "file_name", "file_path", "file_size", _text("created_at"),
        F.round("lon", 2).alias("lon"), F.round("lat", 2).alias("lat"),
    )


@query
def insert_assets(spark, sf_dir):
    """A2"""
    rows = tables.customer_assets(spark, sf_dir)
    new = ingest.insert_assets(tables.assets(spark, sf_dir), rows, AS_OF, ["c_custkey"])
    return new.select("id", "asset_type", "file_name", "file_path", "file_size", _text("created_at"), _text("updated_at"))


def _ingested(spark, sf_dir) -> dict[str, DataFrame]:
    return ingest.ingest(
        tables.records(spark, sf_dir), tables.assets(spark, sf_dir), tables.tags(spark, sf_dir), AS_OF, ["doc_id"]
    )


@query
def ingest_assets(spark, sf_dir):
    """A3"""
    return _ingested(spark, sf_dir)["assets"].select(
        "id", "asset_type", "file_name", "file_path", "file_size", _text("created_at"),
        F.round("lon", 2).alias("lon"), F.round("lat", 2).alias("lat"),
    )


@query
def ingest_dimensions(spark, sf_dir):
    """A3"""
    return _ingested(spark, sf_dir)["asset_dimensions"]


@query
def ingest_tags(spark, sf_dir):
    """A3 + B1"""
    return _ingested(spark, sf_dir)["tags"]


@query
def ingest_asset_tags(spark, sf_dir):
    """A3 + B2"""
    return _ingested(spark, sf_dir)["asset_tags"]


@query
def ingest_metadata(spark, sf_dir):
    """A3"""
    return _ingested(spark, sf_dir)["asset_metadata"].select(
        "asset_id", F.get_json_object("metadata", "$.lang").alias("lang"),
        F.get_json_object("metadata", "$.n_chars").cast("long").alias("n_chars"),
    )


@query
def ingest_rejected_locations(spark, sf_dir):
    """A3: what the load could not place"""
    rows = tables.event_records(spark, sf_dir).withColumn("tags", F.array(F.col("asset_type")))
    made = ingest.ingest(rows, tables.assets(spark, sf_dir), tables.tags(spark, sf_dir), AS_OF, ["event_id"])
    return made["rejected_locations"]


def _written(spark, sf_dir) -> dict[str, DataFrame]:
    assets = tables.assets(spark, sf_dir)
    return ingest.write_job(
        tables.records(spark, sf_dir), assets, tables.tags(spark, sf_dir), counts.count_by_type(assets), AS_OF, ["doc_id"])


@query
def write_job_audit(spark, sf_dir):
    """I1 of one loaded batch"""
    return _images(_written(spark, sf_dir)["audit_log"])


@query
def write_job_counts(spark, sf_dir):
    """E4 of one loaded batch"""
    return _written(spark, sf_dir)["asset_counts"]


@query
def write_job_postings(spark, sf_dir):
    """F1 of one loaded batch"""
    return _written(spark, sf_dir)["postings"]


@query
def point_build(spark, sf_dir):
    """A4"""
    events = tables.read(spark, sf_dir, "events")
    made = geo.point(F.col("user_id") * 2 - 100, F.col("value"))
    return events.select("event_id", made["lon"].alias("lon"), made["lat"].alias("lat"))


# --- B: write side ------------------------------------------------------------------------------

@query
def tag_get_or_create(spark, sf_dir):
    """B1"""
    parts = tables.read(spark, sf_dir, "part")
    names = parts.select(F.explode(F.array("p_name", "p_type", "p_brand")).alias("name"))
    return merge.get_or_create_tags(tables.tags(spark, sf_dir), names)[0]


@query
def link_insert_or_ignore(spark, sf_dir):
    """B2: links of returned items exist; all items ask for theirs."""
    lines = tables.read(spark, sf_dir, "lineitem")
    pair = [F.col("l_orderkey").alias("asset_id"), F.col("l_partkey").alias("tag_id")]
    state = lines.where("l_returnflag = 'R'").select(*pair).distinct()
    return merge.insert_or_ignore(state, lines.select(*pair), ["asset_id", "tag_id"])[0]


@query
def link_rejects(spark, sf_dir):
    """Tags for orders that are no longer in the catalog."""
    requests = tables.links(spark, sf_dir)
    _, remaining = tables.snapshots(spark, sf_dir)
    return merge.split_by_parent(requests, remaining, "asset_id")[1]


@query
def add_tags(spark, sf_dir):
    """B1 + B2 + B3 as one batch, over the links that assets of the old snapshot have."""
    old, remaining = tables.snapshots(spark, sf_dir)
    linked = tables.links(spark, sf_dir).join(old.select(F.col("id").alias("asset_id")), "asset_id", "left_semi")
    done = merge.add_tags(
        remaining, tables.tags(spark, sf_dir), linked, tables.order_part_names(spark, sf_dir),
    )
    return done["inserted"]


@query
def patch_assets(spark, sf_dir):
    """B4 + B5"""
    state = tables.assets(spark, sf_dir)
    patched = merge.patch(state, tables.patches(spark, sf_dir), AS_OF)
    return patched.select(
        "id", "asset_type", "file_name", "file_size", _text("updated_at"),
        F.round("lon", 2).alias("lon"), F.round("lat", 2).alias("lat"),
    )


def _side_patches(spark, sf_dir) -> DataFrame:
    """Events patch the sides of the asset of their number: a click sets both lengths and the tags, an
    error clears all, a view sets the height alone; a second patch of the next number follows."""
    kind, n = F.col("event_type"), F.col("event_id")
    fields = F.when(kind == "view", F.array(F.lit("height"))).otherwise(
        F.array(*[F.lit(c) for c in ("width", "height", "tags", "metadata")]))
    some = kind == "click"
    patches = _events(spark, sf_dir).select(
        n.alias("id"), n.alias("seq"), fields.alias("set_fields"),
        F.when(some, F.col("user_id").cast("int")).alias("width"),
        F.when(kind != "error", F.floor("value").cast("int")).alias("height"),
        F.when(some, F.array(F.concat(F.lit("user "), F.col("user_id")), kind, kind, F.lit(None).cast("string"))).alias("tags"),
        F.when(some, F.col("props")).alias("metadata"),
    )
    later = patches.where("height IS NOT NULL").select(
        (F.col("id") + 1).alias("id"), (F.col("seq") + F.lit(1 << 40)).alias("seq"), F.array(F.lit("height")).alias("set_fields"),
        "width", "height", "tags", "metadata")
    return patches.unionByName(later)


@query
def patch_dimensions(spark, sf_dir):
    """B4 for a side table of two columns: what it holds afterwards, and the halves that were rejected"""
    kept, rejected = merge.patch_side(
        tables.dimensions(spark, sf_dir), tables.assets(spark, sf_dir), _side_patches(spark, sf_dir), ["width", "height"])
    return kept.withColumn("rejected", F.lit(False)).unionByName(rejected.withColumn("rejected", F.lit(True)))


@query
def patch_metadata(spark, sf_dir):
    """B4 for documents"""
    done, _ = merge.patch_side(
        tables.metadata(spark, sf_dir), tables.assets(spark, sf_dir), _side_patches(spark, sf_dir), ["metadata"])
    return done.select("asset_id", _k())


@query
def patch_tags(spark, sf_dir):
    """B4 for tags: the names of every asset afterwards"""
    links, names = merge.patch_tags(
        tables.links(spark, sf_dir), tables.tags(spark, sf_dir), tables.assets(spark, sf_dir), _side_patches(spark, sf_dir))
    return links.join(names.select(F.col("id").alias("tag_id"), "name"), "tag_id").select("asset_id", "name")


@query
def asset_records(spark, sf_dir):
    """D3 with the nested record: a page of assets"""
    page_ = catalog.page(tables.assets(spark, sf_dir), 200, 100).select("id", "asset_type", "file_name", "lon", "lat")
    found = catalog.records(
        page_, tables.dimensions(spark, sf_dir), tables.links(spark, sf_dir), tables.tags(spark, sf_dir), tables.metadata(spark, sf_dir))
    return found.select(
        "id", "asset_type", "file_name", F.round("location.latitude", 2).alias("latitude"), F.round("location.longitude", 2).alias("longitude"),
        "dimensions.width", "dimensions.height", _tag_text(), _k(),
    )


def _error_ids(spark, sf_dir) -> DataFrame:
    events = tables.read(spark, sf_dir, "events")
    return events.where("event_type = 'error'").select(F.col("event_id").alias("id"))


@query
def delete_returning(spark, sf_dir):
    """B6"""
    deleted = merge.delete(tables.assets(spark, sf_dir), _error_ids(spark, sf_dir))[1]
    return deleted.select("id", "asset_type", "file_name", "file_size")


@query
def delete_keeping(spark, sf_dir):
    """What is left."""
    return merge.delete(tables.assets(spark, sf_dir), _error_ids(spark, sf_dir))[0].select("id", "asset_type")


@query
def delete_restricted(spark, sf_dir):
    """All finished orders are to go; those with line items or metadata may not."""
    state = tables.assets(spark, sf_dir)
    lines = tables.read(spark, sf_dir, "lineitem")
    done = merge.delete_restricted(
        state, state.where("asset_type = 'F'").select("id"),
        [(lines, "l_orderkey"), (tables.metadata(spark, sf_dir), "asset_id"), (tables.dimensions(spark, sf_dir), "asset_id")],
    )
    return (
        done["deleted"].select("id", F.lit("deleted").alias("outcome"))
        .unionByName(done["blocked"].select("id", F.lit("blocked").alias("outcome")))
    )


@query
def upsert_latest(spark, sf_dir):
    """B8"""
    rows = cache.entries(tables.cache_puts(_events(spark, sf_dir)))
    newest = merge.upsert_latest(rows.where("write_ts < '2024-01-08'"), rows.where("write_ts >= '2024-01-08'"), ["key"], ["write_ts", "seq"])
    return newest.select("key", _k("value"), _text("expires_at"), "seq")


# --- C: constraint reports ----------------------------------------------------------------------

@query
def dq_primary_key(spark, sf_dir):
    """C1"""
    lines = tables.read(spark, sf_dir, "lineitem")
    turns = tables.read(spark, sf_dir, "conversations")
    return quality.primary_key(lines, ["l_orderkey", "l_partkey"], "lineitem").unionByName(
        quality.primary_key(turns, ["conv_id", "turn"], "conversations")
    )


@query
def dq_unique(spark, sf_dir):
    """C2"""
    return quality.unique(tables.read(spark, sf_dir, "part"), "p_name", "part")


@query
def dq_not_null(spark, sf_dir):
    """Columns that the side tables leave empty."""
    joined = (
        tables.assets(spark, sf_dir)
        .join(tables.dimensions(spark, sf_dir).withColumnRenamed("asset_id", "id"), "id", "left")
        .join(tables.metadata(spark, sf_dir).withColumnRenamed("asset_id", "id"), "id", "left")
    )
    return quality.not_null(joined, ["id", "file_name", "width", "height", "metadata"], "asset_sides")


@query
def dq_foreign_key(spark, sf_dir):
    """C4"""
    labels, events = tables.read(spark, sf_dir, "labels"), tables.read(spark, sf_dir, "events")
    lines = tables.read(spark, sf_dir, "lineitem")
    return quality.foreign_key(
        tables.read(spark, sf_dir, "documents"), "doc_id", labels, "doc_id", "documents"
    ).unionByName(quality.foreign_key(lines, "l_orderkey", events, "event_id", "lineitem"))


@query
def dq_domain(spark, sf_dir):
    """C5"""
    documents = tables.read(spark, sf_dir, "documents")
    return quality.domain(documents, "lang", ["en", "fr"], "documents").unionByName(
        quality.domain(tables.assets(spark, sf_dir), "asset_type", schemas.ASSET_TYPES, "assets")
    )


@query
def dq_length(spark, sf_dir):
    """C6"""
    return quality.max_length(
        tables.read(spark, sf_dir, "documents"), "text", schemas.FILE_NAME_LIMIT, "documents"
    ).unionByName(quality.max_length(tables.read(spark, sf_dir, "pages"), "url", schemas.TAG_NAME_LIMIT, "pages"))


@query
def dq_shape(spark, sf_dir):
    """C7"""
    rules = quality.record_shape(["click", "view", "error"])
    return quality.shape(tables.event_records(spark, sf_dir), "event_id", rules)


@query
def dq_catalog(spark, sf_dir):
    """C1 to C6 over all catalog tables."""
    return quality.check_tables({
        "assets": tables.assets(spark, sf_dir),
        "asset_dimensions": tables.dimensions(spark, sf_dir),
        "tags": tables.tags(spark, sf_dir),
        "asset_tags": tables.links(spark, sf_dir),
        "asset_metadata": tables.metadata(spark, sf_dir),
    })


@query
def dq_incremental(spark, sf_dir):
    """C1 to C6 kept up: early assets go and late ones come, and all but toxic ones lose a second row of dimensions."""
    assets, dimensions = tables.assets(spark, sf_dir), tables.dimensions(spark, sf_dir)
    came, gone = F.lit(1).alias("sign"), F.lit(-1).alias("sign")
    late, early = F.col("created_at") >= F.lit(tables.OLD_UNTIL), F.col("created_at") < F.lit(tables.NEW_FROM)
    kept = quality_upkeep.KeptReport(spark, fresh_path(spark, "report"), tables.catalog_rules())
    kept.apply({
        "assets": assets.where(~late).select("*", came),
        "asset_dimensions": dimensions.unionByName(dimensions).select("*", came),
        "tags": tables.tags(spark, sf_dir).select("*", came),
        "asset_tags": tables.links(spark, sf_dir).select("*", came),
        "asset_metadata": tables.metadata(spark, sf_dir).select("*", came),
    }, 0)
    kept.fold(0)
    kept.apply({
        "assets": assets.where(early).select("*", gone).unionByName(assets.where(late).select("*", came)),
        "asset_dimensions": dimensions.where("height = 0").select("*", gone),
    }, 1)
    return kept.report()


# --- D: catalog queries -------------------------------------------------------------------------

@query
def asset_details(spark, sf_dir):
    """D1"""
    view = catalog.asset_details(
        tables.assets(spark, sf_dir), tables.dimensions(spark, sf_dir), tables.links(spark, sf_dir),
        tables.tags(spark, sf_dir), tables.metadata(spark, sf_dir),
    )
    return view.select("id", "asset_type", "file_name", "file_path", "file_size", "width", "height", _tag_text(), _k())


@query
def asset_lookup(spark, sf_dir):
    """D2"""
    return catalog.lookup(tables.assets(spark, sf_dir), 99).select("id", "asset_type", "file_name", "file_size")


@query
def asset_lookup_batch(spark, sf_dir):
    """D2 for many ids: every eleventh number, as many as there are parts; some do not exist."""
    ids = tables.read(spark, sf_dir, "part").select((F.col("p_partkey") * 11).alias("id"))
    return catalog.lookup_batch(tables.assets(spark, sf_dir), ids).select(
        "id", F.col("found").cast("int").alias("found"), "asset_type", "file_name"
    )


@query
def page(spark, sf_dir):
    """D3"""
    return _ranked(catalog.page(tables.assets(spark, sf_dir), 200, 100).select("id", "asset_type", "file_name"))


@query
def page_after(spark, sf_dir):
    """D3 by key"""
    return _ranked(catalog.page_after(tables.assets(spark, sf_dir), 700, 100).select("id", "asset_type", "file_name"))


def _substring(spark, sf_dir, text: str, literal: bool = False) -> DataFrame:
    return catalog.substring_search(
        tables.assets(spark, sf_dir), tables.links(spark, sf_dir), tables.tags(spark, sf_dir), text, literal
    ).select("id", "asset_type", "file_name")


@query
def substring_search(spark, sf_dir):
    """D4"""
    return _substring(spark, sf_dir, "ed")


@query
def substring_search_wildcard(spark, sf_dir):
    """D4 with wildcards in the query"""
    return _substring(spark, sf_dir, "R_D b%T")


@query
def substring_batch(spark, sf_dir):
    """D4 for many patterns: pieces of part and nation names, with wildcards, and some at the edge; for each
    pattern what it finds."""
    words = tables.read(spark, sf_dir, "part").select(F.col("p_name").alias("name")).union(
        tables.read(spark, sf_dir, "nation").select("n_name")).union(
        tables.read(spark, sf_dir, "orders").select("o_orderpriority")).where("name IS NOT NULL").distinct()
    pieces = words.select(F.explode(F.array(
        F.expr("substring(name, 3, 4)"), F.expr("concat(substring(name, 1, 2), '%', right(name, 2))"),
        F.expr("concat(substring(name, 1, 3), '_', substring(name, 5))"),
        F.expr("upper(right(name, 5))"), F.lit(""), F.lit("___________"), F.lit("%z%"),
    )).alias("pattern"))
    assets, links, names = tables.assets(spark, sf_dir), tables.links(spark, sf_dir), tables.tags(spark, sf_dir)
    found = substrings.substring_batch(assets, links, names, pieces)
    return found.groupBy("pattern").agg(F.count("id").alias("assets"), F.sum("id").alias("id_sum"), F.min("id").alias("first"))


@query
def substring_search_literal(spark, sf_dir):
    """D4 with wildcards taken literally; only the hyphenated names match."""
    return _substring(spark, sf_dir, "-l", literal=True)


@query
def asset_json(spark, sf_dir):
    """D5"""
    documents = catalog.asset_json(
        tables.assets(spark, sf_dir), tables.dimensions(spark, sf_dir), tables.links(spark, sf_dir),
        tables.tags(spark, sf_dir), tables.metadata(spark, sf_dir),
    )

    def at(path: str) -> Column:
        return F.get_json_object("document", path)

    return documents.select(
        "id", at("$.type").alias("type"), at("$.file_name").alias("file_name"),
        at("$.dimensions.width").cast("long").alias("width"),
        at("$.dimensions.height").cast("long").alias("height"),
        at("$.tags").alias("tags"), at("$.metadata.k").cast("long").alias("k"),
        F.array_join(F.json_object_keys("document"), ",").alias("members"),
        F.array_join(F.json_object_keys(at("$.dimensions")), ",").alias("dimension_members"),
    )


@query
def recent(spark, sf_dir):
    """D6"""
    rows = catalog.recent(tables.messages(_events(spark, sf_dir)), "created_at")
    return _ranked(rows.select("id", _k("payload"), _text("created_at")))


@query
def table_stats(spark, sf_dir):
    """D7"""
    return _ranked(catalog.table_stats({n: tables.read(spark, sf_dir, n) for n in tables.NAMES}))


@query
def metadata_contains(spark, sf_dir):
    """D8"""
    return catalog.metadata_contains(tables.metadata(spark, sf_dir), {"k": 42}).select("asset_id", _k())


# JSON of every kind from one event: member values of other types, nested, repeated, and no JSON.
_EDGES = (
    """'{"k": ' || k || '}'""", """'{"k": "' || k || '"}'""", """'{"k": ' || k || '.70}'""", """'{"k": 1, "k": ' || k || '}'""",
    """'{"tags": ["a", ' || k || ', null], "o": {"k": ' || k || ', "z": null}}'""", """'{"k": null, "big": 12345678901234567890123456789012345678901}'""",
    """'[' || k || ']'""", """'no json ' || k""",
)


def _edges(spark, sf_dir, kinds=_EDGES) -> DataFrame:
    """(asset_id, metadata): for every event a document, its kind by the event's turn."""
    cases = " ".join(f"WHEN {n} THEN {text}" for n, text in enumerate(kinds))
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("asset_id"), _k("props").cast("string").alias("k"),
    ).select("asset_id", F.expr(f"CASE asset_id % {len(kinds)} {cases} END").alias("metadata"))


# Numbers that are equal, nearly equal or long, and a name with quotes.
_NUMBERS = (
    """'{"n": ' || k || '.0000000001}'""", """'{"n": ' || k || '.000}'""", """'{"n": 1234567890123456789012345678901234' || k || '}'""",
    """'{"it''s \\\\"n\\\\"": {"n": ' || k || '}}'""", """'{"n": ' || k || 'e1}'""", """'{"n": -0.0}'""",
)
NUMBERS = (
    {"n": 42}, {"n": 42.0}, {"n": Decimal("42.0000000001")}, {"n": 123456789012345678901234567890123442}, {'it\'s "n"': {"n": 42}}, {"n": 420}, {"n": 0},
)

CONTAINED = (
    {"k": 42}, {"k": "42"}, {"k": 42.7}, {"k": None}, {"o": {"k": 42}}, {"o.z": None}, {"tags": ["a"]}, {"tags": [42, "a"]},
    {"tags": [None]}, {"tags": []}, {"o": {}}, {"k": True}, {"k": {}}, {"tags": {}},
)


@query
def metadata_contains_types(spark, sf_dir):
    """D8 for values of every type, documents that name a member twice, long and nearly equal numbers, and any name"""
    found = [
        catalog.metadata_contains_many(_edges(spark, sf_dir, kinds), tests).select((F.col("test") + first).alias("test"), "asset_id")
        for kinds, tests, first in ((_EDGES, CONTAINED, 0), (_NUMBERS, NUMBERS, len(CONTAINED)))
    ]
    return reduce(DataFrame.unionByName, found)


@query
def asset_json_edge(spark, sf_dir):
    """D5 and C7 over documents of every kind: the stored text, and what is reported as no object."""
    metadata = _edges(spark, sf_dir)
    owners = metadata.select(F.col("asset_id").alias("id"), F.lit("F").alias("asset_type"), F.lit("f").alias("file_name"))
    none = spark.createDataFrame([], "asset_id long, width int, height int, tag_id long, id long, name string")
    documents = catalog.asset_json(
        owners, none.select("asset_id", "width", "height"), none.select("asset_id", "tag_id"), none.select("id", "name"), metadata)
    records = metadata.select(
        "asset_id", F.lit("F").alias("asset_type"), F.lit("f").alias("file_name"), F.lit("p").alias("file_path"), F.lit(1).alias("file_size"),
        F.lit(None).cast("struct<latitude:double,longitude:double>").alias("location"),
        F.lit(None).cast("struct<width:int,height:int>").alias("dimensions"), "metadata",
    )
    reported = quality.shape(records, "asset_id", quality.record_shape(["F"])).withColumnRenamed("asset_id", "id")
    return documents.join(reported, "id", "left").select("id", "document", "field")


@query
def metadata_has_key(spark, sf_dir):
    """D8"""
    return catalog.metadata_has_key(tables.metadata(spark, sf_dir), "k").select("asset_id")


@query
def metadata_keys(spark, sf_dir):
    """D8"""
    return catalog.metadata_keys(tables.metadata(spark, sf_dir))


# --- E: counts ----------------------------------------------------------------------------------

@query
def count_by_type(spark, sf_dir):
    """E1"""
    return counts.count_by_type(tables.assets(spark, sf_dir))


@query
def count_map(spark, sf_dir):
    """E1 as a map"""
    return counts.count_map(tables.assets(spark, sf_dir)).select(F.to_json("counts").alias("counts"))


@query
def count_columns(spark, sf_dir):
    """E2; one kind of the domain has no assets."""
    return counts.count_columns(tables.assets(spark, sf_dir), [*tables.KINDS, "video"]).toDF("f", "o", "p", "video")


@query
def counts_refresh(spark, sf_dir):
    """Refresh twice; readers get the newest version."""
    stored = SnapshotTable(spark, fresh_path(spark, "asset-counts"), schemas.ASSET_COUNTS)
    old, new = tables.snapshots(spark, sf_dir)
    counts.refresh_counts(old, stored)
    counts.refresh_counts(new, stored)
    return stored.read()


@query
def counts_incremental(spark, sf_dir):
    """Counts of the old snapshot moved on by the changes to the new one."""
    old, new = tables.snapshots(spark, sf_dir)
    return counts.apply_count_changes(counts.count_by_type(old), audit.snapshot_changes(old, new, AS_OF))


# --- F: search ----------------------------------------------------------------------------------

@query
def text_index(spark, sf_dir):
    """F1 over whole documents"""
    return search.field_postings(tables.document_texts(spark, sf_dir))


@query
def text_index_english(spark, sf_dir):
    """F1 with stop words and stems"""
    return search.field_postings(tables.document_texts(spark, sf_dir), "english")


@query
def text_index_catalog(spark, sf_dir):
    """F1 over file names and tag names"""
    return search.build_index(tables.assets(spark, sf_dir), tables.links(spark, sf_dir), tables.tags(spark, sf_dir))


@query
def text_index_incremental(spark, sf_dir):
    """F1 kept up by changes: assets come, go and change names, then tags change names and are taken away"""
    tags = materialize(tables.tags(spark, sf_dir), "tags")
    assets = tables.assets(spark, sf_dir).select("id", "file_name", "created_at")
    marked = materialize(
        assets.join(_events(spark, sf_dir).select(F.col("event_id").alias("id"), "event_type"), "id", "left"), "assets")
    in_before = F.col("created_at") < F.lit("1998-01-01").cast("timestamp")
    in_after = ~F.col("event_type").eqNullSafe("error")
    before = assets.where(in_before).select("id", "file_name")
    after = marked.where(in_after).select(
        "id", F.when(F.col("event_type") == "click", "click").otherwise(F.col("file_name")).alias("file_name"))
    renamed = tags.select("id", F.replace("name", F.lit("small"), F.lit("tiny")).alias("name"))
    low = tags.where(F.contains("name", F.lit("low"))).select(F.col("id").alias("tag_id"))
    # Links are made once and written with where their asset is, so that every set of links below is a filter.
    # The semi-join goes below the distinct of the links: one shuffle by asset then serves it and the join.
    marks = marked.groupBy(F.col("id").alias("asset_id")).agg(
        F.max(in_before).alias("old"), F.max(in_after).alias("kept"), F.max(F.col("event_type") == "view").alias("viewed"))
    linked = tables.links(spark, sf_dir).join(marked.select(F.col("id").alias("asset_id")), "asset_id", "left_semi")
    links = materialize(linked.join(marks, "asset_id"), "links")
    pair = ["asset_id", "tag_id"]
    first = links.where("kept").select(*pair)
    dropped = materialize(links.where("kept AND viewed").select(*pair).join(low, "tag_id", "left_semi").select(*pair), "dropped")
    second = materialize(first.join(dropped, pair, "left_anti"), "links")

    none = spark.createDataFrame([], audit.snapshot_changes(tags, tags, AS_OF, table="tags").schema)
    old_links = links.where("old").select(*pair)
    new_links = links.where("kept AND NOT coalesce(old, false)").select(*pair)
    index = index_upkeep.KeptIndex(spark, fresh_path(spark, "kept-index"))
    index.start(before, old_links, tags)
    changes = audit.snapshot_changes(before, after, AS_OF)
    index.apply(1, materialize(index_upkeep.touched(changes, new_links, none, first), "pairs"), after, first, tags)
    tag_changes = audit.snapshot_changes(tags, renamed, AS_OF, table="tags")
    pairs = materialize(index_upkeep.touched(none, dropped, tag_changes, second), "pairs")
    index.apply(2, pairs, after, second, renamed)
    index.apply(2, pairs, after, second, renamed)  # comes again and counts once
    return index.read()


@query
def text_vocabulary(spark, sf_dir):
    """term statistics of the documents"""
    return search.vocabulary(search.field_postings(tables.document_texts(spark, sf_dir)))


WIDE_METRES = 7_000_000.0
ENGLISH_QUERY, ENGLISH_SEARCH = "The ens, ING", "Smalls and the lows"


def _scored(matches: DataFrame) -> DataFrame:
    return matches.withColumn("score", F.round("score", 6))


@query
def text_match(spark, sf_dir):
    """F2 + F3"""
    postings = search.field_postings(tables.document_texts(spark, sf_dir))
    return _scored(search.rank(search.match(postings, "The en, AND of!")))


@query
def text_match_bm25f(spark, sf_dir):
    """F3 with the length-normalised scorer"""
    postings = materialize(search.field_postings(tables.document_texts(spark, sf_dir)), "postings")
    return _scored(search.rank(search.match(postings, "the en and of", scorer="bm25f")))


@query
def text_match_batch(spark, sf_dir):
    """F2 + F3 for many queries: every passage of the benchmark against every document"""
    postings = materialize(search.field_postings(tables.document_texts(spark, sf_dir)), "postings")
    queries = tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return _scored(search.match_batch(postings, queries))


@query
def text_top_batch(spark, sf_dir):
    """F2 + F3: the five best assets for every tag name as a query"""
    assets, links, tags = (f(spark, sf_dir) for f in (tables.assets, tables.links, tables.tags))
    postings = materialize(search.build_index(assets, links, tags), "postings")
    queries = tags.select(F.col("id").alias("query_id"), F.col("name").alias("query"))
    return _scored(top_search.top_batch(postings, queries, 5))


@query
def text_search(spark, sf_dir):
    """F4"""
    assets, links, tags = (f(spark, sf_dir) for f in (tables.assets, tables.links, tables.tags))
    postings = search.build_index(assets, links, tags)
    found = search.search(assets, links, tags, postings, "small LOW")
    return _scored(found).select("id", "file_name", "asset_type", _tag_text(), "score", "rank")


@query
def text_match_english(spark, sf_dir):
    """F2 + F3 with stop words and stems: other forms of a word match it"""
    postings = search.field_postings(tables.document_texts(spark, sf_dir), "english")
    return _scored(search.rank(search.match(postings, ENGLISH_QUERY, "english")))


@query
def text_search_english(spark, sf_dir):
    """F4 with stems, over file names and tags"""
    assets, links, tags = (f(spark, sf_dir) for f in (tables.assets, tables.links, tables.tags))
    postings = search.build_index(assets, links, tags, "english")
    found = search.search(assets, links, tags, postings, ENGLISH_SEARCH, "english")
    return _scored(found).select("id", "file_name", "asset_type", _tag_text(), "score", "rank")


@query
def nearby_radius(spark, sf_dir):
    """F5"""
    near = nearby.nearby(tables.places(spark, sf_dir), tables.CENTRE_LAT, tables.CENTRE_LON, tables.NEAR_METRES)
    return near.select("id", "file_name", F.round("distance", 1).alias("distance"), "rank")


@query
def nearby_batch(spark, sf_dir):
    """F5 for many centres"""
    near = nearby.nearby_join(tables.places(spark, sf_dir), tables.centres(spark, sf_dir), tables.BATCH_METRES)
    return near.select("centre_id", "id", geo.tenths(F.col("distance")).alias("distance"))


@query
def nearby_batch_wide(spark, sf_dir):
    """F5 for many centres at a radius of a quarter of the globe"""
    near = nearby_sphere.nearby_join(tables.places(spark, sf_dir), tables.centres(spark, sf_dir), WIDE_METRES)
    return near.select("centre_id", "id", geo.tenths(F.col("distance")).alias("distance"))


@query
def knn_planar(spark, sf_dir):
    """F6"""
    near = nearby.knn(tables.places(spark, sf_dir), tables.CENTRE_LON, tables.CENTRE_LAT)
    return _ranked(near.withColumn("distance", F.round("distance", 6)))


@query
def knn_haversine(spark, sf_dir):
    """F6 on the sphere"""
    near = nearby.knn(tables.places(spark, sf_dir), tables.CENTRE_LON, tables.CENTRE_LAT, 10, "haversine")
    return _ranked(near.withColumn("distance", F.round("distance", 1)))


@query
def knn_batch(spark, sf_dir):
    """F6 for many centres"""
    near = nearby.knn_join(tables.places(spark, sf_dir), tables.centres(spark, sf_dir), 5)
    return near.withColumn("distance", F.round("distance", 6))


@query
def knn_batch_haversine(spark, sf_dir):
    """F6 for many centres on the sphere"""
    near = nearby_sphere.knn_join(tables.places(spark, sf_dir), tables.centres(spark, sf_dir), 5)
    return near.withColumn("distance", F.round("distance", 1))


# --- G: keyed values with expiry ----------------------------------------------------------------

def _early() -> Column:
    return F.col("write_ts") < F.lit("2024-01-09").cast("timestamp")


def _cached(puts: DataFrame) -> DataFrame:
    """The table as earlier puts left it."""
    return cache.put(cache.entries(puts.limit(0)), puts.where(_early()))


@query
def cache_put(spark, sf_dir):
    """G1"""
    puts = tables.cache_puts(_events(spark, sf_dir))
    table = cache.put(_cached(puts), puts.where(~_early()))
    return table.select("key", _k("value"), _text("expires_at"))


@query
def cache_get(spark, sf_dir):
    """G2"""
    written = cache.entries(tables.cache_puts(_events(spark, sf_dir)))
    keys = tables.cache_gets(_events(spark, sf_dir)).select("key")
    return cache.get(written, keys, AS_OF).select("key", _k("value"))


@query
def cache_get_many(spark, sf_dir):
    """G2 for many (key, time) pairs"""
    got = cache.get_many(tables.cache_puts(_events(spark, sf_dir)), tables.cache_gets(_events(spark, sf_dir)))
    return got.select("get_id", "key", _k("value"))


@query
def cache_purge(spark, sf_dir):
    """G3"""
    puts = tables.cache_puts(_events(spark, sf_dir))
    table = cache.put(_cached(puts), puts.where(~_early() & (F.col("write_ts") <= AS_OF)))
    return cache.purge(table, AS_OF).select("key", _k("value"), _text("expires_at"))


# --- H: work queue ------------------------------------------------------------------------------

@query
def queue_enqueue(spark, sf_dir):
    """H1: conversation turns become messages after the events."""
    turns = tables.read(spark, sf_dir, "conversations")
    payloads = turns.select("conv_id", "turn", F.to_json(F.struct("conv_id", "turn")).alias("payload"))
    new = work_queue.enqueue(tables.messages(_events(spark, sf_dir)), payloads, AS_OF, ["conv_id", "turn"])
    return new.select("id", "status", _text("created_at"),
                      F.get_json_object("payload", "$.conv_id").cast("long").alias("conv_id"),
                      F.get_json_object("payload", "$.turn").cast("long").alias("turn"))


NO_CLAIMS = "id long, payload string, worker int, turn long, batch_id long"


@query
def queue_claim(spark, sf_dir):
    """H2: two rounds of four workers; the second round goes on where the first ended."""
    queue = tables.messages(_events(spark, sf_dir))
    first = materialize(work_queue.claim(queue, spark.createDataFrame([], NO_CLAIMS), 50, 4, 0), "claims")
    second = work_queue.claim(queue, first, 50, 4, 1)
    return first.unionByName(second).select("id", "worker", "turn", "batch_id", _k("payload"))


@query
def queue_status(spark, sf_dir):
    """H2 + H3: backlog after one round"""
    queue = tables.messages(_events(spark, sf_dir))
    claims = work_queue.claim(queue, spark.createDataFrame([], NO_CLAIMS), 50, 4, 0)
    return work_queue.backlog(work_queue.mark_claimed(queue, claims)).select("status", "messages", _text("oldest"))


@query
def queue_backlog(spark, sf_dir):
    """H3"""
    return work_queue.backlog(tables.messages(_events(spark, sf_dir))).select("status", "messages", _text("oldest"))


# --- I: change log ------------------------------------------------------------------------------

def _images(rows: DataFrame) -> DataFrame:
    def member(image: str, name: str) -> Column:
        return F.get_json_object(image, f"$.{name}")

    return rows.select(
        "record_id", "action", "table_name", _text("changed_at"),
        member("old_data", "asset_type").alias("old_type"), member("old_data", "file_size").cast("long").alias("old_size"),
        member("new_data", "asset_type").alias("new_type"), member("new_data", "file_size").cast("long").alias("new_size"),
        *[c for c in ("id",) if c in rows.columns],
    )


@query
def audit_diff(spark, sf_dir):
    """I1"""
    return _images(audit.snapshot_changes(*tables.snapshots(spark, sf_dir), AS_OF))


@query
def audit_feed(spark, sf_dir):
    """I1 in feed mode: every common record counts as updated, changed or not."""
    old, new = tables.snapshots(spark, sf_dir)
    feed = old.select("id", F.struct(*old.columns).alias("old")).join(
        new.select("id", F.struct(*new.columns).alias("new")), "id", "full_outer"
    )
    return _images(audit.feed_changes(feed, AS_OF))


def _log(spark, sf_dir) -> DataFrame:
    """All inserts of the old snapshot, then the changes to the new one."""
    old, new = tables.snapshots(spark, sf_dir)
    empty = spark.createDataFrame([], schemas.AUDIT_LOG)
    first = audit.append_log(empty, audit.snapshot_changes(old.limit(0), old, F.lit("2024-01-01")))
    return first.unionByName(audit.append_log(first, audit.snapshot_changes(old, new, AS_OF)))


@query
def audit_log(spark, sf_dir):
    """I1 with log ids"""
    return _images(_log(spark, sf_dir))


@query
def audit_tail(spark, sf_dir):
    """I2"""
    return _ranked(_images(catalog.recent(_log(spark, sf_dir))))


@query
def audit_replay(spark, sf_dir):
    """The state before the second batch of changes"""
    old, _ = tables.snapshots(spark, sf_dir)
    return audit.replay(_log(spark, sf_dir), F.lit("2024-01-10").cast("timestamp"), old.schema)


@query
def audit_replay_now(spark, sf_dir):
    """The state after all changes"""
    old, _ = tables.snapshots(spark, sf_dir)
    return audit.replay(_log(spark, sf_dir), AS_OF, old.schema)


@query
def audit_replay_many(spark, sf_dir):
    """I3 for many (record, time) pairs: events write the row of their user, views delete it; each event
    asks for the user after its own as of 36 hours before."""
    events = _events(spark, sf_dir)
    log = events.select(
        F.col("event_id").alias("id"), F.lit("users").alias("table_name"), F.col("user_id").alias("record_id"),
        F.when(F.col("event_type") == "view", "DELETE").otherwise("UPDATE").alias("action"), F.lit(None).cast("string").alias("old_data"),
        F.when(F.col("event_type") != "view", F.col("props")).alias("new_data"), F.col("ts").cast("timestamp").alias("changed_at"),
        F.lit("spark").alias("changed_by"),
    )
    kept = history.History(spark, fresh_path(spark, "history"), width=86_400)
    kept.append(log, 0)
    span = kept.log().agg(F.min("period"), F.max("period")).first()
    for period in range(span[0] + 7, span[1] + 1, 7) if span[0] is not None else ():
        kept.seal(period)
    asked = events.select(
        "event_id", (F.col("user_id") + 1).alias("record_id"), (F.col("ts").cast("timestamp") - F.expr("INTERVAL 36 HOURS")).alias("at"),
    )
    found = kept.as_of(asked, "record_id", "at")
    return found.select("event_id", "record_id", F.get_json_object("image", "$.k").cast("long").alias("k"), F.col("image").isNotNull().alias("there"))


# --- streaming forms ----------------------------------------------------------------------------

for _stream in (streams.stream_counts, streams.stream_cache, streams.stream_queue, streams.stream_audit, streams.stream_audit_rows):
    query(_stream)
