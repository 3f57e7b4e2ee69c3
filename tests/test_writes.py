"""A, B and C: loads, merges and constraint reports."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lumencat import schemas
from lumencat.operators import ingest, merge, ordered, quality
from tests.catalog_rows import BARE, rows
from tests.catalog_rows import catalog as make

NOW = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def c(spark):
    return make(spark)


def test_ranks_are_dense_over_many_parts(spark):
    values = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("v"))
    ranked = ordered.rank_rows(values, ["v"], "n", start=10)
    assert [r.n for r in ranked.orderBy("v").collect()] == list(range(11, 5011))


@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_carry_forward_matches_a_loop(spark, hot):
    rng = random.Random(3)
    data = [
        ("hot" if rng.random() < hot else f"k{rng.randrange(40)}", i, rng.choice([None, None, i])) for i in range(3000)
    ]
    want, last = set(), {}
    for key, at, value in data:
        last[key] = value if value is not None else last.get(key)
        want.add((key, at, last[key]))
    df = spark.createDataFrame(data, "key string, at int, value int").repartition(6)
    got = ordered.carry_forward(df, "key", ["at"], "value", "found")
    assert {(r.key, r.at, r.found) for r in got.collect()} == want


def test_insert_assets_continues_ids_and_defaults_times(c, spark):
    new = spark.createDataFrame([("video", "b", "/b", 2), ("image", "a", "/a", 1)], "asset_type string, file_name string, file_path string, file_size long")
    made = ingest.insert_assets(c.assets, new, NOW, ["file_name"])
    assert made.columns == c.assets.columns
    assert rows(made, "id", "file_name") == [(6, "a"), (7, "b")]
    assert made.where((F.col("created_at") == F.lit(NOW)) & F.col("lon").isNull()).count() == 2


def test_ingest_fans_out(c, spark):
    records = spark.createDataFrame([
        ("image", "n1", "/n1", 5, (48.0, 11.0), (10, 20), ["nature", "new", "new", None], '{"a":1}'),
        ("video", "n2", "/n2", 6, None, None, [], None),
        ("video", "n3", "/n3", 7, (95.0, 11.0), None, None, None),
    ], schemas.ASSET_RECORDS)
    made = ingest.ingest(records, c.assets, c.tags, NOW, ["file_name"])
    assert rows(made["assets"], "id", "lon", "lat") == [(6, 11.0, 48.0), (7, None, None), (8, None, None)]
    assert rows(made["asset_dimensions"]) == [(6, 10, 20)]
    assert rows(made["tags"]) == [(8, "new")]
    assert rows(made["asset_tags"]) == [(6, 1), (6, 8)]
    assert rows(made["asset_metadata"]) == [(6, '{"a":1}')]


def test_add_tags_twice_changes_nothing(c, spark):
    asked = spark.createDataFrame([(1, "nature"), (1, "fresh"), (1, "fresh"), (99, "lost"), (2, "fresh")], "asset_id long, name string")
    once = merge.add_tags(c.assets, c.tags, c.links, asked)
    assert rows(once["created"]) == [(8, "fresh")]
    assert rows(once["inserted"]) == [(1, 8), (2, 8)]
    assert rows(once["rejected"]) == [(99, "lost")]
    again = merge.add_tags(c.assets, once["tags"], once["links"], asked)
    assert rows(again["tags"]) == rows(once["tags"]) and rows(again["links"]) == rows(once["links"])
    assert rows(again["inserted"]) == []


def test_patches(c, spark):
    p = spark.createDataFrame([
        (1, 1, ["file_name", "lon"], "first", None, 5.0),
        (1, 2, ["file_name"], "second", 9, None),
        (2, 1, ["lon"], "ignored", 9, None),
        (3, 1, [], None, None, None),
        (99, 1, ["file_name"], "nobody", None, None),
    ], "id long, seq long, set_fields array<string>, file_name string, file_size long, lon double")
    after = merge.patch(c.assets, p, NOW, ["file_name", "file_size", "lon"])
    got = {r.id: r for r in after.withColumn("touched", F.col("updated_at") == F.lit(NOW)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert (got[1].file_name, got[1].lon, got[1].file_size) == ("second", 5.0, 2048000)
    assert (got[2].file_name, got[2].lon) == ("mountain1.png", None)
    assert got[3].file_name == "interview1.mp4"
    assert [got[i].touched for i in (1, 2, 3, 4, 5)] == [True, True, True, False, False]


def test_delete_returns_rows_and_respects_children(c, spark):
    ids = spark.createDataFrame([(1,), (99,)], "id long")
    kept, deleted = merge.delete(c.assets, ids)
    assert rows(kept, "id") == [(2,), (3,), (4,), (5,)] and rows(deleted, "id") == [(1,)]
    more = make(spark, BARE)
    done = merge.delete_restricted(
        more.assets, more.assets.select("id").where("id IN (1, 6)"),
        [(c.links, "asset_id"), (c.dimensions, "asset_id"), (c.metadata, "asset_id")],
    )
    assert rows(done["deleted"], "id") == [(6,)] and rows(done["blocked"], "id") == [(1,)]
    assert done["kept"].count() == 5


def test_upsert_is_idempotent(spark):
    schema = "key string, value int, ts int"
    state = spark.createDataFrame([("a", 1, 1), ("b", 1, 5)], schema)
    writes = spark.createDataFrame([("a", 2, 3), ("a", 9, 2), ("b", 7, 4), ("c", 3, 1)], schema)
    once = merge.upsert_latest(state, writes, ["key"], ["ts"])
    assert rows(once) == [("a", 2, 3), ("b", 1, 5), ("c", 3, 1)]
    assert rows(merge.upsert_latest(once, writes, ["key"], ["ts"])) == rows(once)


def test_constraints(c, spark):
    bad = c.assets.union(c.assets.where("id = 1").withColumn("asset_type", F.lit("audio"))).withColumn(
        "file_path", F.when(F.col("id") == 2, F.repeat(F.lit("x"), 256)).when(F.col("id") != 3, F.col("file_path"))
    )
    tables = {
        "assets": bad, "asset_dimensions": c.dimensions.union(spark.sql("SELECT 77L, 1, 1")),
        "tags": c.tags.union(spark.sql("SELECT 8L, 'beach'")), "asset_tags": c.links.union(c.links.where("tag_id = 7")),
        "asset_metadata": c.metadata,
    }
    report = rows(quality.check_tables(tables), "table_name", "rule", "columns", "value", "row_count")
    assert report == sorted([
        ("assets", "primary_key", "id", "1", 2), ("assets", "domain", "asset_type", "audio", 1),
        ("assets", "not_null", "file_path", None, 1), ("assets", "max_length", "file_path", "256", 1),
        ("asset_dimensions", "foreign_key", "asset_id", "77", 1), ("tags", "unique", "name", "beach", 2),
        ("asset_tags", "primary_key", "asset_id,tag_id", "1,7", 2),
    ], key=repr)


def test_row_rules_equal_the_single_checks(c):
    rules = schemas.TableRules(
        c.assets.schema, ("id",), not_null=("file_name", "lon"), domains={"asset_type": ("image",)}, lengths={"file_name": 11}
    )
    df = make(c.assets.sparkSession, BARE).assets
    single = quality.not_null(df, ["id", "file_name", "lon"], "t").unionByName(
        quality.domain(df, "asset_type", ["image"], "t")
    ).unionByName(quality.max_length(df, "file_name", 11, "t"))
    assert rows(quality.row_rules(df, rules, "t")) == rows(single) != []


def test_record_shape(spark):
    records = spark.createDataFrame([
        ("image", "f", "/f", 1, (1.0, 2.0), (1, 2), [], '{"a": 1}'), ("image", "f", "/f", 1, None, None, None, None),
        ("audio", "f", None, 1, (91.0, 2.0), (1, None), [], "[1]"), (None, "f", "/f", 1, (1.0, None), None, [], "{x"),
    ], schemas.ASSET_RECORDS).withColumn("n", F.expr("CASE WHEN asset_type = 'audio' THEN 3 WHEN asset_type IS NULL THEN 4 ELSE 1 END"))
    broken = quality.shape(records, "n", quality.record_shape(schemas.ASSET_TYPES))
    assert rows(broken) == sorted([
        (3, "asset_type"), (3, "file_path"), (3, "location"), (3, "dimensions"), (3, "metadata"),
        (4, "asset_type"), (4, "location"), (4, "metadata"),
    ], key=repr)


def test_half_a_dimension_is_rejected(spark):
    """A patch may not leave width without height; the row stays as it was and the patch is reported."""
    side = spark.createDataFrame([(1, 10, 20), (2, 30, 40), (3, 50, 60)], "asset_id long, width int, height int")
    owners = spark.createDataFrame([(n,) for n in range(1, 7)], "id long")
    patches = spark.createDataFrame([
        (1, 1, ["width"], None, None), (2, 1, ["width", "height"], None, None), (3, 1, ["height"], None, 61),
        (4, 1, ["height"], None, 5), (5, 1, ["width"], 7, None), (5, 2, ["height"], None, 8), (9, 1, ["width"], 1, None),
    ], "id long, seq long, set_fields array<string>, width int, height int")
    kept, rejected = merge.patch_side(side, owners, patches, ["width", "height"])
    assert sorted(map(tuple, kept.collect())) == [(1, 10, 20), (3, 50, 61), (5, 7, 8)]
    assert sorted(map(tuple, rejected.collect())) == [(1, None, 20), (4, None, 5)]
