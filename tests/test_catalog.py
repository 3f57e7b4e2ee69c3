"""D and E on the catalog with known answers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lumencat import schemas
from lumencat.functions.documents import is_json
from lumencat.operators import catalog, counts
from lumencat.plans import queries
from lumencat.sources.storage import SnapshotTable
from tests.catalog_rows import BARE, TAGS, rows
from tests.catalog_rows import catalog as make


@pytest.fixture(scope="module")
def c(spark):
    return make(spark, BARE)


def test_details(c):
    view = {r.id: r for r in catalog.asset_details(c.assets, c.dimensions, c.links, c.tags, c.metadata).collect()}
    assert len(view) == 6
    assert (view[1].tags, view[1].width, view[1].height) == (["landscape", "nature", "sunset"], 1920, 1080)
    assert (view[6].tags, view[6].width, view[6].metadata) == ([], None, None)


def test_repeated_links_do_not_repeat_tags(c):
    assert rows(catalog.tag_names(c.links.union(c.links), c.tags)) == rows(catalog.tag_names(c.links, c.tags))


def test_json_keeps_null_members(c):
    documents = {
        r.id: json.loads(r.document)
        for r in catalog.asset_json(c.assets, c.dimensions, c.links, c.tags, c.metadata).collect()
    }
    assert list(documents[1]) == ["id", "type", "file_name", "dimensions", "tags", "metadata"]
    assert documents[1]["metadata"] == {"iso": 100, "lens": {"zoom": 1}, "owner": None}
    assert documents[6]["dimensions"] == {"width": None, "height": None}
    assert documents[6]["tags"] is None and documents[6]["metadata"] is None
    wanted = c.assets.where("id IN (2, 6)").select("id")
    some = catalog.asset_json(c.assets, c.dimensions, c.links, c.tags, c.metadata, wanted)
    assert {r.id: json.loads(r.document) for r in some.collect()} == {i: documents[i] for i in (2, 6)}


def test_lookup(c, spark):
    assert rows(catalog.lookup(c.assets, 99)) == []
    asked = spark.createDataFrame([(1,), (99,), (1,)], "id long")
    assert rows(catalog.lookup_batch(c.assets, asked), "id", "found") == [(1, True), (99, False)]


def test_pages_cover_the_table_once(c):
    by_offset = [r.id for skip in (0, 4) for r in catalog.page(c.assets, skip, 4).collect()]
    by_key = [r.id for last in (0, 4) for r in catalog.page_after(c.assets, last, 4).collect()]
    assert by_offset == by_key == [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("text, literal, ids", [
    ("sunset", False, [1]), ("IMAGE", False, [1, 2, 4, 6]), ("LAND", False, [1, 2, 4]), ("videos/", False, []),
    ("%_d", True, [6]), ("i%1", False, [2, 3, 5]), ("_", True, [6]), ("", False, [1, 2, 3, 4, 5, 6]),
])
def test_substring_search(c, text, literal, ids):
    found = catalog.substring_search(c.assets, c.links, c.tags, text, literal)
    assert rows(found, "id") == [(i,) for i in ids]


def test_recent_puts_missing_times_first(spark):
    log = spark.sql("SELECT * FROM VALUES (1, 5), (2, NULL), (3, 5), (4, 9) AS t(id, changed_at)")
    assert [r.id for r in catalog.recent(log, n=3).collect()] == [2, 4, 3]


def test_table_stats(c):
    stats = catalog.table_stats({"assets": c.assets, "tags": c.tags, "asset_tags": c.links}).collect()
    assert [tuple(r) for r in stats] == [("asset_tags", 11), ("tags", len(TAGS)), ("assets", 6)]


def test_metadata_predicates(c):
    assert rows(catalog.metadata_contains(c.metadata, {"iso": 300, "lens.zoom": 3}), "asset_id") == [(3,)]
    assert rows(catalog.metadata_contains(c.metadata, {"iso": 300, "lens.zoom": 4}), "asset_id") == []
    assert len(rows(catalog.metadata_has_key(c.metadata, "owner"))) == 5
    assert rows(catalog.metadata_keys(c.metadata)) == [("iso", 5), ("lens", 5), ("owner", 5)]


def test_counts(c, spark):
    known = c.assets.where("id <= 5")
    assert rows(counts.count_by_type(known)) == [("image", 3), ("video", 2)]
    assert counts.count_map(known).first().counts == {"image": 3, "video": 2}
    assert tuple(counts.count_columns(known.where("asset_type = 'image'")).first()) == (3, 0)


def test_refresh_keeps_the_old_version(c, spark, tmp_path):
    stored = SnapshotTable(spark, str(tmp_path / "counts"), schemas.ASSET_COUNTS)
    assert rows(stored.read()) == []
    counts.refresh_counts(c.assets.where("id = 3"), stored)
    before = stored.read()
    counts.refresh_counts(c.assets, stored)
    assert rows(before) == [("video", 1)]
    assert rows(stored.read()) == [("image", 4), ("video", 2)]
    assert stored.current_version() == 1 and stored.current_version(before=1) == 0


def test_json_containment_compares_types(spark):
    texts = ['{"k": 42}', '{"k": "42"}', '{"k": 42.0}', '{"k": 1, "k": 42}', '{"a": [1, {"b": null}]}', "not json", None, '{"k": true}']
    data = spark.createDataFrame(list(enumerate(texts)), "asset_id long, metadata string")

    def found(members):
        return {r.asset_id for r in catalog.metadata_contains(data, members).collect()}

    assert found({"k": 42}) == {0, 2, 3} and found({"k": "42"}) == {1} and found({"k": True}) == {7}
    assert found({"a": [{"b": None}]}) == {4} and found({"a": [1]}) == {4} and found({"a": {"b": None}}) == set()
    assert found({}) == {0, 1, 2, 3, 4, 7} or found({}) == set(range(8))


def test_json_keeps_the_stored_text(c, spark):
    stored = {1: '{"a": 1, "a": 2}', 2: '{"n": 1.0, "big": 12345678901234567890123456789012345678901}', 6: "oops"}
    metadata = spark.createDataFrame(list(stored.items()), "asset_id long, metadata string")
    got = {r.id: r.document for r in catalog.asset_json(c.assets, c.dimensions, c.links, c.tags, metadata).collect()}
    assert got[1].endswith(',"metadata":{"a": 1, "a": 2}}') and got[2].endswith(f',"metadata":{stored[2]}}}') and got[6].endswith(',"metadata":null}')


def test_plans_start_no_job(c, spark):
    """The joins are laid out by the planner; no table is read ahead of the query."""
    tracker, group = spark.sparkContext.statusTracker(), "plan-only"
    spark.sparkContext.setJobGroup(group, group)
    try:
        catalog.asset_details(c.assets, c.dimensions, c.links, c.tags, c.metadata).schema  # noqa: B018
        catalog.asset_json(c.assets, c.dimensions, c.links, c.tags, c.metadata).schema  # noqa: B018
        catalog.substring_search(c.assets, c.links, c.tags, "a").schema  # noqa: B018
        assert not tracker.getJobIdsForGroup(group)
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()


@pytest.mark.parametrize("allowed", ["true", "false"])
def test_the_last_of_repeated_members_counts_in_any_session(spark, allowed):
    setting = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(setting)
    spark.conf.set(setting, allowed)
    try:
        documents = spark.createDataFrame([
            (1, '{"k": 1, "k": 42}'), (2, '{"k": 42, "k": 1}'), (3, '{"o": {"k": 1, "k": 42.70}}'), (4, '{"k": "it\'s", "k": "42"}'),
            (5, '{"tags": [{"a": 1, "a": 2}]}'), (6, "no json"), (7, None), (8, '{"k": 42}'), (9, '{"k": NaN, "k": 42}'),
            (10, '{"k": 1, "k": 12345678901234567890.5}'),
        ], "id long, metadata string")
        found = lambda members: sorted(r.id for r in catalog.metadata_contains(documents, members).collect())
        assert catalog.metadata_contains(documents, {"k": 42}).columns == documents.columns
        assert found({"k": 42}) == [1, 8] and found({"k": 1}) == [2] and found({"k": "42"}) == [4]
        assert found({"o.k": 42.7}) == [3] and found({"tags": [{"a": 2}]}) == [5] and found({"tags": [{"a": 1}]}) == []
        edges = queries._edges(spark, "/root/testdata/sf0.001")
        got = sorted(r.asset_id for r in catalog.metadata_contains(edges, {"k": 42}).collect())
        twice = edges.where("metadata IN ('{\"k\": 42}', '{\"k\": 1, \"k\": 42}')")
        assert got == sorted(r.asset_id for r in twice.collect()) and any(i % 8 == 3 for i in got)
    finally:
        spark.conf.set(setting, before)


@pytest.mark.parametrize("allowed", ["true", "false"])
def test_an_apostrophe_in_a_string_is_json(spark, allowed):
    setting = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(setting)
    spark.conf.set(setting, allowed)
    try:
        texts = ["""{"a": "it's", "a": 2}""", r"""{"a": "\"it's\"", "a": 2}""", """{'a': 1, 'a': 2}""", """{"a": 'x"', "a": 2}"""]
        documents = spark.createDataFrame([(n, x) for n, x in enumerate(texts)], "id long, document string")
        got = {r.id for r in documents.where(is_json(F.col("document"))).collect()}
        assert got == {0, 1}
    finally:
        spark.conf.set(setting, before)


def test_contained_numbers_are_equal_by_value_and_names_are_any(spark):
    documents = spark.createDataFrame([
        (1, '{"k": 42.0000000001}'), (2, '{"k": 42.0}'), (3, '{"k": 123456789012345678901234567890123456}'),
        (4, '{"k": 1000000000000000000000000000000}'), (5, '{"it\'s": 1, "": 2}'), (6, '{"k": 42e0}'), (7, '{"k": -0}'),
        (8, '{"a\\"b\'c": {"d": [1.50]}}'), (9, '{"k": 420}'),
    ], "id long, metadata string")
    found = lambda members: sorted(r.id for r in catalog.metadata_contains(documents, members).collect())
    assert found({"k": 42}) == found({"k": 42.0}) == [2, 6]
    assert found({"k": 42.0000000001}) == [1] and found({"k": 0}) == [7] and found({"k": 420}) == [9]
    assert found({"k": 123456789012345678901234567890123456}) == [3] and found({"k": 10**30}) == [4]
    assert found({"it's": 1}) == found({"": 2}) == [5] and found({"it's": 2}) == []
    assert found({"a\"b'c": {"d": [1.5]}}) == [8]


def test_many_tests_parse_a_document_once(spark, c):
    tests = [{"iso": 300}, {"lens.zoom": 3}, {"iso": 400, "lens": {"zoom": 4}}, {"owner": None}, {}]
    got = catalog.metadata_contains_many(c.metadata, tests)
    assert rows(got, "test", "asset_id") == [(0, 3), (1, 3), (2, 4), *[(n, i) for n in (3, 4) for i in range(1, 6)]]
    assert catalog.metadata_contains_many(c.metadata, []).collect() == []
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.lower().count("parsejson") <= 4
