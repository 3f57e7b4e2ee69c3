"""F1 kept up by changes: equal to a rebuild, and only what is touched is made into postings again."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from lumencat.operators import audit, index_upkeep, search
from lumencat.operators.index_upkeep import KeptIndex
from lumencat.plans import queries, tables

WORDS = ["red", "green", "small", "running", "cats", "the", "Beach"]
AT = dt.datetime(2024, 1, 1)


def _state(spark, rng, assets, tags, links):
    return (
        spark.createDataFrame(sorted(assets.items()), "id long, file_name string"),
        spark.createDataFrame(sorted(links), "asset_id long, tag_id long"),
        spark.createDataFrame(sorted(tags.items()), "id long, name string"),
    )


def _all(df):
    return sorted(map(tuple, df.select("id", "weight", "term", "tf").collect()))


@pytest.mark.parametrize("config", ["simple", "english"])
def test_equals_a_rebuild_after_every_batch(spark, tmp_path, config):
    rng = random.Random(4)
    name = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(4)))
    assets = {n: name() for n in range(30)}
    tags = {n: name() for n in range(6)}
    links = {(rng.randrange(30), rng.randrange(6)) for _ in range(50)}
    old = _state(spark, rng, assets, tags, links)
    index = KeptIndex(spark, f"{tmp_path}/index")
    index.start(*old, config)
    for version in range(1, 4):
        for n in rng.sample(sorted(assets), 4):
            assets[n] = name()
        del assets[rng.choice(sorted(assets))]
        assets[100 + version] = name()
        tags[rng.randrange(6)] = name()
        before = links
        links = {(a, t) for a, t in links if a in assets and rng.random() > 0.1} | {(100 + version, rng.randrange(6))}
        new = _state(spark, rng, assets, tags, links)
        moved = spark.createDataFrame(sorted(before ^ links), "asset_id long, tag_id long")
        pairs = index_upkeep.touched(
            audit.snapshot_changes(old[0], new[0], AT), moved, audit.snapshot_changes(old[2], new[2], AT, table="tags"), new[1])
        index.apply(version, pairs, *new, config)
        if version == 2:
            index.apply(version, pairs, *new, config)  # a repeated batch
        assert _all(index.read()) == _all(search.build_index(*new, config))
        made = spark.read.parquet(f"{index.root}/postings/version={version}")
        assert {(r.id, r.weight) for r in made.collect()} <= {tuple(r) for r in pairs.collect()}
        assert pairs.count() < 2 * len(assets)
        old = new
    merged = index.merge(f"{tmp_path}/merged")
    assert _all(merged.read()) == _all(index.read())
    assert {r.id for r in search.match(merged.read(), "beach", config).collect()} == {
        r.id for r in search.match(search.build_index(*old, config), "beach", config).collect()}


def test_an_untouched_document_is_not_made_again(spark, tmp_path):
    rows = [(n, f"file {n}") for n in range(50)]
    assets, links, tags = _state(spark, None, dict(rows), {1: "red"}, {(n, 1) for n in range(50)})
    after = assets.selectExpr("id", "if(id = 7, 'other name', file_name) as file_name").where("id != 9")
    none = spark.createDataFrame([], audit.snapshot_changes(tags, tags, AT, table="tags").schema)
    pairs = index_upkeep.touched(audit.snapshot_changes(assets, after, AT), links.limit(0), none, links)
    assert sorted(map(tuple, pairs.collect())) == [(7, "A"), (9, "A"), (9, "B")]
    made = index_upkeep.delta(pairs, after, links, tags)
    assert sorted(map(tuple, made.collect())) == [(7, "A", "name", 1), (7, "A", "other", 1)]


def _counting(spark, df, column):
    """``df``, and a counter of how often a row of it is made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(value):
        made.add(1)
        return value

    return df.withColumn(column, seen.asNondeterministic()(F.col(column))), made


def test_a_version_is_made_once_though_ranges_are_cut_after_a_look_at_it(spark, tmp_path):
    rows = spark.createDataFrame([(n, "A", f"term{n % 7}", 1) for n in range(200)], "id long, weight string, term string, tf long")
    postings, made = _counting(spark, rows, "tf")
    index = KeptIndex(spark, f"{tmp_path}/index")
    index.write(postings, spark.createDataFrame([], "id long, weight string"), 0)
    assert _all(index.read()) == _all(rows)
    assert made.value == 200


def test_the_query_makes_its_links_once(spark, monkeypatch):
    sf_dir = "/root/testdata/sf0.001"
    links = tables.links(spark, sf_dir)
    counted, made = _counting(spark, links, "tag_id")
    monkeypatch.setattr(tables, "links", lambda *_: counted)
    rows = queries.QUERIES["text_index_incremental"](spark, sf_dir)
    assert 0 < made.value <= links.count()
    assert rows.count() > 0
