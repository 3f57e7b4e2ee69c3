"""Many patterns at once against ILIKE of each pattern with each asset."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumencat.operators import catalog, substrings
from tests.catalog_rows import catalog as make
from tests.catalog_rows import rows

WILD = ["sun", "SUN", "s_n", "n%t", "%", "_", "", "___", "jpg", ".", "o", "zzz", "\\%", "a\\_b", "\\\\", "e%e%e", "_" * 60, "at", "r_s_", "İ", "日本", "本"]


@pytest.fixture(scope="module")
def c(spark):
    made = make(spark)
    odd = [(101, "a_b 50% Off", "image"), (102, "a\\b", "image"), (103, "İstanbul 日本語.jpg", "video"), (104, "", "image"), (105, None, None)]
    extra = spark.createDataFrame(odd, "id long, file_name string, asset_type string")
    return made, made.assets.select("id", "file_name", "asset_type").union(extra)


@pytest.mark.parametrize("literal", [False, True])
def test_each_pattern_equals_its_own_search(spark, c, literal):
    made, assets = c
    patterns = spark.createDataFrame([(p,) for p in WILD + ["sun", None]], "pattern string")
    links = made.links.union(spark.createDataFrame([(9999, 1)], made.links.schema))
    got = substrings.substring_batch(assets, links, made.tags, patterns, literal=literal)
    want = []
    for p in WILD:
        want += [(p, r.id) for r in catalog.substring_search(assets, links, made.tags, p, literal).select("id").collect()]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_pattern_meets_only_texts_with_its_rarest_gram(spark):
    texts = spark.range(2000).select(F.concat(F.lit("holiday photo "), F.lpad(F.col("id").cast("string"), 5, "0")).alias("text"))
    queries = spark.createDataFrame([("photo 00017",), ("holiday%01999",), ("photo x",), ("day_photo 0000",)], "query string")
    met = {r["query"]: r["n"] for r in substrings.candidates(texts, queries).groupBy("query").agg(F.count("*").alias("n")).collect()}
    all_texts = [r.text for r in texts.collect()]

    def fewest(*runs):
        return min(sum(run[i:i + 3] in text for text in all_texts) for run in runs for i in range(len(run) - 2))

    # A gram that no text holds ends a query at once.
    assert met == {"photo 00017": fewest("photo 00017"), "holiday%01999": fewest("holiday", "01999"), "day_photo 0000": fewest("day", "photo 0000")}
    assert max(met.values()) < 120


def test_nothing_given(spark, c):
    made, assets = c
    patterns = spark.createDataFrame([("sun",)], "p string")
    assert substrings.substring_batch(assets, made.links, made.tags, patterns.limit(0), "p").collect() == []
    assert substrings.substring_batch(assets.limit(0), made.links, made.tags, patterns, "p").collect() == []
    assert rows(substrings.substring_batch(assets, made.links, made.tags, patterns, "p")) != []


def test_what_patterns_find_is_gathered_once(spark, c):
    """Links without an asset go before patterns multiply them, so one sum over (pattern, id) is enough."""
    made, assets = c
    patterns = spark.createDataFrame([("sun",)], "pattern string")
    plan = substrings.substring_batch(assets, made.links, made.tags, patterns)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Aggregate [pattern#" in line and ", id#" in line.split("]")[0] for line in plan.splitlines()) == 1
