"""The best k of many queries against ranking all matches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window, functions as F

from lumencat.operators import search, top_search

POSTINGS = "id long, weight string, term string, tf long"


@pytest.fixture(scope="module")
def postings(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        for term, share in (("common", 1.0), ("half", 0.5), ("rare", 0.1), ("single", 0.01)):
            for weight in "AB":
                if rng.random() < share:
                    rows.append((i, weight, term, rng.choice([1, 1, 1, 2, 9])))
    return spark.createDataFrame(rows, POSTINGS)


QUERIES = ["common", "common half", "rare common", "single", "rare half common", "absent common", "", "half common common", None]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_equals_ranking_all_matches(spark, postings, k):
    queries = spark.createDataFrame([(n, q) for n, q in enumerate(QUERIES)], "query_id long, query string")
    everything = search.match_batch(postings, queries)
    order = Window.partitionBy("query_id").orderBy(F.round("score", search.DIGITS).desc(), "id")
    want = everything.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def rows(df):
        return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect())

    got = rows(top_search.top_batch(postings, queries, k, ahead=1 if k == 3 else 4))
    assert got == rows(want) and {r[0] for r in got} == {0, 1, 2, 3, 4, 7}


def test_bounds_stop_candidates(spark):
    """Ten documents are far better than 5,000 others: only those few are looked up at all."""
    n = F.col("id")
    both = spark.range(5010).select("id", F.when(n < 10, 50).otherwise(1).cast("long").alias("tf"))
    impacts = both.crossJoin(spark.createDataFrame([("a",), ("b",)], "term string")).select("id", "term", (n * 0 + F.col("tf") / (F.col("tf") + 1.0)).alias("impact"))
    impacts = impacts.where("term = 'a' OR id < 10 OR impact < 0.6")
    words = spark.createDataFrame([(1, "a"), (1, "b")], "query_id long, term string")
    candidates = top_search.starts(impacts, words)
    first = top_search._best(candidates, [F.desc("bound"), "id"], 20).drop("place")
    scored = top_search._scored(first, impacts)
    assert candidates.count() == 5010 and first.count() == 20
    assert top_search.still_open(candidates, first, scored, 5).count() == 0
    # Beyond what is good, every candidate may count and is looked at.
    assert top_search.still_open(candidates, first, scored, 15).count() == 4990


def test_candidates_are_scored_where_they_stand(spark):
    """Common words leave nearly all candidates open: looking each of them up moved all that they hold again."""
    rows = [(n, {t: 1.0 + n % 5 for t in ("a", "b", "c") if n % (ord(t) - 95)}) for n in range(200)]
    impacts = spark.createDataFrame(rows, "id long, impacts map<string,double>").select("id", "impacts", F.explode("impacts").alias("term", "impact"))
    words = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "a"), (3, "c"), (3, "b")], "query_id long, term string")
    candidates = top_search.starts(impacts, words)
    scored = top_search._scored_in_place(candidates)
    assert sorted(map(tuple, scored.collect())) == sorted(map(tuple, top_search._scored(candidates, impacts.drop("impacts")).collect()))
    plain = spark.createDataFrame(candidates.collect(), candidates.schema)
    assert "Exchange" not in top_search._scored_in_place(plain)._jdf.queryExecution().executedPlan().toString()
