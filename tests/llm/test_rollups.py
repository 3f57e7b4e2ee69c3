from __future__ import annotations

import pytest

from lumencat.llm.rollups import Rollup

CHANGES = "kind string, source string, lang string, tokenizer string, n_tokens long, old_tokens long, docs long"


def _totals(store):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in store.totals().collect()}


def test_batches_count_once(spark, tmp_path):
    store = Rollup(spark, f"{tmp_path}/r")
    assert _totals(store) == {}
    first = spark.createDataFrame([
        ("insert", "a", "en", "v1", 10, None, 9), ("insert", "a", "en", "v1", 5, None, 9), ("insert", None, "en", "v1", 7, None, 9),
        ("insert", "a", "en", "v2", None, None, 9), ("insert", "a", "en", "v1", 10, None, 9),
    ], CHANGES)
    assert store.commit("1", first) and not store.commit("1", first)
    assert not Rollup(spark, f"{tmp_path}/r").commit("1", first)
    want = {("a", "en", "v1"): (3, 25), (None, "en", "v1"): (1, 7), ("a", "en", "v2"): (1, 0)}
    assert _totals(store) == want
    second = spark.createDataFrame([
        ("revise", "a", "en", "v1", 12, 10, 0), ("delete", "a", "en", "v1", 5, None, 0), ("delete", None, "en", "v1", 7, None, 0),
    ], CHANGES)
    assert store.commit("2", second)
    want = {("a", "en", "v1"): (2, 22), ("a", "en", "v2"): (1, 0)}
    assert _totals(store) == want
    store.compact()
    store.compact()
    assert _totals(store) == want and not store.commit("2", second)
    assert store.commit("3", spark.createDataFrame([], CHANGES)) and _totals(store) == want


def test_two_writers_of_one_batch(spark, tmp_path):
    """Both saw no such batch and both published it: one counts."""
    store = Rollup(spark, f"{tmp_path}/r")
    rows = spark.createDataFrame([("a", "en", "v1", 1, 10)], "source string, lang string, tokenizer string, docs long, tokens long")
    store._publish(rows, "1", [])
    store._publish(rows, "1", [])
    assert _totals(store) == {("a", "en", "v1"): (1, 10)}


def test_unknown_kind(spark, tmp_path):
    with pytest.raises(Exception, match="unknown kind"):
        Rollup(spark, f"{tmp_path}/r").commit("1", spark.createDataFrame([("upsert", "a", "en", "v1", 1, None, 0)], CHANGES))


def _batch(spark, n):
    return spark.createDataFrame([("insert", "a", "en", "v1", n, None, 0)], CHANGES)


def test_a_commit_while_compacting(spark, tmp_path):
    """What lands between the reads of a compaction is not in its folder and still counts, once."""
    store = Rollup(spark, f"{tmp_path}/r")
    store.commit("1", _batch(spark, 1))
    store.commit("2", _batch(spark, 2))

    class Slow(Rollup):
        def _sum(self, folders):
            Rollup(spark, self.path).commit("3", _batch(spark, 10))
            return super()._sum(folders)

    Slow(spark, store.path).compact()
    assert _totals(store) == {("a", "en", "v1"): (3, 13)}
    store.compact()
    assert _totals(store) == {("a", "en", "v1"): (3, 13)} and not store.commit("3", _batch(spark, 10))


def test_compactions_that_race(spark, tmp_path):
    store = Rollup(spark, f"{tmp_path}/r")
    for n in (1, 2):
        store.commit(str(n), _batch(spark, n))

    class Twice(Rollup):
        def _sum(self, folders):
            Rollup(spark, self.path).compact()
            return super()._sum(folders)

    Twice(spark, store.path).compact()
    assert _totals(store) == {("a", "en", "v1"): (2, 3)}

    class Later(Rollup):
        """Another batch lands and another compaction covers it before this one is published."""

        def _sum(self, folders):
            other = Rollup(spark, self.path)
            other.commit("4", _batch(spark, 100))
            other.compact()
            return super()._sum(folders)

    store.commit("3", _batch(spark, 10))
    Later(spark, store.path).compact()
    assert _totals(store) == {("a", "en", "v1"): (4, 113)}
    store.compact()
    store.compact()
    assert _totals(store) == {("a", "en", "v1"): (4, 113)}
