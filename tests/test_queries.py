"""Every registered query against its SQL, and the driver contract."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from tests.compare import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, ORACLE[name]) is None


def test_english_index_equals_stemming_the_simple_one(spark):
    """The index must be the simple one, stemmed word by word."""
    from collections import Counter

    from lumencat.functions import text
    from tests import porter2

    want = Counter()
    for r in QUERIES["text_index"](spark, SF_DIR).toLocalIterator():
        if r.term not in text.ENGLISH_STOP_WORDS:
            want[r.id, r.weight, porter2.stem(r.term)] += r.tf
    got = {(r.id, r.weight, r.term): r.tf for r in QUERIES["text_index_english"](spark, SF_DIR).toLocalIterator()}
    assert got == want


def test_entry(spark):
    assert contract.entry(spark).count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert set(ORACLE) <= set(QUERIES)
