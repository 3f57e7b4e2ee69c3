"""Settings that the queries see to themselves."""

from __future__ import annotations

import pytest

from lumencat import session
from lumencat.plans import tables

NAME = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@pytest.mark.parametrize("given, held", [(None, session.MERGED_TASK_BYTES), ("64MB", session.MERGED_TASK_BYTES), ("16k", 16 << 10)])
def test_tables_bound_what_a_task_is_given(spark, tmp_path, given, held):
    """A larger setting is lowered, a smaller one stays."""
    before = spark.conf.get(NAME, None)
    spark.range(1).write.parquet(f"{tmp_path}/one.parquet")
    try:
        spark.conf.unset(NAME)
        if given:
            spark.conf.set(NAME, given)
        tables.read(spark, str(tmp_path), "one")
        as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
        assert as_bytes(spark.conf.get(NAME)) == held
    finally:
        spark.conf.unset(NAME)
        if before:
            spark.conf.set(NAME, before)
