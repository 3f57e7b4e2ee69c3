from __future__ import annotations

import numpy as np
import pytest

from lumencat.llm import shards


@pytest.mark.parametrize("n", [1, 2, 3, 10, 24, 99, 1000, 65_537])
def test_permutation(n):
    x = shards.permute(np.arange(n), n)
    assert sorted(x.tolist()) == list(range(n))
    assert (x == np.concatenate([shards.permute(np.arange(n)[k::3], n) for k in range(3)])[np.argsort(np.concatenate([np.arange(n)[k::3] for k in range(3)]))]).all()
    if n > 50:
        assert (x != shards.permute(np.arange(n), n, seed=1)).mean() > 0.9
        assert abs(np.corrcoef(x, np.arange(n))[0, 1]) < 0.3


def test_shards_are_even_and_gapless(spark, odd_docs, no_docs, tmp_path):
    for rows, n in ((spark.range(1000).withColumnRenamed("id", "doc_id"), 1000), (odd_docs, 11)):
        placed = shards.assign(rows, rows.columns, shards=7)
        assert placed.columns == [*(c for c in rows.columns if c != "slot"), "shard", "slot"]
        got = [(r[-2], r[-1]) for r in placed.collect()]
        assert len(got) == n == len(set(got))
        sizes = [sorted(s for k, s in got if k == shard) for shard in range(7)]
        assert all(s == list(range(len(s))) for s in sizes)
        assert max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert shards.assign(no_docs, ["doc_id"]).collect() == []
    path = f"{tmp_path}/out"
    shards.write(shards.assign(spark.range(100).withColumnRenamed("id", "doc_id"), ["doc_id"], shards=3), path)
    assert spark.read.parquet(path).groupBy("shard").count().count() == 3
