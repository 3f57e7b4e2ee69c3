"""Reproducible shuffle into shards by a Feistel permutation of row numbers (operator 4).

Rows are numbered from 0 in key order over all of the table. A Feistel network on pairs (number div
b, number mod b) permutes a domain just larger than the table; what falls outside is sent through
again until it falls inside (cycle walking). The permuted number gives shard (mod shards) and slot
(div shards), so shards differ by a row at most, and both follow from number, count and seed alone.

Defined cases: null and empty texts are rows like others; rows that share a key are numbered by the
rest of the row and stay all; a null key comes first; an empty table gives no rows; other columns
are kept, but for those named shard or slot.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lumencat.llm.textvec import mix
from lumencat.operators.ordered import rank_rows

SHARDS, SEED, ROUNDS = 24, 20_240_101, 8


def permute(x: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """The place of each of ``x`` in a permutation of 0 .. n - 1."""
    x = x.astype(np.uint64)
    if n <= 1:
        return x
    a = int(np.ceil(np.sqrt(n)))
    b = -(-n // a)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    open_ = np.arange(len(x))
    while len(open_):
        left, right = x[open_] // np.uint64(b), x[open_] % np.uint64(b)
        for k, key in enumerate(keys):
            if k % 2:
                right = (right + mix(left ^ key) % np.uint64(b)) % np.uint64(b)
            else:
                left = (left + mix(right ^ key) % np.uint64(a)) % np.uint64(a)
        x[open_] = left * np.uint64(b) + right
        open_ = open_[x[open_] >= n]
    return x


def assign(rows: DataFrame, order: Sequence[Column | str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with shard and slot (gapless from 0 in each shard), in place of columns so named."""
    ranked = rank_rows(rows, order, "_number")
    n = ranked.count()

    @F.pandas_udf("long")
    def place(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy() - 1, n, seed).astype(np.int64))

    placed = ranked.withColumn("_place", place("_number"))
    return placed.select(
        *rows.drop("shard", "slot").columns,
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.floor(F.col("_place") / shards).alias("slot"),
    )


def write(assigned: DataFrame, path: str, parts: int = 1) -> None:
    """Write a folder ``shard=<n>`` per shard in slot order, each from ``parts`` tasks."""
    spread = assigned.repartitionByRange("shard", "slot") if parts > 1 else assigned.repartition("shard")
    spread.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
