"""Global order without a single task: ranks, dense ids and last-value-carried-forward.

Rows are range-partitioned and sorted once and written, each with its part number and position.
What crosses part borders is one summary row per part, so the only unpartitioned window runs over
as many rows as there are parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumencat.sources.storage import materialize

_PART, _POS = "__part", "__pos"
_POSITION_BITS = (1 << 33) - 1


def _sorted_parts(df: DataFrame, order: Sequence[Column | str], label: str) -> DataFrame:
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(
        ranged.select(
            "*",
            F.spark_partition_id().alias(_PART),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_BITS)).alias(_POS),
        ),
        label,
    )


def _earlier_parts():
    return Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)


def rank_rows(df: DataFrame, order: Sequence[Column | str], name: str, start: int = 0) -> DataFrame:
    """Add ``name`` = start + 1, start + 2, ... in the total order ``order`` (ties must not occur)."""
    parts = _sorted_parts(df, order, "ranked")
    sizes = parts.groupBy(_PART).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(_PART, F.coalesce(F.sum("__n").over(_earlier_parts()), F.lit(0)).alias("__before"))
    # One row per part: bounded by the partition count, not by the data.
    return (
        parts.join(F.broadcast(before), _PART)
        .withColumn(name, F.col("__before") + F.col(_POS) + F.lit(start + 1))
        .drop(_PART, _POS, "__before")
    )


def next_id(df: DataFrame, column: str = "id") -> int:
    """The highest id in use, 0 for an empty table."""
    return df.agg(F.max(column)).first()[0] or 0


def carry_forward(
    df: DataFrame, key: str, order: Sequence[Column | str], value: str, name: str,
) -> DataFrame:
    """Add ``name`` = the last non-NULL ``value`` of the same key at or before each row.

    A key of any size is cut at part borders; the last value before a border is handed to the next
    part, so no key is ever gathered in one task.
    """
    parts = _sorted_parts(df, [key, *order], "carried")
    last = F.max_by(F.struct(F.col(key).alias("k"), F.col(value).alias("v")), F.when(F.col(value).isNotNull(), F.col(_POS)))
    tails = parts.groupBy(_PART).agg(last.alias("__tail"))
    handed = tails.select(_PART, F.last("__tail", ignorenulls=True).over(_earlier_parts()).alias("__in"))
    seen = Window.partitionBy(_PART, key).orderBy(_POS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inherited = F.when(F.col("__in.k").eqNullSafe(F.col(key)), F.col("__in.v"))
    return (
        parts.join(F.broadcast(handed), _PART)
        .withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(seen), inherited))
        .drop(_PART, _POS, "__in")
    )
