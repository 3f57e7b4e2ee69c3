"""Constraint reports (C): one row per violating key or value, with the number of rows behind it.

Every check aggregates before it shuffles, so a key or value shared by much of the table costs one
row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lumencat.functions.documents import json_type
from lumencat.schemas import TABLES, TableRules


def _report(df: DataFrame, rule: str, table: str, columns: str, value: Column, rows: Column) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"), F.lit(table).alias("table_name"), F.lit(columns).alias("columns"),
        value.cast("string").alias("value"), rows.cast("long").alias("row_count"),
    )


def _grouped(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))


def joined_value(columns: Sequence[str]) -> Column:
    """The values of a key as a report shows them."""
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns])


def primary_key(df: DataFrame, columns: Sequence[str], table: str) -> DataFrame:
    """Keys that occur more than once."""
    repeated = _grouped(df, columns).where("__n > 1")
    return _report(repeated, "primary_key", table, ",".join(columns), joined_value(columns), F.col("__n"))


def unique(df: DataFrame, column: str, table: str) -> DataFrame:
    """Values that occur more than once; NULLs are exempt."""
    repeated = _grouped(df.where(F.col(column).isNotNull()), [column]).where("__n > 1")
    return _report(repeated, "unique", table, column, F.col(column), F.col("__n"))


def not_null(df: DataFrame, columns: Sequence[str], table: str) -> DataFrame:
    """One pass over all columns; a row per column that holds NULLs."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"__{i}") for i, c in enumerate(columns)])
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"__{i}").alias("n")) for i, c in enumerate(columns)
    ]))
    found = counts.select(pairs.alias("__p")).where("__p.n > 0")
    return found.select(
        F.lit("not_null").alias("rule"), F.lit(table).alias("table_name"),
        F.col("__p.column").alias("columns"), F.lit(None).cast("string").alias("value"),
        F.col("__p.n").cast("long").alias("row_count"),
    )


def foreign_key(
    df: DataFrame, column: str, parent: DataFrame, parent_column: str, table: str,
) -> DataFrame:
    """C4: child keys without a parent."""
    keys = _grouped(df.where(F.col(column).isNotNull()), [column])
    orphans = keys.join(parent.select(F.col(parent_column).alias(column)), column, "left_anti")
    return _report(orphans, "foreign_key", table, column, F.col(column), F.col("__n"))


def domain(df: DataFrame, column: str, allowed: Sequence[str], table: str) -> DataFrame:
    """Values outside the allowed set; NULL is left to C3."""
    outside = _grouped(df.where(~F.col(column).isin(*allowed)), [column])
    return _report(outside, "domain", table, column, F.col(column), F.col("__n"))


def max_length(df: DataFrame, column: str, limit: int, table: str) -> DataFrame:
    """Number of values longer than ``limit`` characters, per length."""
    long = _grouped(
        df.select(F.char_length(column).alias("__length")).where(F.col("__length") > limit), ["__length"]
    )
    return _report(long, "max_length", table, column, F.col("__length"), F.col("__n"))


def record_shape(asset_types: Sequence[str]) -> dict[str, Column]:
    """C7 rules by field; a rule holds for a record that may be ingested."""
    place, size = F.col("location"), F.col("dimensions")
    return {
        "asset_type": F.coalesce(F.col("asset_type").isin(*asset_types), F.lit(False)),
        "file_name": F.col("file_name").isNotNull(),
        "file_path": F.col("file_path").isNotNull(),
        "file_size": F.col("file_size").isNotNull(),
        "location": place.isNull() | F.coalesce(
            place["latitude"].between(-90, 90) & place["longitude"].between(-180, 180), F.lit(False)
        ),
        "dimensions": size.isNull() | (size["width"].isNotNull() & size["height"].isNotNull()),
        "metadata": F.col("metadata").isNull()
        | F.coalesce(json_type(F.col("metadata")) == "OBJECT", F.lit(False)),
    }


def shape(records: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """(key, field) for every field that breaks its rule; a narrow scan."""
    broken = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))
    return records.select(F.col(key), F.explode(broken).alias("field"))


def broken_rules(rules: TableRules) -> list[tuple[Column, str, str, Column]]:
    """(test, rule, column, value) of every rule that a row breaks by itself: C3, C5 and C6."""
    broken: list[tuple[Column, str, str, Column]] = []
    for name in dict.fromkeys((*rules.primary, *rules.not_null)):
        broken.append((F.col(name).isNull(), "not_null", name, F.lit(None)))
    for name, allowed in rules.domains.items():
        broken.append((~F.col(name).isin(*allowed), "domain", name, F.col(name)))
    for name, limit in rules.lengths.items():
        broken.append((F.char_length(name) > limit, "max_length", name, F.char_length(name)))
    return broken


def row_rules(df: DataFrame, rules: TableRules, table: str) -> DataFrame:
    """C3, C5 and C6 of a table in one pass; rows that keep all rules leave it at once."""
    broken = broken_rules(rules)
    found = F.array_compact(F.array(*[
        F.when(test, F.struct(
            F.lit(rule).alias("rule"), F.lit(name).alias("columns"), value.cast("string").alias("value")
        ))
        for test, rule, name, value in broken
    ]))
    return (
        df.where(reduce(Column.__or__, [test for test, *_ in broken]))
        .select(F.inline(found))
        .groupBy("rule", "columns", "value").agg(F.count(F.lit(1)).alias("row_count"))
        .select("rule", F.lit(table).alias("table_name"), "columns", "value", "row_count")
    )


def check_tables(tables: Mapping[str, DataFrame], rules: Mapping[str, TableRules] = TABLES) -> DataFrame:
    """C1 to C6 for all given tables as one report."""
    parts: list[DataFrame] = []
    for name, df in tables.items():
        rule = rules[name]
        parts.append(primary_key(df, rule.primary, name))
        parts += [unique(df, c, name) for c in rule.unique]
        parts.append(row_rules(df, rule, name))
        parts += [
            foreign_key(df, c, tables[parent], key, name)
            for c, (parent, key) in rule.foreign.items() if parent in tables
        ]
    return reduce(DataFrame.unionByName, parts)
