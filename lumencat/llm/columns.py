"""Keep the columns of a caller apart from those an operator adds, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def apart(docs: DataFrame, needed: list[str]) -> DataFrame:
    """All columns of ``docs`` as one struct ``row``, and beside it the ``needed`` ones."""
    own = F.struct(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(docs.columns)])
    return docs.select(own.alias("row"), *[F.col(f"`{c}`") for c in needed])


def together(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, from the struct ``row``."""
    return df.select([F.col(f"row.c{n}").alias(c) for n, c in enumerate(docs.columns)])
