"""Aggregation, ordering and sampling of columns as thin builders over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.dialect import ordering


def aggregate(df: DataFrame, keys: list[str], having: str | None = None, **measures: str) -> DataFrame:
    """Grouped (or, without keys, ungrouped) aggregates given as SQL expressions; partial sums are Spark's own."""
    out = df.groupBy(*keys).agg(*[F.expr(e).alias(n) for n, e in measures.items()])
    return out.where(having) if having else out


def count_distinct(df: DataFrame, keys: list[str], columns: list[str], name: str) -> DataFrame:
    """Distinct tuples of the columns in each group; a tuple of nulls counts."""
    return df.groupBy(*keys).agg(F.count_distinct(F.struct(*columns)).alias(name))


def order(df: DataFrame, *keys: str) -> DataFrame:
    """Sorted by keys such as ``"price desc"`` or ``"name nulls first"``; nulls last by default in both directions."""
    return df.orderBy(*[_key(k) for k in keys])


def top_n(df: DataFrame, n: int, *keys: str, offset: int = 0) -> DataFrame:
    """The rows at offset..offset+n of that order, which each task cuts before anything is sent."""
    out = order(df, *keys)
    return (out.offset(offset) if offset else out).limit(n)


def _key(text: str) -> Column:
    words = text.lower().split()
    return ordering(text.split()[0], "desc" in words, "first" in words)
