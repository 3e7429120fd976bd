"""Ordering, stacking and reshaping of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import quoted


def latest_n(df: DataFrame, time: str, key: str, n: int = 100) -> DataFrame:
    """The ``n`` newest rows, newest first."""
    return df.orderBy(F.col(time).desc(), F.col(key).desc()).limit(n)


def union_slices(parts: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Tables of the same columns stacked, each tagged with its name."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def intersect_columns(a: DataFrame, b: DataFrame, name: str = "column") -> DataFrame:
    """Column names present in both reports."""
    return a.select(name).intersect(b.select(name))


def concat_columns(base: DataFrame, *blocks: DataFrame, key: str) -> DataFrame:
    """Column blocks side by side, matched on a unique key."""
    return reduce(lambda left, right: left.join(right, key, "left"), blocks, base)


def wide_to_long(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``(ids, feature, value)``, missing values kept."""
    typed = df.select(*ids, *[F.col(quoted(c)).cast("double").alias(c) for c in features])
    return typed.unpivot(list(ids), list(features), "feature", "value")
