"""Column choice and column naming, decided on the driver from the schema alone."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ID_COL = "SK_ID_CURR"
TARGET_COL = "TARGET"
# Columns that never act as model features.
NON_FEATURES = ("TARGET", "SK_ID_CURR", "SK_ID_BUREAU", "SK_ID_PREV", "index")


def columns_of(df: DataFrame, *kinds: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, T.NumericType)


def text_columns(df: DataFrame) -> list[str]:
    return columns_of(df, T.StringType)


def boolean_columns(df: DataFrame) -> list[str]:
    return columns_of(df, T.BooleanType)


def fractional_columns(df: DataFrame) -> list[str]:
    return columns_of(df, T.FractionalType)


def feature_columns(df: DataFrame, exclude=NON_FEATURES) -> list[str]:
    return [c for c in df.columns if c not in exclude]


def type_counts(df: DataFrame) -> dict[str, int]:
    counts: dict[str, int] = {}
    for field in df.schema.fields:
        name = field.dataType.simpleString()
        counts[name] = counts.get(name, 0) + 1
    return counts


def clean_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]+", "_", name)


def clean_columns(df: DataFrame) -> DataFrame:
    """Model-safe column names; two names that would become one are an error."""
    cleaned = [clean_name(c) for c in df.columns]
    clash = sorted({c for c in cleaned if cleaned.count(c) > 1})
    if clash:
        raise ValueError(f"column names collide after cleaning: {clash}")
    return df.toDF(*cleaned)


def quoted(name: str) -> str:
    """A column reference safe for names with dots, spaces or slashes."""
    return "`" + name.replace("`", "``") + "`"
