"""Query registration and the helpers the query modules share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.naming import quoted
from ..session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn(spark, sf_dir)`` under ``name`` with its SQL twin."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame, keys: Sequence[str] = (), digits: int | Callable[[str], int] | None = 4) -> DataFrame:
    """Comparable output: fractions finite and rounded (unless ``digits`` is None), other columns as they are."""
    places = digits if callable(digits) else lambda _: digits
    columns = []
    for field in df.schema.fields:
        c = quoted(field.name)
        if field.name not in keys and isinstance(field.dataType, T.FractionalType):
            finite = f"CASE WHEN abs({c}) < double('inf') THEN {c} END"
            c = f"{finite} AS {c}" if digits is None else f"round({finite}, {places(field.name)}) AS {c}"
        columns.append(c)
    return df.selectExpr(*columns)


def tidy_double(
    df: DataFrame, keys: Sequence[str] = (), digits: int | Callable[[str], int] | None = 4
) -> DataFrame:
    """As ``tidy``, with every numeric column outside ``keys`` as a double."""
    columns = [
        f"CAST({quoted(f.name)} AS DOUBLE) AS {quoted(f.name)}"
        if f.name not in keys and isinstance(f.dataType, (T.NumericType, T.BooleanType))
        else quoted(f.name)
        for f in df.schema.fields
    ]
    return tidy(df.selectExpr(*columns), keys, digits)
