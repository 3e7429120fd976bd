"""Categorical encoding: a fit that lists category values, a transform of plain expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import literal
from ..functions.naming import quoted, text_columns

Domain = dict[str, list[str]]

# More distinct values than this cannot sensibly become one column each.
MAX_CATEGORIES = 10_000


def category_domain(df: DataFrame, columns: Sequence[str] | None = None, source: str = "") -> DataFrame:
    """``(source, column, category, n)`` for every value of every text column, NULL included."""
    columns = list(columns if columns is not None else text_columns(df))
    if not columns:
        return df.sparkSession.createDataFrame([], "source string, column string, category string, n long")
    long = df.select(*[F.col(quoted(c)) for c in columns]).unpivot([], columns, "column", "category")
    counted = long.groupBy("column", "category").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.lit(source).alias("source"), "column", "category", "n")


def categorical_catalogue(sources: dict[str, DataFrame]) -> DataFrame:
    """Which columns of each source are categorical; read off the schemas, no data touched."""
    spark = next(iter(sources.values())).sparkSession
    rows = [(name, c) for name, df in sources.items() for c in text_columns(df)]
    return spark.createDataFrame(rows, "source_file string, original_categorical_column string")


def fit_domains(
    sources: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]], max_categories: int = MAX_CATEGORIES
) -> dict[str, Domain]:
    """Sorted category values per text column of several tables, from one job.

    Output columns have to be known before a plan can be made, so the values come to the
    driver; tables with more than ``max_categories`` of them are refused, never cut.
    """
    domains: dict[str, Domain] = {name: {c: [] for c in columns[name]} for name in sources}
    parts = [category_domain(df, columns[name], name) for name, df in sources.items() if columns[name]]
    if not parts:
        return domains
    values = reduce(lambda a, b: a.unionByName(b), parts).where(F.col("category").isNotNull())
    rows = values.select("source", "column", "category").limit(max_categories + 1).collect()
    if len(rows) > max_categories:
        raise ValueError(f"more than {max_categories} category values in {dict(columns)}")
    for row in rows:
        domains[row["source"]][row["column"]].append(row["category"])
    return {name: {c: sorted(v) for c, v in domain.items()} for name, domain in domains.items()}


def fit_domain(
    df: DataFrame, columns: Sequence[str] | None = None, max_categories: int = MAX_CATEGORIES
) -> Domain:
    """Sorted category values per text column of one table."""
    columns = list(columns if columns is not None else text_columns(df))
    return fit_domains({"": df}, {"": columns}, max_categories)[""]


def dummy_tests(domain: Domain, dummy_na: bool) -> dict[str, str]:
    """``{COLUMN_value: SQL condition}``; with ``dummy_na`` also ``COLUMN_nan``."""
    tests: dict[str, str] = {}
    for column, values in domain.items():
        c = quoted(column)
        for value in values:
            tests[f"{column}_{value}"] = f"{c} <=> {literal(value)}"
        if dummy_na:
            tests[f"{column}_nan"] = f"{c} IS NULL"
    return tests


def one_hot(df: DataFrame, domain: Domain | None = None, dummy_na: bool = True) -> DataFrame:
    """Replace each text column by one 0/1 column per fitted value, appended last.

    A value unseen at fit time gives zeros everywhere.
    """
    domain = fit_domain(df) if domain is None else domain
    kept = [quoted(c) for c in df.columns if c not in domain]
    dummies = [f"CAST({t} AS INT) AS {quoted(n)}" for n, t in dummy_tests(domain, dummy_na).items()]
    return df.selectExpr(*kept, *dummies)


def one_hot_encoder(df: DataFrame, dummy_na: bool = True) -> tuple[DataFrame, list[str], list[str]]:
    """The encoded table, the names of the new columns and of the columns they replace."""
    domain = fit_domain(df)
    return one_hot(df, domain, dummy_na), list(dummy_tests(domain, dummy_na)), list(domain)


def category_counts(domain: Domain, dummy_na: bool = True) -> list[Column]:
    """Aggregates counting the rows of each category, named after the dummy.

    Dividing by the group size gives the mean of the dummy without ever storing it.
    """
    return [F.expr(f"count_if({t}) AS {quoted(n)}") for n, t in dummy_tests(domain, dummy_na).items()]


def one_hot_rate(df: DataFrame, key: str, domain: Domain | None = None, dummy_na: bool = True) -> DataFrame:
    """Per key, the share of rows in each category: ``COLUMN_value_MEAN``."""
    domain = fit_domain(df, [c for c in text_columns(df) if c != key]) if domain is None else domain
    counts = category_counts(domain, dummy_na)
    grouped = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), *counts)
    shares = [f"{quoted(n)} / _rows AS {quoted(n + '_MEAN')}" for n in dummy_tests(domain, dummy_na)]
    return grouped.selectExpr(key, *shares)


def fit_labels(
    df: DataFrame, columns: Sequence[str], key: str, max_categories: int = MAX_CATEGORIES
) -> dict[str, list[str]]:
    """Values of each column in order of their lowest key, ties by value.

    A DataFrame has no row order, so "first seen" is taken along the key.
    """
    long = df.select(F.col(key).alias("_key"), *[F.col(quoted(c)) for c in columns]).unpivot(
        ["_key"], list(columns), "column", "category"
    )
    firsts = (
        long.where(F.col("category").isNotNull())
        .groupBy("column", "category")
        .agg(F.min("_key").alias("first_key"))
        .limit(max_categories + 1)
        .collect()
    )
    if len(firsts) > max_categories:
        raise ValueError(f"more than {max_categories} category values in {list(columns)}")
    order = sorted(firsts, key=lambda r: (r["first_key"], r["category"]))
    return {c: [r["category"] for r in order if r["column"] == c] for c in columns}


def label_code(column: str, values: Sequence[str]) -> Column:
    """Position of the value in ``values``; -1 for NULL and for an unknown value."""
    if not values:
        return F.lit(-1)
    codes = F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, i)])
    return F.coalesce(F.try_element_at(codes, F.col(quoted(column))), F.lit(-1))


def label_encode(
    df: DataFrame, columns: Sequence[str], key: str, labels: dict[str, list[str]] | None = None
) -> DataFrame:
    labels = fit_labels(df, columns, key) if labels is None else labels
    return df.withColumns({c: label_code(c, labels[c]) for c in columns})
