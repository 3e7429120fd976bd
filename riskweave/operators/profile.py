"""Column profiles. Each is one or two passes of plain aggregates, whatever the width."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import boolean_columns, fractional_columns, numeric_columns, quoted, text_columns
from .moments import pair_correlation
from .ordered import exact_quantiles

_HIGH_SHARE = 0.99


def column_report(df: DataFrame, measures: dict[str, str], value: str) -> DataFrame:
    """One SQL aggregate per column of ``df``, returned as rows ``(column, value)``."""
    if not measures:
        return df.sparkSession.createDataFrame([], f"column string, {quoted(value)} double")
    wide = df.selectExpr(*[f"{m} AS {quoted(c)}" for c, m in measures.items()])
    return wide.unpivot([], list(map(quoted, measures)), "column", value)


def inf_to_null(df: DataFrame) -> DataFrame:
    fractional = set(fractional_columns(df))
    return df.selectExpr(
        *[
            f"CASE WHEN abs({quoted(c)}) < double('inf') THEN {quoted(c)} END AS {quoted(c)}" if c in fractional else quoted(c)
            for c in df.columns
        ]
    )


def count_inf(df: DataFrame) -> DataFrame:
    cells = [f"count_if(abs({quoted(c)}) = double('inf'))" for c in fractional_columns(df)]
    return df.selectExpr(f"{' + '.join(['0L', *cells])} AS n_inf")


def bool_to_int(df: DataFrame) -> DataFrame:
    flags = set(boolean_columns(df))
    return df.selectExpr(
        *[f"CAST({quoted(c)} AS INT) AS {quoted(c)}" if c in flags else quoted(c) for c in df.columns]
    )


def null_ratio(df: DataFrame, columns: Sequence[str] | None = None, top: int | None = None) -> DataFrame:
    """``(column, null_ratio)``, highest first.

    The report comes from a single aggregated row, so it sits in one partition already and is
    ordered there.
    """
    columns = list(columns if columns is not None else df.columns)
    shares = {c: f"(count(1) - count({quoted(c)})) / nullif(count(1), 0)" for c in columns}
    report = column_report(df, shares, "null_ratio")
    report = report.coalesce(1).sortWithinPartitions(F.col("null_ratio").desc(), "column")
    return report.limit(top) if top else report


def _null_cells(df: DataFrame) -> str:
    """SQL for the number of NULL cells of the table."""
    known = " + ".join(["0L", *[f"count({quoted(c)})" for c in df.columns]])
    return f"count(1) * {len(df.columns)}L - ({known})"


def null_count_total(df: DataFrame) -> DataFrame:
    return df.selectExpr(f"{_null_cells(df)} AS n_null")


def nonnull_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns if columns is not None else df.columns)
    return column_report(df, {c: f"count({quoted(c)})" for c in columns}, "n_known")


def select_high_missing(df: DataFrame, threshold: float = _HIGH_SHARE) -> DataFrame:
    return null_ratio(df).where(F.col("null_ratio") > threshold)


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with at most one distinct value, NULL counting as a value."""
    tests = {}
    for c in df.columns:
        x = quoted(c)
        tests[c] = f"min({x}) <=> max({x}) AND count({x}) IN (0, count(1))"
    return column_report(df, tests, "is_constant").where("is_constant").select("column")


def quasi_constant_columns(df: DataFrame, threshold: float = _HIGH_SHARE) -> DataFrame:
    """``(column, top_share)`` where one value, NULL included, exceeds ``threshold``.

    A value holding most of a column cannot be missed by a frequent-items sketch of 128
    counters, so the sketch names one candidate per column and a second pass counts it
    exactly. No value is shuffled.
    """
    if not 0.5 <= threshold < 1:
        raise ValueError("threshold must lie in [0.5, 1)")
    sketches = [F.expr(f"approx_top_k({quoted(c)}, 1, 128)").alias(f"c{i}") for i, c in enumerate(df.columns)]
    sketched = df.agg(*sketches).first()
    candidates = {c: sketched[i][0]["item"] for i, c in enumerate(df.columns) if sketched[i]}
    names = list(candidates)
    counted = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(quoted(c)).eqNullSafe(F.lit(candidates[c]))).alias(f"k{i}") for i, c in enumerate(names)],
    )
    shares = counted.selectExpr(*[f"k{i} / nullif(n, 0) AS {quoted(c)}" for i, c in enumerate(names)])
    return shares.unpivot([], list(map(quoted, names)), "column", "top_share").where(F.col("top_share") > threshold)


def distinct_values(df: DataFrame, columns: Sequence[str] | None = None, top: int = 20) -> DataFrame:
    """The first ``top`` distinct values of each text column, in value order."""
    columns = list(columns if columns is not None else text_columns(df))
    long = df.select(*[F.col(quoted(c)).cast("string").alias(c) for c in columns])
    values = long.unpivot([], columns, "column", "value").distinct()
    ranked = values.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy("value")))
    return ranked.where(F.col("rank") <= top)


def value_counts_norm(df: DataFrame, column: str) -> DataFrame:
    """``(column, n, share)`` per known value."""
    known = df.where(F.col(quoted(column)).isNotNull())
    counts = known.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def default_rate(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Share, number of positives and row count, overall or per value of ``by``."""
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(
        F.avg(label).alias("default_rate"),
        F.sum(label).cast("long").alias("n_default"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(feature, count, mean, std, min, p25, p50, p75, max)`` over the known values."""
    columns = list(columns if columns is not None else numeric_columns(df))
    quantiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).select(
        "feature", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75")
    )

    def stats(c: str) -> Column:
        x = F.col(quoted(c)).cast("double")
        return F.struct(
            F.count(x).alias("count"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
        )

    report = df.agg(*[stats(c).alias(c) for c in columns]).unpivot([], columns, "feature", "s")
    return report.select("feature", "s.*").join(quantiles, "feature", "left")


def target_corr(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, r)`` against the label for numeric and boolean columns, pairwise complete."""
    if columns is None:
        columns = [c for c in numeric_columns(df) + boolean_columns(df) if c != target]
    names = F.array(*[F.lit(c) for c in columns])
    r = pair_correlation(bool_to_int(df), [*columns, target], target)
    return r.where(F.col("i") != F.col("j")).select(F.get(names, F.col("i")).alias("column"), "r")


def suspicious_missing(
    df: DataFrame, target: str, null_threshold: float = _HIGH_SHARE, r_threshold: float = 0.8
) -> DataFrame:
    """Nearly empty columns that still follow the label closely: a sign of leakage."""
    empty = select_high_missing(df, null_threshold)
    related = target_corr(df, target).where(F.abs("r") > r_threshold)
    return empty.join(related, "column")


def shape_report(df: DataFrame) -> DataFrame:
    """Rows, columns and NULL cells of a table."""
    return df.selectExpr("count(1) AS n_rows", f"{len(df.columns)} AS n_columns", f"{_null_cells(df)} AS n_null")
