"""Pairwise correlation of many columns, and the choice of columns to drop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import numeric_columns
from ..session import materialise
from .moments import pair_correlation


def corr_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(i, j, column_i, column_j, r)`` for all pairs i < j, each over its own known rows."""
    columns = list(columns if columns is not None else numeric_columns(df))
    if len(columns) < 2:
        raise ValueError("correlation needs two columns")
    names = F.array(*[F.lit(c) for c in columns])
    return pair_correlation(df, columns).select(
        "i",
        "j",
        F.get(names, F.col("i")).alias("column_i"),
        F.get(names, F.col("j")).alias("column_j"),
        "r",
    )


def high_corr_columns(pairs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Columns correlated above ``threshold`` with some column before them."""
    return pairs.where(F.abs("r") > threshold).select(F.col("column_j").alias("column")).distinct()


def corr_prune(pairs: DataFrame, target_r: DataFrame, threshold: float = 0.9) -> DataFrame:
    """From every pair above ``threshold`` the column less correlated with the label.

    On a tie, or where a label correlation is unknown, the earlier column goes. Columns
    already dropped keep competing, so the result does not depend on any order.
    ``target_r`` has ``(column, r)``, one row per column.
    """
    strength = target_r.select("column", F.abs("r").alias("strength"))
    close = pairs.where(F.abs("r") > threshold).select("column_i", "column_j")
    i, j = (strength.select(F.col("column").alias(f"column_{k}"), F.col("strength").alias(f"s_{k}")) for k in "ij")
    judged = close.join(i, "column_i", "left").join(j, "column_j", "left")
    later_is_weaker = F.coalesce(F.col("s_j") < F.col("s_i"), F.lit(False))
    loser = F.when(later_is_weaker, F.col("column_j")).otherwise(F.col("column_i"))
    return judged.select(loser.alias("column")).distinct()


def prune_correlated(df: DataFrame, target: str, threshold: float = 0.9) -> DataFrame:
    """``(column)`` to drop from ``df``; label and ids take part like any number.

    The correlations with the label are among the pairs. The pairs are written once, as three
    joins read them.
    """
    pairs = materialise(corr_pairs(df), "pairs")
    with_label = pairs.where(F.col("column_i") == target).select(F.col("column_j").alias("column"), "r")
    with_label = with_label.unionByName(
        pairs.where(F.col("column_j") == target).select(F.col("column_i").alias("column"), "r")
    )
    label = df.sparkSession.createDataFrame([(target, 1.0)], "column string, r double")
    return corr_prune(pairs, with_label.unionByName(label), threshold)


def top_corr_features(target_r: DataFrame, n: int = 15, present: DataFrame | None = None) -> DataFrame:
    """The ``n`` columns most correlated with the label, then only those still present."""
    ranked = target_r.where(F.col("r").isNotNull()).orderBy(F.abs("r").desc(), "column").limit(n)
    return ranked if present is None else ranked.join(present, "column", "left_semi")


def top_bottom(target_r: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` lowest and the ``n`` highest correlations, tagged with their end."""
    known = target_r.where(F.col("r").isNotNull())
    low = known.orderBy(F.col("r"), "column").limit(n).withColumn("end", F.lit("low"))
    high = known.orderBy(F.col("r").desc(), F.col("column").desc()).limit(n).withColumn("end", F.lit("high"))
    return low.unionByName(high)
