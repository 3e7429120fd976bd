"""Contributions of features to scores, long form ``(key, feature, contribution)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import quoted
from .scoring import linear_terms

# How a contribution is named to the client.
UNFAVOURABLE, FAVOURABLE = "défavorable", "favorable"
MAX_FACTORS = 50


def explain_linear(
    df: DataFrame, keep: Sequence[str], coefficients: Mapping[str, float], means: Mapping[str, float]
) -> DataFrame:
    """``coefficient * (x - mean)`` per row and feature."""
    terms = linear_terms(coefficients, means)
    wide = df.select(*keep, *[t.alias(n) for n, t in terms.items()])
    return wide.unpivot(list(keep), list(terms), "feature", "contribution")


def factor_direction(contribution: Column | str) -> Column:
    v = F.col(contribution) if isinstance(contribution, str) else contribution
    return F.when(v > 0, F.lit(UNFAVOURABLE)).otherwise(F.lit(FAVOURABLE))


def topk_abs(contributions: DataFrame, keys: Sequence[str], n: int = 10) -> DataFrame:
    """Per key the ``n`` features with the largest absolute contribution.

    The rank filter is applied before the shuffle as well, so a key with very many rows
    sends at most ``n`` of them per task.
    """
    if not 1 <= n <= MAX_FACTORS:
        raise ValueError(f"n must lie between 1 and {MAX_FACTORS}")
    w = Window.partitionBy(*keys).orderBy(F.abs("contribution").desc(), "feature")
    return contributions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def named_factors(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rounded contributions with their direction."""
    return ranked.select(
        *keys,
        "rank",
        "feature",
        F.round("contribution", 4).alias("contribution"),
        factor_direction("contribution").alias("direction"),
    )


def factor_arrays(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key with its ranked factors as an array of at most ``MAX_FACTORS``."""
    factor = F.struct("rank", "feature", "contribution", "direction")
    packed = named_factors(ranked, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(factor)).alias("f"))
    without_rank = F.transform(
        "f", lambda x: F.struct(x["feature"].alias("feature"), x["contribution"].alias("contribution"), x["direction"].alias("direction"))
    )
    return packed.select(*keys, without_rank.alias("top_factors"))


def global_importance(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature."""
    return contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))


def grouped_importance(contributions: DataFrame, keys: Sequence[str], groups: Mapping[str, str]) -> DataFrame:
    """As ``global_importance`` with the dummies of one variable added up per row first.

    ``groups`` names the variable of each dummy and comes from the category domain; a mean of
    sums is the sum of means, so nothing has to be grouped per row.
    """
    table = [(f, v) for f, v in groups.items()]
    lookup = contributions.sparkSession.createDataFrame(table, "feature string, variable string")
    named = contributions.join(lookup, "feature", "left")
    per_feature = named.groupBy(F.coalesce("variable", "feature").alias("variable"), "feature").agg(
        F.sum(F.abs("contribution")).alias("total"), F.count(F.lit(1)).alias("rows")
    )
    return per_feature.groupBy("variable").agg(
        F.sum(F.col("total") / F.col("rows")).alias("importance")
    )


def topk_global(df: DataFrame, value: str, name: str, n: int = 20) -> DataFrame:
    """The ``n`` rows with the highest value."""
    return df.orderBy(F.col(quoted(value)).desc(), F.col(quoted(name))).limit(n)


def wide_contributions(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Long form of an array column ``phi`` aligned with ``features``."""
    names = F.array(*[F.lit(f) for f in features])
    pairs = F.explode(F.arrays_zip(names.alias("feature"), F.col("phi").alias("contribution")))
    return df.select(*keys, pairs.alias("p")).select(
        *keys, F.col("p.feature").alias("feature"), F.col("p.contribution").alias("contribution")
    )
