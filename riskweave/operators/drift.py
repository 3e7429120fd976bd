"""Distribution change between a reference and a current slice of the same table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import quoted
from ..functions.numeric import chi_square_tail, guarded_ratio
from ..session import materialise
from .brackets import Bracket, bracketed, could_cross, could_hold_the_gap, open_cells
from .ordered import prefix_totals
from .profile import default_rate

REFERENCE, CURRENT = "reference", "current"
# Thresholds of the report.
MIN_VALUES = 10
DRIFT_AT, STRONG_AT = 0.1, 0.2
P_VALUE_AT = 0.05
STABLE_BELOW, RETRAIN_ABOVE = 0.20, 0.30


_SPANS = "feature string, number int, cell int, lo double, hi double, base_r long, base_q long, n_ref long, n_cur long"


def _open_spans(spark, group: Sequence[str], brackets: list[Bracket]) -> DataFrame:
    """The open intervals of a group: their ends (null where there is none) and the counts before them."""
    rows = []
    for i, (name, b) in enumerate(zip(group, brackets, strict=True)):
        n_ref, n_cur = (int(x) for x in b.sizes())
        before = np.concatenate([[0.0], np.cumsum(b.counts[:, 0])]), np.concatenate([[0.0], np.cumsum(b.counts[:, 1])])
        for k in np.flatnonzero(b.open):
            lo = float(b.cuts[k - 1]) if k else None
            hi = float(b.cuts[k]) if k < len(b.cuts) else None
            rows.append((name, i, int(k), lo, hi, int(before[0][k]), int(before[1][k]), n_ref, n_cur))
    return spark.createDataFrame(rows, _SPANS)


def _enough(b: Bracket) -> bool:
    """Features with ten known values or fewer on either side are left out."""
    return bool((b.sizes() > MIN_VALUES).all())


def _placed(table: DataFrame, spans: DataFrame, brackets: list[Bracket]) -> DataFrame:
    """Values of open intervals with both distribution functions at each and the value that follows in its interval."""
    cells = open_cells(table, brackets).withColumnRenamed("feature", "number")
    running = prefix_totals(cells, ["value"], ["r", "q"], ["number", "cell"], with_next=True)
    joined = running.join(spans, ["number", "cell"])
    return joined.withColumns(
        {
            "f_ref": (F.col("base_r") + F.col("r_upto")) / F.col("n_ref"),
            "f_cur": (F.col("base_q") + F.col("q_upto")) / F.col("n_cur"),
        }
    )


def ks_two_sample(df: DataFrame, features: Sequence[str], slice_col: str = "slice") -> DataFrame:
    """``(feature, n_ref, n_cur, ks)``: largest gap between the two distribution functions, exact.

    Only values in intervals that could hold it are shuffled; the gaps at the ends of the others are known.
    """
    spark, known, parts = df.sparkSession, [], []
    for group, table, brackets in bracketed(df, features, slice_col, REFERENCE, CURRENT, could_hold_the_gap):
        for b in brackets:
            b.open &= _enough(b)
        for name, b in zip(group, brackets, strict=True):
            if _enough(b):
                ref, cur = b.shares()
                known.append((name, *(int(x) for x in b.sizes()), float(np.abs(ref - cur).max())))
        if any(b.open.any() for b in brackets):
            placed = _placed(table, _open_spans(spark, group, brackets), brackets)
            parts.append(placed.select("feature", "n_ref", "n_cur", F.abs(F.col("f_ref") - F.col("f_cur")).alias("ks")))
    found = reduce(DataFrame.unionByName, parts, spark.createDataFrame(known, "feature string, n_ref long, n_cur long, ks double"))
    return found.groupBy("feature").agg(F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"), F.max("ks").alias("ks"))


def ks_p_value(ks: Column, n_ref: Column, n_cur: Column, terms: int = 20) -> Column:
    """Asymptotic Kolmogorov p-value, for the report only."""
    en = F.sqrt(n_ref.cast("double") * n_cur / (n_ref + n_cur))
    x = en * ks
    total = F.lit(0.0)
    for k in range(1, terms + 1):
        total = total + F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * x * x)
    # the series needs ever more terms towards zero, where the value is 1
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def _settled_area(b: Bracket) -> float:
    """Area between the functions over the intervals in which one stays above the other."""
    ref, cur = b.shares()
    n_ref, n_cur = b.sizes()
    closed = np.flatnonzero(~b.open[1:-1]) + 1  # those with two ends
    width = b.cuts[closed] - b.cuts[closed - 1]
    n = b.counts[closed]
    under_ref = ref[closed] * width + (n[:, 0] * b.cuts[closed] - n[:, 2]) / n_ref
    under_cur = cur[closed] * width + (n[:, 1] * b.cuts[closed] - n[:, 3]) / n_cur
    return float(np.abs(under_ref - under_cur).sum())


def wasserstein(df: DataFrame, features: Sequence[str], slice_col: str = "slice") -> DataFrame:
    """``(feature, distance)``: area between the two distribution functions.

    Where one function stays above the other, the area follows from counts and totals of whole intervals. In those where
    they could cross, the functions stay flat from one value to the next, so the area is a sum of rectangles.
    """
    spark, known, parts = df.sparkSession, [], []
    for group, table, brackets in bracketed(df, features, slice_col, REFERENCE, CURRENT, could_cross):
        for b in brackets:
            b.open &= _enough(b)
        known += [(name, _settled_area(b)) for name, b in zip(group, brackets, strict=True) if _enough(b)]
        if not any(b.open.any() for b in brackets):
            continue
        spans = _open_spans(spark, group, brackets)
        placed = _placed(table, spans, brackets)
        # from the last value of an interval to its end, and from its start to the first
        follows = F.coalesce("value_next", "hi", "value") - F.col("value")
        parts.append(placed.select("feature", (F.abs(F.col("f_ref") - F.col("f_cur")) * follows).alias("distance")))
        firsts = placed.groupBy("number", "cell").agg(F.min("value").alias("value"))
        gap = F.abs(F.col("base_r") / F.col("n_ref") - F.col("base_q") / F.col("n_cur"))
        parts.append(
            firsts.join(spans.where("lo IS NOT NULL"), ["number", "cell"]).select(
                "feature", (gap * (F.col("value") - F.col("lo"))).alias("distance")
            )
        )
    found = reduce(DataFrame.unionByName, parts, spark.createDataFrame(known, "feature string, distance double"))
    return found.groupBy("feature").agg(F.sum("distance").alias("distance"))


def chi_square_drift(df: DataFrame, column: str, slice_col: str = "slice") -> DataFrame:
    """``(feature, chi2, dof)`` over the known categories of one column."""
    known = df.where(F.col(quoted(column)).isNotNull())
    observed = known.groupBy(F.col(quoted(column)).alias("category")).agg(
        F.count_if(F.col(slice_col) == REFERENCE).alias("o_ref"),
        F.count_if(F.col(slice_col) == CURRENT).alias("o_cur"),
    )
    size = observed.agg(F.sum("o_ref").alias("r"), F.sum("o_cur").alias("c"))
    r, c = size.select("r").scalar(), size.select("c").scalar()
    row = F.col("o_ref") + F.col("o_cur")
    e_ref, e_cur = row * r / F.nullif(r + c, F.lit(0)), row * c / F.nullif(r + c, F.lit(0))

    def part(o: str, e: Column) -> Column:
        return guarded_ratio((F.col(o) - e) * (F.col(o) - e), e)

    parts = observed.select((part("o_ref", e_ref) + part("o_cur", e_cur)).alias("x"))
    return parts.agg(
        F.lit(column).alias("feature"), F.sum("x").alias("chi2"), (F.count(F.lit(1)) - 1).alias("dof")
    )


def chi_square_report(df: DataFrame, columns: Sequence[str], slice_col: str = "slice") -> DataFrame:
    """``(feature, chi2, dof, p_value, drifted)`` of all given categorical columns, from one pass over ``df``.

    A column of one known category has p-value 1; one that is unknown throughout a slice has no statistic.
    """
    typed = df.select(F.col(quoted(slice_col)).alias("side"), *[F.col(quoted(c)).cast("string").alias(c) for c in columns])
    long = typed.unpivot(["side"], [F.col(quoted(c)) for c in columns], "feature", "category").where("category IS NOT NULL")
    observed = long.groupBy("feature", "category").agg(
        F.count_if(F.col("side") == REFERENCE).alias("o_ref"), F.count_if(F.col("side") == CURRENT).alias("o_cur")
    )
    observed = materialise(observed.where("o_ref + o_cur > 0"), "categories")
    sizes = observed.groupBy("feature").agg(F.sum("o_ref").alias("r"), F.sum("o_cur").alias("c"))
    row, whole = F.col("o_ref") + F.col("o_cur"), F.col("r") + F.col("c")

    def part(o: str, size: str) -> Column:
        expected = row * F.col(size) / whole
        return guarded_ratio((F.col(o) - expected) * (F.col(o) - expected), expected)

    parts = observed.join(sizes, "feature").withColumn("x", part("o_ref", "r") + part("o_cur", "c"))
    totals = parts.groupBy("feature").agg(F.sum("x").alias("chi2"), (F.count(F.lit(1)) - 1).alias("dof"))
    tested = totals.withColumn("p_value", chi_square_tail(F.col("chi2"), F.col("dof")))
    return tested.withColumn("drifted", (F.col("p_value") < P_VALUE_AT).cast("int"))


def drift_flag(ks: Column | str = "ks") -> Column:
    k = F.col(ks) if isinstance(ks, str) else ks
    return (k >= F.lit(DRIFT_AT)).cast("int")


def drift_band(ks: Column | str = "ks") -> Column:
    k = F.col(ks) if isinstance(ks, str) else ks
    return F.when(k >= STRONG_AT, F.lit("strong")).when(k >= DRIFT_AT, F.lit("moderate")).otherwise(F.lit("none"))


def drift_report(ks: DataFrame) -> DataFrame:
    return ks.withColumns(
        {
            "drifted": drift_flag(),
            "band": drift_band(),
            "p_value": ks_p_value(F.col("ks"), F.col("n_ref"), F.col("n_cur")),
        }
    )


def drift_summary(report: DataFrame) -> DataFrame:
    """Drifted features, all features, their share and the verdict."""
    counted = report.agg(
        F.coalesce(F.sum("drifted"), F.lit(0)).cast("long").alias("n_drifted"), F.count(F.lit(1)).alias("n_features")
    )
    share = guarded_ratio(F.col("n_drifted"), F.col("n_features"), 0.0)
    verdict = (
        F.when(share < STABLE_BELOW, F.lit("stable"))
        .when(share > RETRAIN_ABOVE, F.lit("retrain"))
        .otherwise(F.lit("watch"))
    )
    return counted.withColumns({"share": share, "verdict": verdict})


def label_drift(df: DataFrame, label: str, slice_col: str = "slice") -> DataFrame:
    """Default rate of both slices and its change."""
    rates = default_rate(df, label, slice_col)

    def on(name: str) -> Column:
        return F.max(F.when(F.col(slice_col) == name, F.col("default_rate")))

    pair = rates.agg(on(REFERENCE).alias("rate_reference"), on(CURRENT).alias("rate_current"))
    return pair.withColumn("rate_change", F.col("rate_current") - F.col("rate_reference"))
