"""Drift of arriving rows against a fixed reference, per event-time window, as running state.

The stream keeps, as state of a streaming aggregation, how often each value of each feature has occurred in each window.
Every micro-batch writes the counts it changed under its own number; the newest of each are the state of the windows,
open ones included. The reference is read once and counted per value. A report joins the two at any time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import quoted
from ..operators.drift import MIN_VALUES, drift_flag
from ..operators.ordered import prefix_totals, value_cells
from ..session import materialise
from .logs import LATE_BY, run_latest

WINDOW = ["window_start", "window_end"]


def window_values(rows: DataFrame, features: Sequence[str], time: str, width: str = "1 hour", late_by: str = LATE_BY) -> DataFrame:
    """``(window_start, window_end, feature, value, n)`` of the known values, of a stream or a table.

    Rows later than the watermark are dropped; counts of a window are let go when it has passed.
    """
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(quoted(c)).cast("double").alias("value")) for c in features]
    long = rows.withWatermark(time, late_by).select(F.col(quoted(time)).alias("at"), F.explode(F.array(*pairs)).alias("x"))
    # -0.0 and 0.0 are one value
    known = long.select("at", "x.feature", (F.col("x.value") + F.lit(0.0)).alias("value")).where("value IS NOT NULL")
    counted = known.groupBy(F.window("at", width).alias("w"), "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "feature", "value", "n")


def reference_values(reference: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(feature, value, n)``, counted once and written."""
    return materialise(value_cells(reference, features), "reference")


def window_drift(values: DataFrame, reference: DataFrame) -> DataFrame:
    """``(window_start, window_end, feature, n_ref, n_cur, ks, drifted)`` from the value counts of windows and reference.

    The largest gap of the two distribution functions lies at, or just before, a value of the window. So the reference
    is totalled once over all values, and each window only looks its own values up. As in the batch test,
    features with ten known values or fewer on either side are left out.
    """
    points = reference.select("feature", "value", "n").unionByName(values.select("feature", "value", F.lit(0).cast("long").alias("n")))
    points = points.groupBy("feature", "value").agg(F.sum("n").alias("r"))
    upto = prefix_totals(points, ["value"], ["r"], ["feature"], with_totals=True)
    own = prefix_totals(values.withColumnRenamed("n", "q"), ["value"], ["q"], [*WINDOW, "feature"], with_totals=True)

    def gap(r, q):
        return F.abs(r / F.col("r_total") - q / F.col("q_total"))

    at, before = gap(F.col("r_upto"), F.col("q_upto")), gap(F.col("r_upto") - F.col("r"), F.col("q_upto") - F.col("q"))
    joined = own.join(upto, ["feature", "value"]).where((F.col("r_total") > MIN_VALUES) & (F.col("q_total") > MIN_VALUES))
    found = joined.groupBy(*WINDOW, "feature").agg(
        F.max("r_total").alias("n_ref"), F.max("q_total").alias("n_cur"), F.max(F.greatest(at, before)).alias("ks")
    )
    return found.withColumn("drifted", drift_flag())


def stream_drift(
    rows: DataFrame,
    reference: DataFrame,
    features: Sequence[str],
    path: str,
    time: str = "timestamp",
    width: str = "1 hour",
    late_by: str = LATE_BY,
    checkpoint: str | None = None,
) -> DataFrame:
    """Take in what has arrived and report the drift of every window so far.

    With the ``checkpoint`` and ``path`` of an earlier call the windows go on from there; a batch that is replayed
    overwrites its own counts. ``reference`` may be the output of ``reference_values``, so that it is counted once for all calls.
    """
    counted = reference if set(reference.columns) == {"feature", "value", "n"} else reference_values(reference, features)
    values = run_latest(window_values(rows, features, time, width, late_by), [*WINDOW, "feature", "value"], path, checkpoint)
    return window_drift(values, counted)
