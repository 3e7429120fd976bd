"""Running totals, exact quantiles and cut points over a global order.

A window without a partition key would put the whole table into one task. Here the cells,
already grouped by value, are range-partitioned into slices, the slices are totalled, and each
slice runs its own window on top of the total of the slices before it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, shuffle_width

_SLICE = "_slice"


def prefix_totals(
    cells: DataFrame,
    order: Sequence[str],
    measures: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    with_next: bool = False,
    with_totals: bool = False,
) -> DataFrame:
    """Add ``<measure>_upto``: the total of ``measure`` up to and including this row.

    ``cells`` has one row per ``(by, order)``. Slice numbers must not change between the two
    uses of the sliced table, so that table is written once. ``with_next`` also adds
    ``<order>_next``, the first order column of the following row (ascending order only),
    and ``with_totals`` the total of every measure over its ``by`` as ``<measure>_total``.
    """
    by, order = list(by), list(order)
    direction = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    width = shuffle_width(cells.sparkSession)
    sliced = cells.repartitionByRange(width, *[F.col(c) for c in by], *direction)
    sliced = materialise(sliced.withColumn(_SLICE, F.spark_partition_id()), "slices")

    totals = sliced.groupBy(_SLICE, *by).agg(
        F.min(order[0]).alias("_first"), *[F.sum(m).alias(m) for m in measures]
    )
    group = Window.partitionBy(*(by or [F.lit(0)]))
    slices = group.orderBy(_SLICE)
    earlier = slices.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        _SLICE,
        *by,
        F.lead("_first").over(slices).alias("_next_first"),
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_{m}_before") for m in measures],
        *[F.sum(m).over(group).alias(f"{m}_total") for m in measures if with_totals],
    )
    inside = Window.partitionBy(_SLICE, *by).orderBy(*direction)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {f"{m}_upto": F.col(f"_{m}_before") + F.sum(m).over(so_far) for m in measures}
    if with_next:
        added[f"{order[0]}_next"] = F.coalesce(F.lead(order[0]).over(inside), F.col("_next_first"))
    running = sliced.join(offsets, [_SLICE, *by]).withColumns(added)
    return running.drop(_SLICE, "_next_first", *[f"_{m}_before" for m in measures])


def value_cells(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by, feature, value, n)``: how often each known value of each column occurs."""
    typed = df.select(*by, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    long = typed.unpivot(list(by), list(columns), "feature", "value").where(F.col("value").isNotNull())
    # -0.0 and 0.0 are one value
    long = long.withColumn("value", F.col("value") + F.lit(0.0))
    return long.groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("n"))


# Rank error of the sketch that brackets a quantile, and columns sketched together.
_ACCURACY, _SKETCH_COLUMNS = 1000, 100


def _brackets(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> list[tuple]:
    """``(feature, p, lo, hi, count)``: an interval sure to hold each quantile.

    The sketch errs by at most n / accuracy ranks; the interval is three times as wide on
    either side. A few numbers per column come to the driver. Columns go in groups, each
    group being read once, so that no task holds hundreds of sketches.
    """
    margin = 3.0 / _ACCURACY
    asked = [q for p in probabilities for q in (max(0.0, p - margin), min(1.0, p + margin))]
    wanted = "array(" + ", ".join(f"{q!r}D" for q in asked) + ")"
    found = []
    for start in range(0, len(columns), _SKETCH_COLUMNS):
        chunk = columns[start : start + _SKETCH_COLUMNS]
        measures = []
        for i, c in enumerate(chunk):
            x = f"CAST(`{c}` AS DOUBLE)"
            measures += [f"count({x}) AS n{i}", f"percentile_approx({x}, {wanted}, {_ACCURACY}) AS q{i}"]
        row = df.selectExpr(*measures).first()
        for i, c in enumerate(chunk):
            n = row[f"n{i}"]
            for k in range(len(probabilities) if n else 0):
                # the ends have no neighbour, and of few values the margin spans too few ranks
                lo_known = asked[2 * k] > 0 and n > 2 * _ACCURACY
                hi_known = asked[2 * k + 1] < 1 and n > 2 * _ACCURACY
                lo = row[f"q{i}"][2 * k] if lo_known else -math.inf
                hi = row[f"q{i}"][2 * k + 1] if hi_known else math.inf
                found.append((c, k, lo, hi, n))
    return found


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """``(feature, count, q0, q1, ...)``: quantiles by linear interpolation, NULLs left out.

    ``percentile`` would gather every distinct value of a column in one task. Here a sketch
    brackets each quantile, values below the bracket are only counted, and just the cells
    inside it, under two percent of a column of distinct values, are ordered.
    """
    spark = df.sparkSession
    columns = list(columns)
    rows = _brackets(df, columns, probabilities)
    layout = "feature string, k int, lo double, hi double, count long"
    brackets = spark.createDataFrame(rows, layout)
    if not rows:
        empty = ", ".join(f"CAST(NULL AS DOUBLE) AS q{k}" for k in range(len(probabilities)))
        return brackets.selectExpr("feature", "count", empty)

    below, near = [], {}
    for c, k, lo, hi, _ in rows:
        x = f"CAST(`{c}` AS DOUBLE)"
        below.append(f"count_if({x} < {_double(lo)}) AS `{c}#{k}`")
        near.setdefault(c, []).append(f"{x} BETWEEN {_double(lo)} AND {_double(hi)}")
    # values outside every bracket of their column become NULL before the table is made long
    kept = df.selectExpr(*[f"CASE WHEN {' OR '.join(t)} THEN CAST(`{c}` AS DOUBLE) END AS `{c}`" for c, t in near.items()])
    cells = value_cells(kept, list(near)).join(brackets, "feature")
    inside = cells.where(F.col("value").between(F.col("lo"), F.col("hi"))).select("feature", "k", "value", "n")
    running = prefix_totals(inside, ["value"], ["n"], ["feature", "k"])

    names = [f"`{c}#{k}`" for c, k, *_ in rows]
    outside = df.selectExpr(*below).unpivot([], names, "name", "below")
    outside = outside.select(
        F.regexp_extract("name", "^(.*)#", 1).alias("feature"),
        F.regexp_extract("name", "#([0-9]+)$", 1).cast("int").alias("k"),
        "below",
    )
    p = F.get(F.array(*[F.lit(float(q)) for q in probabilities]), F.col("k"))
    placed = running.join(brackets.join(outside, ["feature", "k"]), ["feature", "k"])
    placed = placed.withColumn("at", (F.col("count") - 1) * p)
    upto = F.col("below") + F.col("n_upto")
    before = upto - F.col("n")

    def value_at(rank):
        return F.max(F.when((before <= rank) & (rank < upto), F.col("value")))

    found = placed.groupBy("feature", "k").agg(
        F.max("count").alias("count"),
        F.max("at").alias("at"),
        value_at(F.floor("at")).alias("lo"),
        value_at(F.ceil("at")).alias("hi"),
    )
    missed = F.raise_error(F.lit("a quantile lies outside its bracket"))
    lo, hi = F.coalesce("lo", missed), F.coalesce("hi", missed)
    step = F.when(lo == hi, F.lit(0.0)).otherwise((hi - lo) * (F.col("at") - F.floor("at")))
    exact = found.select("feature", "k", "count", (lo + step).alias("q"))
    picks = [F.max(F.when(F.col("k") == k, F.col("q"))).alias(f"q{k}") for k in range(len(probabilities))]
    return exact.groupBy("feature").agg(F.max("count").alias("count"), *picks)


def _double(x: float) -> str:
    return f"double('{x}')" if math.isinf(x) else f"{x!r}D"


# Above this many rows the first n are found by a cut point instead of in one task.
_TOP_IN_ONE_TASK = 100_000


def first_rows(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows along ``keys``, which together are unique."""
    if n <= _TOP_IN_ONE_TASK:
        return df.orderBy(*keys).limit(n)
    cut = cut_rows(df.select(*keys), keys, {None: [n]}).get((None, n))
    if cut is None:
        return df
    # lexicographic comparison: equal on the keys before, smaller on this one
    within = F.lit(True)
    for key, value in reversed(list(zip(keys, cut, strict=True))):
        within = (F.col(key) < F.lit(value)) | ((F.col(key) == F.lit(value)) & within)
    return df.where(within)


def cut_rows(
    df: DataFrame, order: Sequence[str], ranks: dict[object, Sequence[int]], by: str | None = None
) -> dict[tuple[object, int], tuple]:
    """The values of ``order`` at the given 1-based ranks, per value of ``by``.

    The caller names a handful of ranks, so what comes to the driver is that handful.
    Only the ordering columns are shuffled, never the table that is to be cut.
    """
    group = [by] if by else []
    cells = df.groupBy(*group, *order).agg(F.count(F.lit(1)).alias("n"))
    running = prefix_totals(cells, order, ["n"], group)
    wanted = F.lit(False)
    for value, positions in ranks.items():
        for rank in positions:
            hit = (F.col("n_upto") - F.col("n") < rank) & (F.lit(rank) <= F.col("n_upto"))
            wanted = wanted | (hit & F.col(by).eqNullSafe(F.lit(value)) if by else hit)
    rows = running.where(wanted).select(*group, *order, "n", "n_upto").collect()
    cuts: dict[tuple[object, int], tuple] = {}
    for value, positions in ranks.items():
        for rank in positions:
            for row in rows:
                if (not by or row[by] == value) and row["n_upto"] - row["n"] < rank <= row["n_upto"]:
                    cuts[(value, rank)] = tuple(row[c] for c in order)
    return cuts
