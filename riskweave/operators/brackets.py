"""Two distribution functions compared exactly without ordering every value.

Cut points from a sample divide the values of a feature into intervals, whose sizes in both slices are counted exactly. That
fixes the distribution functions at every cut and bounds them in between, so most intervals are settled: they cannot hold
the largest gap, or the functions do not cross in them. Intervals left open are cut again, and at last only the
values inside them are counted one by one and shuffled. The sample decides how much is left open, never the result.

What the driver holds is bounded by CELLS; features go in groups that keep to it, each reading its own columns.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import quoted

# The helpers travel inside the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cut points of a feature in a round: this many times the root of the number of rows, within the bounds.
PER_ROOT, MIN_CUTS, MAX_CUTS = 8, 64, 8192
#: Intervals of all features of a group.
CELLS = 1 << 18
#: Rounds of cutting, and the share of values that may be left open without another.
ROUNDS, LEFT_OPEN = 3, 1 / 32
SEED = 42


@dataclass
class Bracket:
    """Interval i of a feature holds the values above ``cuts[i - 1]`` up to ``cuts[i]``; the last one all above.

    ``counts`` has per interval the values of the reference, of the current slice, and their totals.
    """

    cuts: np.ndarray
    counts: np.ndarray
    open: np.ndarray

    def sizes(self) -> np.ndarray:
        return self.counts[:, :2].sum(0)

    def shares(self) -> tuple[np.ndarray, np.ndarray]:
        """Distribution functions of both slices at the left ends of the intervals and, in the same array, after the last."""
        ref, cur = (np.concatenate([[0.0], np.cumsum(self.counts[:, k])]) / max(1.0, self.sizes()[k]) for k in (0, 1))
        return ref, cur

    def inner(self) -> np.ndarray:
        """Intervals that can hold values below their right end."""
        single = np.zeros(len(self.counts), bool)
        if len(self.cuts) > 1:
            single[1:-1] = self.cuts[:-1] == np.nextafter(self.cuts[1:], -np.inf)
        return ~single & (self.counts[:, :2].sum(1) > 0)


def could_hold_the_gap(b: Bracket) -> np.ndarray:
    """Intervals with a bound above the largest gap at any cut."""
    ref, cur = b.shares()
    bound = np.maximum(ref[1:] - cur[:-1], cur[1:] - ref[:-1])
    return b.inner() & (bound > np.abs(ref - cur).max())


def could_cross(b: Bracket) -> np.ndarray:
    """Intervals in which neither function is known to stay above the other, and those without an end."""
    ref, cur = b.shares()
    found = b.inner() & (ref[:-1] < cur[1:]) & (cur[:-1] < ref[1:])
    found[[0, -1]] = b.counts[[0, -1], :2].sum(1) > 0
    return found


def _sides(df: DataFrame, features: Sequence[str], slice_col: str, reference: str, current: str) -> DataFrame:
    side = F.when(F.col(quoted(slice_col)) == reference, 0).when(F.col(quoted(slice_col)) == current, 1)
    values = [F.col(quoted(c)).cast("double").alias(f"f{i}") for i, c in enumerate(features)]
    return df.select(side.alias("side"), *values).where("side IS NOT NULL")


def _known(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per feature its known values and their sides; -0.0 and 0.0 are one value."""
    side = batch.column(0).to_numpy(zero_copy_only=False)
    for i in range(batch.num_columns - 1):
        values = batch.column(i + 1)
        there = ~np.asarray(values.is_null())
        yield i, values.to_numpy(zero_copy_only=False)[there].astype("float64") + 0.0, side[there]


def _interval_counts(cuts: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((2 * len(c) + 2, 2)) for c in cuts]
        for batch in batches:
            for i, values, side in _known(batch):
                at = 2 * np.searchsorted(cuts[i], values) + side
                totals[i][:, 0] += np.bincount(at, minlength=len(totals[i]))
                totals[i][:, 1] += np.bincount(at, values, len(totals[i]))
        for i, t in enumerate(totals):
            n, v = t[:, 0].reshape(-1, 2), t[:, 1].reshape(-1, 2)
            at = np.flatnonzero(n.any(1))
            if len(at):
                columns = [np.full(len(at), i, np.int32), at.astype(np.int32), *n[at].T.astype(np.int64), *v[at].T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["feature", "cell", "r", "q", "sr", "sq"])

    return run


def _counted(table: DataFrame, cuts: list[np.ndarray]) -> list[np.ndarray]:
    """Counts and totals per interval of every feature."""
    each = table.mapInArrow(_interval_counts(cuts), "feature int, cell int, r long, q long, sr double, sq double")
    names = ("r", "q", "sr", "sq")
    rows = each.groupBy("feature", "cell").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out = [np.zeros((len(c) + 1, 4)) for c in cuts]
    feature, cell = rows["feature"].to_numpy(), rows["cell"].to_numpy()
    for i, counts in enumerate(out):
        own = feature == i
        for k, c in enumerate(names):
            counts[cell[own], k] = rows[c].to_numpy()[own]
    return out


def _sample(table: DataFrame, brackets: list[Bracket], wanted: int) -> list[np.ndarray]:
    """About ``wanted`` values of each feature from its open intervals."""
    shares = []
    for b in brackets:
        held = b.counts[b.open, :2].sum()
        shares.append(min(1.0, wanted / held) if held else 0.0)
    cuts, opened = [b.cuts for b in brackets], [b.open for b in brackets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(SEED)
        for batch in batches:
            for i, values, _ in _known(batch):
                if shares[i]:
                    found = values[opened[i][np.searchsorted(cuts[i], values)]]
                    found = found[rng.random(len(found)) < shares[i]]
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), i, np.int32)), pa.array(found)], names=["feature", "value"])

    rows = table.mapInArrow(run, "feature int, value double").toArrow()
    feature, value = rows["feature"].to_numpy(), rows["value"].to_numpy()
    return [value[feature == i] for i in range(len(brackets))]


def _with_cuts(cuts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Cuts at the sampled values; one that repeats gets an interval of its own."""
    found, times = np.unique(values[np.isfinite(values)], return_counts=True)
    return np.unique(np.concatenate([cuts, found, np.nextafter(found[times > 1], -np.inf)]))


def _brackets(table: DataFrame, n_features: int, rows: int, decide: Callable[[Bracket], np.ndarray]) -> list[Bracket]:
    wanted = int(min(MAX_CUTS, max(MIN_CUTS, PER_ROOT * math.sqrt(rows))))
    # before any cut each feature is one open interval
    found = [Bracket(np.empty(0), np.array([[rows, 0.0, 0.0, 0.0]]), np.ones(1, bool)) for _ in range(n_features)]
    for _ in range(ROUNDS):
        cuts = [_with_cuts(b.cuts, v) for b, v in zip(found, _sample(table, found, wanted), strict=True)]
        found = [Bracket(c, n, np.zeros(len(n), bool)) for c, n in zip(cuts, _counted(table, cuts), strict=True)]
        for b in found:
            b.open = decide(b)
        held = sum(b.counts[b.open, :2].sum() for b in found)
        if held <= LEFT_OPEN * sum(b.sizes().sum() for b in found):
            break
    return found


def open_cells(table: DataFrame, brackets: list[Bracket]) -> DataFrame:
    """``(feature, cell, value, r, q)`` of the values in open intervals, counted before they are shuffled."""
    cuts, opened = [b.cuts for b in brackets], [b.open for b in brackets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, values, side in _known(batch):
                at = np.searchsorted(cuts[i], values)
                keep = opened[i][at]
                value, place = np.unique(values[keep], return_inverse=True)
                if len(value):
                    n = np.bincount(2 * place + side[keep], minlength=2 * len(value)).reshape(-1, 2)
                    columns = [np.full(len(value), i, np.int32), np.searchsorted(cuts[i], value).astype(np.int32), value, *n.T.astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["feature", "cell", "value", "r", "q"])

    each = table.mapInArrow(run, "feature int, cell int, value double, r long, q long")
    return each.groupBy("feature", "cell", "value").agg(F.sum("r").alias("r"), F.sum("q").alias("q"))


def bracketed(
    df: DataFrame, features: Sequence[str], slice_col: str, reference: str, current: str, decide: Callable[[Bracket], np.ndarray]
) -> Iterator[tuple[list[str], DataFrame, list[Bracket]]]:
    """Groups of features with their table and their brackets."""
    rows = df.count()
    wanted = int(min(MAX_CUTS, max(MIN_CUTS, PER_ROOT * math.sqrt(rows))))
    size = max(1, CELLS // (2 * ROUNDS * wanted))
    for start in range(0, len(features), size):
        group = list(features[start : start + size])
        table = _sides(df, group, slice_col, reference, current)
        yield group, table, _brackets(table, len(group), rows, decide)
