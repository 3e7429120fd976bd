"""Pearson correlation of many columns from per-task blocks of sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import quoted
from ..functions.numeric import guarded_ratio
from ..session import shuffle_width

_SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]
_BLOCK = "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS)
_SHIFT_ROWS = 1000


def _block_sums(target: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over the rows of a task for all column pairs i < j, or for all pairs with one column.

    A pair counts a row only where both of its columns are known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype("float64") for c in batch.columns])
            known = np.isfinite(x)
            x = np.where(known, x, 0.0)
            known = known.astype("float64")
            one = slice(None) if target is None else slice(target, target + 1)
            y, known_y = x[:, one], known[:, one]
            squares = x * x
            sums = np.stack(
                [
                    known.T @ known_y,
                    x.T @ known_y,
                    known.T @ y,
                    squares.T @ known_y,
                    known.T @ (y * y),
                    x.T @ y,
                ]
            )
            total = sums if total is None else total + sums
        if total is None:
            return
        if target is None:
            i, j = np.triu_indices(total.shape[1], k=1)
            parts = [part[i, j] for part in total]
        else:
            i = np.arange(total.shape[1])
            j = np.full_like(i, target)
            parts = [part[:, 0] for part in total]
        arrays = [pa.array(i.astype("int32")), pa.array(j.astype("int32")), *[pa.array(p) for p in parts]]
        for lo in range(0, len(i), 50_000):
            yield pa.RecordBatch.from_arrays([a.slice(lo, 50_000) for a in arrays], names=["i", "j", *_SUMS])

    return run


def pair_correlation(df: DataFrame, columns: Sequence[str], target: str | None = None) -> DataFrame:
    """``(i, j, r)`` by column position: all pairs i < j, or every column with ``target``.

    Each task reduces its rows to one block of sums, so the shuffle carries tasks x pairs rows
    and not one row per cell. Input splits are joined into about one task per core (or per
    shuffle partition, if more) to keep that product small.

    All columns are first shifted by a typical value from the top of the table. Any shift gives
    the same correlation; a near one keeps the sums of squares small. ``r`` is NULL where a
    side is constant.
    """
    spark = df.sparkSession
    columns = list(columns)
    x = df.selectExpr(*[f"CAST({quoted(c)} AS DOUBLE) AS c{i}" for i, c in enumerate(columns)])
    finite = x.selectExpr(*[f"CASE WHEN abs(c{i}) < double('inf') THEN c{i} END AS c{i}" for i in range(len(columns))])
    typical = [f"if(min(c{i}) = max(c{i}), min(c{i}), avg(c{i})) AS c{i}" for i in range(len(columns))]
    shift = finite.limit(_SHIFT_ROWS).selectExpr(*typical).first()
    shifted = finite.selectExpr(*[f"c{i} - {shift[i] or 0.0!r}D AS c{i}" for i in range(len(columns))])

    tasks = max(shuffle_width(spark), spark.sparkContext.defaultParallelism)
    position = None if target is None else columns.index(target)
    blocks = shifted.coalesce(tasks).mapInArrow(_block_sums(position), _BLOCK)
    s = blocks.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS])

    n = F.nullif("n", F.lit(0.0))
    spread_x = F.col("sxx") - F.col("sx") * F.col("sx") / n
    spread_y = F.col("syy") - F.col("sy") * F.col("sy") / n
    shared = F.col("sxy") - F.col("sx") * F.col("sy") / n
    # below this share of the raw squares a spread is rounding noise around a constant
    real = (spread_x > F.col("sxx") * 1e-11) & (spread_y > F.col("syy") * 1e-11)
    r = F.when(real, guarded_ratio(shared, F.sqrt(F.abs(spread_x)) * F.sqrt(F.abs(spread_y))))
    return s.select("i", "j", r.alias("r"))
