"""Mixing of sources to target weights by Pfair scheduling.

Each source's texts are cut into blocks of equal bytes. Block ``j`` (from 1) of a source with weight ``w``, all
weights adding up to 1, is released at slot ``floor((j - 1) / w)`` and due by ``ceil(j / w)``; every slot takes the
released block with the earliest deadline. So after ``t`` slots a source has between ``t w - 1`` and ``t w + 1``
blocks. Weights are whole numbers of any size, so the windows are exact however long the schedule is. When a source runs
dry the others share its part and a new phase begins: every row is placed once.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Mapping
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import prefix_totals
from ..session import materialise

#: Text bytes of a block,
BLOCK_BYTES = 1 << 16
#: unless the input is so large that there would be more blocks than this: the driver works the schedule out. From 64 GiB
#: of text on, blocks grow with the input.
MAX_BLOCKS = 1 << 20
#: More sources are an error: each has a block at least.
MAX_SOURCES = 1 << 16
#: Rows that one window sorts, on average.
CELL_ROWS = 4096
#: Without target weights a source gets its bytes to this power.
TEMPERATURE = 0.5


def whole_weights(weights: Mapping[str, float | Fraction]) -> dict[str, int]:
    """Whole numbers in exactly the proportion of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    common = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * common) for s, w in exact.items()}
    divisor = math.gcd(*whole.values())
    return {s: w // divisor for s, w in whole.items()}


def schedule(weights: Mapping[str, int], blocks: Mapping[str, int]) -> dict[str, array]:
    """Per source the slots of its ``blocks``, in order."""
    left = {s: n for s, n in blocks.items() if n > 0}
    slots = {s: array("q") for s in left}
    start = 0
    while left:
        whole = sum(weights[s] for s in left)
        waiting = [(0, s, 0) for s in sorted(left)]  # release, source, blocks taken in this phase
        heapq.heapify(waiting)
        ready: list[tuple[int, str, int]] = []
        slot, dry = 0, None
        while dry is None:
            while waiting and waiting[0][0] <= slot:
                _, s, j = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(j + 1) * whole // weights[s]), s, j))
            _, s, j = heapq.heappop(ready)
            slots[s].append(start + slot)
            slot += 1
            if j + 1 == left[s]:
                dry = s
            else:
                heapq.heappush(waiting, ((j + 1) * whole // weights[s], s, j + 1))
        start += slot
        left = {s: blocks[s] - len(slots[s]) for s in left if s != dry}
    return slots


SOURCE = "coalesce(concat('s', source), 'n')"
UNIT = "xxhash64(doc_id, text)"


def placed_units(
    documents: DataFrame, weights: Mapping[str | None, float] | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``mix_source, mix_unit, start_byte, block, slot``: the place of each unit of ``documents``.

    A unit is the rows that are equal in source, id and text; it stays together, in the block its first byte
    falls in. Within a source, units are in order of their hash.
    """
    spark = documents.sparkSession
    units = materialise(
        documents.select(
            F.expr(SOURCE).alias("mix_source"),
            F.expr(UNIT).alias("mix_unit"),
            F.expr("coalesce(octet_length(text), 0)").cast("long").alias("n"),
        )
        .groupBy("mix_source", "mix_unit")
        .agg(F.sum("n").alias("n")),
        "mix-units",
    )
    # cells of consecutive hashes, so that no window holds a whole source
    bits = max(0, (units.count() // CELL_ROWS).bit_length())
    cell = F.expr(f"shiftright(mix_unit, {64 - bits})") if bits else F.lit(0).cast("long")
    units = units.withColumn("cell", cell)
    cells = materialise(units.groupBy("mix_source", "cell").agg(F.sum("n").alias("bytes")), "mix-cells")
    sizes = cells.groupBy("mix_source").agg(F.sum("bytes").alias("bytes")).limit(MAX_SOURCES + 1).collect()
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them first")
    amount = {r["mix_source"]: r["bytes"] for r in sizes}
    if weights is None:
        target = {s: max(1, n) ** TEMPERATURE for s, n in amount.items()}
    else:
        target = {("n" if s is None else f"s{s}"): w for s, w in weights.items()}
        if missing := sorted(set(amount) - set(target)):
            raise ValueError(f"sources without a weight: {missing}")
        if min(target.values()) <= 0:
            raise ValueError("weights must be above zero")
        target = {s: target[s] for s in amount}
    block_bytes = max(block_bytes, -(-sum(amount.values()) // MAX_BLOCKS))
    blocks = {s: max(1, -(-n // block_bytes)) for s, n in amount.items()}
    placed = schedule(whole_weights(target), blocks) if amount else {}
    # a row per block, of which there are at most MAX_BLOCKS and one more for each source
    turns = pd.DataFrame(
        {
            "mix_source": pd.Series([s for s, slots in placed.items() for _ in slots], dtype="object"),
            "block": pd.Series([j for slots in placed.values() for j in range(len(slots))], dtype="int64"),
            "slot": pd.Series([t for slots in placed.values() for t in slots], dtype="int64"),
        }
    )
    turns = spark.createDataFrame(turns, "mix_source string, block long, slot long")
    ends = spark.createDataFrame([(s, n - 1) for s, n in blocks.items()], "mix_source string, last long")
    in_cell = Window.partitionBy("mix_source", "cell").orderBy("mix_unit").rowsBetween(Window.unboundedPreceding, -1)
    running = prefix_totals(cells, ["cell"], ["bytes"], ["mix_source"])
    bases = running.select("mix_source", "cell", (F.col("bytes_upto") - F.col("bytes")).alias("base"))
    local = units.withColumn("start_byte", F.coalesce(F.sum("n").over(in_cell), F.lit(0)))
    blocked = (
        local.join(bases, ["mix_source", "cell"])
        .withColumn("start_byte", F.col("start_byte") + F.col("base"))
        .join(ends, "mix_source")
        # a unit without bytes at the very end belongs to the last block
        .withColumn("block", F.expr(f"least(start_byte div {block_bytes}, last)"))
    )
    return blocked.join(turns, ["mix_source", "block"]).select("mix_source", "mix_unit", "start_byte", "block", "slot")


def mix(
    documents: DataFrame, weights: Mapping[str | None, float] | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """All rows of ``documents(doc_id, text, source, ...)`` with ``block`` and ``slot``, in no order.

    ``weights`` maps every source (None: a null source) to its target; without it a source gets its
    bytes to the power TEMPERATURE. Reading the rows by ``slot, start_byte`` meets the weights within one
    block at any point while all sources last. Input columns named ``block``, ``slot`` or ``start_byte`` are
    replaced.
    """
    units = placed_units(documents, weights, block_bytes)
    kept = [c for c in documents.columns if c not in ("block", "slot", "start_byte")]
    # the row travels as one column, so that none of its columns can clash
    keyed = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.expr(SOURCE).alias("own_source"), F.expr(UNIT).alias("own_unit"))
    match = (F.col("own_source") == F.col("mix_source")) & (F.col("own_unit") == F.col("mix_unit"))
    return keyed.join(units, match).select("row.*", "start_byte", "block", "slot")


def mixed_stream(
    documents: DataFrame, weights: Mapping[str | None, float] | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of ``documents`` with its own columns, sorted over all partitions in the order of the mix."""
    placed = placed_units(documents, weights, block_bytes)
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.expr(SOURCE).alias("own_source"), F.expr(UNIT).alias("own_unit"))
    match = (F.col("own_source") == F.col("mix_source")) & (F.col("own_unit") == F.col("mix_unit"))
    return rows.join(placed, match).orderBy("slot", "start_byte", "mix_unit").select("row.*")
