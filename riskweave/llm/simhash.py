"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints at most ``distance`` bits apart are linked. The 64 bits are grouped into partitions of
correlated bits; partition ``i`` gets a threshold ``t_i`` with ``sum(t_i + 1) = distance + 1``, so two
linked fingerprints must lie within ``t_i`` bits of each other in some partition. The number of
partitions and the thresholds come from a dynamic programme on estimated candidate counts. Each
fingerprint probes the values within ``t_i`` of its own part; candidates are verified on all bits.
Nothing is lost, whatever the estimates say: these only steer the cost.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, VariantType

from ..session import materialise
from .common import bound_batches, column, components

BITS = 64
WORDS = 4
DISTANCE = 4
#: Words are taken from texts in pieces of so many bytes.
PIECE = 1 << 20
#: Cost of one probe against that of one candidate, in the choice of thresholds.
PROBE_COST = 2.0

_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def _bit_counts(hashes: list[int]) -> np.ndarray:
    each = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(each, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, words: int = WORDS, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text: a bit is 1 if set in over half of the shingles' hashes."""
    digest = xxhash.xxh64_intdigest
    counts, total = np.zeros(BITS, np.int64), 0
    rest, before = b"", []
    for at in range(0, max(1, len(text)), PIECE):
        piece = rest + text[at : at + PIECE]
        found = piece.translate(_LOWER).split()
        more = at + PIECE < len(text)
        rest = b""
        if more and found and not piece[-1:].isspace():
            rest = found.pop()
        found = before + found
        if len(found) >= words:
            joined = b" ".join(found)
            ends = list(accumulate(len(w) + 1 for w in found))
            starts = [0, *ends]
            hashes = [digest(joined[s : e - 1], seed) for s, e in zip(starts, ends[words - 1 :], strict=False)]
            counts += _bit_counts(hashes)
            total += len(hashes)
            found = found[len(found) - words + 1 :] if words > 1 else []
        before = found
    if not total:
        return digest(b" ".join(before), seed) if before else 0
    return int(np.packbits((2 * counts > total).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, words: int = WORDS, seed: int = 42, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``key``, which are whole numbers, and ``fp`` (signed long of the 64 bits) of every row."""
    bound_batches(documents.sparkSession)

    def run(batches):
        for batch in batches:
            texts = column(batch, "text").cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", words, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*[column(batch, k) for k in key], pa.array(fps.view(np.int64))], [*key, "fp"])

    keys = [F.col(k).cast("long").alias(k) for k in key]
    return documents.select(*keys, "text").mapInArrow(run, ", ".join(f"{k} long" for k in [*key, "fp"]))


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together, over all of them."""

    def run(batches):
        total, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            for at in range(0, batch.num_rows, 50_000):
                part = column(batch, "fp").slice(at, 50_000).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(part, axis=1, bitorder="little").astype(np.float32)
                total += len(bits)
                both += bits.T @ bits
        rows = np.arange(BITS * BITS, dtype=np.int32)
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(both.ravel()), pa.array(np.full(len(rows), total))], ["cell", "both", "n"]
            )

    cells = fps.mapInArrow(run, "cell int, both double, n long").groupBy("cell").agg(F.sum("both"), F.sum("n")).collect()
    both = np.zeros(BITS * BITS)
    for cell, value, _ in cells:
        both[cell] = value
    return (cells[0][2] if cells else 0), both.reshape(BITS, BITS)


def group_bits(total: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of about equal size in which each bit joins the group it correlates with most."""
    p = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tied = np.abs((both / max(total, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tied, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = math.ceil(len(free) / (parts - k))
        group = [max(free, key=lambda b: (round(tied[b, free].sum(), 9), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (round(tied[b, group].sum(), 9), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def thresholds(total: int, both: np.ndarray, groups: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """Thresholds of least estimated cost with sum(t + 1) = distance + 1; -1 leaves a partition out."""
    p = np.diag(both) / max(total, 1)
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(math.inf, [])] * (distance + 1)
    for group in groups:
        within = np.zeros(len(group) + 1)  # chances that two fingerprints differ in k bits of the group
        within[0] = 1
        for b in group:
            q = 2 * p[b] * (1 - p[b])
            within[1:] = within[1:] * (1 - q) + within[:-1] * q
            within[0] *= 1 - q
        cost = [0.0]
        for t in range(distance + 1):
            probes = sum(math.comb(len(group), k) for k in range(t + 1))
            cost.append(PROBE_COST * total * probes + total * total / 2 * within[: t + 1].sum())
        best = [
            min(((best[u - own][0] + cost[own], [*best[u - own][1], own - 1]) for own in range(u + 1)), key=lambda x: x[0])
            for u in range(distance + 2)
        ]
    return best[distance + 1]


def probe_plan(total: int, both: np.ndarray, distance: int) -> list[tuple[int, list[int]]]:
    """Per partition in use: the mask of its bits, and the changes that a probe applies to them."""
    choices = []
    for parts in range(1, distance + 2):  # the first has all bits in one partition, and very many probes
        groups = group_bits(total, both, parts)
        choices.append((*thresholds(total, both, groups, distance), groups))
    _, most, groups = min(choices, key=lambda c: c[0])
    to_long = lambda bits: (sum(1 << b for b in bits) ^ (1 << 63)) - (1 << 63)
    return [
        (to_long(g), [to_long(flip) for k in range(t + 1) for flip in combinations(g, k)])
        for g, t in zip(groups, most, strict=True)
        if t >= 0
    ]


def near_pairs(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs ``x, y`` with x < y of the distinct long column ``fp`` at most ``distance`` bits apart."""
    total, both = bit_statistics(fps)
    total = max(total, 2)  # estimates of no rows would all be alike
    plan = probe_plan(total, both, distance)
    long = lambda v: F.lit(v).cast("long")
    entry = F.array(
        *[
            F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(long(mask)).alias("value"))
            for i, (mask, _) in enumerate(plan)
        ]
    )
    index = fps.select(F.col("fp").alias("y"), F.inline(entry))
    probes = [
        fps.select(
            F.col("fp").alias("x"),
            F.lit(i).alias("part"),
            F.explode(F.array(*map(long, changes))).alias("change"),
        ).select("x", "part", F.col("x").bitwiseAND(long(mask)).bitwiseXOR(F.col("change")).alias("value"))
        for i, (mask, changes) in enumerate(plan)
    ]
    probe = probes[0]
    for other in probes[1:]:
        probe = probe.unionByName(other)
    found = probe.join(index, ["part", "value"]).where("x < y").where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= distance)
    return found.select("x", "y").distinct()


def simhash_classes(documents: DataFrame, words: int = WORDS, distance: int = DISTANCE, seed: int = 42) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``documents(doc_id, text)``; other columns are ignored.

    Words are the runs of bytes other than space and code points 9 to 13, after A-Z were
    lower-cased. A text with fewer than ``words`` words is one shingle; without any (also null) its
    fingerprint is zero, and links like any other. ``component_id`` is the smallest id reachable by
    links. Repeated rows stay repeated. A row with a null id gets the component of its
    fingerprint (null if no row with an id has that), but carries no links of its own.
    """
    each = materialise(fingerprints(documents, words, seed), "simhash")
    ids = materialise(each.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-first")
    pairs = near_pairs(ids.select("fp"), distance)
    links = pairs.join(ids.select(F.col("fp").alias("x"), F.col("first").alias("a")), "x").join(
        ids.select(F.col("fp").alias("y"), F.col("first").alias("b")), "y"
    )
    groups = components(links.select("a", "b"), "simhash-links")
    classes = ids.join(groups, ids["first"] == groups["node"], "left").select(
        "fp", F.coalesce("component", "first").alias("component_id")
    )
    return each.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def row_hashes(documents: DataFrame) -> list[F.Column]:
    """``r1, r2``: two hashes of a whole row; nulls count, and nested columns as JSON text."""
    parts = []
    for field in documents.schema:
        value = F.col(f"`{field.name}`")
        plain = isinstance(field.dataType, AtomicType) and not isinstance(field.dataType, VariantType)
        parts += [value.isNull(), value if plain else F.to_json(F.struct(value.alias("c")), {"ignoreNullFields": "false"})]
    return [F.xxhash64(*parts).alias("r1"), F.xxhash64(F.lit(1), *parts).alias("r2")]


def drop_near_duplicates(documents: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """One row of each component: that of the lowest id (null last) and, of these, the lowest hashes of the row.

    All rows carry links here, also those that share an id or have none. Columns beside ``doc_id`` and ``text`` may
    be of any name and type.
    """
    # a row is told by its hashes, as its id need not tell it, and travels as one column, so that no name can clash
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("own")
    keyed = documents.select(whole, *row_hashes(documents))
    each = materialise(
        fingerprints(keyed.select("own.doc_id", "own.text", "r1", "r2"), words, key=["doc_id", "r1", "r2"]), "simhash-rows"
    )
    prints = each.select("fp").distinct()
    pairs = near_pairs(prints, distance).select(F.col("x").alias("a"), F.col("y").alias("b"))
    groups = components(pairs, "simhash-links")
    classes = prints.join(groups, prints["fp"] == groups["node"], "left").select("fp", F.coalesce("component", "fp").alias("class"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "r1", "r2")).alias("first")
    # the rows of one fingerprint are combined before they meet their component
    firsts = each.groupBy("fp").agg(first).join(classes, "fp")
    kept = firsts.groupBy("class").agg(F.min("first").alias("first")).select("first.r1", "first.r2")
    return keyed.join(kept, ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"]).select("own.*")
