"""Packing of token sequences by exact-complement hashing, then best fit.

Documents are tokenised and cut into pieces. A piece matters to the packing only by its length, so
the plan is made on the counts per length, of which there are at most ``capacity``: for each length
from the longest down, the gap it leaves is looked up among single lengths and the sums of pairs and
triples, and as many sequences as all counts allow are made at once. What finds no exact complement
is put where it fits best. Pieces then take the plan's places by their rank within their length.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import bound_batches, column, numbered

CAPACITY = 2048
END = 0

#: The pattern that splits text before the merges of the byte-level vocabulary (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are tokenised by the rank file only if both libraries split them alike: tested for each code
#: point below 0x10000. Texts with others, and those with a special token, go to the full tokenizer.
BEYOND = re.compile("[\U00010000-\U0010ffff]")
SPECIAL = "<|"
#: The pattern steps back over a run of white space, which a run of about a million overflows; such texts too go to the
#: full tokenizer.
LONG_RUN = re.compile(r"\s{100000}")


def encoder(tokenizer_file: str, ranks_file: str | None = None) -> Callable[[str], np.ndarray]:
    """A function from text to token ids as the ``tokenizers`` file gives them, without special tokens added.

    ``ranks_file`` may name the same vocabulary as merge ranks, which is faster on plain texts.
    """
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(tokenizer_file)

    def slow(text: str) -> np.ndarray:
        return np.array(full.encode(text, add_special_tokens=False).ids, np.uint32)

    if ranks_file is None:
        return slow
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text or not text.isascii() and BEYOND.search(text) or len(text) >= 100_000 and LONG_RUN.search(text):
            return slow(text)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Pieces ``start, length`` of n tokens: all of ``capacity`` but the first, which takes the rest."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = [0, *range(first, n, capacity)] if first else list(range(0, n, capacity))
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def pieces(
    documents: DataFrame,
    tokenizer_file: str,
    ranks_file: str | None,
    capacity: int = CAPACITY,
    ids: bool = False,
    place: Column | None = None,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, place, part, nth`` (and ``ids``) of every row's pieces.

    ``place`` is the row's, 0 if none is given; ``part`` is the task and ``nth`` counts the task's pieces of one length, from 0.
    """
    bound_batches(documents.sparkSession)

    def run(batches):
        encode = encoder(tokenizer_file, ranks_file)
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out = []
            keys, places_of = column(batch, "doc_id").to_pylist(), column(batch, "place").to_pylist()
            for key, at, text in zip(keys, places_of, column(batch, "text"), strict=True):
                tokens = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(tokens), capacity)):
                    own = tokens[start : start + length]
                    row = (key, k, start, length, zlib.crc32(own.tobytes()), at, part, seen[length])
                    out.append((*row, own.tolist()) if ids else row)
                    seen[length] += 1
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names
                )

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "place", "part", "nth", *(["ids"] if ids else [])]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    types += [pa.list_(pa.int64())] if ids else []
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, place long, part int, nth long"
    at = (F.lit(0) if place is None else place).cast("long").alias("place")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", at).mapInArrow(
        run, schema + (", ids array<long>" if ids else "")
    )


class _Supply:
    """Pieces left per length, and which gaps their sums fill."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self._pairs = None

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for length in lengths:
            self.left[length] -= times
            if not self.left[length]:
                self._pairs = None

    def pair_sums(self) -> np.ndarray:
        if self._pairs is None:
            there = (self.left > 0).astype(np.float64)
            self._pairs = np.convolve(there, there)[: len(self.left)] > 0.5
        return self._pairs

    def enough(self, lengths: tuple[int, ...]) -> int:
        """How many times these lengths can be taken together."""
        return min(int(self.left[length]) // n for length, n in Counter(lengths).items())

    def pair(self, gap: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        for x in a[(self.left[a] > 0) & (self.left[gap - a] > 0)]:
            if self.enough((*taken, int(x), gap - int(x))):
                return (*taken, int(x), gap - int(x))
        return None

    def complement(self, length: int, gap: int) -> tuple[int, ...] | None:
        """``length`` and one, two or three more lengths that fill the gap exactly."""
        if self.enough((length, gap)):
            return (length, gap)
        if gap > 1 and self.pair_sums()[gap] and (found := self.pair(gap, (length,))):
            return found
        if gap > 2:
            a = np.arange(gap - 2, (gap - 1) // 3, -1)
            for x in a[(self.left[a] > 0) & self.pair_sums()[gap - a]]:
                if self.enough((length, int(x))) and (found := self.pair(gap - int(x), (length, int(x)))):
                    return found
        return None


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as ``(lengths in order, how many such)`` that use up the counts per length.

    Each step uses up some length or fills up some kind of sequence, so the number of steps depends on
    ``capacity``, not on the number of pieces.
    """
    supply = _Supply(counts, capacity)
    steps, rest = [], []
    if supply.left[capacity]:
        steps.append(((capacity,), int(supply.left[capacity])))
        supply.left[capacity] = 0
    for length in range(capacity - 1, 0, -1):
        while supply.left[length]:
            found = supply.complement(length, capacity - length)
            if found is None:
                rest.append((length, int(supply.left[length])))
                supply.take((length,), int(supply.left[length]))
                break
            times = supply.enough(found)
            supply.take(found, times)
            steps.append((found, times))
    gaps: dict[int, list[list]] = {}  # room left -> kinds of sequence with it
    for length, n in rest:
        while n:
            room = min((g for g in gaps if g >= length), default=None)
            kind, free = gaps[room][-1] if room is not None else ((), n)
            each = 1 if kind else capacity // length
            times = min(n // each, free) if n >= each else 1
            own = (length,) * min(each, n)
            n -= len(own) * times
            if room is not None:
                gaps[room][-1][1] -= times
                if not gaps[room][-1][1]:
                    gaps[room].pop()
                    if not gaps[room]:
                        del gaps[room]
            new = (*kind, *own)
            gaps.setdefault(capacity - sum(new), []).append([new, times])
    steps += [(kind, times) for kinds in gaps.values() for kind, times in kinds]
    return steps


@dataclass(frozen=True)
class Places:
    """Runs of ranks within a length, in order of ``key`` = length and first rank, and where they go.

    ``many`` ranks after each other go to one sequence, from ``offset`` on, the next ones to the following sequence.
    """

    key: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    many: np.ndarray

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of these lengths and ranks."""
        key = length << _RANK_BITS | rank
        at = np.searchsorted(self.key, key, "right") - 1
        sequence, nth = np.divmod(key - self.key[at], self.many[at])
        return self.sequence[at] + sequence, self.offset[at] + nth * length


_RANK_BITS = 48


def places(plan: list[tuple[tuple[int, ...], int]]) -> Places:
    used, runs, base = Counter(), [], 0
    for lengths, times in plan:
        offset = 0
        for length, many in Counter(lengths).items():
            runs.append((length << _RANK_BITS | used[length], base, offset, many))
            used[length] += many * times
            offset += many * length
        base += times
    runs.sort()
    return Places(*(np.array(c, np.int64) for c in (zip(*runs, strict=True) if runs else ([], [], [], []))))


def pack(
    documents: DataFrame,
    tokenizer_file: str,
    ranks_file: str | None = None,
    capacity: int = CAPACITY,
    ids: bool = False,
    place: Column | None = None,
) -> DataFrame:
    """Pieces of all documents with their place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``documents(doc_id, text)``; other columns are ignored. A document's tokens are those of its whole text
    and the end token; null is empty text. Only a longer document is cut, and then its first piece
    may be shorter than ``capacity``. Places in a sequence follow each other from 0. With ``ids`` the
    token ids come along. Rows with null or repeated ids are packed like any other.

    With ``place``, a number that orders the rows (null first), pieces of one length are used in that order and
    sequences are numbered by the first place that a piece of theirs has.
    """
    each = materialise(pieces(documents, tokenizer_file, ranks_file, capacity, ids, place), "pieces")
    counts = each.groupBy("part", "length").agg(F.count("*").alias("n"))
    # at most `capacity` rows reach the driver
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(packing_plan(total, capacity))
    if place is None:
        before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        bases = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
        ranked = each.join(bases, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("base"))
    else:
        ranked = numbered(each, "length", ["place", "doc_id", "piece"]).withColumn("nth", F.col("pos"))

    def run(batches):
        for batch in batches:
            sequence, offset = where.find(column(batch, "length").to_numpy(), column(batch, "nth").to_numpy())
            keep = [i for i, name in enumerate(batch.schema.names) if name != "nth"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)],
                names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"],
            )

    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    ordered = ranked.select(*kept, *([] if place is None else ["place"]), "nth")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema if f.name != "nth")
    packed = ordered.mapInArrow(run, schema + ", sequence_id long, offset long")
    if place is None:
        return packed
    packed = materialise(packed, "packed")
    firsts = packed.groupBy("sequence_id").agg(F.min("place").alias("first")).withColumn("all", F.lit(0))
    order = numbered(firsts, "all", ["first", "sequence_id"]).select("sequence_id", F.col("pos").alias("number"))
    return packed.join(order, "sequence_id").select(*kept, F.col("number").alias("sequence_id"), "offset")
