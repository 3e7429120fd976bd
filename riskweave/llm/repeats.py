"""Removal of repeated byte strings by bucket-pointer refinement over a sparse suffix array.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Of the strings
(windows) of a text each belongs to one *anchor*: the place in it whose ``seed_bytes``-gram has the
lowest hash. Equal windows have their anchor at the same offset, so only windows of anchors in
one bucket need to be compared, and an anchor stands for all its windows, which start one after another.

1. The initial buckets are those of the anchors' q-grams. An anchor alone in its bucket is done.
2. A bucket is refined by the identifier of the whole context of its anchors, the text of all their
   windows. A context found twice makes all its windows repeats.
3. Buckets that still hold different contexts are refined by the identifiers of the strings at
   later offsets: first by the part that a run of ``BLOCK`` windows has in common, then by the text of
   the whole run, and last by single windows. Each round takes over the buckets of the one before, and
   only members of buckets that are neither single nor settled go on.

Identifiers are 64-bit hashes of the strings, the same in every task, so refining a bucket is a
grouping: counts are combined before the shuffle, and a bucket of any size is spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, column, discard, mix, pair_hash, settle, slices, text_buffer

LENGTH = 200
SEED_BYTES = 32
#: Windows that the second refinement takes together.
BLOCK = 16
#: Window starts worked on at a time; their places take PLACE_BITS.
PLACE_BITS = 21
STARTS = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Strings:
    """Identifiers of substrings of a buffer, from sums of its bytes times powers."""

    def __init__(self, buf: np.ndarray):
        power = np.full(len(buf), _BASE, np.uint64)
        power[:1] = 1
        np.cumprod(power, out=power)
        self.total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power, out=self.total[1:])
        power[:] = _BASE_INVERSE
        power[:1] = 1
        self.inverse = np.cumprod(power, out=power)

    def ids(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.total[end] - self.total[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        """Identifiers of all substrings of ``size`` bytes."""
        n = len(self.total) - size
        return mix((self.total[size:] - self.total[:n]) * self.inverse[:n] + np.uint64(size))


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    have, out = 1, values
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def anchors(buf: np.ndarray, ends: np.ndarray, starts: int, length: int, seed_bytes: int) -> tuple[np.ndarray, ...]:
    """``first window, last window, anchor, seed, context`` of the runs of windows in a buffer.

    The buffer holds texts that end at ``ends``; windows start below ``starts`` and lie in one text.
    """
    none = np.empty(0, np.int64)
    if len(buf) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    strings = Strings(buf)
    grams = strings.grams(seed_bytes)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    keys = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_lowest(keys, length - seed_bytes + 1) & mask).astype(np.int64)
    n = min(len(anchor), starts)
    edge = np.zeros(n + 1, np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    good = (ends - begins >= length) & (begins < n)
    np.add.at(edge, begins[good], 1)
    np.add.at(edge, np.minimum(ends[good] - length + 1, n), -1)
    valid = np.cumsum(edge[:n]) > 0
    change = np.empty(n, bool)
    change[:1] = True
    change[1:] = (anchor[1:n] != anchor[: n - 1]) | (valid[1:] != valid[:-1])
    at = np.flatnonzero(change)
    last = np.append(at[1:], n) - 1
    at, last = at[valid[at]], last[valid[at]]
    place = anchor[at]
    context = pair_hash(strings.ids(at, last + length), ((place - at) << 32 | (place - last)).astype(np.uint64))
    return at, last, place, grams[place], context


def text_anchors(buf: np.ndarray, places: np.ndarray, length: int, seed_bytes: int):
    """Text number and runs of windows (places within the text) of the texts in a buffer."""
    for i, j in slices(places, STARTS):
        lo, hi = int(places[i]), int(places[j])
        if hi - lo <= STARTS + length:
            at, last, place, seed, context = anchors(buf[lo:hi], places[i + 1 : j + 1] - lo, STARTS + length, length, seed_bytes)
            doc = np.searchsorted(places[i + 1 : j + 1] - lo, at, "right")
            base = places[i:j][doc] - lo
            yield i + doc, at - base, last - base, place - base, seed, context
            continue
        for a in range(lo, hi - length + 1, STARTS):
            z = min(hi, a + STARTS + length - 1)
            at, last, place, seed, context = anchors(buf[a:z], np.array([z - a]), STARTS, length, seed_bytes)
            base = a - lo
            yield np.full(len(at), i), at + base, last + base, place + base, seed, context


ROW = "doc_id long, row long"
#: Tells rows apart; rows equal in id and text are the same to this operator.
ROW_HASH = "xxhash64(doc_id, text)"


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.expr(ROW_HASH))


def anchor_rows(texts: DataFrame, length: int, seed_bytes: int) -> DataFrame:
    """``doc_id, row, first, last, place, seed, context`` for every anchor of ``texts(doc_id, row, text)``."""

    def run(batches):
        for batch in batches:
            ids, rows = column(batch, "doc_id"), column(batch, "row")
            for doc, *places, seed, context in text_anchors(*text_buffer(column(batch, "text")), length, seed_bytes):
                at = pa.array(doc)
                found = [ids.take(at), rows.take(at), *map(pa.array, places)]
                found += [pa.array(seed.view(np.int64)), pa.array(context.view(np.int64))]
                yield pa.RecordBatch.from_arrays(found, names=names)

    names = ["doc_id", "row", "first", "last", "place", "seed", "context"]
    schema = f"{ROW}, first long, last long, place long, seed long, context long"
    return texts.mapInArrow(run, schema)


def context_texts(texts: DataFrame, contexts: DataFrame, length: int) -> DataFrame:
    """``contexts`` with column ``bytes``, the text of all their windows."""
    fields = ["seed", "context", "twice", "first", "last", "place"]
    wanted = contexts.groupBy(F.col("row").alias("_row"), F.col("doc_id").alias("_doc_id")).agg(
        F.collect_list(F.struct(*fields)).alias("found")
    )
    match = (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))

    def run(batches):
        for batch in batches:
            buf, places = text_buffer(column(batch, "text"))
            for i, found in enumerate(column(batch, "found")):
                found = found.values
                first = found.field("first").to_numpy() + places[i]
                last = found.field("last").to_numpy() + places[i] + length
                cut = pa.array([buf[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary())
                n = pa.array(np.full(len(first), i))
                yield pa.RecordBatch.from_arrays(
                    [*(column(batch, c).take(n) for c in ("doc_id", "row")), *(found.field(f) for f in fields), cut],
                    names=["doc_id", "row", *fields, "bytes"],
                )

    schema = f"{ROW}, seed long, context long, twice boolean, first long, last long, place long, bytes binary"
    return texts.join(wanted, match).select("doc_id", "row", "text", "found").mapInArrow(run, schema)


def _offsets(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Lowest and highest offset of the anchor in its windows, and where the anchor is in ``bytes``."""
    first, last, place = (column(batch, c).to_numpy() for c in ("first", "last", "place"))
    return place - last, place - first, place - first


def block_rows(contexts: DataFrame, length: int) -> DataFrame:
    """A row for each run of ``BLOCK`` offsets of a context, with the identifiers of two strings.

    ``inner`` is what all windows of the run have in common, whether the context has all of
    them or not. ``outer`` is the text of those it has, from offset ``low`` to ``high``.
    """

    def run(batches):
        for batch in batches:
            buf, places = text_buffer(column(batch, "bytes").cast(pa.binary()))
            for i, j in slices(places):
                part = batch.slice(i, j - i)
                low, high, at = _offsets(part)
                strings = Strings(buf[places[i] : places[j]])
                at = at + places[i:j] - places[i]
                n = high // BLOCK - low // BLOCK + 1
                own = np.repeat(np.arange(j - i), n)
                block = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low // BLOCK, n)
                a, z = np.maximum(low[own], block * BLOCK), np.minimum(high[own], block * BLOCK + BLOCK - 1)
                at = at[own]
                inner = strings.ids(at - block * BLOCK, at - block * BLOCK - BLOCK + 1 + length)
                outer = pair_hash(strings.ids(at - z, at - a + length), (a << 32 | z).astype(np.uint64))
                rows = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(column(part, c).take(rows) for c in ("doc_id", "row", "seed", "context", "twice", "place")),
                        *map(pa.array, (block, a, z, inner.view(np.int64), outer.view(np.int64))),
                    ],
                    names=names,
                )

    names = ["doc_id", "row", "seed", "context", "twice", "place", "block", "low", "high", "inner", "outer"]
    schema = f"{ROW}, seed long, context long, twice boolean, place long, block long, low long, high long, "
    return contexts.mapInArrow(run, schema + "inner long, outer long")


def window_rows(contexts: DataFrame, length: int) -> DataFrame:
    """``doc_id, row, seed, twice, start, window`` for the windows of the runs in column ``blocks``."""

    def run(batches):
        for batch in batches:
            buf, places = text_buffer(column(batch, "bytes").cast(pa.binary()))
            blocks = column(batch, "blocks")
            for i, j in slices(places):
                part = batch.slice(i, j - i)
                low, high, at = _offsets(part)
                strings = Strings(buf[places[i] : places[j]])
                at = at + places[i:j] - places[i]
                n = np.array([len(b) for b in blocks.slice(i, j - i)])
                own = np.repeat(np.arange(j - i), n * BLOCK)
                block = blocks.slice(i, j - i).flatten().to_numpy()
                offset = (block[:, None] * BLOCK + np.arange(BLOCK)[None, :]).ravel()
                there = (offset >= low[own]) & (offset <= high[own])
                own, offset = own[there], offset[there]
                window = strings.ids(at[own] - offset, at[own] - offset + length)
                rows = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(column(part, c).take(rows) for c in ("doc_id", "row", "seed", "twice")),
                        pa.array(column(part, "place").to_numpy()[own] - offset),
                        pa.array(window.view(np.int64)),
                    ],
                    names=["doc_id", "row", "seed", "twice", "start", "window"],
                )

    return contexts.mapInArrow(run, f"{ROW}, seed long, twice boolean, start long, window long")


def repeated_windows(documents: DataFrame, length: int = LENGTH, seed_bytes: int = SEED_BYTES) -> DataFrame:
    """``doc_id, row, first, last``: runs of window starts whose windows are repeats; ``row`` is ROW_HASH."""
    bound_batches(documents.sparkSession)
    texts = _texts(documents)
    found = anchor_rows(texts, length, seed_bytes)
    # initial buckets: q-grams of two anchors or more
    seeds = settle(found.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed"), "repeat-seeds")
    shared = settle(found.join(seeds, "seed", "left_semi"), "repeat-anchors")
    # first refinement: whole contexts
    contexts = settle(
        shared.groupBy("seed", "context")
        .agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "first", "last", "place")).alias("at"))
        .select("seed", "context", F.expr("n > 1").alias("twice"), "at.*"),
        "repeat-contexts",
    )
    whole = settle(
        shared.join(contexts.where("twice").select("seed", "context"), ["seed", "context"], "left_semi")
        .select("doc_id", "row", "first", "last")
        .distinct(),
        "repeat-whole",
    )
    discard(seeds, shared)
    split = contexts.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    open_contexts = settle(context_texts(texts, contexts.join(split, "seed", "left_semi"), length), "repeat-texts")
    discard(contexts)
    # second refinement: runs of offsets; a context known to be there twice counts so
    every = settle(block_rows(open_contexts, length), "repeat-blocks")
    keys = ["seed", "block", "inner"]
    buckets = (
        every.groupBy(*keys)
        .agg(F.sum(F.expr("if(twice, 2, 1)")).alias("n"), F.min("outer").alias("one"), F.max("outer").alias("other"))
        .where("n > 1")
        .select(*keys, F.expr("one = other").alias("alike"))
    )
    blocks = settle(every.join(buckets, keys).drop("inner", "outer"), "repeat-runs")
    discard(every)
    runs = blocks.where("alike and not twice").selectExpr("doc_id", "row", "place - high AS first", "place - low AS last")
    # last refinement: windows of the runs whose buckets are still mixed
    mixed = blocks.where("not alike").groupBy("seed", "context").agg(F.collect_set("block").alias("blocks"))
    windows = settle(window_rows(open_contexts.join(mixed, ["seed", "context"]), length), "repeat-windows")
    discard(open_contexts)
    again = windows.groupBy("seed", "window").agg(F.sum(F.expr("if(twice, 2, 1)")).alias("n")).where("n > 1")
    single = windows.where("not twice").join(again.select("seed", "window"), ["seed", "window"], "left_semi")
    single = single.selectExpr("doc_id", "row", "start AS first", "start AS last")
    found = settle(whole.unionByName(runs).unionByName(single), "repeat-found")
    discard(whole, blocks, windows)
    return found


def remove_repeats(documents: DataFrame, length: int = LENGTH, seed_bytes: int = SEED_BYTES) -> DataFrame:
    """``doc_id, n_bytes, spans array<struct<start, end>>, kept binary`` for every row of ``documents(doc_id, text)``.

    ``spans`` are the maximal runs of removed bytes, ``kept`` is the rest. All is judged on the input, so
    all copies go. Texts shorter than ``length`` (also empty and null ones) stay whole. Rows with a null or
    repeated id are treated like any other. Other columns are ignored.
    """
    found = repeated_windows(documents, length, seed_bytes)
    runs = found.groupBy(F.col("row").alias("_row"), F.col("doc_id").alias("_doc_id")).agg(
        F.collect_list(F.struct("first", "last")).alias("runs")
    )
    match = (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    joined = _texts(documents).join(runs, match, "left").select("doc_id", "text", "runs")

    def run(batches):
        for batch in batches:
            buf, places = text_buffer(column(batch, "text"))
            out = []
            for i, found in enumerate(column(batch, "runs")):
                text = buf[places[i] : places[i + 1]]
                spans, kept = [], text
                if found.is_valid and len(found.values):
                    start = found.values.field("first").to_numpy()
                    order = np.argsort(start)
                    start = start[order]
                    end = np.maximum.accumulate(found.values.field("last").to_numpy()[order] + length)
                    new = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
                    spans = list(zip(start[new].tolist(), end[np.append(new[1:], len(end)) - 1].tolist(), strict=True))
                    edges = [0, *(x for span in spans for x in span), len(text)]
                    kept = np.concatenate([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                out.append((len(text), [{"start": a, "end": b} for a, b in spans], kept.tobytes()))
            if out:
                n_bytes, spans, kept = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "doc_id"), pa.array(n_bytes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "spans", "kept"],
                )

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
