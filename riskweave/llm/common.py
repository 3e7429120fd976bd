"""Helpers shared by the operators: text buffers of Arrow batches, word hashes, connected components."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path, shuffle_width

#: Bytes of text worked on at a time; a longer text is one slice of its own.
SLICE_BYTES = 2 << 20
#: Bounds of the Arrow batches that pass between Spark and its Python workers.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20

#: The white space that separates words: space and code points 9 to 13.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the n + 1 places where its texts begin; a null text is empty."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    texts, kind = (texts.cast(pa.large_binary()), np.int64) if wide else (texts.cast(pa.binary()), np.int32)
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, places


def slices(places: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts with at most ``most`` bytes together, or one longer text."""
    i, n = 0, len(places) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(places, places[i] + most, "right")) - 1)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (splitmix finaliser); one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs of 64-bit hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + mix(b + np.uint64(0x632BE59BD9B4E019)))


def _piece_words(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of one buffer; no word crosses a place in ``starts``."""
    word = ~WHITE[buf]
    edge = np.empty(len(buf), bool)
    edge[0] = True
    np.logical_not(word[:-1], out=edge[1:])
    edge[starts[starts < len(buf)]] = True
    first = np.flatnonzero(word & edge)
    if not len(first):
        return first, np.empty(0, np.uint64)
    ends = np.empty(len(buf), bool)
    ends[-1] = True
    np.logical_not(word[1:], out=ends[:-1])
    inner = starts[(starts > 0) & (starts < len(buf))]
    ends[inner - 1] = True
    last = np.flatnonzero(word & ends)
    power = np.full(len(buf), _BASE, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    power[:] = _BASE_INVERSE
    power[0] = 1
    np.cumprod(power, out=power)
    return first, mix((total[last + 1] - total[first]) * power[first] + (last - first).astype(np.uint64))


def word_hashes(buf: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 64-bit hash of each word of the texts ``buf[places[i]:places[i + 1]]``.

    A single text longer than a slice is worked on in pieces cut at white space, so that beside
    8 bytes a word only one piece is in memory.
    """
    lo, hi = int(places[0]), int(places[-1])
    if hi - lo <= 2 * SLICE_BYTES or len(places) > 2:
        if hi == lo:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        first, hashes = _piece_words(buf[lo:hi], places[:-1] - lo)
        return np.searchsorted(places[1:] - lo, first, "right"), hashes
    parts = []
    at = lo
    while at < hi:
        to = min(hi, at + SLICE_BYTES)
        while to < hi and not WHITE[buf[to]]:
            gap = np.flatnonzero(WHITE[buf[to : to + SLICE_BYTES]])
            to = to + int(gap[0]) if len(gap) else min(hi, to + SLICE_BYTES)
        parts.append(_piece_words(buf[at:to], np.zeros(1, np.int64))[1])
        at = to
    hashes = np.concatenate(parts)
    return np.zeros(len(hashes), np.int64), hashes


def signed(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as the long column of the same bits."""
    return pa.array(values.view(np.int64))


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """``node, component`` of an undirected graph given as longs ``a, b``; component = smallest node.

    Alternates large-star and small-star steps: each node hands its neighbours to the smallest
    of them. Minima are combined before the shuffle and joined back, so a node with very many
    neighbours is spread over tasks. Each round is a table in the shared folder. Rows with a null
    end and loops are ignored; nodes without an edge do not appear.
    """
    now = settle(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label
    )
    state = None
    while True:
        after = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if after == state or after[0] == 0:
            break
        state = after
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, settle(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), label)
        discard(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


#: Bits of a row's number within its slice.
_LOCAL_BITS = 33


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place from 0 along ``order`` within ``group``, and ``total``, the rows of the group.

    Rows are sorted in slices of the whole order, so a group of any size is spread over tasks; only a count
    per group and slice meets in a window.
    """
    along = [group, *order]
    sliced = rows.repartitionByRange(shuffle_width(rows.sparkSession), *along).sortWithinPartitions(*along)
    # its high bits number the slice, the others the row within
    sliced = settle(sliced.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    split = sliced.withColumns(
        {"_slice": F.shiftright("_at", _LOCAL_BITS), "_at": F.col("_at").bitwiseAND((1 << _LOCAL_BITS) - 1)}
    )
    sizes = split.groupBy(group, "_slice").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(
        group,
        "_slice",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_base"),
        F.sum("_n").over(whole).alias("total"),
    )
    return split.join(bases, [group, "_slice"]).withColumn("pos", F.col("_at") + F.col("_base")).drop("_slice", "_at", "_base")


def settle(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """``materialise``, after which the shuffle files of finished jobs are let go.

    Spark removes them when the driver's garbage collector finds their plans unused, which can take
    long; jobs of many steps would keep all of them on disk until then.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that no unfinished plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
