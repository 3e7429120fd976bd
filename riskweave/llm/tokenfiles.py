"""Token ids in binary files, compressed document by document with one shared dictionary.

Documents are tokenised and their id arrays serialised; a zstandard dictionary is trained on a bounded sample of such
arrays, so that even short documents compress well although each is a frame of its own. Frames are
sorted by document id in ranges and every range writes its files. A file is

    header      magic, bytes of an id, SHA-256 of the dictionary
    frames      one per document
    index       per document: id, whether the id is null, place of its frame, first token, number of tokens
    footer      place of the index, documents, tokens, checksum of the index, magic

all little-endian. A reader of one document takes footer, index and a single frame. The folder also has the
dictionary and a table ``manifest`` of the files with the number of ids in the files before each.
Files are named after the attempt that wrote them and count only if the manifest names them, so a lost or repeated
task leaves no trace in the result.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import prefix_totals
from ..session import scratch_path, shuffle_width
from .common import bound_batches, column, discard, settle
from .packing import END, encoder

#: The sample that the dictionary is trained on: about so many documents, so many characters of each at most.
SAMPLE_DOCUMENTS = 1000
SAMPLE_CHARACTERS = 4096
DICTIONARY_BYTES = 1 << 16
LEVEL = 3
#: A file is closed once its frames reach this.
FILE_BYTES = 64 << 20

MAGIC = b"TOKZ0001"
_HEADER, _HEADER_BYTES = "<8sI32s", 44
_FOOTER, _FOOTER_BYTES = "<QQQI8s", 36
_ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("start", "<u8"), ("n_tokens", "<u8")])


def id_width(tokenizer_file: str) -> int:
    """Bytes that the largest id of a vocabulary takes."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer_file).get_vocab_size() <= 1 << 16 else 4


def serialised(encode, text: str | None, width: int) -> tuple[int, int, bytes]:
    """Number of ids with the end id, their checksum as 32-bit values, and the id array as bytes."""
    ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4")
    return len(ids), zlib.crc32(ids.tobytes()), ids.astype(f"<u{width}").tobytes()


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def sample_arrays(documents: DataFrame, tokenizer_file: str, ranks_file: str | None, width: int) -> list[bytes]:
    """Serialised ids of about SAMPLE_DOCUMENTS rows, of a stretch of up to SAMPLE_CHARACTERS of each."""
    total = documents.count()
    if not total:
        return []
    drawn = documents.select("text") if total <= SAMPLE_DOCUMENTS else documents.select("text").sample(SAMPLE_DOCUMENTS / total, 42)
    place = F.expr(f"cast(1 + pmod(xxhash64(text), greatest(1, length(text) - {SAMPLE_CHARACTERS})) as int)")
    stretch = drawn.limit(2 * SAMPLE_DOCUMENTS).select(F.substring("text", place, F.lit(SAMPLE_CHARACTERS)).alias("text"))

    def run(batches):
        encode = encoder(tokenizer_file, ranks_file)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([serialised(encode, t, width)[2] for t in column(batch, "text").to_pylist()], pa.binary())], names=["ids"])

    return sorted(bytes(r["ids"]) for r in stretch.mapInArrow(run, "ids binary").collect())


def train_dictionary(arrays: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for id arrays like these; of arrays too few to train on, their bytes serve as they are."""
    try:
        return zstandard.train_dictionary(size, arrays, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(arrays)[-size:]


def frames(documents: DataFrame, tokenizer_file: str, ranks_file: str | None, width: int, dictionary: bytes) -> DataFrame:
    """``doc_id, n_tokens, crc, frame`` of every row: the ids of its whole text, compressed."""

    def run(batches):
        encode = encoder(tokenizer_file, ranks_file)
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_checksum=True).compress
        for batch in batches:
            counts, sums, packed = [], [], []
            for text in column(batch, "text"):
                n, crc, data = serialised(encode, text.as_py(), width)
                counts.append(n)
                sums.append(crc)
                packed.append(compress(data))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(packed, pa.binary())],
                names=["doc_id", "n_tokens", "crc", "frame"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, crc long, frame binary")


class _Writer:
    """One file of a folder; nothing but its index is kept in memory."""

    def __init__(self, folder: str, width: int, dictionary_hash: bytes):
        self.fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        self.name = f"tokens-{uuid.uuid4().hex}.tok"
        self.out = self.fs.open_output_stream(f"{root}/{self.name}")
        self.out.write(struct.pack(_HEADER, MAGIC, width, dictionary_hash))
        self.at, self.tokens, self.entries = _HEADER_BYTES, 0, []

    def add(self, doc_id: int | None, n_tokens: int, frame: bytes) -> None:
        self.entries.append((doc_id or 0, doc_id is None, self.at, self.tokens, n_tokens))
        self.out.write(frame)
        self.at += len(frame)
        self.tokens += n_tokens

    def close(self) -> tuple[str, int, int, int]:
        """Name, documents, tokens and bytes."""
        index = np.array(self.entries, _ENTRY).tobytes()
        self.out.write(index)
        self.out.write(struct.pack(_FOOTER, self.at, len(self.entries), self.tokens, zlib.crc32(index), MAGIC))
        self.out.close()
        return self.name, len(self.entries), self.tokens, self.at + len(index) + _FOOTER_BYTES


class TokenFile:
    """A written file. Opening it reads header, footer and index; a document costs one more read."""

    def __init__(self, folder: str, name: str, dictionary: bytes):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        self.file = fs.open_input_file(f"{root}/{name}")
        size = self.file.size()
        magic, width, known = struct.unpack(_HEADER, self._read(0, _HEADER_BYTES))
        self.end, n, self.tokens, checksum, last = struct.unpack(_FOOTER, self._read(size - _FOOTER_BYTES, _FOOTER_BYTES))
        index = self._read(self.end, n * _ENTRY.itemsize)
        if magic != MAGIC or last != MAGIC or zlib.crc32(index) != checksum:
            raise ValueError(f"{name} is not a whole token file")
        if known != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} was written with another dictionary")
        self.index = np.frombuffer(index, _ENTRY)
        self.type = np.dtype(f"<u{width}")
        self._decompress = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress

    def _read(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def __len__(self) -> int:
        return len(self.index)

    def doc_id(self, i: int) -> int | None:
        return None if self.index["null"][i] else int(self.index["doc_id"][i])

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document, the end id included, as 32-bit values."""
        start = int(self.index["offset"][i])
        end = int(self.index["offset"][i + 1]) if i + 1 < len(self) else self.end
        ids = np.frombuffer(self._decompress(self._read(start, end - start)), self.type).astype("<u4")
        if len(ids) != self.index["n_tokens"][i]:
            raise ValueError("the index and a frame disagree")
        return ids

    def find(self, doc_id: int) -> range:
        """Places of the documents with this id."""
        nulls = int(self.index["null"].sum())  # they come first
        known = self.index["doc_id"][nulls:]
        return range(*(nulls + int(np.searchsorted(known, doc_id, side)) for side in ("left", "right")))

    def close(self) -> None:
        self.file.close()


_MANIFEST = "slice int, nth int, file string, documents long, tokens long, bytes long"


def write_tokens(documents: DataFrame, folder: str, tokenizer_file: str, ranks_file: str | None = None) -> DataFrame:
    """Write the ids of ``documents(doc_id, text, ...)`` to ``folder`` and return its manifest.

    Ids are those of the whole text without special tokens, and the end id; null is empty text. Documents
    stand in ascending order of doc_id over all files, null first; rows of one id by number of ids and
    checksum, and each row is written, also equal ones. ``folder`` must be a place that all
    executors reach; an empty table gives an empty manifest. Other columns are ignored.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    width = id_width(tokenizer_file)
    dictionary = train_dictionary(sample_arrays(documents, tokenizer_file, ranks_file, width))
    known = hashlib.sha256(dictionary).digest()
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{_dictionary_name(known)}") as out:
        out.write(dictionary)

    packed = frames(documents, tokenizer_file, ranks_file, width, dictionary)
    packed = settle(packed.withColumn("row", F.monotonically_increasing_id()), "token-frames")
    order = ["doc_id", "n_tokens", "crc", "row"]
    ranged = packed.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)

    def run(batches):
        part, nth, writer = TaskContext.get().partitionId(), 0, None
        done = []
        for batch in batches:
            columns = [column(batch, c) for c in ("doc_id", "n_tokens", "frame")]
            for doc_id, n_tokens, frame in zip(*columns, strict=True):
                writer = writer or _Writer(folder, width, known)
                writer.add(doc_id.as_py(), n_tokens.as_py(), frame.as_py())
                if writer.at >= FILE_BYTES:
                    done.append((part, nth, *writer.close()))
                    writer, nth = None, nth + 1
        if writer:
            done.append((part, nth, *writer.close()))
        if done:
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = ["slice", "nth", "file", "documents", "tokens", "bytes"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

    written = settle(ranged.select("doc_id", "n_tokens", "frame").mapInArrow(run, _MANIFEST), "token-files")
    discard(packed)
    placed = prefix_totals(written, ["slice", "nth"], ["tokens"])
    placed = placed.select(*written.columns, (F.col("tokens_upto") - F.col("tokens")).alias("base"), F.lit(known.hex()).alias("dictionary"))
    placed.write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def _dictionary_name(known: bytes) -> str:
    return f"dictionary-{known.hex()}.zdict"


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``slice, nth, file, documents, tokens, bytes, base, dictionary``, one row per file; ``base`` ids come before it."""
    return spark.read.schema(_MANIFEST + ", base long, dictionary string").parquet(f"{folder}/manifest")


def load_dictionary(folder: str, known: str) -> bytes:
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{root}/{_dictionary_name(bytes.fromhex(known))}") as f:
        return f.read()


def read_tokens(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of every document in the files of ``folder``.

    ``start`` counts the ids of all documents before it. Everything but the id comes from decompressing the frames.
    """
    listed = read_manifest(spark, folder)
    n = listed.count()
    if n:
        # a task reads a file after the other; the manifest itself may lie in one partition
        listed = listed.repartitionByRange(min(n, 4 * shuffle_width(spark)), "slice", "nth")
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])]
    types = [pa.int64()] * 4 + ([pa.list_(pa.int64())] if ids else [])

    def documents(file: TokenFile, base: int) -> Iterator[tuple]:
        for i in range(len(file)):
            own = file.ids(i)
            row = (file.doc_id(i), base + int(file.index["start"][i]), len(own), zlib.crc32(own.tobytes()))
            yield (*row, own.tolist()) if ids else row

    def run(batches):
        dictionary = None
        for batch in batches:
            for name, base, known in zip(*(column(batch, c).to_pylist() for c in ("file", "base", "dictionary")), strict=True):
                dictionary = dictionary if dictionary is not None else load_dictionary(folder, known)
                file, rows, held = TokenFile(folder, name, dictionary), [], 0
                for row in documents(file, base):
                    rows.append(row)
                    held += row[2] if ids else 1
                    if held >= 1 << 18 or len(rows) >= 10_000:
                        yield _batch(rows, names, types)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names, types)
                file.close()

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else ""))


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def round_trip(documents: DataFrame, tokenizer_file: str, ranks_file: str | None = None) -> DataFrame:
    """``read_tokens`` of what ``write_tokens`` has written to a new folder of the shared scratch place."""
    folder = scratch_path(documents.sparkSession, "tokens")
    write_tokens(documents, folder, tokenizer_file, ranks_file)
    return read_tokens(documents.sparkSession, folder)
