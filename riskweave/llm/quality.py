"""Quality rules: fixed limits on word counts and a hashed n-gram log-likelihood ratio.

Word uni- and bigrams are hashed to buckets. Their counts over all documents and over trusted
documents give two multinomials; a document's score is the mean over its n-grams of
``log p_trusted - log p_raw``. It passes at or above one threshold for all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from ..operators.ordered import exact_quantiles, prefix_totals
from .common import SLICE_BYTES, WHITE, bound_batches, column, pair_hash, settle, slices, text_buffer, word_hashes

#: Hash buckets of the n-grams; bounds the model and what each task sends for it.
BUCKETS = 1 << 15
#: Words of the bit filter of trusted ids; bounds what every task gets of it.
FILTER_WORDS = 1 << 18
#: The threshold is below this quantile of unseen trusted scores by MARGIN times its distance from their median.
TRUSTED_LOSS = 0.001
MARGIN = 1.0
#: Added to every count.
SMOOTHING = 0.5

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
#: Code points start at bytes other than 10xxxxxx.
_WORD_POINT = ((np.arange(256) & 0xC0) != 0x80) & ~WHITE


@dataclass(frozen=True)
class Model:
    """Weights per bucket, and the least score that passes."""

    weights: np.ndarray
    threshold: float


def _per_text(flags: np.ndarray, buf: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged, a slice of bytes at a time."""
    out = np.zeros(len(places) - 1, np.int64)
    for at in range(int(places[0]), int(places[-1]), SLICE_BYTES):
        to = min(at + SLICE_BYTES, int(places[-1]))
        total = np.zeros(to - at + 1, np.int64)
        np.cumsum(flags[buf[at:to]], out=total[1:])
        cut = np.clip(places, at, to) - at
        out += total[cut[1:]] - total[cut[:-1]]
    return out


def repeated_words(doc: np.ndarray, hashes: np.ndarray, texts: int) -> np.ndarray:
    """Per text, the words inside a 3-word window that the text has twice or more."""
    covered = np.zeros(len(hashes), bool)
    if len(hashes) >= 3:
        at = np.flatnonzero(doc[2:] == doc[:-2])
        windows = pair_hash(pair_hash(hashes[at], hashes[at + 1]), hashes[at + 2]) + doc[at].astype(np.uint64) * np.uint64(
            0x9E3779B97F4A7C15
        )
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        for k in range(3):
            covered[at[again] + k] = True
    return np.bincount(doc[covered], minlength=texts)


def duplicate_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            n += line in seen
            seen.add(line)
    return n


def buckets(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every uni- and bigram."""
    size = np.uint64(BUCKETS)
    inner = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.empty(0, np.int64)
    pairs = pair_hash(hashes[inner], hashes[inner + 1])
    return (
        np.concatenate([doc, doc[inner]]),
        np.concatenate([hashes % size, pairs % size]).astype(np.int64),
    )


def texts_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, text`` of the rows whose id is among ``ids(doc_id)``, which has no id twice.

    A filter of 64 bits in each of FILTER_WORDS words goes to every task and rules out nearly all other rows, so that
    hardly more than the wanted texts are shuffled for the exact join.
    """
    place = [
        f"pmod(xxhash64(doc_id), {FILTER_WORDS}) AS word",
        "shiftleft(1L, cast(pmod(shiftright(xxhash64(doc_id), 32), 64) AS int)) AS bit",
    ]
    bits = ids.selectExpr(*place).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").selectExpr("*", *place)
    near = own.join(F.broadcast(bits), "word").where("bits & bit <> 0").select("doc_id", "text")
    # a semi-join would be moved before the filter
    return near.join(ids.select("doc_id"), "doc_id")


def count_ngrams(texts: DataFrame) -> np.ndarray:
    """Bucket counts over all rows."""
    bound_batches(texts.sparkSession)

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            buf, places = text_buffer(column(batch, "text"))
            for i, j in slices(places):
                _, cell = buckets(*word_hashes(buf, places[i : j + 1]))
                counts += np.bincount(cell, minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    cells = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BUCKETS)
    for bucket, n in cells:
        counts[bucket] = n
    return counts


def with_scores(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """``documents`` with the five counts and ``score``, the mean weight of its n-grams (0 without any).

    Columns of ``documents`` that have one of these names are replaced.
    """
    bound_batches(documents.sparkSession)
    base = documents.drop(*COUNTS, "score")
    schema = StructType([*base.schema.fields, *[StructField(c, LongType()) for c in COUNTS], StructField("score", DoubleType())])
    weights = weights.astype(np.float64)

    def run(batches):
        for batch in batches:
            texts = column(batch, "text")
            buf, places = text_buffer(texts)
            n = batch.num_rows
            counts = np.zeros((3, n), np.int64)
            score = np.zeros(n)
            for i, j in slices(places):
                here = places[i : j + 1]
                doc, hashes = word_hashes(buf, here)
                counts[0, i:j] = np.bincount(doc, minlength=j - i)
                counts[1, i:j] = [duplicate_lines(buf[a:b].tobytes()) for a, b in zip(here[:-1], here[1:], strict=True)]
                counts[2, i:j] = repeated_words(doc, hashes, j - i)
                doc, cell = buckets(doc, hashes)
                grams = np.bincount(doc, minlength=j - i)
                score[i:j] = np.bincount(doc, weights[cell], minlength=j - i) / np.maximum(grams, 1)
            new = [counts[0], _per_text(_WORD_POINT, buf, places), _per_text(_SYMBOL, buf, places), counts[1], counts[2]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, new), pa.array(score)], names=schema.names)

    return base.mapInArrow(run, schema)


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """The weights from all documents, the threshold from the scores of trusted labelled ones.

    Trusted are all documents labelled ``quality = 1``. Half of them, every other id in the order of a hash, give
    the trusted counts, the other half the threshold: the former score higher than clean documents the model
    has not seen. Without one of the halves every document passes the ratio.
    """
    trusted = (
        labels.where("quality = 1 and doc_id is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"))
        .distinct()
        .withColumns({"hash": F.xxhash64("doc_id"), "one": F.lit(1).cast("long")})
    )
    placed = prefix_totals(trusted, ["hash", "doc_id"], ["one"])
    halves = settle(placed.select("doc_id", (F.col("one_upto") % 2 == 1).alias("fitted")), "quality-halves")
    good = count_ngrams(texts_of(documents, halves.where("fitted")))
    if not good.sum():
        return Model(np.zeros(BUCKETS), -np.inf)
    raw = count_ngrams(documents)
    weights = np.log((good + SMOOTHING) / (good + SMOOTHING).sum()) - np.log((raw + SMOOTHING) / (raw + SMOOTHING).sum())
    unseen = texts_of(documents, halves.where("not fitted"))
    scores = settle(with_scores(unseen, weights).where(~base_failed()).select("score"), "quality-scores")
    cut = exact_quantiles(scores, ["score"], [TRUSTED_LOSS, 0.5]).first()
    return Model(weights, -np.inf if cut is None else cut["q0"] - MARGIN * (cut["q1"] - cut["q0"]))


def base_failed() -> F.Column:
    """True below the least number of words, or with too many repeated ones."""
    return F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` with COUNTS, ``score``, ``base_failed`` and ``kept`` for every row.

    ``documents(doc_id, text, ...)``, ``labels(doc_id, quality, ...)``. A null text has no words and
    fails the base rules. Rows with a null or repeated id are judged like any other. Input columns
    with the names of new ones are replaced.
    """
    model = fit(documents, labels)
    out = with_scores(documents.drop("base_failed", "kept"), model.weights)
    passes = (F.col("score") >= F.lit(float(model.threshold))).cast(BooleanType())
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & passes)
