import math
import random
from collections import Counter

import numpy as np
import plain
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskweave.llm import common, quality

SCHEMA = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def counts(texts):
    raw = [t.encode() for t in texts]
    buf, places = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    doc, hashes = common.word_hashes(buf, places)
    return list(
        zip(
            np.bincount(doc, minlength=len(texts)).tolist(),
            quality._per_text(quality._WORD_POINT, buf, places).tolist(),
            quality._per_text(quality._SYMBOL, buf, places).tolist(),
            [quality.duplicate_lines(t) for t in raw],
            quality.repeated_words(doc, hashes, len(texts)).tolist(),
            strict=True,
        )
    )


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é\n\t#|\x0b\u2003"), max_size=40), max_size=4))
def test_counts(texts):
    assert counts(texts) == [plain.quality_counts(t) for t in texts]


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(random.Random(1).choice(["a", "bcd", "éé", "x" * 30]) for _ in range(400)) + "\n" + "y" * 100
    for size in (1, 5, 64):
        monkeypatch.setattr(common, "SLICE_BYTES", size)
        monkeypatch.setattr(quality, "SLICE_BYTES", size)
        assert counts([text]) == [plain.quality_counts(text)]


def test_equal_words_have_equal_hashes():
    texts = ["one two one", "two", "", "one  ", "onetwo"]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    doc, hashes = common.word_hashes(buf, np.cumsum([0, *map(len, texts)]))
    names = [w for t in texts for w in t.split()]
    assert doc.tolist() == [0, 0, 0, 1, 3, 4]
    assert all((a == b) == (x == y) for a, x in zip(hashes, names, strict=True) for b, y in zip(hashes, names, strict=True))


def plain_scores(rows, trusted):
    """Scores from counts per bucket in plain Python."""
    grams = {}
    for i, t in rows:
        buf = np.frombuffer(t.encode(), np.uint8)
        grams[i] = quality.buckets(*common.word_hashes(buf, np.array([0, len(buf)])))[1].tolist()
        n = len(t.split())
        assert len(grams[i]) == max(0, 2 * n - 1)
    raw = Counter(g for own in grams.values() for g in own)
    good = Counter(g for i in trusted for g in grams[i])
    a = quality.SMOOTHING
    n_raw, n_good = (c.total() + a * quality.BUCKETS for c in (raw, good))
    weight = {g: math.log((good[g] + a) / n_good) - math.log((raw[g] + a) / n_raw) for g in raw}
    return {i: sum(weight[g] for g in own) / len(own) if own else 0.0 for i, own in grams.items()}


def test_judge(spark):
    rng = random.Random(3)
    good, junk = [f"w{i}" for i in range(20)], [f"zz{i}#" for i in range(20)]
    rows = [(i, " ".join(rng.choice(junk if i % 5 == 0 else good) for _ in range(80))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 300, 3)], LABELS)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("other", F.lit(1))
    out = {r.doc_id: r for r in quality.judge(df, labels).collect()}
    assert len(out) == 300 and out[1].other == 1
    trusted = labels.where("quality = 1").orderBy(F.xxhash64("doc_id")).collect()
    trusted = {r.doc_id for r in trusted[::2]}
    want = plain_scores(rows, trusted)
    assert max(abs(out[i].score - want[i]) for i, _ in rows) < 1e-9
    for i, t in rows:
        assert tuple(out[i][c] for c in quality.COUNTS) == plain.quality_counts(t)
        assert not out[i].base_failed and out[i].kept == (i % 5 > 0)


def test_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None), (2, ""), (None, long), (4, long), (4, long), (5, "same words here " * 30)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = quality.judge(df, spark.createDataFrame([], LABELS)).select("doc_id", "n_words", "base_failed", "kept").collect()
    want = [(1, 0, True, False), (2, 0, True, False), (None, 60, False, True), (4, 60, False, True), (4, 60, False, True), (5, 90, True, False)]
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)
    assert quality.judge(df.limit(0), spark.createDataFrame([(1, 1, 0)], LABELS)).collect() == []


def test_all_trusted_documents_count(spark):
    """More trusted documents than any fixed number that one could be tempted to read."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[k] for k in rng.integers(0, 40 if i % 3 else 20, 52))) for i in range(21_000)]
    df, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, 1, 0) for i, _ in rows], LABELS)
    order = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    want = plain_scores(rows, order[::2])
    model = quality.fit(df, labels)
    low, middle = np.quantile([want[i] for i in order[1::2]], [quality.TRUSTED_LOSS, 0.5])
    assert abs(model.threshold - (low - quality.MARGIN * (middle - low))) < 1e-9
    scores = {r.doc_id: r.score for r in quality.with_scores(df, model.weights).collect()}
    assert max(abs(scores[i] - want[i]) for i, _ in rows) < 1e-9
