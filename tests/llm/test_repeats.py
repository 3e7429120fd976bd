import random

import numpy as np
import plain
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskweave.llm import repeats


def digest(out):
    cut = out.selectExpr(
        "doc_id", "n_bytes", "aggregate(spans, 0L, (n, s) -> n + s.end - s.start) AS removed", "size(spans) AS n", "sha2(kept, 256) AS d"
    )
    return {r[0]: tuple(r[1:]) for r in cut.collect()}


def test_against_brute_force(spark):
    rng = random.Random(5)
    passage = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(15, 120))) for _ in range(12)]
    texts = ["", None, "a" * 300, "ab" * 200, "z" * 19, "y" * 20, passage[0] * 9]
    for _ in range(120):
        parts = [rng.choice(passage) if rng.random() < 0.4 else "".join(rng.choice("efgh ij") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(6))]
        texts.append("".join(parts))
    texts += texts[20:24] * 3
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("spans", F.lit("x"))
    want = plain.removal([(t or "").encode() for t in texts], 20)
    assert digest(repeats.remove_repeats(df, 20, 6)) == dict(enumerate(want))


def test_odd_rows(spark):
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(500))
    rows = [(None, text), (None, "short"), (3, "q" + text[:300]), (3, text[100:400]), (3, text[100:400])]
    out = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r.n_bytes, sum(s.end - s.start for s in r.spans)) for r in out)
    want = plain.removal([t.encode() for _, t in rows], 200)
    assert got == sorted((w[0], w[1]) for w in want)
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=5), st.integers(4, 12), st.integers(1, 4))
def test_windows_have_one_anchor(texts, length, seed_bytes):
    raw = [t.encode() for t in texts]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    places = np.cumsum([0, *map(len, raw)])
    seen, offsets = set(), {}
    for doc, first, last, place, _, _ in repeats.text_anchors(buf, places, length, seed_bytes):
        for d, a, z, p in zip(doc, first, last, place, strict=True):
            for s in range(a, z + 1):
                assert (d, s) not in seen and s <= p <= s + length - seed_bytes
                seen.add((d, s))
                # equal windows have their anchor at the same offset
                assert offsets.setdefault(raw[d][s : s + length], p - s) == p - s
    assert seen == {(d, s) for d, t in enumerate(raw) for s in range(len(t) - length + 1)}


@pytest.mark.parametrize("starts", [7, 50])
def test_long_text_in_pieces(monkeypatch, starts):
    rng = random.Random(starts)
    raw = bytes(rng.choice(b"abc") for _ in range(400))
    monkeypatch.setattr(repeats, "STARTS", starts)
    found = list(repeats.text_anchors(np.frombuffer(raw, np.uint8), np.array([0, 400]), 10, 3))
    covered = [s for _, first, last, *_ in found for a, z in zip(first, last, strict=True) for s in range(a, z + 1)]
    assert sorted(covered) == list(range(391))
