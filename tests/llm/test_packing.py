import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskweave.llm import packing
from riskweave.llm.queries import vocabulary

SCHEMA = "doc_id long, text string"


def valid(plan, counts, capacity):
    used = Counter()
    for lengths, times in plan:
        assert times > 0 and sum(lengths) <= capacity
        for length in lengths:
            used[length] += times
    assert used == Counter({k: n for k, n in counts.items() if n})


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 50), max_size=12))
def test_plan_uses_every_piece(counts):
    plan = packing.packing_plan(counts, 30)
    valid(plan, counts, 30)
    sequences = sum(n for _, n in plan)
    tokens = sum(k * n for k, n in counts.items())
    assert sequences >= -(-tokens // 30)
    places = packing.places(plan)
    ends, used = Counter(), defaultdict(set)
    for length, n in counts.items():
        for s, o in zip(*places.find(np.full(n, length), np.arange(n)), strict=True):
            ends[int(s)] += length
            taken = range(o, o + length)
            assert o + length <= 30 and not used[int(s)] & set(taken)
            used[int(s)] |= set(taken)
    assert len(ends) == sequences and max(ends.values(), default=0) <= 30


@pytest.mark.parametrize("gap", [1, 2, 3])
def test_exact_complements(gap):
    """Lengths made by cutting full sequences go back into as many."""
    rng = random.Random(gap)
    counts = Counter()
    for _ in range(400):
        cuts = sorted(rng.sample(range(1, 100), gap))
        counts.update(b - a for a, b in zip([0, *cuts], [*cuts, 100], strict=True))
    assert sum(n for _, n in packing.packing_plan(counts, 100)) <= 402


def test_many_pieces_near_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(6, 1, 100_000).astype(int), 1, 2048)
    plan = packing.packing_plan(Counter(lengths.tolist()), 2048)
    assert sum(n for _, n in plan) <= 1.0005 * lengths.sum() / 2048
    assert len(plan) < 3 * 2048


def test_cut():
    assert packing.cut(5, 10) == [(0, 5)] and packing.cut(10, 10) == [(0, 10)]
    assert packing.cut(25, 10) == [(0, 5), (5, 10), (15, 10)] and packing.cut(20, 10) == [(0, 10), (10, 10)]


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder(*vocabulary())
    rng = random.Random(2)
    points = [*range(32, 127), *range(0xA0, 0x250), 9, 10, 13, 0x3B1, 0x4E2D, 0x1F600, 0x300, 0x200D, 0x85, 0x2028]
    texts = ["", "<|endoftext|> x", "it's I'LL we've", "a" * 5000, " " * 500]
    texts += ["".join(chr(rng.choice(points)) for _ in range(60)) for _ in range(300)]
    for text in texts:
        assert encode(text).tolist() == full.encode(text, add_special_tokens=False).ids


def test_pack(spark):
    rng = random.Random(7)
    words = ["lorem", "ipsum", "Dolor", "été", "42"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(120)))) for i in range(150)]
    rows += [(900, None), (901, ""), (None, "no id"), (5, "again"), (5, "again")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("length", F.lit("x")).withColumn("nth", F.lit(1))
    out = packing.pack(df, *vocabulary(), capacity=64, ids=True).collect()
    encode = packing.encoder(*vocabulary())
    want = Counter()
    for i, t in rows:
        tokens = [*encode(t or "").tolist(), 0]
        for k, (start, n) in enumerate(packing.cut(len(tokens), 64)):
            want[i, k, start, n, zlib.crc32(np.array(tokens[start : start + n], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r.ids_crc32 for r in out)
    at = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 64 and len(at) <= 1.05 * sum(at.values()) / 64
    assert packing.pack(spark.createDataFrame([], SCHEMA), *vocabulary()).collect() == []


@pytest.mark.parametrize("run", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "x " + "\t" * 150_000 + "y"])
def test_long_runs(spark, run):
    """A run of about a million spaces is more than the splitting pattern can step back over."""
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(vocabulary()[0]).encode(run, add_special_tokens=False).ids
    assert packing.encoder(*vocabulary())(run).tolist() == want
    rows = packing.pack(spark.createDataFrame([(1, run), (2, "b")], SCHEMA), *vocabulary()).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == len(want) + 1
