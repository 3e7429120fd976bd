"""The pipeline against plain Python, stage by stage, and the registered queries."""

import zlib
from collections import Counter

import numpy as np
import plain
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from riskweave.llm import mixing, packing, quality
from riskweave.llm.queries import ORACLES, QUERIES, table, vocabulary
from riskweave.session import materialise

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The documents, and what each stage makes of them."""
    out = [table(spark, SF_DIR, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], SF_DIR), "step"))
    return [df.collect() for df in out]


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_quality_stage(spark, steps):
    before, after = texts(steps[0]), texts(steps[1])
    judged = quality.judge(table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")).collect()
    assert set(after) == {r.doc_id for r in judged if r.kept}
    for r in judged:
        n, _, _, _, again = plain.quality_counts(before[r.doc_id])
        assert r.base_failed == (n < 50 or 100 * again > 50 * n)
    assert all(after[i] == before[i] for i in after)


def test_line_stage(steps):
    before, after = texts(steps[1]), texts(steps[2])
    dropped = plain.dropped_lines(sorted(before.items()))
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in dropped[i]) for i, t in before.items()}
    assert after == want and any(dropped.values())
    assert all(r.n_chars == len(r.text) for r in steps[2])


def test_near_copy_stage(steps):
    before, after = sorted(texts(steps[2]).items()), texts(steps[3])
    groups = plain.simhash_components(before)
    assert after == {i: t for (i, t), g in zip(before, groups, strict=True) if i == g}


def test_mixing_stage(steps):
    assert sorted(steps[3]) == sorted(steps[4])


def test_mix_reaches_the_sequences(spark):
    """The first sequences hold the sources by their weights, not by their sizes."""
    rows = [(i, f"document {i} of some words " * 4, "large" if i % 10 else "small") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").orderBy("source", "doc_id")
    weights = {"large": 1, "small": 1}
    mixed = materialise(mixing.mixed_stream(docs, weights, 2000), "mixed")
    source = {i: s for i, _, s in rows}

    def share_of_small(packed, part):
        sequences = sorted({r.sequence_id for r in packed})
        assert sequences == list(range(len(sequences)))
        tokens = Counter()
        for r in packed:
            if r.sequence_id < part * len(sequences):
                tokens[source[r.doc_id]] += r.length
        return tokens["small"] / tokens.total()

    packed = corpus_pipeline.pack_sequences(spark, mixed, SF_DIR).collect()
    # a tenth of the tokens is small; with equal weights it lasts for a fifth of the mix. A sequence is numbered by
    # its first piece, others in it may come from later in the mix.
    for part in (0.05, 0.1, 0.15):
        assert share_of_small(packed, part) > 0.3
    assert abs(share_of_small(packed, 1) - 0.1) < 0.01
    at = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0) and r.offset + r.length <= packing.CAPACITY
        at[r.sequence_id] = r.offset + r.length
    # exactly: the first places of the sequences ascend with their numbers
    place = {r.doc_id: r.place for r in mixed.select("doc_id", F.expr(corpus_pipeline.PLACE).alias("place")).collect()}
    first = {}
    for r in packed:
        first[r.sequence_id] = min(place[r.doc_id], first.get(r.sequence_id, place[r.doc_id]))
    assert len(set(place.values())) == len(rows) and [first[k] for k in sorted(first)] == sorted(first.values())


def test_packing_stage(steps):
    encode, want = packing.encoder(*vocabulary()), set()
    for i, t in texts(steps[4]).items():
        tokens = [*encode(t).tolist(), 0]
        for k, (start, n) in enumerate(packing.cut(len(tokens), packing.CAPACITY)):
            want.add((i, k, start, n, zlib.crc32(np.array(tokens[start : start + n], "<u4").tobytes())))
    assert {tuple(r)[:5] for r in steps[5]} == want and len(steps[5]) == len(want)
    at = {}
    for r in sorted(steps[5], key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length


def test_run(spark, steps):
    out = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {tuple(r)[:5] for r in out} == {tuple(r)[:5] for r in steps[5]}


def test_stages_on_no_documents(spark):
    docs = table(spark, SF_DIR, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF_DIR), "none")
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, name):
    if name in ORACLES:
        assert compare(spark, connect(SF_DIR), SF_DIR, name, QUERIES[name], ORACLES[name]) is None
        return
    rows = QUERIES[name](spark, SF_DIR).collect()
    source = {"op6_url_filter": "pages", "op8_vector_near_dedup": "embeddings"}.get(name, "documents")
    least = table(spark, SF_DIR, source).count()
    assert len(rows) >= least if name.startswith("op9") else len(rows) == least


def test_entry_has_them():
    import __spark_entry__ as entry

    assert {*QUERIES, "pipeline"} <= set(entry.queries())
