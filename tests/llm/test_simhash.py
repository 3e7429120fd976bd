import random

import plain
import pytest
from pyspark.sql import functions as F

from riskweave.llm import simhash


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_one_text_in_pieces(monkeypatch):
    text = "One Two  THREE\tfour\nfive É six seven\x0beight nine " * 7 + "x" * 50 + " end"
    whole = simhash.fingerprint(text.encode())
    assert whole == plain.simhash(text)
    for piece in (1, 3, 10, 64):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text.encode()) == whole
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \n\t") == 0
    assert simhash.fingerprint(b"A b") == plain.simhash("a b")


def test_classes(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + str(rng.randrange(40)) for _ in range(120)) for _ in range(12)]
    rows = []
    for text in base:
        rows += [text] * rng.randrange(1, 4)
        for _ in range(5):
            words = text.split()
            words[rng.randrange(len(words))] = f"new{rng.randrange(9)}"
            rows.append(" ".join(words))
    rows += ["", None, "  \n", "two words", "Two  Words", "y" * 3000]
    rng.shuffle(rows)
    rows = [(i * 7 + 1, t) for i, t in enumerate(rows)]
    want = dict(zip([i for i, _ in rows], plain.simhash_components(rows), strict=True))
    df = documents(spark, rows).withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(0))
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.simhash_classes(df).collect()}
    assert got == {i: (plain.simhash(t), want[i]) for i, t in rows}
    kept = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
    assert kept == set(want.values())


def test_odd_rows(spark):
    rows = [(None, "a b c d e"), (None, "only without id at all"), (4, "a b c d e"), (4, "a b c d e"), (2, "a b c d e")]
    got = simhash.simhash_classes(documents(spark, rows)).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 2), (None, None), (4, 2), (4, 2), (2, 2)], key=repr)
    assert simhash.simhash_classes(documents(spark, [])).collect() == []
    kept = simhash.drop_near_duplicates(documents(spark, rows)).select("doc_id").collect()
    # a row without id belongs to the group of its text
    assert sorted((r[0] for r in kept), key=repr) == [2, None]


@pytest.mark.parametrize("size", [2, 400])
@pytest.mark.parametrize("distance", [0, 1, 4])
def test_all_close_pairs(spark, size, distance):
    rng = random.Random(size)
    fps = set()
    while len(fps) < size:
        fp = rng.getrandbits(64)
        fps.add(fp)
        for _ in range(3):
            fp ^= 1 << rng.randrange(64)
            fps.add(fp)
    longs = sorted(f - 2**64 if f >> 63 else f for f in fps)
    want = {(a, b) for a in longs for b in longs if a < b and ((a ^ b) % 2**64).bit_count() <= distance}
    got = simhash.near_pairs(spark.createDataFrame([(f,) for f in longs], "fp long"), distance)
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("total", [10, 10**5, 10**9])
def test_thresholds_add_up(total):
    import numpy as np

    both = np.full((64, 64), total / 4)
    np.fill_diagonal(both, total / 2)
    for parts in range(1, 6):
        groups = simhash.group_bits(total, both, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        _, most = simhash.thresholds(total, both, groups, 4)
        assert sum(t + 1 for t in most) == 5


def test_one_row_a_component_whatever_the_ids(spark):
    one, two, three = "a b c d e", "quite another text with words of its own", "and a third that is like neither one"
    rows = [(4, one), (4, two), (4, two), (9, one), (None, one), (None, three), (None, three), (7, two)]
    got = [tuple(r) for r in simhash.drop_near_duplicates(documents(spark, rows)).select("doc_id", "text").collect()]
    assert sorted(got, key=repr) == sorted([(4, one), (4, two), (None, three)], key=repr)


def test_any_column_name_and_type(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (1, "f g h i j k l"), (None, "a b c d e"), (2, None)]
    names = ["_row", "own", "r1", "r2", "fp", "class", "first", "x"]
    df = documents(spark, rows).withColumns({c: F.concat(F.lit(c), F.coalesce("text", F.lit("-"))) for c in names})
    df = df.withColumns({"m": F.create_map(F.lit("k"), "doc_id"), "a.b": F.array(F.lit(None), "doc_id"), "v": F.parse_json(F.lit("1"))})
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    got = out.select("doc_id", "text", *names, "m", "`a.b`").collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == [(1, "a b c d e"), (1, "f g h i j k l"), (2, "")]
    assert all(r[c] == c + (r["text"] or "-") for r in got for c in names)
    assert all(r.m == {"k": r.doc_id} and r["a.b"] == [None, r.doc_id] for r in got)


def test_rows_are_told_apart(spark):
    df = spark.createDataFrame([(1, None, "a", [None, "x"]), (1, "a", None, ["x", None]), (1, "a", None, [None, "x"])], "doc_id long, p string, q string, z array<string>")
    assert df.select(*simhash.row_hashes(df)).distinct().count() == 3
