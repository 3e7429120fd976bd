"""The Merkle manifest against a plain Python tree."""

import sys
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from riskweave.llm import merkle, queries

sys.path.insert(0, "tests")
from oracle import compare, connect  # noqa: E402

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Root, and per leaf the (left, right) digests of each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            run = i // 3 * 3
            path.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
        nodes = [digest(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], paths


def plain_report(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {}
    for s in sources:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        own[s] = mine, tree([leaf_of(r) for r in mine])
    if not rows:
        return []
    root, above = tree([own[s][1][0] for s in sources])
    out = []
    for s, up in zip(sources, above, strict=True):
        mine, (subroot, paths) = own[s]
        for row, path in zip(mine, paths, strict=True):
            tampered = row[0] is not None and crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
            h = leaf_of((*row[:4], row[4].replace("\n", ""))) if tampered else leaf_of(row)
            for left, right in path + up:
                h = digest(left, h, right)
            proof = digest(*(x for pair in path + up for x in pair))
            out.append((row[0], leaf_of(row), subroot, root, proof, h, h == root))
    return out


def report(spark, rows):
    return [tuple(r) for r in merkle.proof_report(spark.createDataFrame(rows, SCHEMA)).collect()]


@pytest.mark.parametrize("sizes", [[1], [243, 3], [244, 1, 4], [1000, 729, 730, 2]])
def test_sizes(spark, sizes):
    rows = [(i, f"s{k}", "en", i, f"t{i}\nx" if i % 3 else f"t{i}") for k, n in enumerate(sizes) for i in range(k, 5 * n + k, 5)]
    assert sorted(report(spark, rows)) == sorted(plain_report(rows))


def test_many_sources(spark):
    rows = [(i, f"{i % 301}", None, None, "a\n") for i in range(700)]
    got = report(spark, rows)
    assert sorted(got) == sorted(plain_report(rows))
    assert len({r[2] for r in got}) == 301 and len({r[3] for r in got}) == 1


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None),
        (None, "a", "en", 1, "x\ny"),
        (1, "a", "en", 0, ""),
        (1, "a", "en", 0, None),
        (1, "a", "en", 0, None),
        (1, "", "en", 0, "é\n" * 3),
        (2, "é", None, -5, "\n"),
        (3, "z", "en", 2, "long " * 200_000),
        (-4, None, "-", None, "-"),
    ]
    assert sorted(report(spark, rows), key=repr) == sorted(plain_report(rows), key=repr)
    assert report(spark, []) == []


def test_one_id_for_all(spark):
    rows = [(7, "a", "en", 1, "same\n")] * 800 + [(7, "a", "en", 1, f"t{i % 5}") for i in range(400)]
    assert sorted(report(spark, rows)) == sorted(plain_report(rows))


def test_clashing_columns(spark):
    rows = [(i, "a", "en", i, f"t{i}") for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = [F.lit("x").alias(c) for c in ("grp", "pos", "_at", "load", "path", "top", "hash", "root", "row", "total")]
    got = merkle.proof_report(df.select("*", *extra, F.create_map(F.lit(1), F.lit(2)).alias("m")))
    assert sorted(map(tuple, got.collect())) == sorted(plain_report(rows))


def test_paths_prove_the_root(spark):
    rows = [(i, f"s{i % 4}", "en", i, f"t{i}") for i in range(600)]
    listed = merkle.manifest(spark.createDataFrame(rows, SCHEMA), kept=F.col("n_chars") + 1)
    assert listed.columns == ["doc_id", "source", "place", "leaf", "path", "subroot", "root", "kept"]
    got = listed.select(merkle.folded("leaf", "path").alias("h"), "root", "doc_id", "kept", "place").collect()
    assert all(r["h"] == r["root"] and r["kept"] == r["doc_id"] + 1 and r["place"] == r["doc_id"] // 4 for r in got)


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(spark, connect(sf), sf, "op13", queries.QUERIES["op13_merkle_manifest"], merkle.REPORT_SQL) is None
