"""Collocations against plain Python counting."""

import random
import re
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import phrases, queries

sys.path.insert(0, "tests")
from oracle import compare, connect  # noqa: E402

SCHEMA = "doc_id long, lang string, text string"


def plain(rows, least, top=phrases.TOP):
    counts, totals = Counter(), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 6):
                counts.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    found = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    inner = Counter()
    for p, a in found.items():
        for i in range(1, len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p) - 1:
                    key = (p[0], *p[i:j])
                    inner[key] = max(inner[key], a)
    out = {}
    for p, a in found.items():
        if inner[p] >= a:
            continue
        cuts = []
        for k in range(1, len(p) - 1):
            left, right = counts[p[: k + 1]], counts[(p[0], *p[k + 1 :])]
            cuts.append((1000 * a * totals[p[0]] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return sorted(
        (lang, i + 1, q.decode(), -a, left, right, totals[lang], -s)
        for lang, mine in out.items()
        for i, (s, a, q, left, right) in enumerate(sorted(mine)[:top])
    )


def got(spark, rows, least, top=phrases.TOP, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, phrases.collocations(df, least, top, **options).collect()))


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["Éa", "a-b", " x", "日本"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for i in range(150):
        words = rng.choices(vocabulary, weights, k=rng.randint(0, 80))
        text = "".join(w + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ",", "? "]) for w in words)
        rows.append((i, rng.choice(["en", "de", None, "und"]), text + " Strong Tea for ALL of us"))
    return rows


def test_like_counting(spark, prose):
    want = plain(prose, 4)
    assert len(want) > 50 and any(len(r[2].split(" ")) == 5 for r in want)
    assert got(spark, prose, 4) == want


def test_small_budgets_change_nothing(spark, prose, monkeypatch):
    """Prefixes that are extended to four words, tasks that hand on early, texts cut into stretches."""
    rows = prose + [(999, "en", "the very same five words again " * 3000 + "x" * 9000 + " the very same")]
    want = plain(rows, 4)
    monkeypatch.setattr(phrases, "HELD", 64)
    monkeypatch.setattr(phrases, "SLICE_BYTES", 1000)
    assert got(spark, rows, 4, budget=1) == want


def test_extended_prefixes(spark):
    """Suffixes of one prefix spread over several groups; each node is counted once."""
    rng = np.random.default_rng(3)
    texts = ["the one " + " ".join(f"w{x}" for x in rng.integers(0, 4, 3)) for _ in range(600)] + ["a b"] * 30
    df = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    words = phrases.word_counts(df, 5)
    often = phrases.bit_filter(words.where("word is not null").selectExpr("key AS h"), 10)
    pairs = phrases.prefix_counts(df, often).where("n >= 5")
    begins = phrases.bit_filter(pairs.select("h"), pairs.count())
    extended, groups = phrases.partition(df, often, begins, pairs, 50)
    assert [len(e) for e in extended][0] > 1 and len(extended) > 1 and groups > 2
    leaves = phrases.suffixes(df, often, begins, extended, groups)
    assert {r["depth"] for r in leaves.collect()} >= {2, 4} and leaves.select("grp").distinct().count() > 10
    names = {r["key"]: r["word"] for r in words.collect()}
    found = {tuple(names[k] for k in r["words"]): r["n"] for r in phrases.subtrees(leaves, 5).collect()}
    want = Counter()
    for t in texts:
        w = t.split()
        want.update(tuple(w[i : i + m]) for m in range(2, 6) for i in range(len(w) - m + 1))
    assert found == {k: n for k, n in want.items() if n >= 5}


def test_ranks_and_ties(spark):
    rows = [(i, "en", f"b{i % 20} c{i % 20}. é{i % 20} ü{i % 20}") for i in range(100)]
    want = plain(rows, 5, 7)
    assert len(want) == 7 and len({r[-1] for r in want}) == 1
    assert got(spark, rows, 5, 7) == want


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "en", ""), (1, "en", " . \t"), (2, "en", "a a a a a a a"), (2, "en", "a a a a a a a"), (3, "", "A,a b\x0bb a\x0cc")]
    assert got(spark, rows, 2) == plain(rows, 2)
    assert got(spark, [], 1) == []
    clash = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("n", "words", "key", "word", "w1", "grp", "rank")])
    assert sorted(map(tuple, phrases.collocations(clash, 2).collect())) == plain(rows, 2)


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(spark, connect(sf), sf, "op11", queries.QUERIES["op11_phrase_collocations"], phrases.COLLOCATIONS_SQL) is None
