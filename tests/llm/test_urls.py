import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from riskweave.llm import urls

LABELS = "doc_id long, quality int, toxic int"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([i for i, c in enumerate(path) if c in "?#"], default=len(path))]


def fixed(host, path):
    fits = [r for r in urls.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


def test_parts_and_rules(spark):
    rng = random.Random(1)
    odd = [None, "", "no scheme", "://", "a://", "http://X.COM", "http://com/", "http://éÀ.net/es/x", "x://a://b/c", "http://a\nb.com/\n?q#f"]
    hosts = ["example.com", "WWW.example.com", "a.www.example.com", "net", "b.net", "xnet", "example.org", "com"]
    paths = ["", "/", "/en/", "/en", "/es/1", "/fr/2?x=/en/", "#/en/", "?/es/"]
    rows = odd + [f"https://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(120)]
    rows = [(i, u) for i, u in enumerate(rows)] + [(None, "http://b.net/es/"), (3, "http://b.net/es/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("tokens", F.lit(2))
    got = urls.judge(pages, spark.createDataFrame([], LABELS)).collect()
    want = []
    for i, u in rows:
        host, path = split(u)
        rule = fixed(host, path)
        want.append((i, host, path, rule and rule[1] + rule[2], rule[0] if rule else "allow"))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert urls.judge(pages.limit(0), spark.createDataFrame([], LABELS)).collect() == []
    with pytest.raises(ValueError, match="rules"):
        urls.with_rule(pages, [("allow", "x", str(i)) for i in range(urls.MAX_RULES + 1)])


def brute_rules(sets, support, confidence):
    """Rules from all subsets of the token sets, less those a shorter one says as well."""
    total, found = len(sets), {}
    for items in {c for tokens, _ in sets for n in range(1, 4) for c in combinations(sorted(tokens), n)}:
        have = [bad for tokens, bad in sets if set(items) <= set(tokens)]
        for verdict, flag in (("block", True), ("allow", False)):
            n = have.count(flag)
            if n >= support * total and n / len(have) >= confidence:
                found[items, verdict] = n / len(have)
    less = lambda items: [tuple(x for x in items if x != y) for y in items]
    return {k for k, sure in found.items() if not any(found.get((s, k[1]), -1) >= sure for s in less(k[0]))}


def test_mined_rules(spark):
    rng = random.Random(3)
    sets = []
    for _ in range(600):
        tokens = sorted({rng.choice(["h:shop", "h:blog"]), rng.choice(["p:bet", "p:news"]), rng.choice(["p:de", "p:fr", "p:win"])})
        bad = {"h:shop", "p:bet"} <= set(tokens) and rng.random() < 0.97 or rng.random() < 0.02
        sets.append((tokens, bad))
    df = spark.createDataFrame([*sets, (["p:none"], None)], "tokens array<string>, bad boolean")
    got = urls.mine(df, 0.05, 0.8).collect()
    assert {(tuple(r["items"]), r["verdict"]) for r in got} == brute_rules(sets, 0.05, 0.8)
    assert (("h:shop", "p:bet"), "block") in {(tuple(r["items"]), r["verdict"]) for r in got}
    assert all(r["probe"] in r["items"] for r in got)


def test_held_out_urls(spark):
    rng = random.Random(4)

    def page(i):
        words = [rng.choice(["casino", "hotel"]), rng.choice(["bonus", "news"]), rng.choice(["x", "y"])]
        bad = words[:2] == ["casino", "bonus"]  # neither token is bad alone
        return i, f"http://{rng.choice('pqr')}.example.org/{words[2]}/{words[0]}/{words[1]}/{i}", bad

    made = [page(i) for i in range(1200)]
    labels = spark.createDataFrame([(i, int(not bad), 0) for i, _, bad in made if i < 600], LABELS)
    pages = spark.createDataFrame([(i, u) for i, u, _ in made], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, labels).collect()}
    held = [(got[i] == "block") == bad for i, _, bad in made if i >= 600]
    assert sum(held) / len(held) > 0.95


def test_template_of_many_tokens(spark):
    """Forty tokens that always occur together would alone make 2^40 sets."""
    rng = random.Random(5)
    template = "/".join(f"t{a}{b}" for a in "abcdefgh" for b in "klmno")

    def page(i):
        casino = rng.random() < 0.5
        return i, f"http://example.org/{template if casino else 'plain'}/{rng.choice(['red', 'blue'])}/{i}", casino

    made = [page(i) for i in range(300)]
    labels = spark.createDataFrame([(i, int(not bad), 0) for i, _, bad in made if i < 200], LABELS)
    # one token of the template is enough, as each is a rule of its own
    more = [(900, "http://example.org/tak/red/x"), (901, "http://example.org/other/red/x")]
    pages = spark.createDataFrame([(i, u) for i, u, _ in made] + more, "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, labels).collect()}
    assert all((got[i] == "block") == bad for i, _, bad in made)
    assert got[900] == "block" and got[901] == "allow"


def test_token_classes(spark):
    sets = [(["a", "b", "c", "d"], True)] * 25 + [(["c", "e"], False)] * 30 + [(["f", "g"], True)] * 3 + [(["a"], None)] * 5
    classes = urls.token_classes(spark.createDataFrame(sets, "tokens array<string>, bad boolean"))
    assert sorted(map(tuple, classes.collect())) == [("b", "a"), ("d", "a")]
    named = urls.as_items(spark.createDataFrame([(["b", "c", "d", "z"],), ([],)], "tokens array<string>"), classes)
    assert sorted((r.tokens, r["items"]) for r in named.collect()) == [([], []), (["b", "c", "d", "z"], ["a", "c", "z"])]
