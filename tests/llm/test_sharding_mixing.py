import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from riskweave.llm import mixing, sharding

SF_DIR = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, source string"


@pytest.mark.parametrize("limit", [sharding.LIMIT, 50_000, 3000])
def test_shards_as_in_sql(spark, limit):
    query = lambda s, d: sharding.shards(s.read.parquet(f"{d}/documents.parquet"), limit)
    assert compare(spark, connect(SF_DIR), SF_DIR, "shards", query, sharding.shards_sql(limit)) is None


def test_shards_of_odd_rows(spark):
    rows = [(7, "x" * 100)] * 50 + [(None, "y" * 10)] * 30 + [(i, None) for i in range(100, 120)] + [(1000, "z" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("head", F.lit(1)).withColumn("shard", F.lit(2))
    out = sharding.shards(df, 400).collect()
    assert sorted((r.doc_id or 0, r.n_bytes) for r in out) == sorted((i or 0, len(t or "")) for i, t in rows)
    size, members = Counter(), Counter()
    for r in out:
        size[r.shard] += r.n_bytes
        members[r.shard] += 1
    assert all(size[s] <= 400 or members[s] == 1 for s in size)
    assert all(r.shard_bytes == size[r.shard] and len(r.shard) == r.depth for r in out)
    # no shard is the beginning of another
    assert not any(a != b and b.startswith(a) for a in size for b in size)
    assert sharding.shards(df.limit(0), 400).collect() == []


def test_written_shards(spark, tmp_path):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    placed = {r.doc_id: r.shard for r in sharding.write_shards(df, str(tmp_path / "s"), 50_000).collect()}
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.select(*df.columns).exceptAll(df).isEmpty() and back.count() == df.count()
    assert {r[0]: r[1][1:] for r in back.select("doc_id", F.col("shard_folder").cast("string")).collect()} == placed


def test_written_shards_of_odd_rows(spark, tmp_path):
    rows = [(7, "x" * 100)] * 50 + [(None, "y" * 10)] * 30 + [(i, None) for i in range(100, 120)] + [(1000, "z" * 5000)]
    sharding.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "s"), 400)
    back = spark.read.parquet(str(tmp_path / "s")).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter(rows)
    size, members = Counter(), Counter()
    for r in back:
        size[r.shard_folder] += len(r.text or "")
        members[r.shard_folder] += 1
    assert all(size[s] <= 400 or members[s] == 1 for s in size)


def shares():
    rng = random.Random(4)
    for _ in range(30):
        yield {f"s{i}": rng.randrange(1, 200) for i in range(rng.randrange(1, 9))}


def earliest_deadline_first(share, blocks):
    """Slot by slot: the source of each slot."""
    left, out = dict(blocks), []
    while left:
        cycle, done, start = sum(share[s] for s in left), Counter(), len(out)
        while True:
            t = len(out) - start
            free = [(-(-(done[s] + 1) * cycle // share[s]), s) for s in left if done[s] * cycle // share[s] <= t]
            s = min(free)[1]
            out.append(s)
            done[s] += 1
            if done[s] == left[s]:
                break
        left = {s: n - done[s] for s, n in left.items() if n > done[s]}
    return out


def in_order(slots):
    """Source and number of the block of each slot."""
    out = sorted((t, s, j) for s, own in slots.items() for j, t in enumerate(own))
    assert [t for t, *_ in out] == list(range(len(out)))
    return [(s, j) for _, s, j in out]


def test_schedule_is_earliest_deadline_first():
    rng = random.Random(5)
    for share in shares():
        blocks = {s: rng.randrange(0, 900) for s in share}
        got = in_order(mixing.schedule(share, blocks))
        assert [s for s, _ in got] == earliest_deadline_first(share, {s: n for s, n in blocks.items() if n})
        assert Counter(s for s, _ in got) == Counter({s: n for s, n in blocks.items() if n})


@pytest.mark.parametrize("slots", [3000, 458_000])
def test_sources_stay_within_one_block_of_the_true_weights(slots):
    """Weights of twenty sources that no short cycle meets, over as many slots as 30 GB have."""
    rng = random.Random(slots)
    weights = {f"s{i:02}": (1 + rng.random()) ** 0.5 for i in range(19)} | {"rare": 0.0001}
    total = sum(Fraction(w) for w in weights.values())
    exact = {s: Fraction(w) / total for s, w in weights.items()}
    got = in_order(mixing.schedule(mixing.whole_weights(weights), {s: int(slots * w) + 1 for s, w in exact.items()}))
    # until the first source runs dry
    last = {s: max(t for t, (x, _) in enumerate(got) if x == s) for s in weights}
    until = min(last.values()) + 1
    assert until > 0.95 * slots * min(1, 1 - 1 / (slots * float(exact["rare"]) + 1)) or until > 0.9 * slots
    done, share = Counter(), {s: float(w) for s, w in exact.items()}
    for t, (s, _) in enumerate(got[:until], 1):
        done[s] += 1
        if t % 97 == 0 or t > until - 100:
            assert all(abs(done[x] - t * share[x]) < 1 + 1e-6 for x in share)


def test_whole_weights_are_exact():
    weights = {"a": 0.1, "b": 1 / 3, "c": 2, "d": Fraction(1, 7)}
    whole = mixing.whole_weights(weights)
    assert all(Fraction(whole[s], whole["c"]) == Fraction(w) / 2 for s, w in weights.items())


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randrange(200), rng.choice("aaab")) for i in range(900)]
    rows += [(2000 + i, "y" * 50, None) for i in range(60)] + [(3000, None, "c"), (3001, "", "c"), (None, "z" * 5000, "c")]
    rows += [(1, "same", "a")] * 3
    df = spark.createDataFrame(rows, DOCUMENTS).withColumn("slot", F.lit(1)).withColumn("cell", F.lit(2))
    weights = {"a": 2, "b": 1, None: 1, "c": 0.5}
    out = mixing.mix(df, weights, 1000).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in out) == Counter(rows)
    slots, per = {}, defaultdict(set)
    for r in out:
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
        per[r.source].add((r.block, r.slot))
    total = Counter()
    for i, t, s in rows:
        total[s] += len(t or "")
    blocks = {s: -(-n // 1000) for s, n in total.items()}
    want = earliest_deadline_first(mixing.whole_weights({f"s{s}" if s else "n": w for s, w in weights.items()}), {f"s{s}" if s else "n": n for s, n in blocks.items()})
    seen = Counter()
    for t, name in enumerate(want):
        if t in slots:
            assert slots[t] == (None if name == "n" else name[1:], seen[name])
        seen[name] += 1
    assert max(slots) < len(want)
    for order in per.values():
        assert [b for b, _ in sorted(order)] == [b for b, _ in sorted(order, key=lambda x: x[1])]
    assert mixing.mix(df.limit(0)).collect() == []
    stream = mixing.mixed_stream(df.drop("cell"))
    assert stream.columns == ["doc_id", "text", "source", "slot"] and stream.count() == len(rows)
    with pytest.raises(ValueError, match="weight"):
        mixing.mix(df, {"a": 1})


def test_mix_of_a_hot_source_and_clashing_columns(spark):
    rows = [(i, "x" * 20, "hot" if i % 3 else f"s{i % 40}") for i in range(9000)]
    names = ("mix_source", "mix_unit", "_source", "_unit", "row", "own_source", "last", "cell", "n")
    df = spark.createDataFrame(rows, DOCUMENTS).select("*", *[F.lit(c).alias(c) for c in names], F.create_map(F.lit(1), F.lit(2)).alias("m"))
    out = mixing.mix(df, block_bytes=500)
    assert out.columns == [*df.columns, "start_byte", "block", "slot"]
    got = out.collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(rows) and all(r["_unit"] == "_unit" and r["m"] == {1: 2} for r in got)
    ends = defaultdict(list)
    for r in got:
        ends[r.source].append((r.start_byte, r.block))
    for own in ends.values():
        assert [b for b, _ in sorted(own)] == [20 * k for k in range(len(own))] and all(j == b // 500 for b, j in own)


def test_blocks_grow_with_the_input(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_BLOCKS", 10)
    df = spark.createDataFrame([(i, "x" * 100, "ab"[i % 2]) for i in range(200)], DOCUMENTS)
    assert {r.slot for r in mixing.mix(df, block_bytes=100).collect()} == set(range(10))


def test_any_column_name(spark, tmp_path):
    rows = [(i % 3 or None, "x" * (10 * i), f"s{i % 2}") for i in range(12)]
    names = ["own", "shard_row", "shard", "prefix", "bits", "mix_source", "mix_unit", "own_source", "own_unit", "_source", "_unit", "row", "cell"]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.concat(F.lit(c), "text") for c in names})
    sharding.write_shards(df, str(tmp_path / "s"), 200)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert set(back.columns) == {*df.columns, "shard_folder"}
    for out in (back, mixing.mix(df), mixing.mixed_stream(df)):
        got = out.select("doc_id", "text", "source", *names).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, df.collect()), key=repr)
