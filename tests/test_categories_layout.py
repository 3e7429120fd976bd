"""Categories kept in tables, and tables kept in buckets."""

import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from riskweave.operators import category_table as C
from riskweave.operators import encode, history
from riskweave.plans import features as P
from riskweave.sources import layout

ROWS = [(1, "a", "x"), (1, "a", None), (1, None, "y"), (2, "b", "x"), (3, None, None), (None, "a", "z"), (4, "nan", "x")]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "k int, c string, `d e` string")


def test_shares_equal_the_dense_form(table):
    dense = {r["k"]: r.asDict() for r in encode.one_hot_rate(table, "k", {"c": ["a", "b"], "d e": ["x", "y"]}).collect()}
    maps = C.share_maps(table, "k").withColumns({"sa": C.share_of("c", "a"), "sx": C.share_of("d e", "x")}).collect()
    assert {r["k"] for r in maps} == set(dense) == {1, 2, 3, 4}
    for r in maps:
        d = dense[r["k"]]
        for column, values in (("c", "ab"), ("d e", "xy")):
            assert {v: r[column].get(v, 0.0) for v in values} == {v: d[f"{column}_{v}_MEAN"] for v in values}
            assert r[column + C.MISSING] == d[f"{column}_nan_MEAN"]
        assert (r["sa"], r["sx"]) == (d["c_a_MEAN"], d["d e_x_MEAN"])
    # a category called like the missing one is still a category
    assert next(r for r in maps if r["k"] == 4)["c"] == {"nan": 1.0}
    rows = {(r["k"], r["column"], r["category"]): (r["n"], r["share"]) for r in C.share_rows(table, "k").collect()}
    assert rows[(1, "c", "a")] == (2, 2 / 3) and rows[(1, "c", None)] == (1, 1 / 3) and rows[(3, "d e", None)] == (1, 1.0)


def test_codes_equal_those_of_the_collected_form(spark, table):
    columns, table = ["c", "d e"], table.where("k IS NOT NULL")
    want = encode.label_encode(table, columns, "k").collect()
    got = C.label_encode(table, C.label_table(table, columns, "k"), columns)
    assert got.columns == table.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want), key=repr)
    unseen = spark.createDataFrame([(9, "new", None)], table.schema)
    assert [tuple(r) for r in C.label_encode(unseen, C.label_table(table, columns, "k"), columns).collect()] == [(9, -1, -1)]
    assert C.label_table(table.limit(0), columns, "k").collect() == []


def test_a_column_of_a_million_values(spark):
    """A third of the rows share one value, the others have their own."""
    n = 1_500_000
    df = spark.range(n).selectExpr("id AS k", "IF(id % 3 = 0, 'hot', concat('v', id)) AS c")
    with pytest.raises(ValueError, match="more than"):
        encode.fit_labels(df, ["c"], "k")
    labels = C.label_table(df, ["c"], "k")
    coded = C.label_encode(df, labels, ["c"])
    row = coded.agg(F.count_distinct("c"), F.min("c"), F.max("c"), F.sum((F.col("k") % 3 == 0).cast("int") * F.col("c"))).first()
    assert tuple(row) == (1_000_001, 0, 1_000_000, 0)
    # codes follow the lowest key, which here is the order of the rows
    assert coded.where("k % 3 > 0 AND c <> k - k div 3").isEmpty()
    shares = C.share_maps(df.withColumn("k", F.col("k") % 1000), "k")
    assert shares.agg(F.sum(F.size("c"))).first()[0] == 1_000_000 + 1000


# ---- layout -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("layout")
    rng = random.Random(1)
    clients = spark.range(20_000).selectExpr("id * 3 AS SK_ID_CURR", "id % 2 AS TARGET")
    loans = spark.createDataFrame([(3 * rng.randrange(20_000), float(i)) for i in range(30_000)], "SK_ID_CURR long, x double")
    cards = loans.where("x % 2 = 0").withColumnRenamed("x", "y")
    tables = {"clients_t": clients, "loans_t": loans, "cards_t": cards}
    yield {n: layout.store_by_key(df, n, f"{root}/{n}", 8) for n, df in tables.items()}, tables, str(root)
    for name in tables:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def joined(tables):
    blocks = [history.group_count(tables[t], "SK_ID_CURR", n) for t, n in (("loans_t", "n_loans"), ("cards_t", "n_cards"))]
    return P.join_feature_blocks(tables["clients_t"], *blocks)


def test_stored_blocks_join_without_an_exchange(spark, stored):
    got, plain, _ = stored
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = joined(got)
        rows = sorted(map(tuple, df.collect()), key=repr)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") >= 2
        assert "Exchange" in joined(plain)._jdf.queryExecution().executedPlan().toString()
        assert rows == sorted(map(tuple, joined(plain).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_lookups_open_few_files_and_row_groups(spark, stored):
    got, plain, _ = stored
    clients = got["clients_t"]
    assert layout.files_read(clients.groupBy().count()) == 8
    rng = random.Random(2)
    for n in (1, 3, 100):
        ids = [3 * rng.randrange(20_000) for _ in range(n)]
        found = layout.lookup_stored(clients, ids)
        assert sorted(map(tuple, found.collect())) == sorted((i, i // 3 % 2) for i in set(ids))
        assert 1 <= layout.files_read(found) <= min(n, 8)
    missing = layout.lookup_stored(clients, [1, 4])
    assert missing.collect() == [] and layout.lookup_stored(clients, []).collect() == []
    asked = spark.createDataFrame([(3,), (3,), (None,), (7,)], "SK_ID_CURR long")
    assert [tuple(r) for r in layout.lookup_stored(clients, asked).collect()] == [(3, 1)]


def test_many_ids_are_joined(spark, stored, monkeypatch):
    got, plain, _ = stored
    monkeypatch.setattr(layout, "LISTED_IDS", 5)
    asked = spark.range(0, 3000).selectExpr("id AS SK_ID_CURR")
    found = layout.lookup_stored(got["clients_t"], asked)
    assert found.count() == 1000 and "SemiJoin" in found._jdf.queryExecution().optimizedPlan().toString().replace("Join LeftSemi", "SemiJoin")


def test_files_have_bloom_filters_and_order(spark, stored):
    import glob

    import pyarrow.parquet as pq

    _, _, root = stored
    files = glob.glob(f"{root}/clients_t/*.parquet")
    assert len(files) == 8
    for f in files:
        keys = pq.read_table(f)["SK_ID_CURR"].to_pylist()
        assert keys == sorted(keys)
        plain_size = sum(pq.ParquetFile(f).metadata.row_group(0).column(i).total_compressed_size for i in range(2))
        # a filter for a bucket's keys takes at least a byte for each
        assert len(open(f, "rb").read()) - plain_size > len(keys)


OTHER = """
import sys
from riskweave.session import local_session
from riskweave.sources import layout
spark = local_session(2, 2)
df = layout.open_by_key(spark, "clients_t", sys.argv[1], "SK_ID_CURR BIGINT, TARGET BIGINT", 8)
found = layout.lookup_stored(df, [30, 31])
print("FOUND", [tuple(r) for r in found.collect()], layout.files_read(found))
"""


def test_another_session_opens_the_table(stored):
    _, _, root = stored
    done = subprocess.run([sys.executable, "-c", OTHER, f"{root}/clients_t"], capture_output=True, text=True, timeout=300, check=True)
    assert done.stdout.rpartition("FOUND ")[2].strip() in ("[(30, 0)] 1", "[(30, 0)] 2")


def test_names_are_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        layout.store_by_key(spark.range(3), "a; b", str(tmp_path / "x"), 2, "id")


def test_shares_have_tasks_for_their_rows(spark, monkeypatch):
    """The partitions of both exchanges follow from the rows; the adaptive plan does not join them."""
    monkeypatch.setattr(C, "ROWS_PER_TASK", 100)
    df = spark.range(0, 2500, 1, 1).selectExpr("id % 50 AS k", "concat('v', id % 7) AS c", "IF(id % 5 = 0, NULL, 'x') AS d")
    out = C.share_maps(df, "k")
    assert out.rdd.getNumPartitions() == 25
    plain = df.toPandas()
    for r in out.collect():
        own = plain[plain.k == r["k"]]
        assert r["c"] == pytest.approx(own.c.value_counts(normalize=True).to_dict()) and r["d_nan"] == pytest.approx(own.d.isna().mean())
