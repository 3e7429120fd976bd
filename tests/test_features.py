"""Missing-value and subset rules of the feature expressions, on tables written by hand."""

import math

import pytest
from pyspark.sql import functions as F

from riskweave.functions import naming
from riskweave.functions import numeric as N
from riskweave.operators import encode, history
from riskweave.plans import features as P

INF = float("inf")


def test_ratio_keeps_infinity_until_cleaned(spark, rows):
    df = spark.createDataFrame(
        [(1, 4.0, 2.0), (2, 4.0, 0.0), (3, -4.0, 0.0), (4, 0.0, 0.0), (5, None, 2.0), (6, 4.0, None)],
        "k int, a double, b double",
    )
    got = rows(df.select("k", N.ratio_ieee("a", "b").alias("r")))
    assert got == [(1, 2.0), (2, INF), (3, -INF), (4, None), (5, None), (6, None)]
    cleaned = rows(df.select("k", N.finite_or_null(N.ratio_ieee("a", "b")).alias("r")))
    assert [r for _, r in cleaned] == [2.0, None, None, None, None, None]


def test_infinity_poisons_the_aggregate(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (1, 1.0, 2.0)], "k int, a double, b double")
    ratio = df.select("k", N.ratio_ieee("a", "b").alias("r"))
    row = history.rollup(ratio, "k", {"r": ["max", "mean", "sum", "var"]}).first()
    assert row["r_MAX"] == row["r_MEAN"] == row["r_SUM"] == INF
    assert math.isnan(row["r_VAR"])


def test_group_of_nulls_group_of_one_and_null_key(spark):
    df = spark.createDataFrame(
        [(1, None), (1, None), (2, 5.0), (None, 7.0)], "k int, x double"
    )
    spec = {"x": ["min", "max", "mean", "sum", "var", "size", "nunique"]}
    got = {r["k"]: r for r in history.rollup(df, "k", spec).collect()}
    assert set(got) == {1, 2}
    assert (got[1]["x_SUM"], got[1]["x_SIZE"], got[1]["x_NUNIQUE"], got[1]["x_MEAN"]) == (0.0, 2, 0, None)
    assert (got[2]["x_SUM"], got[2]["x_VAR"], got[2]["x_MIN"]) == (5.0, None, 5.0)


def test_absent_subset_is_null_not_zero(spark):
    df = spark.createDataFrame(
        [(1, "A", 2.0), (1, "B", 3.0), (2, "B", 4.0), (3, "A", None)], "k int, status string, x double"
    )
    spec = {"x": ["sum", "size", "max", "nunique"]}
    got = {r["k"]: r for r in history.rollup(df, "k", spec, subsets={"A_": "status <=> 'A'"}).collect()}
    assert (got[1]["A_x_SUM"], got[1]["A_x_SIZE"], got[1]["A_x_NUNIQUE"]) == (2.0, 1, 1)
    assert all(got[2][c] is None for c in ("A_x_SUM", "A_x_SIZE", "A_x_MAX", "A_x_NUNIQUE"))
    assert (got[3]["A_x_SUM"], got[3]["A_x_SIZE"], got[3]["A_x_MAX"]) == (0.0, 1, None)


def test_one_hot_null_column_unseen_value_and_awkward_names(spark):
    df = spark.createDataFrame([(1, "x"), (2, "it's a\\b"), (3, None)], "k int, c string")
    domain = encode.fit_domain(df)
    assert domain == {"c": ["it's a\\b", "x"]}
    got = encode.one_hot(df, domain).orderBy("k")
    assert got.columns == ["k", "c_it's a\\b", "c_x", "c_nan"]
    assert [tuple(r)[1:] for r in got.collect()] == [(0, 1, 0), (1, 0, 0), (0, 0, 1)]
    unseen = spark.createDataFrame([(4, "new")], "k int, c string")
    assert tuple(encode.one_hot(unseen, domain).first())[1:] == (0, 0, 0)
    no_null = encode.one_hot(df, domain, dummy_na=False)
    assert "c_nan" not in no_null.columns
    # the null column exists although nothing is null
    full = df.where("c IS NOT NULL")
    assert encode.one_hot_encoder(full)[1][-1] == "c_nan"


def test_category_shares_add_up_to_one(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (1, "b"), (2, "a")], "k int, c string")
    for r in encode.one_hot_rate(df, "k").collect():
        assert sum(r[c] for c in r.asDict() if c != "k") == pytest.approx(1.0)


def test_too_many_categories_are_refused(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError, match="more than 10"):
        encode.fit_domain(df, max_categories=10)


def test_labels_follow_the_lowest_key(spark):
    df = spark.createDataFrame([(3, "M"), (1, "F"), (2, None), (4, "F")], "k int, g string")
    got = {r["k"]: r["g"] for r in encode.label_encode(df, ["g"], "k").collect()}
    assert got == {1: 0, 2: -1, 3: 1, 4: 0}


def test_invalid_gender_goes_and_unknown_stays(spark):
    df = spark.createDataFrame([(1, "XNA"), (2, None), (3, "M"), (4, "F")], "k int, g string")
    assert {r["k"] for r in df.where(N.not_sentinel("g")).collect()} == {2, 3, 4}


def test_sentinel(spark):
    df = spark.createDataFrame([(1, 365243), (2, None), (3, -100)], "k int, d int")
    got = df.select("k", N.sentinel_flag("d").alias("f"), N.sentinel_to_null("d").alias("d")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 1, None), (2, 0, None), (3, 0, -100)]


def test_late_early_and_unpaid_instalments(spark):
    df = spark.createDataFrame(
        [(1, 10.0, 15.0), (2, 10.0, 4.0), (3, 10.0, 10.0), (4, 10.0, None)],
        "k int, DAYS_INSTALMENT double, DAYS_ENTRY_PAYMENT double",
    ).selectExpr("*", "5D AS AMT_PAYMENT", "10D AS AMT_INSTALMENT")
    got = P.payment_columns(df).orderBy("k").select("DPD", "DBD", "LATE_PAYMENT_FLAG").collect()
    assert [tuple(r) for r in got] == [(5.0, 0.0, 1), (0.0, 6.0, 0), (0.0, 0.0, 0), (0.0, 0.0, 0)]


def test_row_statistics_skip_missing_values(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 2.0, 6.0), (2, 1.0, None, 3.0), (3, None, 2.0, None), (4, None, None, None)],
        "k int, a double, b double, c double",
    )
    got = df.select("k", N.row_mean("a", "b", "c").alias("m"), N.row_std("a", "b", "c").alias("s")).orderBy("k").collect()
    assert [r["m"] for r in got] == [3.0, 2.0, 2.0, None]
    assert got[0]["s"] == pytest.approx(math.sqrt(7))
    assert got[1]["s"] == pytest.approx(math.sqrt(2))
    assert got[2]["s"] is None and got[3]["s"] is None


def test_all_columns_rollup_of_dummies(spark):
    df = spark.createDataFrame([(1, "a", True), (1, "b", False), (1, "a", True), (2, "a", True)], "k int, c string, f boolean")
    got = {r["k"]: r for r in history.rollup_all_columns(df, "k", {"c": ["a", "b"]}, "CC_", "CC_COUNT").collect()}
    one = got[1]
    assert (one["CC_c_a_MIN"], one["CC_c_a_MAX"], one["CC_c_a_SUM"]) == (0, 1, 2)
    assert one["CC_c_a_MEAN"] == pytest.approx(2 / 3) and one["CC_c_a_VAR"] == pytest.approx(1 / 3)
    assert one["CC_f_SUM"] == 2 and one["CC_COUNT"] == 3
    assert got[2]["CC_c_a_VAR"] is None and got[2]["CC_c_a_MIN"] == 1


def test_left_joins_keep_every_client_once(spark):
    from riskweave.queries.bindings import sources

    data = sources(spark, "/root/testdata/sf0.001")
    built = P.build_dataset(data)
    clients = data["application"].where(N.not_sentinel("CODE_GENDER"))
    assert built.count() == clients.count() == built.select("SK_ID_CURR").distinct().count()


def test_clean_names_and_collisions(spark):
    assert naming.clean_name("Cash loans (X)") == "Cash_loans_X_"
    df = spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int")
    with pytest.raises(ValueError, match="a_b"):
        naming.clean_columns(df)


def test_a_hot_client_is_combined_before_the_shuffle(spark):
    """One client with nearly all rows reaches the reducers as one row per task."""
    df = spark.range(200_000).selectExpr("if(id % 100 = 0, id, -1) AS k", "CAST(id AS DOUBLE) AS x")
    plan = history.rollup(df, "k", {"x": ["sum", "var"]})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 2
    assert plan.index("partial_") > plan.index("Exchange")


def test_joined_rows_travel_before_they_are_aggregated(spark, monkeypatch):
    """One exchange, of the rows themselves; with a hot client they are combined before it."""
    names = ["NUM_INSTALMENT_VERSION", "DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT", "AMT_INSTALMENT", "AMT_PAYMENT"]
    rows = spark.range(0, 2000, 1, 4).selectExpr("IF(id % 40 = 0, NULL, id % 30) AS SK_ID_CURR", *[f"CAST(id % {7 + i} AS DOUBLE) AS {c}" for i, c in enumerate(names)])

    def built():
        df = P.installment_features(rows, {})
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"), sorted(map(tuple, df.collect()))

    n, found = built()
    assert n == 1 and len(found) == 30
    monkeypatch.setattr(history, "HOT_ROWS", 10)
    n, again = built()
    assert n == 2 and len(again) == 30
    assert all(a == pytest.approx(b, nan_ok=True) for a, b in zip(found, again, strict=True))
