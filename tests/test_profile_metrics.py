"""Profiles, splits, ranking metrics and drift against direct computation on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import correlate, drift, metrics, ordered, profile, scoring, splits


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(5)
    n = 400
    a = rng.normal(1e6, 1.0, n)
    b = a * 2 + rng.normal(0, 0.1, n)
    c = rng.normal(0, 1, n)
    data = []
    for i in range(n):
        data.append((
            i,
            float(a[i]),
            float(b[i]) if i % 7 else None,
            float(c[i]) if i % 5 else None,
            3.5,
            int(c[i] > 0),
        ))
    return spark.createDataFrame(data, "id int, a double, b double, c double, flat double, y int").repartition(5)


def test_correlation_matches_numpy_pairwise(noisy):
    pdf = noisy.toPandas()
    got = {(r["column_i"], r["column_j"]): r["r"] for r in correlate.corr_pairs(noisy, ["a", "b", "c", "flat", "y"]).collect()}
    for (i, j), r in got.items():
        if "flat" in (i, j):
            assert r is None
            continue
        both = pdf[[i, j]].dropna()
        assert r == pytest.approx(np.corrcoef(both[i], both[j])[0, 1], abs=1e-9)
    target = {r["column"]: r["r"] for r in profile.target_corr(noisy, "y", ["a", "b", "c", "flat"]).collect()}
    assert target["flat"] is None and target["c"] == pytest.approx(got[("c", "y")], abs=1e-12)


def test_prune_keeps_the_column_closer_to_the_label(spark, rows):
    pairs = spark.createDataFrame(
        [("a", "b", 0.95), ("a", "c", -0.97), ("b", "c", 0.5), ("d", "e", 0.99), ("f", "g", 0.95)],
        "column_i string, column_j string, r double",
    )
    label = spark.createDataFrame(
        [("a", 0.1), ("b", -0.3), ("c", 0.05), ("d", 0.2), ("e", -0.2), ("f", None), ("g", 0.4)], "column string, r double"
    )
    # a loses to b and beats c; d and e tie, so the earlier goes; f is unknown, so the earlier goes
    assert rows(correlate.corr_prune(pairs, label)) == [("a",), ("c",), ("d",), ("f",)]


def test_quasi_constant_counts_null_as_a_value(spark, rows):
    df = spark.range(1000).selectExpr(
        "id",
        "if(id < 5, 'x', NULL) AS mostly_null",
        "if(id < 5, 1.5, 2.5) AS mostly_value",
        "if(id < 20, 1, 2) AS mixed",
        "true AS constant",
    )
    got = dict(rows(profile.quasi_constant_columns(df)))
    assert got == {"mostly_null": 0.995, "mostly_value": 0.995, "constant": 1.0}
    assert rows(profile.constant_columns(df)) == [("constant",)]


def test_exact_quantiles_interpolate(spark):
    values = [float(v) for v in [5, 1, 1, 9, 2, 7, 7, 7, 3, 100]]
    df = spark.createDataFrame([(v, None if i % 3 else v) for i, v in enumerate(values)], "x double, y double")
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["feature"]: r for r in ordered.exact_quantiles(df, ["x", "y"], probabilities).collect()}
    known = {"x": values, "y": values[::3]}
    for name, v in known.items():
        assert got[name]["count"] == len(v)
        for i, p in enumerate(probabilities):
            assert got[name][f"q{i}"] == pytest.approx(np.quantile(v, p))


def test_quantiles_of_many_values_inside_their_brackets(spark):
    rng = np.random.default_rng(9)
    n = 20_011
    skewed = np.round(np.exp(rng.normal(0, 3, n)), 3)
    # one value holds a third of the rows, another sits at every end
    skewed[: n // 3] = 2.5
    coded = rng.integers(0, 3, n).astype(float)
    df = spark.createDataFrame(list(zip(skewed.tolist(), coded.tolist(), strict=True)), "skewed double, coded double").repartition(9)
    probabilities = [0.001, 0.25, 0.5, 0.61803, 0.999]
    got = {r["feature"]: r for r in ordered.exact_quantiles(df, ["skewed", "coded"], probabilities).collect()}
    for name, v in {"skewed": skewed, "coded": coded}.items():
        assert got[name]["count"] == n
        for i, p in enumerate(probabilities):
            assert got[name][f"q{i}"] == pytest.approx(np.quantile(v, p), rel=1e-12)


def test_first_rows_by_cut_point(spark, monkeypatch, rows):
    df = spark.range(500).selectExpr("id % 7 AS a", "id AS b").repartition(5)
    want = rows(df.orderBy("a", "b").limit(123))
    monkeypatch.setattr(ordered, "_TOP_IN_ONE_TASK", 10)
    assert rows(ordered.first_rows(df, ["a", "b"], 123)) == want
    assert ordered.first_rows(df, ["a", "b"], 600).count() == 500


def test_prefix_totals_over_many_slices(spark):
    rng = random.Random(3)
    cells = [(g, float(v), rng.randint(1, 9)) for g in "abc" for v in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(cells, "g string, v double, n int")
    got = {(r["g"], r["v"]): (r["n_upto"], r["v_next"]) for r in ordered.prefix_totals(df, ["v"], ["n"], ["g"], with_next=True).collect()}
    for g in "abc":
        total = 0
        mine = sorted((v, n) for h, v, n in cells if h == g)
        for i, (v, n) in enumerate(mine):
            total += n
            following = mine[i + 1][0] if i + 1 < len(mine) else None
            assert got[(g, v)] == (total, following)


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.range(503).selectExpr("id AS k", "CAST(id % 9 = 0 AS INT) AS y").repartition(7)


def test_split_sizes_and_repeatability(labelled, rows):
    got = splits.split_stratified(labelled, "k", "y")
    counts = {(r["split"], r["y"]): r["count"] for r in got.groupBy("split", "y").count().collect()}
    assert counts[("test", 0)] + counts[("test", 1)] == math.ceil(503 * 0.2)
    assert abs(counts[("test", 1)] - 56 * 0.2) < 1
    again = splits.split_stratified(labelled.repartition(3), "k", "y")
    assert rows(got) == rows(again)
    assert rows(got) != rows(splits.split_stratified(labelled, "k", "y", seed=7))


def test_folds_cover_every_row_once_with_even_classes(labelled):
    got = splits.kfold_stratified(labelled, "k", "y").toPandas()
    assert len(got) == 503 and got["fold"].notna().all()
    by_class = got.groupby(["y", "fold"]).size().unstack()
    assert (by_class.max(axis=1) - by_class.min(axis=1) <= 1).all()
    whole = got.groupby("fold").size()
    assert whole.max() - whole.min() <= 1


def test_split_by_key_order(spark):
    df = spark.range(11).selectExpr("id * 3 AS k")
    got = splits.split_by_key_order(df, "k").orderBy("k").collect()
    assert [r["slice"] for r in got] == ["reference"] * 8 + ["current"] * 3


def brute_auc(y, s):
    pairs = [(p > n) + 0.5 * (p == n) for p, a in zip(s, y, strict=True) if a for n, b in zip(s, y, strict=True) if not b]
    return sum(pairs) / len(pairs)


def brute_ap(y, s):
    total, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp = sum(a for a, v in zip(y, s, strict=True) if v >= t)
        recall = tp / sum(y)
        total += (recall - last) * tp / sum(v >= t for v in s)
        last = recall
    return total


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(11)
    y = [int(rng.random() < 0.3) for _ in range(300)]
    s = [round(min(0.99, max(0.0, rng.gauss(0.4 + 0.2 * a, 0.2))), 2) for a in y]
    s[:4] = [0.46, 0.06, 0.07, 0.29]
    return y, s, spark.createDataFrame(list(zip(range(300), y, s, strict=True)), "id int, y int, s double")


def test_ranking_metrics(scores):
    y, s, df = scores
    ranked = metrics.ranked_cells(df, "y", "s")
    assert metrics.roc_auc(ranked).first()["auc"] == pytest.approx(brute_auc(y, s))
    assert metrics.average_precision(ranked).first()[0] == pytest.approx(brute_ap(y, s))
    reverse = metrics.ranked_cells(df.withColumn("s", -F.col("s")), "y", "s")
    assert metrics.roc_auc(reverse).first()["auc"] == pytest.approx(1 - brute_auc(y, s))


def test_one_class_has_no_auc(scores):
    _, _, df = scores
    only = df.where("y = 0")
    assert metrics.roc_auc(metrics.ranked_cells(only, "y", "s")).first()["auc"] is None


def test_every_threshold_of_the_sweep(scores):
    y, s, df = scores
    got = {r["threshold"]: (r["fn"], r["fp"], r["cost"]) for r in metrics.threshold_sweep(df, "y", "s").collect()}
    assert len(got) == 98
    for t in [0.01 + i * 0.01 for i in range(98)]:
        fn = sum(a == 1 and v < t for a, v in zip(y, s, strict=True))
        fp = sum(a == 0 and v >= t for a, v in zip(y, s, strict=True))
        assert got[t] == (fn, fp, 10 * fn + fp)
    best = metrics.best_threshold(metrics.threshold_sweep(df, "y", "s")).first()
    cheapest = min((c, t) for t, (_, _, c) in got.items())
    assert (best["cost"], best["threshold"]) == (cheapest[0], round(cheapest[1], 2))


def test_grid_position_at_the_thresholds_themselves(spark):
    cuts = metrics.thresholds()
    probes = [x for t in cuts for x in (np.nextafter(t, 0), t, np.nextafter(t, 1))] + [0.0, 1.0]
    df = spark.createDataFrame([(float(p),) for p in probes], "s double")
    for r in df.select("s", metrics.grid_position("s").alias("c")).collect():
        assert r["c"] == sum(t <= r["s"] for t in cuts)


def test_ks_and_wasserstein_match_direct_computation(spark):
    rng = np.random.default_rng(2)
    ref, cur = np.round(rng.normal(0, 1, 300), 1), np.round(rng.normal(0.4, 1, 120), 1)
    data = [("reference", float(v), None, 1.0) for v in ref] + [("current", float(v), float(v), 1.0) for v in cur]
    df = spark.createDataFrame(data, "slice string, f double, one_sided double, same double")
    grid = np.unique(np.concatenate([ref, cur]))
    gap = np.abs((ref[:, None] <= grid).mean(0) - (cur[:, None] <= grid).mean(0))
    ks = {r["feature"]: r["ks"] for r in drift.ks_two_sample(df, ["f", "one_sided", "same"]).collect()}
    assert ks == {"f": pytest.approx(gap.max()), "same": 0.0}
    area = {r["feature"]: r["distance"] for r in drift.wasserstein(df, ["f", "same"]).collect()}
    assert area == {"f": pytest.approx(float((gap[:-1] * np.diff(grid)).sum())), "same": 0.0}


def test_ten_values_are_too_few_for_ks(spark):
    data = [("reference", float(i)) for i in range(50)] + [("current", float(i)) for i in range(10)]
    df = spark.createDataFrame(data, "slice string, f double")
    assert drift.ks_two_sample(df, ["f"]).count() == 0
    assert drift.ks_two_sample(df.unionByName(df.where("f = 3")), ["f"]).count() == 1


@pytest.mark.parametrize("drifted,total,verdict", [(0, 10, "stable"), (2, 10, "watch"), (3, 10, "watch"), (4, 10, "retrain")])
def test_drift_verdict(spark, drifted, total, verdict):
    report = spark.createDataFrame([(int(i < drifted),) for i in range(total)], "drifted int")
    row = drift.drift_summary(report).first()
    assert (row["n_drifted"], row["n_features"], row["verdict"]) == (drifted, total, verdict)


def test_extreme_cases_fall_back(spark):
    df = spark.createDataFrame([(1, 0, 0.35), (2, 0, 0.35), (3, 1, 0.40), (4, 1, 0.2)], "id int, y int, s double")
    got = {r["label"]: (r["id"], r["score"]) for r in scoring.pick_extreme_case(df, "id", "y", "s").collect()}
    assert got == {0: (1, 0.35), 1: (3, 0.40)}
