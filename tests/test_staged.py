"""Staged AUC, early stopping and truncation against scores worked out row by row."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskweave.operators import splits, staged, training
from riskweave.session import materialise

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (300, 3))
    y = (x[:, 0] - 0.8 * x[:, 1] * (x[:, 2] > 0) + rng.normal(0, 0.5, 300) > 0.7).astype(int)
    rows = [(i, int(y[i]), float(x[i, 0]), None if i % 11 == 0 else float(x[i, 1]), float(x[i, 2])) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, y int, a double, b double, c double")
    return materialise(splits.kfold_stratified(training.class_weights(df, "y"), "k", "y", 3), "staged")


@pytest.fixture(scope="module")
def model(table):
    return training.gbt_train(FEATURES, "y", trees=14, rate=0.4, leaves=8, min_rows=5).fit(table.where("fold <> 0"))


def auc(score, y):
    pos, neg = score[y == 1][:, None], score[y == 0][None, :]
    return ((pos > neg).sum() + (pos == neg).sum() / 2) / (pos.size * neg.size)


def log_odds(fitted, df):
    return np.array([r[0] for r in fitted.transform(df).orderBy("k").select(vector_to_array("rawPrediction")[1] * 2).collect()])


def test_outputs_add_up_to_the_model(table, model):
    out = staged.tree_outputs(table, model, ["k"]).orderBy("k").collect()
    totals = np.cumsum([r["outputs"] for r in out], 1)
    assert totals.shape == (300, 14)
    assert np.abs(totals[:, -1] - log_odds(model, table)).max() < 1e-9


def test_auc_of_every_round(table, model):
    held_out = table.where("fold = 0")
    outputs = staged.tree_outputs(held_out, model, ["k", "y"])
    rows = outputs.orderBy("k").collect()
    y, totals = np.array([r["y"] for r in rows]), np.cumsum([r["outputs"] for r in rows], 1)
    want = {k + 1: auc(totals[:, k], y) for k in range(14)}
    got = {r["round"]: r["auc"] for r in staged.staged_auc(outputs, "y", 14).collect()}
    assert got == pytest.approx(want)
    part = {r["round"]: r["auc"] for r in staged.staged_auc(outputs, "y", 9, first=5).collect()}
    assert part == pytest.approx({k: want[k] for k in range(6, 10)})
    # the best round over all prefixes, and over those that a search with patience sees
    best, judged = staged.search_rounds(outputs, "y", 14, patience=14, block=4)
    assert best == max(want, key=lambda k: (round(want[k], 12), -k)) and judged.count() == 14


def stopped_by_hand(aucs, patience):
    best = 0
    for k in range(1, len(aucs)):
        if aucs[k] > aucs[best]:
            best = k
        elif k - best >= patience:
            return best + 1, k + 1
    return best + 1, None


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=14), st.integers(1, 5))
def test_patience(spark, values, patience):
    df = spark.createDataFrame([(i + 1, v / 8) for i, v in enumerate(values)], "round int, auc double")
    got = staged.best_round(df, patience).first()
    assert (got["round"], got["stopped"]) == stopped_by_hand(values, patience)


def test_a_search_that_stops_leaves_later_blocks_alone(spark):
    rows = [(i % 2, [float(i % 2), *[-0.01 * (i % 2)] * 99]) for i in range(40)]
    best, judged = staged.search_rounds(spark.createDataFrame(rows, "y int, outputs array<double>"), "y", 100, patience=3, block=10)
    assert best == 1 and judged.count() == 10


def test_truncated_models_score_by_their_first_trees(table, model, tmp_path):
    cut = staged.truncated(model, 5)
    totals = np.cumsum([r["outputs"] for r in staged.tree_outputs(table, model, ["k"]).orderBy("k").collect()], 1)
    assert len(cut.stages[-1].treeWeights) == 5 and len(model.stages[-1].treeWeights) == 14
    assert np.abs(log_odds(cut, table) - totals[:, 4]).max() < 1e-9
    cut.write().save(str(tmp_path / "m"))
    assert np.array_equal(log_odds(PipelineModel.load(str(tmp_path / "m")), table), log_odds(cut, table))


def test_early_stopping_keeps_the_best_round(table):
    pipeline = training.gbt_train(FEATURES, "y", trees=10, rate=0.4, leaves=8, min_rows=5)
    fitted, judged = staged.fit_early_stopping(pipeline, table.where("fold <> 0"), table.where("fold = 0"), "y", 2, block=3)
    aucs = [r["auc"] for r in judged.orderBy("round").collect()]
    assert len(fitted.stages[-1].treeWeights) == stopped_by_hand(aucs, 2)[0]
    oof = training.cv_oof(table, lambda _: pipeline, "k", "y", folds=3, patience=2)
    assert oof.count() == 300 and oof.where("score IS NULL").count() == 0


def test_odd_labels(spark, model):
    rows = [(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [0.5, 2.0])]
    df = spark.createDataFrame(rows, "y int, outputs array<double>")
    assert [tuple(r) for r in staged.staged_auc(df, "y", 2).orderBy("round").collect()] == [(1, None), (2, None)]
    assert staged.staged_auc(df.limit(0), "y", 2).collect() == []
    more = spark.createDataFrame([(0, [1.0, 0.0])], df.schema)
    assert [r["auc"] for r in staged.staged_auc(df.unionByName(more), "y", 2).orderBy("round").collect()] == [0.25, 1.0]


def test_two_stage_search(table):
    values = {**training.TREES_SEARCH, "trees": [2, 3], "leaves": [4, 8], "rate": [0.3], "min_rows": [20, 40]}
    rows = training.two_stage_search(table, FEATURES, "y", values, draws=3, folds=3, parallel=3).collect()
    first, second = ([r for r in rows if r["stage"] == n] for n in (1, 2))
    assert len(first) == 3 and [r["auc"] for r in first] == sorted((r["auc"] for r in first), reverse=True)
    best = {k: v if k.endswith("share") else float(v) for k, v in first[0]["params"].items()}
    near = {(float(r["params"]["leaves"]), float(r["params"]["min_rows"])) for r in second}
    leaves, least = best["leaves"], best["min_rows"]
    assert near == {(a, b) for a in (max(4, leaves // 2), leaves, leaves * 2) for b in (max(10, least // 2), least, least * 2)}
    assert all(r["params"][k] == first[0]["params"][k] for r in second for k in ("trees", "rate", "row_share", "column_share"))
    # the centre of the grid is judged once
    centre = next(r for r in second if r["params"] == first[0]["params"])
    assert centre["auc"] == first[0]["auc"]
    again = training.random_search(table, FEATURES, "y", [{k: type(training.TREES_IN_USE[k])(v) for k, v in second[0]["params"].items()}], folds=3)
    assert again.first()["auc"] == pytest.approx(second[0]["auc"])
    assert len(training.draw_candidates(training.TREES_SEARCH)) == training.SEARCH_DRAWS == 30
