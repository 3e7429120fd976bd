"""Training, search and tree explanation on a small generated table."""

import itertools
import math
import subprocess
import sys

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from riskweave.operators import splits, training
from riskweave.operators.trees import explain_trees, leaf_tables, model_leaves, row_values, shapley_shares, top_factors
from riskweave.plans import cleaning
from riskweave.queries import modelling
from riskweave.session import materialise

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (240, 3))
    y = (x[:, 0] - 0.8 * x[:, 1] * (x[:, 2] > 0) + rng.normal(0, 0.5, 240) > 0.7).astype(int)
    data = [
        (i, int(y[i]), float(x[i, 0]), None if i % 11 == 0 else float(x[i, 1]), float(x[i, 2])) for i in range(240)
    ]
    df = spark.createDataFrame(data, "k int, y int, a double, b double, c double")
    return materialise(splits.kfold_stratified(training.class_weights(df, "y"), "k", "y", 3), "training")


def test_balanced_weights(table):
    total = {r["y"]: r["w"] for r in table.groupBy("y").agg(F.sum("weight").alias("w")).collect()}
    assert total[0] == pytest.approx(total[1]) and sum(total.values()) == pytest.approx(240)


def test_logistic_regression_solves_the_penalised_problem(table, tmp_path):
    c = 0.1
    model = training.logreg_train(FEATURES, "y", 240, c).fit(table)
    pdf = table.toPandas()
    x = pdf[FEATURES].fillna(pdf[FEATURES].median()).to_numpy()
    x = (x - x.mean(0)) / x.std(0)
    w, b = model.stages[-1].coefficients.toArray(), model.stages[-1].intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    residual = pdf["weight"].to_numpy() * (p - pdf["y"].to_numpy())
    assert np.abs(w + c * x.T @ residual).max() < 1e-4
    assert abs(c * residual.sum()) < 1e-4
    model.write().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    mine = training.score_with(loaded, table, ["k"]).orderBy("k").toPandas()["score"]
    assert np.abs(mine - p[np.argsort(pdf["k"])]).max() < 1e-9


def test_out_of_fold_scores_cover_every_row(table):
    oof = training.cv_oof(table, lambda train: training.logreg_train(FEATURES, "y", 160), "k", "y", folds=3)
    assert oof.count() == 240 and oof.select("k").distinct().count() == 240
    assert oof.where("score IS NULL").count() == 0


def test_grid_search_ranks_all_candidates(table):
    got = training.grid_search(table, FEATURES, "y", 240, [0.001, 0.1], ("l2", "l1"), folds=3).collect()
    assert len(got) == 4
    assert [r["auc"] for r in got] == sorted((r["auc"] for r in got), reverse=True)
    assert {(r["params"]["c"], r["params"]["penalty"]) for r in got} == set(itertools.product(["0.001", "0.1"], ["l2", "l1"]))
    # the candidates really differ: a strong l1 penalty leaves nothing but the intercept
    assert next(r["auc"] for r in got if r["params"] == {"c": "0.001", "penalty": "l1"}) == pytest.approx(0.5)


def test_candidates_are_distinct_and_the_local_grid_is_bounded():
    draws = training.draw_candidates(training.TREES_SEARCH)
    assert len(draws) == 30 == len({tuple(d.items()) for d in draws})
    assert draws == training.draw_candidates(training.TREES_SEARCH)
    near = training.local_grid({"leaves": 200, "min_rows": 12, "trees": 5})
    assert {d["leaves"] for d in near} == {100, 200, 255} and {d["min_rows"] for d in near} == {10, 12, 24}


def brute_shapley(value, covers, met):
    """Definition: average marginal contribution over all orders."""
    m = len(covers)

    def worth(coalition):
        return value * math.prod(met[k] if k in coalition else covers[k] for k in range(m))

    out = [0.0] * m
    for order in itertools.permutations(range(m)):
        seen = set()
        for j in order:
            out[j] += (worth(seen | {j}) - worth(seen)) / math.factorial(m)
            seen.add(j)
    return out


def test_shares_match_the_definition():
    covers = [0.2, 0.7, 0.5, 0.9]
    table = shapley_shares(1.7, np.array(covers))
    for pattern in range(16):
        met = [(pattern >> k) & 1 for k in range(4)]
        assert table[pattern] == pytest.approx(brute_shapley(1.7, covers, met))


def test_tree_values_add_up_to_the_model(spark, table):
    model = training.gbt_train(FEATURES, "y", trees=8, rate=0.3, leaves=8, min_rows=5).fit(table)
    phi = explain_trees(table, model, FEATURES, ["k"])
    from pyspark.ml.functions import vector_to_array

    raw = model.transform(table).select("k", (vector_to_array("rawPrediction")[1] * 2).alias("raw"))
    total = F.aggregate("phi", F.col("base"), lambda acc, v: acc + v)
    gaps = phi.join(raw, "k").select(F.abs(total - F.col("raw")).alias("gap")).toPandas()["gap"]
    assert len(gaps) == 240 and gaps.max() < 1e-9
    leaves, base = model_leaves(spark, model.stages[-1])
    x = np.random.default_rng(1).normal(0, 1, (50, 6))
    kept = row_values(x, leaves, leaf_tables(leaves), 6)
    assert np.allclose(kept, row_values(x, leaves, None, 6))
    assert base == pytest.approx(phi.first()["base"]) and leaves
    best = phi.select(top_factors("phi", FEATURES, 2).alias("f"), "phi").first()
    order = sorted(zip(FEATURES, best["phi"], strict=True), key=lambda p: -abs(p[1]))
    assert [f["feature"] for f in best["f"]] == [f for f, _ in order[:2]]


def test_dummy_prior(table):
    share = table.agg(F.avg("y")).first()[0]
    got = training.dummy_prior(table.where("fold <> 0"), table, "y").select("score").distinct().collect()
    assert len(got) == 1 and abs(got[0]["score"] - share) < 0.02


def test_cleaning_drops_for_each_reason(spark):
    df = spark.range(1000).selectExpr(
        "id AS SK_ID_CURR",
        "CAST(IF(id % 10 = 0, NULL, id % 3 = 0) AS INT) AS TARGET",
        "IF(id < 3, 1.0D, NULL) AS nearly_empty",
        "IF(id < 3, 2, 1) AS nearly_constant",
        "pmod(id * 7919, 997) / 10.0D AS x",
        "pmod(id * 7919, 997) * 2 + IF(id % 3 = 0, 1, 0) AS follows_x",
        "IF(id % 2 = 0, double('inf'), CAST(pmod(id * 31, 101) AS DOUBLE)) AS ratio",
        "id % 4 = 1 AS flag",
    )
    cleaned, plan = cleaning.clean_dataset(df)
    assert plan.high_missing == ["nearly_empty"]
    assert plan.quasi_constant == ["nearly_constant"]
    assert plan.correlated == ["x"]
    assert cleaned.count() == 900
    assert dict(cleaned.dtypes)["flag"] == "int"
    assert cleaned.where("ratio = double('inf')").count() == 0


def test_executors_need_no_copy_of_the_package(tmp_path):
    """What a task runs must load in a Python that cannot import this package."""
    from pyspark import cloudpickle

    from riskweave.operators.moments import _block_sums

    load = "import pickle, sys; pickle.loads(sys.stdin.buffer.read())"
    for work in (row_values, leaf_tables, _block_sums(None)):
        subprocess.run([sys.executable, "-c", load], input=cloudpickle.dumps(work), cwd=tmp_path, check=True)


def test_fits_have_tasks_for_their_rows(spark, monkeypatch):
    """A table in one partition is dealt out for the fit, and its folds are stored in as many parts."""
    monkeypatch.setattr(training, "ROWS_PER_TASK", 100)
    table = spark.range(0, 1000, 1, 1).selectExpr("id AS k", "id % 3 AS fold", "CAST(id % 2 AS INT) AS y", "id % 17 + id % 2 AS x", "1.0D AS weight")
    seen = []
    fit = training.GBTClassifier._fit
    monkeypatch.setattr(training.GBTClassifier, "_fit", lambda self, rows: seen.append((rows.rdd.getNumPartitions(), rows.columns)) or fit(self, rows))
    model = training.gbt_train(["x"], "y", trees=2, leaves=4, min_rows=5).fit(table)
    assert seen == [(10, ["features_vector", "y", "weight"])] and model.transform(table).count() == 1000
    written = []
    write = training.materialise
    monkeypatch.setattr(training, "materialise", lambda df, label: written.append((label, df.rdd.getNumPartitions())) or write(df, label))
    training.cv_oof(table, lambda _: training.gbt_train(["x"], "y", trees=2, leaves=4, min_rows=5), "k", "y", folds=3).count()
    assert written == [("folds", 10)]


def test_gbt_train_boosts_the_whole_baseline(spark, monkeypatch):
    """The registered query fits all trees of the baseline and judges them with the full patience."""
    seen = []

    def watched(pipeline, train, held_out, label, patience):
        classifier = pipeline.getStages()[-1]
        seen.append([classifier.getOrDefault(p) for p in ("maxIter", "stepSize", "maxDepth", "minInstancesPerNode", "subsamplingRate", "featureSubsetStrategy")] + [patience])
        raise InterruptedError

    df = spark.range(100).selectExpr("CAST(id AS INT) AS SK_ID_CURR", "CAST(id % 2 AS INT) AS TARGET", "id % 5 AS fold")
    monkeypatch.setattr(modelling, "folded", lambda *_: df)
    monkeypatch.setattr(modelling.staged, "fit_early_stopping", watched)
    with pytest.raises(InterruptedError):
        modelling.gbt_train(spark, "")
    assert seen == [[1000, 0.05, 5, 20, 0.8, "0.8", 100]]


def test_boosting_cuts_its_lineage(spark):
    """Residuals of many trees are checkpointed, in a session that names no folder for it too."""
    rows = spark.range(0, 60, 1, 1).selectExpr("id AS k", "CAST(id % 2 AS INT) AS y", "id % 17 + id % 2 AS x", "1.0D AS weight")
    assert training.gbt_train(["x"], "y", trees=2, leaves=2, min_rows=5).fit(rows).transform(rows).count() == 60
    assert spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def test_random_search_judges_all_draws(spark, monkeypatch):
    """The registered query draws 30 candidates of all searched values and judges each, and the grid around the best, over five folds."""
    judged, folds = [], []

    class Judge:
        def __init__(self, df, pipeline, label, fold, n, parallel):
            folds.append((n, df.select(fold).distinct().count()))

        def mean_aucs(self, pipelines):
            judged.append([p.getStages()[-1] for p in pipelines])
            return [0.5] * len(pipelines)

    df = spark.range(100).selectExpr("CAST(id AS INT) AS SK_ID_CURR", "CAST(id % 2 AS INT) AS TARGET", "1.0D AS weight")
    monkeypatch.setattr(modelling, "training_table", lambda *_: df)
    monkeypatch.setattr(training, "PreparedFolds", Judge)
    rows = modelling.random_search(spark, "").collect()
    first, second = judged
    assert folds == [(5, 5)] and len(first) == 30
    assert {c.getOrDefault("maxIter") for c in first} == {300, 500}
    assert {c.getOrDefault("maxDepth") for c in first} == {5, 6, 7}
    assert {c.getOrDefault("minInstancesPerNode") for c in first} == {20, 50, 100, 150}
    near = [r for r in rows if r["stage"] == 2]
    assert len([r for r in rows if r["stage"] == 1]) == 30 and len(near) in (6, 9) and len(second) < len(near)
