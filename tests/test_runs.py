"""Stored runs: what is loaded scores like what was fitted; repeated and parallel writes leave one copy."""

import json
import subprocess
import sys
from multiprocessing.pool import ThreadPool

import pytest
from pyspark.sql import functions as F

from riskweave.operators import scoring, training
from riskweave.plans import scoring as plan
from riskweave.sources import runs, sinks

FEATURES = ["AMT x", "b", "c d"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, i % 3 == 0, float(i % 7), None if i % 5 == 0 else float(i % 11), i / 10) for i in range(200)]
    df = spark.createDataFrame(rows, "SK_ID_CURR long, y boolean, a double, b double, c double")
    return training.class_weights(df.toDF("SK_ID_CURR", "y", *FEATURES).withColumn("y", F.col("y").cast("int")), "y")


@pytest.fixture(scope="module")
def model(table):
    return training.logreg_train(FEATURES, "y", 200).fit(table)


def scores(df):
    return {r["SK_ID_CURR"]: (r["score"], r["decision"]) for r in df.collect()}


def test_loaded_champion_scores_like_the_fitted_model(spark, table, model, tmp_path):
    root = str(tmp_path)
    runs.log_run(spark, root, "2024", model, {"auc": 0.7}, {"model_type": "logistic"}, {"split": "stratified"})
    with pytest.raises(ValueError, match="champion"):
        runs.load_run(spark, root)
    runs.set_alias(spark, root, "2024")
    stored = runs.load_run(spark, root)
    assert stored.name == "2024" and stored.features == FEATURES and stored.tags == {"split": "stratified"}
    assert stored.values["auc"] == "0.7" and stored.values["model_type"] == "logistic"
    before = scores(scoring.score_batch(table, model, FEATURES))
    ids = spark.createDataFrame([(3,), (900,), (4,)], "SK_ID_CURR long")
    found, missing = plan.predict(ids, table, stored.model, stored.features)
    assert scores(found) == {k: before[k] for k in (3, 4)} and [r[0] for r in missing.collect()] == [900]
    assert tuple(runs.stored_info(spark, stored, ["model_type", "auc", "none"]).first()) == ("logistic", "0.7", None, 3)


FRESH = """
import json, sys
from riskweave.session import local_session
from riskweave.operators import scoring
from riskweave.sources import runs
spark = local_session(2, 2)
stored = runs.load_run(spark, sys.argv[1])
out = scoring.score_batch(spark.read.parquet(sys.argv[2]), stored.model, stored.features)
print("SCORES", json.dumps([[r["SK_ID_CURR"], r["score"], r["decision"]] for r in out.collect()]))
"""


def test_a_fresh_session_scores_the_same(spark, table, model, tmp_path):
    root, rows = str(tmp_path / "registry"), str(tmp_path / "rows")
    runs.log_run(spark, root, "m", model, {})
    runs.set_alias(spark, root, "m")
    table.write.parquet(rows)
    done = subprocess.run([sys.executable, "-c", FRESH, root, rows], capture_output=True, text=True, timeout=300, check=True)
    got = json.loads(done.stdout.rpartition("SCORES")[2])
    assert {k: (s, d) for k, s, d in got} == scores(scoring.score_batch(table, model, FEATURES))


def test_another_champion(spark, table, model, tmp_path):
    root = str(tmp_path)
    other = training.logreg_train(FEATURES[:2], "y", 200, 0.01).fit(table)
    for name, fitted in (("old", model), ("new", other)):
        runs.log_run(spark, root, name, fitted, {"k": 1})
        runs.set_alias(spark, root, name)
    assert runs.aliased(spark, root) == "new" and runs.load_run(spark, root).features == FEATURES[:2]
    runs.set_alias(spark, root, "old", "fallback")
    assert runs.load_run(spark, root, alias="fallback").features == FEATURES and runs.aliased(spark, root) == "new"
    for missing in (lambda: runs.set_alias(spark, root, "none"), lambda: runs.load_run(spark, root, "none")):
        with pytest.raises(ValueError):
            missing()


def rows_of(spark, path):
    return sorted((r["run"], r["key"], r["value"]) for r in runs.read_runs(spark, path).collect())


def test_writing_a_run_again_replaces_it(spark, tmp_path):
    path = str(tmp_path)
    for value in (1, 2):
        sinks.sink_run_metrics(sinks.run_rows(spark, "7", {"auc": value, **({"old": 1} if value == 1 else {})}), f"{path}/runs")
        sinks.sink_run_metrics(sinks.run_rows(spark, "other", {"auc": 5}), f"{path}/runs")
    assert rows_of(spark, path) == [("7", "auc", "2"), ("other", "auc", "5")]


def test_runs_written_at_the_same_time(spark, tmp_path):
    path = str(tmp_path)
    with ThreadPool(4) as pool:
        pool.map(lambda i: sinks.sink_run_metrics(sinks.run_rows(spark, f"r{i % 4}", {"a": i % 4, "b": 0}), f"{path}/runs"), range(4))
    assert rows_of(spark, path) == sorted((f"r{i}", k, str(i if k == "a" else 0)) for i in range(4) for k in "ab")


def test_a_replaced_run_names_its_new_pipeline(spark, table, model, tmp_path):
    root = str(tmp_path)
    runs.log_run(spark, root, "m", model, {})
    first = runs.load_run(spark, root, "m").values[runs.MODEL_PATH]
    runs.log_run(spark, root, "m", training.logreg_train(["b"], "y", 200).fit(table), {})
    again = runs.load_run(spark, root, "m")
    assert again.values[runs.MODEL_PATH] != first and again.features == ["b"]
