"""Lookup, decision, explanation and the scoring log, batch and stream."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from riskweave.operators import explain, scoring
from riskweave.sources import readers, sinks
from riskweave.streaming import logs


@pytest.fixture(scope="module")
def features(spark):
    return spark.createDataFrame(
        [(100002, 0.5, 0.6, 300000.0), (100003, None, 0.7, 250000.0)],
        "SK_ID_CURR long, EXT_SOURCE_1 double, EXT_SOURCE_2 double, AMT_CREDIT double",
    )


def ids_of(spark, *values):
    return spark.createDataFrame([([str(v) for v in values],)], "client_ids array<string>")


def test_requested_ids(spark, features):
    ids = scoring.request_ids(ids_of(spark, 100002, 100003, 999999, "not_an_int"))
    bad = [r["raw"] for r in ids.where("NOT valid").collect()]
    assert bad == ["not_an_int"]
    good = ids.where("valid").select("SK_ID_CURR")
    assert {r["SK_ID_CURR"] for r in scoring.lookup_batch(good, features).collect()} == {100002, 100003}
    assert [r["SK_ID_CURR"] for r in scoring.lookup_not_found(good, features).collect()] == [999999]
    assert scoring.lookup_found(good, features).count() == 2


def test_single_id_is_a_list_of_one_and_empty_list_is_empty(spark, features):
    one = spark.createDataFrame([(100002,)], "id long").select(scoring.as_id_list("id").alias("client_ids"))
    assert scoring.request_ids(one).count() == 1
    none = scoring.request_ids(ids_of(spark)).select("SK_ID_CURR")
    assert scoring.lookup_batch(none, features).count() == 0
    assert scoring.lookup_not_found(none, features).count() == 0


def test_a_client_asked_for_twice_is_answered_twice(spark, features):
    ids = scoring.request_ids(ids_of(spark, 100002, 100002)).select("SK_ID_CURR")
    assert scoring.lookup_batch(ids, features).count() == 2


def test_decision_uses_the_unrounded_score(spark):
    df = spark.createDataFrame([(0.65,), (0.15,), (0.46,), (0.459996,)], "p double")
    got = [tuple(r) for r in scoring.answer(df, F.col("p"), ["p"]).select("score", "decision").collect()]
    assert got == [(0.65, "refusé"), (0.15, "accordé"), (0.46, "refusé"), (0.46, "accordé")]


def test_sparse_and_empty_maps(spark):
    df = spark.createDataFrame(
        [(1, {"a": 1.0, "extra": 9.0}), (None, {}), (3, {"b": None})], "client_id long, features map<string,double>"
    )
    got = [tuple(r) for r in scoring.features_from_map(df, "features", ["a", "b"], ["client_id"]).collect()]
    assert got == [(1, 1.0, None), (None, None, None), (3, None, None)]


def test_factors(spark):
    df = spark.createDataFrame(
        [(1, "a", 0.15), (1, "b", -0.08), (1, "c", 0.05), (2, "a", 0.0)], "id int, feature string, contribution double"
    )
    top = explain.topk_abs(df, ["id"], 2)
    arrays = {r["id"]: [tuple(f) for f in r["top_factors"]] for r in explain.factor_arrays(top, ["id"]).collect()}
    assert arrays == {1: [("a", 0.15, "défavorable"), ("b", -0.08, "favorable")], 2: [("a", 0.0, "favorable")]}
    with pytest.raises(ValueError):
        explain.topk_abs(df, ["id"], 51)


def test_statistics_of_nobody(spark):
    empty = spark.createDataFrame([], "score double, decision string")
    missing = spark.createDataFrame([(9,)], "id long")
    row = scoring.group_stats_report(empty, missing).first().asDict()
    assert row["total_not_found"] == 1 and row["refusal_rate"] == 0.0 and row["avg_score"] == 0.0


def test_sorted_table_prunes_on_lookup(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.sink_table(spark.range(1000).selectExpr("id AS SK_ID_CURR", "id * 2 AS x"), path)
    found = readers.point_lookup(spark, path, 77)
    assert [tuple(r) for r in found.collect()] == [(77, 154)]
    assert "PushedFilters: [IsNotNull(SK_ID_CURR), EqualTo(SK_ID_CURR,77)]" in found._jdf.queryExecution().toString()


def test_csv_by_name_and_fallback(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.createDataFrame([(1, None, "x"), (2, 2.5, "y")], "b int, a double, other string").coalesce(1).write.option(
        "header", True
    ).csv(path)
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.IntegerType())])
    got = readers.scan_parquet(spark, str(tmp_path / "absent"), path, schema)
    assert {tuple(r) for r in got.collect()} == {(None, 1), (2.5, 2)}
    with pytest.raises(ValueError, match="lacks"):
        readers.scan_csv(spark, path, T.StructType([T.StructField("zzz", T.IntegerType())]))


CALL = {
    "timestamp": "2026-01-01T10:05:00+00:00",
    "level": "INFO",
    "endpoint": "/predict",
    "n_requested": 3,
    "n_scored": 2,
    "n_not_found": 1,
    "predictions": [
        {"client_id": 1, "score": 0.65, "decision": "refusé"},
        {"client_id": 2, "score": 0.15, "decision": "accordé"},
    ],
    "not_found": [9],
    "latency_ms": 12.5,
}
NEW = {
    "timestamp": "2026-01-01T10:50:00+00:00",
    "level": "INFO",
    "endpoint": "/predict/new",
    "client_id": None,
    "score": 0.5,
    "decision": "refusé",
    "n_features": 4,
    "latency_ms": 3.0,
}


def test_log_lines_of_every_kind(spark):
    lines = spark.createDataFrame([(json.dumps(CALL),), (json.dumps(NEW),), ("free text",), ('{"level": "INF',)], "value string")
    got = readers.log_source_json(lines).collect()
    assert [r["message"] for r in got] == [None, None, "free text", '{"level": "INF']
    assert [r["is_text"] for r in got] == [False, False, True, True]
    measured = {r["endpoint"]: r for r in logs.call_measures(readers.log_source_json(lines)).collect()}
    assert set(measured) == {"/predict", "/predict/new"}
    call, new = measured["/predict"], measured["/predict/new"]
    assert (call["n_scored"], call["n_refused"], call["n_not_found"], call["score_sum"]) == (2, 1, 1, pytest.approx(0.8))
    assert (new["n_scored"], new["n_refused"], new["n_not_found"], new["score_sum"]) == (1, 1, 0, 0.5)


def test_a_large_call_is_spread_over_lines_and_stays_whole(spark):
    scored = spark.range(2500).selectExpr("'big' AS call", "id AS position", "7L AS client_id", "0.5D AS score", "'refusé' AS decision")
    missing = spark.range(2500, 2600).selectExpr("'big' AS call", "id AS position", "id AS client_id")
    lines = sinks.call_entries(scored, missing, "call").collect()
    assert len(lines) == 3
    assert sum(r["n_scored"] for r in lines) == 2500 and sum(r["n_not_found"] for r in lines) == 100
    assert sum(len(r["predictions"]) for r in lines) == 2500


def write_lines(folder, name, records):
    """A log file; files are streamed by age, so each is made a minute younger than the last."""
    age = 60 * (100 - len(list(folder.iterdir())))
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in records))
    then = time.time() - age
    os.utime(folder / name, (then, then))


def test_late_rows_are_dropped_and_windows_close(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    at = lambda h, m=0, **k: {**NEW, "timestamp": f"2026-01-01T{h:02d}:{m:02d}:00+00:00", **k}
    write_lines(folder, "1.json", [at(1), at(1, 30), CALL])
    write_lines(folder, "2.json", [at(20)])
    write_lines(folder, "3.json", [at(1, 45), at(20, 10)])
    measures = logs.call_measures(logs.stream_log_ingest(spark, str(folder), files_per_batch=1))
    closed = logs.run_append(logs.stream_stats(measures), str(tmp_path / "out"))
    got = {r["window_start"].hour: (r["total_requests"], r["total_clients_scored"]) for r in closed.collect()}
    # 01:45 arrives when the watermark already stands at 18:00; the 20:00 window is still open
    assert got == {1: (2, 2), 10: (1, 2)}


def test_replayed_rows_count_once(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    write_lines(folder, "1.json", [CALL, NEW, CALL])
    write_lines(folder, "2.json", [NEW])
    records = logs.stream_log_ingest(spark, str(folder), files_per_batch=1)
    once = logs.run_append(logs.stream_dedup(records, ["timestamp", "endpoint"]), str(tmp_path / "out"))
    assert once.count() == 2


def test_stream_equals_batch_in_any_number_of_batches(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    for i in range(4):
        write_lines(folder, f"{i}.json", [{**NEW, "timestamp": f"2026-01-01T10:{i}{j}:00+00:00", "score": j / 10} for j in range(10)])
    batch = logs.stream_stats(logs.call_measures(readers.log_source_json(spark.read.text(str(folder)))), "10 minutes")
    stream = logs.stream_stats(logs.call_measures(logs.stream_log_ingest(spark, str(folder), 1)), "10 minutes")
    latest = logs.run_latest(stream, ["window_start", "window_end"], str(tmp_path / "out"))
    assert sorted(map(tuple, latest.collect())) == sorted(map(tuple, batch.collect()))
