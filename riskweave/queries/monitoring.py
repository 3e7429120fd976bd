"""The scoring log: JSON lines in and out, windows over the stream, replays, streamed scoring and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring
from ..operators.scoring import REFUSED, linear_score
from ..plans import scoring as score_plan
from ..session import scratch_path
from ..sources import readers, sinks
from ..streaming import drift, logs, requests
from ..streaming import scoring as stream_scoring
from .bindings import source
from .evaluation import INTERCEPT, WEIGHTS, _LINEAR
from .registry import query, table, tidy

# ---- the log as text --------------------------------------------------------------------

# Every event is one call: a new-client score, or free text for an error.
_CALLS = """
SELECT event_id AS call_id, ts, user_id AS client_id, event_type,
  value / (value + 30) AS score, value / 7 AS latency_ms
FROM {events}
"""
_CALLS_SQL = "WITH calls AS (" + _CALLS.format(events="events") + ")"


def calls(spark, sf):
    return spark.sql(_CALLS, events=table(spark, sf, "events"))


def call_lines(spark, sf):
    """JSON lines for scoring calls and plain text for the rest, one line per event."""
    c = calls(spark, sf).withColumn("decision", scoring.decide("score"))
    entries = c.where(F.col("event_type") != "error").withColumn("n_features", F.lit(3))
    time = F.col("ts").cast("timestamp")
    endpoint = F.concat(F.lit("/"), F.col("event_type"))
    record = F.struct(
        F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        F.lit("INFO").alias("level"),
        endpoint.alias("endpoint"),
        "client_id",
        "score",
        "decision",
        "n_features",
        "latency_ms",
    )
    text = c.where(F.col("event_type") == "error").select(
        F.concat(F.lit("call "), F.col("call_id").cast("string"), F.lit(" failed")).alias("value")
    )
    return entries.select(F.to_json(record).alias("value")).unionByName(text)


_RECORDS = """
SELECT CAST(ts AS TIMESTAMP) AS "timestamp", 'INFO' AS level, '/' || event_type AS endpoint, client_id, score,
  CASE WHEN score >= 0.46::DOUBLE THEN 'refusé' ELSE 'accordé' END AS decision, latency_ms, CAST(NULL AS VARCHAR) AS message
FROM calls WHERE event_type <> 'error'
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'call ' || call_id || ' failed' FROM calls WHERE event_type = 'error'
"""


def _shown(records):
    """Log records as compared with SQL: timestamps without a zone."""
    return records.select(
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
        "level",
        "endpoint",
        "client_id",
        "score",
        "decision",
        "latency_ms",
        "message",
    )


@query("log_source_json", _CALLS_SQL + _RECORDS)
def log_source_json(spark, sf):
    return _shown(readers.log_source_json(call_lines(spark, sf)))


@query(
    "log_sink_json",
    _LINEAR
    + """, o AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS call, o_custkey * 2 AS id FROM orders)
SELECT call, count(*) AS n_requested, count(p.SK_ID_CURR) AS n_scored, count(*) - count(p.SK_ID_CURR) AS n_not_found,
  count(CASE WHEN p >= 0.46::DOUBLE THEN 1 END) AS n_refused, round(coalesce(sum(round(p, 4)), 0), 4) AS score_sum,
  CAST(coalesce(sum(CASE WHEN p.SK_ID_CURR IS NULL THEN id END), 0) AS BIGINT) AS unknown_id_sum
FROM o LEFT JOIN p ON o.id = p.SK_ID_CURR GROUP BY call""",
)
def log_sink_json(spark, sf):
    """Batch calls: the orders of a day ask for their customers, unknown ids included.

    The lines are written, read back and added up per call.
    """
    orders = table(spark, sf, "orders")
    ids = orders.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("call"),
        F.col("o_orderkey").alias("position"),
        (F.col("o_custkey") * 2).alias("SK_ID_CURR"),
    )
    scored, missing = score_plan.predict_with(
        ids, source(spark, sf, "application"), scoring.linear_score(WEIGHTS, INTERCEPT), ["call", "position"]
    )
    lines = score_plan.log_calls(
        scored.withColumnRenamed("SK_ID_CURR", "client_id"),
        missing.withColumnRenamed("SK_ID_CURR", "client_id"),
        "call",
        F.to_timestamp("call"),
        F.lit(12.5),
    )
    path = scratch_path(spark, "call-log")
    sinks.log_sink_json(lines, path)
    records = readers.log_source_json(spark.read.text(path))
    unknown = F.aggregate("not_found", F.lit(0).cast("long"), lambda acc, x: acc + x)
    sums = records.select("timestamp", unknown.alias("unknown"), "n_requested").join(
        logs.call_measures(records).groupBy("timestamp").agg(
            F.sum("n_scored").alias("n_scored"),
            F.sum("n_not_found").alias("n_not_found"),
            F.sum("n_refused").alias("n_refused"),
            F.round(F.sum("score_sum"), 4).alias("score_sum"),
        ),
        "timestamp",
    )
    return sums.groupBy(
        F.date_format("timestamp", "yyyy-MM-dd").alias("call"), "n_scored", "n_not_found", "n_refused", "score_sum"
    ).agg(F.sum("n_requested").alias("n_requested"), F.sum("unknown").alias("unknown_id_sum"))


# ---- the log as a stream ----------------------------------------------------------------


def _log_folder(spark, sf) -> str:
    path = scratch_path(spark, "log-lines")
    sinks.log_sink_json(call_lines(spark, sf), path)
    return path


def _measures(spark, sf):
    return logs.call_measures(logs.stream_log_ingest(spark, _log_folder(spark, sf)))


@query("stream_log_ingest", _CALLS_SQL + _RECORDS)
def stream_log_ingest(spark, sf):
    stream = logs.stream_log_ingest(spark, _log_folder(spark, sf))
    return _shown(logs.run_append(stream, scratch_path(spark, "log-table")))


def _stats_sql(starts: str, width: str) -> str:
    return (
        _CALLS_SQL
        + f""", w AS (SELECT *, {starts} AS window_start FROM calls WHERE event_type <> 'error')
SELECT window_start, window_start + INTERVAL '{width}' AS window_end, count(*) AS total_requests, count(*) AS total_clients_scored,
  count(CASE WHEN score >= 0.46::DOUBLE THEN 1 END) AS total_refused, count(CASE WHEN score < 0.46::DOUBLE THEN 1 END) AS total_approved,
  CAST(0 AS BIGINT) AS total_not_found, round(avg(score), 4) AS avg_score,
  round(count(CASE WHEN score >= 0.46::DOUBLE THEN 1 END) / count(*), 4) AS refusal_rate FROM w GROUP BY window_start"""
    )


_WINDOW = ["window_start", "window_end"]


def _without_zone(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in _WINDOW})


@query("stream_stats", _stats_sql("date_trunc('hour', ts)", "1 hour"))
def stream_stats(spark, sf):
    windows = logs.stream_stats(_measures(spark, sf))
    return _without_zone(logs.run_latest(windows, _WINDOW, scratch_path(spark, "stats")))


@query(
    "stream_stats_sliding",
    _stats_sql("time_bucket(INTERVAL '15 minutes', ts) - unnest([0, 1, 2, 3]) * INTERVAL '15 minutes'", "1 hour"),
)
def stream_stats_sliding(spark, sf):
    windows = logs.stream_stats(_measures(spark, sf), slide="15 minutes")
    return _without_zone(logs.run_latest(windows, _WINDOW, scratch_path(spark, "stats")))


@query(
    "stream_latency",
    _CALLS_SQL
    + """ SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL '1 hour' AS window_end,
  '/' || event_type AS endpoint, count(latency_ms) AS n_calls, round(avg(latency_ms), 4) AS mean_latency_ms, max(latency_ms) AS max_latency_ms
FROM calls WHERE event_type <> 'error' GROUP BY 1, 2, 3""",
)
def stream_latency(spark, sf):
    windows = logs.stream_latency(_measures(spark, sf))
    keys = [*_WINDOW, "endpoint"]
    return _without_zone(logs.run_latest(windows, keys, scratch_path(spark, "latency")))


@query(
    "stream_dedup",
    "SELECT event_id, ts, user_id, event_type FROM events",
)
def stream_dedup(spark, sf):
    """Every event delivered twice; one copy of each survives."""
    events = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    path = scratch_path(spark, "replayed")
    events.unionByName(events).write.parquet(path)
    stream = logs.stream_table(spark, path, events.schema)
    once = logs.stream_dedup(stream, ["event_id"], "ts")
    return logs.run_append(once, scratch_path(spark, "deduplicated")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "stream_score",
    _LINEAR
    + """SELECT SK_ID_CURR, round(p, 4) AS score, CASE WHEN p >= 0.46::DOUBLE THEN 'refusé' ELSE 'accordé' END AS decision,
  0.46::DOUBLE AS threshold FROM p""",
)
def stream_score(spark, sf):
    path = scratch_path(spark, "arrivals")
    rows = source(spark, sf, "application")
    rows.write.parquet(path)
    stream = logs.stream_table(spark, path, rows.schema)
    scored = stream_scoring.stream_score(stream, WEIGHTS, INTERCEPT, ["SK_ID_CURR"])
    return logs.run_append(scored, scratch_path(spark, "scored"))


_STREAM_FEATURES = ["value", "hour"]


@query(
    "stream_drift",
    """WITH h AS (SELECT date_trunc('day', ts) AS w, value, CAST(hour(ts) AS DOUBLE) AS hour, event_type = 'click' AS cur FROM events),
l AS (SELECT w, 'value' AS feature, value, cur FROM h UNION ALL SELECT w, 'hour', hour, cur FROM h),
r AS (SELECT feature, value, count(*) AS n FROM l WHERE NOT cur GROUP BY 1, 2),
q AS (SELECT w, feature, value, count(*) AS n FROM l WHERE cur GROUP BY 1, 2, 3),
u AS (SELECT feature, value, sum(n) AS r FROM (SELECT feature, value, n FROM r UNION ALL SELECT feature, value, 0 FROM q) GROUP BY 1, 2),
g AS (SELECT w.w, u.feature, u.value, u.r, coalesce(q.n, 0) AS q FROM u JOIN (SELECT DISTINCT w, feature FROM q) w ON w.feature = u.feature
  LEFT JOIN q ON q.w = w.w AND q.feature = u.feature AND q.value = u.value),
s AS (SELECT w, feature, sum(r) OVER (PARTITION BY w, feature) AS n_ref, sum(q) OVER (PARTITION BY w, feature) AS n_cur,
  sum(r) OVER (PARTITION BY w, feature ORDER BY value) AS cr, sum(q) OVER (PARTITION BY w, feature ORDER BY value) AS cq FROM g)
SELECT w AS window_start, w + INTERVAL 1 DAY AS window_end, feature, CAST(max(n_ref) AS BIGINT) AS n_ref, CAST(max(n_cur) AS BIGINT) AS n_cur,
  round(max(abs(cr / n_ref - cq / n_cur)), 6) AS ks, CASE WHEN max(abs(cr / n_ref - cq / n_cur)) >= 0.1 THEN 1 ELSE 0 END AS drifted
FROM s WHERE n_ref > 10 AND n_cur > 10 GROUP BY w, feature""",
)
def stream_drift(spark, sf):
    """Clicks arrive as a stream and are held against all other events, day by day."""
    events = table(spark, sf, "events").select(
        "event_type", "value", F.hour("ts").cast("double").alias("hour"), F.col("ts").cast("timestamp").alias("ts")
    )
    path = scratch_path(spark, "clicks")
    arrivals = events.where(F.col("event_type") == "click")
    arrivals.write.parquet(path)
    stream = logs.stream_table(spark, path, arrivals.schema)
    reference = events.where(F.col("event_type") != "click")
    report = drift.stream_drift(stream, reference, _STREAM_FEATURES, scratch_path(spark, "drift"), "ts", "1 day", "3650 days")
    plain = {c: F.col(c).cast("timestamp_ntz") for c in drift.WINDOW}
    return tidy(report.withColumns(plain), digits=6)


@query(
    "stream_requests",
    _LINEAR
    + """, q AS (SELECT o_orderkey % 97 AS call, o_orderkey AS position, CASE WHEN o_orderkey % 11 = 0 THEN 'x' || o_custkey
  WHEN o_orderkey % 5 = 0 THEN CAST(-o_custkey AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) END AS requested FROM orders),
c AS (SELECT *, TRY_CAST(requested AS BIGINT) AS client_id FROM q),
a AS (SELECT call, requested, client_id, p FROM c LEFT JOIN p ON SK_ID_CURR = client_id)
SELECT call, p IS NOT NULL AS found, count(*) AS n, count(client_id) AS n_valid, count(CASE WHEN p >= 0.46::DOUBLE THEN 1 END) AS n_refused,
  CAST(sum(CAST(round(p, 4) * 10000 AS BIGINT)) AS BIGINT) AS score_sum FROM a GROUP BY 1, 2""",
)
def stream_requests(spark, sf):
    """Lists of ids arrive, some of them unknown or no number; both outcomes are counted per call."""
    wanted = table(spark, sf, "orders").selectExpr(
        "o_orderkey % 97 AS call",
        """CASE WHEN o_orderkey % 11 = 0 THEN concat('x', o_custkey) WHEN o_orderkey % 5 = 0 THEN CAST(-o_custkey AS STRING)
           ELSE CAST(o_custkey AS STRING) END AS id""",
    )
    calls = wanted.groupBy("call").agg(F.collect_list("id").alias("client_ids"))
    path = scratch_path(spark, "requests")
    calls.write.parquet(path)
    stream = logs.stream_table(spark, path, calls.schema)
    features = source(spark, sf, "application")
    scored, unknown = requests.stream_requests(stream, features, linear_score(WEIGHTS, INTERCEPT), scratch_path(spark, "answers"))
    found = scored.select("call", F.lit(True).alias("found"), "client_id", "score", "decision")
    none = unknown.select("call", F.lit(False).alias("found"), "client_id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("decision"))
    return found.unionByName(none).groupBy("call", "found").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("client_id").alias("n_valid"),
        F.count_if(F.col("decision") == REFUSED).alias("n_refused"),
        F.sum(F.round(F.col("score") * 10000).cast("long")).alias("score_sum"),
    )
