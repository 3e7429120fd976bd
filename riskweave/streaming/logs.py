"""The scoring log as a stream: ingest, windowed statistics, latency, de-duplication.

The transformations take a batch or a stream alike; only the readers and runners differ.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import guarded_ratio
from ..operators.scoring import REFUSED
from ..session import scratch_path
from ..sources.readers import log_source_json

LATE_BY = "2 hours"


def stream_log_lines(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema("value string").format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def stream_log_ingest(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Typed records; lines that are no JSON carry their text in ``message``."""
    return log_source_json(stream_log_lines(spark, folder, files_per_batch))


def stream_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet folder or file pattern as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def call_measures(records: DataFrame) -> DataFrame:
    """Per log record the numbers that windows add up.

    A batch call brings an array of predictions, a new-client call a single score.
    """
    predictions = F.coalesce(
        F.col("predictions"),
        F.when(
            F.col("score").isNotNull(),
            F.array(F.struct("client_id", "score", "decision")),
        ),
        F.array().cast("array<struct<client_id:bigint,score:double,decision:string>>"),
    )
    total = F.aggregate("_p", F.lit(0.0), lambda acc, p: acc + F.coalesce(p["score"], F.lit(0.0)))
    return records.where(F.col("endpoint").isNotNull()).withColumn("_p", predictions).select(
        "timestamp",
        "endpoint",
        "latency_ms",
        F.size("_p").cast("long").alias("n_scored"),
        F.size(F.filter("_p", lambda p: p["decision"] == F.lit(REFUSED))).cast("long").alias("n_refused"),
        F.coalesce("n_not_found", F.lit(0)).cast("long").alias("n_not_found"),
        total.alias("score_sum"),
    )


def _window(df: DataFrame, time: str, width: str, slide: str | None, late_by: str) -> DataFrame:
    span = F.window(time, width, slide) if slide else F.window(time, width)
    return df.withWatermark(time, late_by).withColumn("w", span)


def stream_stats(
    measures: DataFrame, width: str = "1 hour", slide: str | None = None, late_by: str = LATE_BY, time: str = "timestamp"
) -> DataFrame:
    """Calls, scored, refused, unknown, mean score and refusal rate per window.

    With ``slide`` the windows overlap. Rows later than the watermark are dropped.
    """
    scored, refused = F.sum("n_scored"), F.sum("n_refused")
    grouped = _window(measures, time, width, slide, late_by).groupBy("w").agg(
        F.count(F.lit(1)).alias("total_requests"),
        scored.alias("total_clients_scored"),
        refused.alias("total_refused"),
        (scored - refused).alias("total_approved"),
        F.sum("n_not_found").alias("total_not_found"),
        F.round(guarded_ratio(F.sum("score_sum"), scored, 0.0), 4).alias("avg_score"),
        F.round(guarded_ratio(refused, scored, 0.0), 4).alias("refusal_rate"),
    )
    return _flat(grouped)


def stream_latency(
    measures: DataFrame, width: str = "1 hour", slide: str | None = None, late_by: str = LATE_BY, time: str = "timestamp"
) -> DataFrame:
    """Count, mean and maximum latency per endpoint and window."""
    grouped = _window(measures, time, width, slide, late_by).groupBy("w", "endpoint").agg(
        F.count("latency_ms").alias("n_calls"),
        F.round(F.avg("latency_ms"), 4).alias("mean_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
    )
    return _flat(grouped)


def _flat(grouped: DataFrame) -> DataFrame:
    rest = [c for c in grouped.columns if c != "w"]
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *rest)


def stream_dedup(df: DataFrame, keys: Sequence[str], time: str = "timestamp", late_by: str = LATE_BY) -> DataFrame:
    """Drop replayed rows that arrive within the watermark of the first copy."""
    return df.withWatermark(time, late_by).dropDuplicatesWithinWatermark(list(keys))


# ---- runners ----------------------------------------------------------------------------


def run_append(stream: DataFrame, path: str, checkpoint: str | None = None) -> DataFrame:
    """Process what is there now into a Parquet table and return that table."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(
    stream: DataFrame, each: Callable[[DataFrame], DataFrame], path: str, mode: str = "append", checkpoint: str | None = None
) -> DataFrame:
    """Apply ``each`` to every micro-batch; results are stored under their batch number.

    A batch that is replayed after a failure overwrites its own folder, so nothing doubles.
    """
    spark = stream.sparkSession
    layout: list[T.StructType] = []

    def write(batch: DataFrame, number: int) -> None:
        result = each(batch)
        layout.append(result.schema)
        result.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    if not layout:
        # nothing new since an earlier run with this checkpoint
        try:
            return spark.read.parquet(path).withColumn("batch", F.col("batch").cast("long"))
        except AnalysisException as problem:
            raise ValueError("the stream held no data") from problem
    schema = T.StructType([*layout[0].fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(path)


def run_latest(stream: DataFrame, keys: Sequence[str], path: str, checkpoint: str | None = None) -> DataFrame:
    """The current value of every window, open ones included, of an aggregated stream."""
    updates = run_batches(stream, lambda batch: batch, path, "update", checkpoint)
    values = [c for c in stream.columns if c not in keys]
    newest = F.max_by(F.struct(*values), "batch").alias("v")
    return updates.groupBy(*keys).agg(newest).select(*keys, "v.*").select(*stream.columns)
