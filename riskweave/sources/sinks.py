"""Writers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import ID_COL
from ..schemas import RUNS

# A call that scored more clients is written as several lines.
PREDICTIONS_PER_LINE = 1000


def sink_table(df: DataFrame, path: str, key: str = ID_COL, fmt: str = "parquet", mode: str = "error") -> None:
    """Write a table sorted by its key, so that lookups prune files and row groups."""
    ordered = df.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    writer = ordered.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def run_rows(
    spark: SparkSession,
    run: str,
    metrics: Mapping[str, float],
    params: Mapping[str, object] | None = None,
    tags: Mapping[str, str] | None = None,
) -> DataFrame:
    """``(run, logged_at, kind, key, value, tags)`` rows describing one model run."""
    entries = [("metric", k, str(v)) for k, v in metrics.items()]
    entries += [("param", k, str(v)) for k, v in (params or {}).items()]
    rows = [(run, None, kind, k, v, dict(tags or {})) for kind, k, v in entries]
    return spark.createDataFrame(rows, RUNS).withColumn("logged_at", F.current_timestamp())


def sink_run_metrics(rows: DataFrame, path: str) -> None:
    """Store the rows of runs, in place of any that are stored under the same names.

    A run is a partition of its own, replaced as a whole: writing it again leaves one copy, and jobs
    that write different runs at a time do not touch each other. Read with the schema ``RUNS``, or a run named like a number becomes one.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def metrics_to_runs(table: DataFrame, run: str, tags: Mapping[str, str] | None = None) -> DataFrame:
    """A metrics table, one row per model, as run rows."""
    names = [c for c in table.columns if c != run and not c.endswith("_best")]
    long = table.select(run, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(
        [run], names, "key", "value"
    )
    pairs = [F.lit(x) for kv in (tags or {}).items() for x in kv]
    tag_map = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return long.select(
        F.col(run).alias("run"),
        F.current_timestamp().alias("logged_at"),
        F.lit("metric").alias("kind"),
        "key",
        F.col("value").cast("string").alias("value"),
        tag_map.alias("tags"),
    )


def call_entries(
    scored: DataFrame, not_found: DataFrame, call: str, id_col: str = "client_id", position: str = "position"
) -> DataFrame:
    """One record per scoring call: counts, predictions and unknown ids.

    A call larger than ``PREDICTIONS_PER_LINE`` is spread over several records by the
    position of the id in the request, so no task ever holds a whole large call.
    """
    found = scored.select(
        call, position, F.struct(F.col(id_col).alias("client_id"), "score", "decision").alias("p"), F.lit(None).cast("long").alias("u")
    )
    absent = not_found.select(
        call,
        position,
        F.lit(None).cast("struct<client_id:bigint,score:double,decision:string>").alias("p"),
        F.col(id_col).cast("long").alias("u"),
    )
    rows = found.unionByName(absent)
    sizes = rows.groupBy(call).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") / PREDICTIONS_PER_LINE)
    placed = rows.join(sizes, call).withColumn("part", F.pmod(F.xxhash64(position), parts))
    grouped = placed.groupBy(call, "part").agg(
        F.count(F.lit(1)).alias("n_requested"),
        F.count("p").alias("n_scored"),
        F.count("u").alias("n_not_found"),
        F.collect_list("p").alias("predictions"),
        F.collect_list("u").alias("not_found"),
    )
    return grouped


def log_lines(entries: DataFrame, timestamp: Column, endpoint: str, level: str = "INFO", *extra: str) -> DataFrame:
    """``value``: one JSON object per record, with time and level merged in."""
    base = [
        F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        F.lit(level).alias("level"),
        F.lit(endpoint).alias("endpoint"),
    ]
    return entries.select(F.to_json(F.struct(*base, *[F.col(c) for c in extra])).alias("value"))


def log_sink_json(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").text(path)
