"""Model runs in shared storage: the fitted pipeline, what is known about it, and a pointer to the one in use.

    <root>/models/<run>-<attempt>/     fitted pipelines
    <root>/runs/run=<run>/             rows of a run, the place of its pipeline among them
    <root>/aliases/alias=<alias>/      the run that an alias stands for

Rows of a run are replaced as one partition, so a job that is repeated leaves one copy and runs that are logged at the
same time do not touch each other. A pipeline is written to a new place before the rows name it: a reader finds
either the old run or the new one, whole.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RUNS
from .sinks import run_rows, sink_run_metrics

CHAMPION = "champion"
MODEL_PATH = "model_path"

_ALIASES = "alias string, run string, set_at timestamp"


@dataclass(frozen=True)
class StoredRun:
    """A run as it was stored: the fitted pipeline, the features it asks for, and the logged values as text."""

    name: str
    model: PipelineModel
    features: list[str]
    values: dict[str, str]
    tags: dict[str, str]


def model_features(model: PipelineModel) -> list[str]:
    """The columns that a fitted pipeline takes, in its own order, read from its preparing stage."""
    columns = re.findall(r"coalesce\(CAST\(`((?:[^`]|``)+)` AS DOUBLE\),", model.stages[0].getStatement())
    return [c.replace("``", "`") for c in columns]


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """``run, logged_at, kind, key, value, tags`` of all runs."""
    return spark.read.schema(RUNS).parquet(f"{root}/runs").select(*RUNS.names)


def log_run(
    spark: SparkSession,
    root: str,
    run: str,
    model: PipelineModel,
    metrics: Mapping[str, float],
    params: Mapping[str, object] | None = None,
    tags: Mapping[str, str] | None = None,
) -> None:
    """Store a fitted pipeline with its metrics, parameters and tags; a run of that name is replaced."""
    path = f"{root}/models/{run}-{uuid.uuid4().hex[:12]}"
    model.write().save(path)
    rows = run_rows(spark, run, metrics, {**(params or {}), MODEL_PATH: path}, tags)
    sink_run_metrics(rows, f"{root}/runs")


def set_alias(spark: SparkSession, root: str, run: str, alias: str = CHAMPION) -> None:
    """Let an alias stand for a stored run from now on."""
    if read_runs(spark, root).where(F.col("run") == run).isEmpty():
        raise ValueError(f"no run {run} is stored")
    row = spark.createDataFrame([(alias, run)], "alias string, run string").withColumn("set_at", F.current_timestamp())
    row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("alias").parquet(f"{root}/aliases")


def aliased(spark: SparkSession, root: str, alias: str = CHAMPION) -> str:
    """The run that an alias stands for."""
    try:
        row = spark.read.schema(_ALIASES).parquet(f"{root}/aliases").where(F.col("alias") == alias).select("run").first()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        row = None
    if row is None:
        raise ValueError(f"no run is the {alias}")
    return row["run"]


def load_run(spark: SparkSession, root: str, run: str | None = None, alias: str = CHAMPION) -> StoredRun:
    """A stored run by name, or the one that ``alias`` stands for. What is collected is one run's values."""
    name = run if run is not None else aliased(spark, root, alias)
    rows = read_runs(spark, root).where(F.col("run") == name).collect()
    if not rows:
        raise ValueError(f"no run {name} is stored")
    values = {r["key"]: r["value"] for r in rows}
    model = PipelineModel.load(values[MODEL_PATH])
    return StoredRun(name, model, model_features(model), values, dict(rows[0]["tags"] or {}))


def stored_info(spark: SparkSession, stored: StoredRun, keys: Sequence[str]) -> DataFrame:
    """One row: the logged values ``keys`` of a stored run and the number of features its pipeline takes."""
    row = tuple(stored.values.get(k) for k in keys)
    layout = ", ".join(f"`{k}` string" for k in keys) + ", n_features int"
    return spark.createDataFrame([(*row, len(stored.features))], layout)
