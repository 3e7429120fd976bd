"""Score a batch of requests: lookup, score, decide, log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import ID_COL
from ..operators.explain import MAX_FACTORS
from ..operators.scoring import THRESHOLD, answer, lookup_batch, lookup_not_found, score_batch
from ..operators.trees import explain_trees, top_factors
from ..sources.sinks import call_entries, log_lines


def predict(
    ids: DataFrame, features: DataFrame, model: PipelineModel, names: Sequence[str], keep: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Predictions of the known ids and the list of unknown ids."""
    found = lookup_batch(ids, features)
    scored = score_batch(found, model, names, [*keep, ID_COL])
    return scored, lookup_not_found(ids, features)


def predict_with(ids: DataFrame, features: DataFrame, score: Column, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The same with a score that is an expression over the features."""
    found = lookup_batch(ids, features)
    return answer(found, score, [*keep, ID_COL]), lookup_not_found(ids, features)


def explain_client(
    ids: DataFrame, features: DataFrame, model: PipelineModel, names: Sequence[str], top_n: int = 10
) -> DataFrame:
    """Score, decision and strongest factors per known id; an unknown id has no row."""
    if not 1 <= top_n <= MAX_FACTORS:
        raise ValueError(f"top_n must lie between 1 and {MAX_FACTORS}")
    phi = explain_trees(lookup_batch(ids, features), model, names, [ID_COL])
    total = F.aggregate("phi", F.col("base"), lambda acc, v: acc + v)
    probability = F.lit(1.0) / (F.lit(1.0) + F.exp(-total))
    explained = phi.withColumn("top_factors", top_factors("phi", names, top_n))
    return answer(explained, probability, [ID_COL, "top_factors"], THRESHOLD)


def log_calls(
    scored: DataFrame, not_found: DataFrame, call: str, timestamp: Column, latency: Column, endpoint: str = "/predict"
) -> DataFrame:
    """JSON lines of scoring calls, ready for ``log_sink_json``."""
    entries = call_entries(scored, not_found, call).withColumn("latency_ms", latency)
    fields = ["n_requested", "n_scored", "n_not_found", "predictions", "not_found", "latency_ms"]
    return log_lines(entries, timestamp, endpoint, "INFO", *fields)
