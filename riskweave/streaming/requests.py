"""Scoring requests that arrive as lists of client ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import ID_COL
from ..operators.scoring import THRESHOLD, decide
from .logs import run_batches

_ANSWER = ["call", "position", "client_id", "score", "decision"]


def answer_requests(requests: DataFrame, features: DataFrame, score: Column, threshold: float = THRESHOLD) -> DataFrame:
    """``(call, position, requested, client_id, found, score, decision)``, one row per requested id.

    ``requests(call, client_ids)`` holds the ids as text or integers; ``features`` has one row per client. ``found``
    is false for an id that the table does not have, and null for text that is no whole number. Repeated ids are answered each time.
    """
    ids = requests.select("call", F.posexplode(F.col("client_ids").cast("array<string>")).alias("position", "requested"))
    ids = ids.withColumn("client_id", F.col("requested").try_cast("bigint"))
    # computed on the side of the table, so that no column of it can clash with those of a request
    scored = features.select(F.col(ID_COL).alias("_key"), score.alias("_score"), F.lit(True).alias("_there"))
    joined = ids.join(scored, F.col("client_id") == F.col("_key"), "left")
    return joined.select(
        "call",
        "position",
        "requested",
        "client_id",
        F.when(F.col("client_id").isNotNull(), F.coalesce("_there", F.lit(False))).alias("found"),
        F.round("_score", 4).alias("score"),
        F.when(F.col("_there"), decide("_score", threshold)).alias("decision"),
    )


def stream_requests(
    requests: DataFrame, features: DataFrame, score: Column, path: str, checkpoint: str | None = None, threshold: float = THRESHOLD
) -> tuple[DataFrame, DataFrame]:
    """Answer the requests that have arrived: the scored ids, and those without a client.

    Each micro-batch is joined once with the feature table and written under its number with both outcomes. The
    second table has a row per unknown or invalid id: ``(call, position, requested, client_id)``.
    """
    answered = run_batches(requests, lambda batch: answer_requests(batch, features, score, threshold), path, checkpoint=checkpoint)
    return answered.where("found").select(*_ANSWER), answered.where("found IS NULL OR NOT found").select(*_ANSWER[:2], "requested", "client_id")
