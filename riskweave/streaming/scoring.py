"""Scoring of arriving feature rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..operators.scoring import answer, linear_score


def stream_score(
    rows: DataFrame, coefficients: Mapping[str, float], intercept: float, keep: Sequence[str]
) -> DataFrame:
    """Score and decision for each arriving row; stateless, so any output mode will do."""
    return answer(rows, linear_score(coefficients, intercept), keep)
