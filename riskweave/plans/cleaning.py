"""The assembled table cleaned for modelling: a fit that reads profiles, a transform that drops columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import ID_COL, TARGET_COL, quoted
from ..operators.correlate import prune_correlated
from ..operators.profile import bool_to_int, inf_to_null, quasi_constant_columns, select_high_missing
from ..session import materialise


@dataclass
class Cleaning:
    """Columns to drop, by reason, in the order the reasons are checked."""

    high_missing: list[str] = field(default_factory=list)
    quasi_constant: list[str] = field(default_factory=list)
    correlated: list[str] = field(default_factory=list)

    def dropped(self) -> set[str]:
        return {*self.high_missing, *self.quasi_constant, *self.correlated}


def _names(report: DataFrame) -> list[str]:
    return sorted(r["column"] for r in report.select("column").collect())


def labelled(df: DataFrame, target: str = TARGET_COL) -> DataFrame:
    """Rows with a label, infinities and NaN removed."""
    return inf_to_null(df.where(F.col(target).isNotNull()))


def fit_cleaning(
    df: DataFrame,
    target: str = TARGET_COL,
    missing_threshold: float = 0.99,
    constant_threshold: float = 0.99,
    corr_threshold: float = 0.9,
) -> Cleaning:
    """Decide which columns of a labelled table go. Only column names come to the driver.

    Every check reads the table again, with fewer columns, so it should be a stored one.
    """
    plan = Cleaning(high_missing=_names(select_high_missing(df, missing_threshold)))
    left = df.drop(*plan.high_missing)
    plan.quasi_constant = _names(quasi_constant_columns(left, constant_threshold))
    left = left.drop(*plan.quasi_constant)
    plan.correlated = _names(prune_correlated(left, target, corr_threshold))
    return plan


def apply_cleaning(df: DataFrame, plan: Cleaning, target: str = TARGET_COL, key: str = ID_COL) -> DataFrame:
    """Drop the chosen columns; key and label stay, whatever the profile says of them."""
    gone = plan.dropped() - {target, key}
    return bool_to_int(df.selectExpr(*[quoted(c) for c in df.columns if c not in gone]))


def clean_dataset(df: DataFrame, target: str = TARGET_COL, key: str = ID_COL) -> tuple[DataFrame, Cleaning]:
    """The assembled table ready for modelling, and what was dropped from it.

    The labelled table is written once; the checks and the result both read that copy.
    """
    stored = materialise(labelled(df, target), "features")
    plan = fit_cleaning(stored, target)
    return apply_cleaning(stored, plan, target, key), plan
