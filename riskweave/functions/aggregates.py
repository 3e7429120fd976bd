"""Aggregate specifications ``{column: [function, ...]}`` written out as Spark SQL expressions.

A client table has hundreds of aggregates. As expression text each costs one call into the
JVM; built from Column objects it would cost a dozen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .naming import quoted

Spec = Mapping[str, Sequence[str]]

# min, max, mean, var and nunique skip NULL; size counts rows; a sum over nothing is 0.
FUNCTIONS = {
    "min": "min({x})",
    "max": "max({x})",
    "mean": "avg({x})",
    "sum": "coalesce(sum({x}), 0)",
    "var": "var_samp({x})",
    "nunique": "count(DISTINCT {x})",
    "size": "count(1)",
}


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def aggregate_sql(name: str, column: str, where: str | None = None) -> str:
    """One aggregate, over all rows of the group or only those where ``where`` holds.

    A client whose group has no such row gets NULL for every function, sums and counts
    included, as a left join with the aggregated subset would give.
    """
    x = quoted(column)
    if where is None:
        return FUNCTIONS[name].format(x=x)
    if name == "size":
        return f"nullif(count_if({where}), 0)"
    value = FUNCTIONS[name].format(x=f"CASE WHEN {where} THEN {x} END")
    if name in ("sum", "nunique"):
        return f"CASE WHEN count_if({where}) > 0 THEN {value} END"
    return value


def spec_sql(spec: Spec, prefix: str = "", where: str | None = None) -> list[str]:
    """``PREFIX_COLUMN_FUNCTION`` aggregates for a whole specification, as SQL text."""
    return [
        f"{aggregate_sql(fn, column, where)} AS {quoted(f'{prefix}{column}_{fn.upper()}')}"
        for column, fns in spec.items()
        for fn in fns
    ]


def spec_columns(spec: Spec, prefix: str = "", where: str | None = None) -> list[Column]:
    return [F.expr(text) for text in spec_sql(spec, prefix, where)]


def spec_names(spec: Spec, prefix: str = "") -> list[str]:
    return [f"{prefix}{column}_{fn.upper()}" for column, fns in spec.items() for fn in fns]
