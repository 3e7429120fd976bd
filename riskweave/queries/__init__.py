"""Registered queries: each operator run on the standard tables, with a SQL twin where SQL can say it."""

from . import (  # noqa: F401
    evaluation,
    features,
    modelling,
    monitoring,
    profiling,
)
from .registry import ORACLES, QUERIES  # noqa: F401
