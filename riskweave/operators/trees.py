"""Shapley values of boosted trees (path-dependent expectations, class 1, log-odds).

A leaf is reached through at most ``depth`` distinct features. Whether a row meets the leaf's
bounds on each of them is a bit pattern, and the leaf's share of every Shapley value depends on
that pattern alone. A task tabulates the patterns of a leaf and then needs a handful of
comparisons and look-ups per row. Rows never meet: no shuffle. Only the leaves travel, a few
numbers per leaf and feature.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .explain import factor_direction


# The helpers travel inside the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Pattern tables of a model up to this size are kept for the whole task.
_TABLE_BYTES = 64 * 2**20


@dataclass
class Leaf:
    """Value of a leaf; per feature on its path the bounds ``low < x <= high`` and the cover.

    ``covers[k]`` is the share of training rows that pass the conditions on feature k.
    """

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    covers: np.ndarray


def shapley_shares(value: float, covers: np.ndarray) -> np.ndarray:
    """What a leaf adds to each of its m features, one row per pattern of met features.

    In a coalition a feature inside it counts as met or not, one outside by its cover.
    ``by_size[:, s]`` sums the products over all coalitions of s other features.
    """
    m = len(covers)
    met = (np.arange(2**m)[:, None] >> np.arange(m)) & 1
    weights = [math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s in range(m)]
    shares = np.empty((2**m, m))
    for j in range(m):
        by_size = np.zeros((2**m, m))
        by_size[:, 0] = 1.0
        for k in range(m):
            if k != j:
                inside = by_size[:, :-1] * met[:, k : k + 1]
                by_size *= covers[k]
                by_size[:, 1:] += inside
        shares[:, j] = value * (met[:, j] - covers[j]) * (by_size @ weights)
    return shares


def model_leaves(spark: SparkSession, model: GBTClassificationModel) -> tuple[list[Leaf], float]:
    """All leaves of a fitted model and the expected log-odds.

    The nodes are read from the saved form of the model, whose size is fixed by its
    parameters and not by any data.
    """
    path = scratch_path(spark, "trees")
    model.write().save(path)
    nodes: dict[int, dict[int, object]] = {}
    for row in spark.read.parquet(f"{path}/data").collect():
        nodes.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"]

    leaves: list[Leaf] = []
    base = 0.0
    for tree, weight in enumerate(model.treeWeights):
        stack = [(nodes[tree][0], {})]
        while stack:
            node, path_bounds = stack.pop()
            if node["leftChild"] < 0:
                value = 2.0 * weight * node["prediction"]
                names = sorted(path_bounds)
                covers = [path_bounds[f][2] for f in names]
                base += value * math.prod(covers)
                if names:
                    low, high = ([path_bounds[f][side] for f in names] for side in (0, 1))
                    leaves.append(Leaf(value, np.array(names), np.array(low), np.array(high), np.array(covers)))
                continue
            feature = node["split"]["featureIndex"]
            cut = node["split"]["leftCategoriesOrThreshold"][0]
            low, high, cover = path_bounds.get(feature, (-math.inf, math.inf, 1.0))
            for child_id, bounds in ((node["leftChild"], (low, min(high, cut))), (node["rightChild"], (max(low, cut), high))):
                child = nodes[tree][child_id]
                passed = cover * child["rawCount"] / node["rawCount"]
                stack.append((child, {**path_bounds, feature: (*bounds, passed)}))
    return leaves, base


def leaf_tables(leaves: Sequence[Leaf]) -> list[np.ndarray] | None:
    """The pattern tables of all leaves, unless together they would be too large to keep."""
    size = sum(8 * len(leaf.covers) * 2 ** len(leaf.covers) for leaf in leaves)
    return [shapley_shares(leaf.value, leaf.covers) for leaf in leaves] if size <= _TABLE_BYTES else None


def row_values(x: np.ndarray, leaves: Sequence[Leaf], tables: list[np.ndarray] | None, width: int) -> np.ndarray:
    """Shapley values (rows x features) of a block of rows."""
    phi = np.zeros((len(x), width))
    for i, leaf in enumerate(leaves):
        z = x[:, leaf.features]
        met = (z > leaf.low) & (z <= leaf.high)
        pattern = met @ (1 << np.arange(len(leaf.features)))
        shares = tables[i] if tables else shapley_shares(leaf.value, leaf.covers)
        # the features of one leaf are distinct, so the indexed addition is safe
        phi[:, leaf.features] += shares[pattern]
    return phi


def explain_trees(
    df: DataFrame, model: PipelineModel, features: Sequence[str], keep: Sequence[str]
) -> DataFrame:
    """``(keep..., base, phi)`` with one value per feature; base + sum(phi) is the log-odds.

    The value of a feature includes that of its missing-value flag.
    """
    prepare, assemble, trees = model.stages
    inputs = assemble.getInputCols()
    leaves, base = model_leaves(df.sparkSession, trees)
    n, keep = len(features), list(keep)
    inputs_of = np.arange(len(inputs)) % n

    def explain(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = leaf_tables(leaves)
        for block in blocks:
            phi = row_values(block[inputs].to_numpy(dtype="float64"), leaves, tables, len(inputs))
            merged = np.zeros((len(block), n))
            np.add.at(merged.T, inputs_of, phi.T)
            out = block[keep].copy()
            out["base"] = base
            out["phi"] = list(merged)
            yield out

    prepared = prepare.transform(df).select(*keep, *inputs)
    kept = ", ".join(f"`{c}` {t}" for c, t in prepared.select(*keep).dtypes)
    return prepared.mapInPandas(explain, f"{kept}, base double, phi array<double>")


def top_factors(phi: Column | str, features: Sequence[str], n: int = 10) -> Column:
    """The ``n`` strongest features of a row as an array, ranked inside the row: no shuffle."""
    values = F.col(phi) if isinstance(phi, str) else phi
    pairs = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), values.alias("v"))
    ranked = F.array_sort(
        F.transform(pairs, lambda p: F.struct((-F.abs(p["v"])).alias("o"), p["feature"].alias("feature"), p["v"].alias("v")))
    )
    return F.transform(
        F.slice(ranked, 1, n),
        lambda p: F.struct(
            p["feature"].alias("feature"),
            F.round(p["v"], 4).alias("contribution"),
            factor_direction(p["v"]).alias("direction"),
        ),
    )
