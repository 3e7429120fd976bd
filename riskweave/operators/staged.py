"""Boosted trees judged tree by tree: AUC after each round, the best round, and the ensemble cut off there.

The score after k rounds is the running total of a row's first k tree outputs. A task adds them up and counts labels
per round and distinct score; only these counts are shuffled, and the AUC of a round comes from them like
any other. Rounds are judged in blocks, so a search that stops early never looks at the later trees.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.naming import quoted
from ..session import materialise, scratch_path
from .metrics import rank_cells, roc_auc

# The helpers travel inside the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rounds that one job judges.
BLOCK = 100
#: Running totals that a task holds at a time.
_HELD = 1 << 22


@dataclass
class Tree:
    """Nodes in order of their number: an inner one sends ``x[feature] <= cut`` to ``left``; a leaf has itself as both."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def outputs(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            down = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            if np.array_equal(down, at):
                return self.value[at]
            at = down


def model_trees(spark: SparkSession, model: GBTClassificationModel) -> list[Tree]:
    """The trees of a fitted model, their values weighted so that they add up to the log-odds.

    Nodes are read from the saved form of the model, whose size is fixed by its parameters and not by any data.
    """
    path = scratch_path(spark, "trees")
    model.write().save(path)
    nodes: dict[int, dict[int, object]] = {}
    for row in spark.read.parquet(f"{path}/data").collect():
        nodes.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"]
    trees = []
    for tree, weight in enumerate(model.treeWeights):
        known = nodes[tree]
        place = {number: i for i, number in enumerate(sorted(known))}
        rows = []
        for i, number in enumerate(sorted(known)):
            node = known[number]
            if node["leftChild"] < 0:
                rows.append((0, 0.0, i, i, 2.0 * weight * node["prediction"]))
            else:
                cut = node["split"]["leftCategoriesOrThreshold"][0]
                rows.append((node["split"]["featureIndex"], cut, place[node["leftChild"]], place[node["rightChild"]], 0.0))
        feature, cut, left, right, value = zip(*rows, strict=True)
        trees.append(Tree(np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value)))
    return trees


def tree_outputs(df: DataFrame, model: PipelineModel, keep: Sequence[str], rounds: int | None = None) -> DataFrame:
    """``(keep..., outputs)``: what each of the first ``rounds`` trees adds to the log-odds of a row."""
    prepare, assemble, ensemble = model.stages
    inputs, keep = assemble.getInputCols(), list(keep)
    trees = model_trees(df.sparkSession, ensemble)[:rounds]

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            x = block[inputs].to_numpy(dtype="float64")
            out = block[keep].copy()
            out["outputs"] = list(np.stack([t.outputs(x) for t in trees], 1)) if trees else [[]] * len(block)
            yield out

    prepared = prepare.transform(df).select(*keep, *inputs)
    kept = ", ".join(f"{quoted(c)} {t}" for c, t in prepared.select(*keep).dtypes)
    return prepared.mapInPandas(run, f"{kept}, outputs array<double>")


def _distinct_scores(k: int, score: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, ...]:
    """Round, score, positives and negatives per distinct score."""
    order = np.argsort(score)
    score, positive = score[order], positive[order]
    at = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
    pos = np.add.reduceat(positive.astype(np.int64), at)
    size = np.diff(np.append(at, len(score)))
    return np.full(len(at), k, np.int32), score[at], pos, size - pos


def staged_cells(outputs: DataFrame, label: str, first: int, last: int, column: str = "outputs") -> DataFrame:
    """``(round, score, pos, neg)`` for the rounds ``first < round <= last``, rows without a label left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # as many rows at a time as bound the running totals
            step = max(1, _HELD // max(1, last))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                values = part.column(1)
                width = len(values[0]) if len(values) else 0
                totals = np.cumsum(values.flatten().to_numpy().reshape(len(values), width), 1)
                positive = part.column(0).to_numpy(zero_copy_only=False) == 1
                found = [_distinct_scores(k + 1, totals[:, k], positive) for k in range(first, min(last, width))]
                if found:
                    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["round", "score", "pos", "neg"])

    known = outputs.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("label"), F.col(column).alias("outputs"))
    cells = known.mapInArrow(run, "round int, score double, pos long, neg long")
    return cells.groupBy("round", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def staged_auc(outputs: DataFrame, label: str, rounds: int, first: int = 0, column: str = "outputs") -> DataFrame:
    """``(round, auc)`` for the rounds ``first < round <= rounds``.

    ``column`` holds as many numbers in every row, one per tree, none of them null. With labels of one class only the AUC is null.
    """
    return roc_auc(rank_cells(staged_cells(outputs, label, first, rounds, column), ["round"]), ["round"])


def best_round(staged: DataFrame, patience: int) -> DataFrame:
    """``(round, auc, stopped)``: the first round of the highest AUC before ``patience`` rounds pass without a higher one.

    ``stopped`` is the round that ended the search, null if the rounds ran out first. ``staged`` has one row
    per round, so a window over it holds as many rows as there are trees.
    """
    along = Window.partitionBy(F.lit(0)).orderBy("round")
    before = F.max("auc").over(along.rowsBetween(Window.unboundedPreceding, -1))
    risen = staged.withColumn("risen", F.when(before.isNull() | (F.col("auc") > before), F.col("round")))
    last = risen.withColumn("last", F.max("risen").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = last.withColumn("late", F.col("round") - F.col("last") >= patience)
    stop = F.min(F.when(F.col("late"), F.col("round")))
    seen = ends.withColumn("stopped", stop.over(Window.partitionBy(F.lit(0))))
    best = F.max_by(F.struct("round", "auc"), F.when(F.col("risen").isNotNull(), F.col("round"))).alias("b")
    return (
        seen.where(F.col("stopped").isNull() | (F.col("round") <= F.col("stopped")))
        .agg(best, F.max("stopped").alias("stopped"))
        .select("b.round", "b.auc", "stopped")
    )


def search_rounds(outputs: DataFrame, label: str, rounds: int, patience: int, block: int = BLOCK) -> tuple[int, DataFrame]:
    """The best round and the AUCs judged until the search stopped, one job per block of rounds."""
    spark = outputs.sparkSession
    judged: list[tuple[int, float]] = []
    for first in range(0, rounds, block):
        judged += [(r["round"], r["auc"]) for r in staged_auc(outputs, label, min(first + block, rounds), first).collect()]
        staged = spark.createDataFrame(judged, "round int, auc double")
        found = best_round(staged, patience).first()
        if found["stopped"] is not None:
            break
    best = found["round"] if judged and found["round"] is not None else rounds
    return best, spark.createDataFrame(judged, "round int, auc double")


def truncated(model: PipelineModel, rounds: int) -> PipelineModel:
    """The fitted pipeline with the first ``rounds`` trees of its ensemble."""
    *before, ensemble = model.stages
    spark = SparkSession.active()
    java, jvm, gateway = ensemble._java_obj, spark._jvm, spark.sparkContext._gateway
    all_trees, all_weights = java.trees(), java.treeWeights()
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(jvm.double, rounds)
    for i in range(rounds):
        trees[i], weights[i] = all_trees[i], float(all_weights[i])
    made = jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), trees, weights, java.numFeatures(), 2)
    cut = GBTClassificationModel(made)
    cut._resetUid(ensemble.uid)
    ensemble._copyValues(cut)
    cut._transfer_params_to_java()
    return PipelineModel([*before, cut])


def fit_early_stopping(
    pipeline, train: DataFrame, held_out: DataFrame, label: str, patience: int, block: int = BLOCK
) -> tuple[PipelineModel, DataFrame]:
    """A boosted pipeline cut at the round with the best AUC on ``held_out``, and the AUCs by round.

    Spark boosts all rounds at once; what stops early is the judging. The per-tree outputs of the held-out rows are written once.
    """
    model = pipeline.fit(train)
    rounds = len(model.stages[-1].treeWeights)
    outputs = materialise(tree_outputs(held_out, model, [label]), "tree-outputs")
    best, staged = search_rounds(outputs, label, rounds, patience, block)
    return truncated(model, best), staged
