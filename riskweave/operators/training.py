"""Training, cross-validation and search with Spark ML."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import quoted
from ..session import allow_checkpoints, materialise
from .ordered import exact_quantiles
from .splits import SEED, label_counts
from .staged import fit_early_stopping

# Parameters of the baseline and tuned models, and the searched values.
LOGREG_C, LOGREG_MAX_ITER = 0.1, 1000
LOGREG_GRID = [0.001, 0.01, 0.1]
LOGREG_WIDE_GRID = [0.001, 0.01, 0.1, 1.0, 10.0]
TREES_BASELINE = {"trees": 1000, "rate": 0.05, "leaves": 31, "min_rows": 20, "row_share": 0.8, "column_share": 0.8}
TREES_IN_USE = {"trees": 500, "rate": 0.05, "leaves": 31, "min_rows": 300, "row_share": 0.8, "column_share": 0.8}
TREES_SEARCH = {
    "trees": [300, 500],
    "rate": [0.05, 0.1],
    "leaves": [31, 63, 100],
    "min_rows": [20, 50, 100, 150],
    "row_share": [0.6, 0.8, 1.0],
    "column_share": [0.6, 0.8, 1.0],
}
SEARCH_DRAWS = 30
EARLY_STOP_ROUNDS = 100
# Rows that a task of a fit gets at most, about, and the parameters that name the columns a classifier reads.
ROWS_PER_TASK = 50_000
_READ = ("featuresCol", "labelCol", "weightCol", "validationIndicatorCol")


# ---- preparation ------------------------------------------------------------------------


def class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Weight n / (classes * n_class), so that every class weighs the same."""
    counts = label_counts(df, label)
    total = sum(counts.values())
    weight = F.lit(None).cast("double")
    for value, n in counts.items():
        weight = F.when(F.col(label) == F.lit(value), F.lit(total / (len(counts) * n))).otherwise(weight)
    return df.withColumn(name, weight)


def fit_medians_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, median)`` over the known values, exact."""
    return exact_quantiles(df, columns, [0.5]).select("feature", F.col("q0").alias("median"))


def fit_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Medians as numbers, one per column; 0 for a column without any known value."""
    found = {r["feature"]: r["median"] for r in fit_medians_table(df, columns).collect()}
    return {c: found.get(c, 0.0) for c in columns}


def fit_scale(df: DataFrame, columns: Sequence[str], fill: Mapping[str, float]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column after filling; a constant column keeps 1."""
    measures = []
    for i, c in enumerate(columns):
        x = f"coalesce(CAST({quoted(c)} AS DOUBLE), {fill.get(c, 0.0)!r}D)"
        measures += [f"avg({x}) AS m{i}", f"stddev_pop({x}) AS s{i}"]
    row = df.agg(*[F.expr(m) for m in measures]).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def standardise(df: DataFrame, columns: Sequence[str], scale: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """``(x - mean) / deviation``; missing values stay missing."""
    if scale is None:
        row = df.agg(
            *[F.avg(F.col(quoted(c))).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(F.col(quoted(c))).alias(f"s{i}") for i, c in enumerate(columns)],
        ).first()
        scale = {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}
    return df.withColumns(
        {c: (F.col(quoted(c)) - F.lit(scale[c][0])) / F.lit(scale[c][1]) for c in columns}
    )


def dummy_prior(train: DataFrame, df: DataFrame, label: str) -> DataFrame:
    """The class share of the training rows as everyone's score."""
    return df.withColumn("score", train.agg(F.avg(label).alias("p")).scalar())


class Preparation(Estimator):
    """Fills missing values with exact training medians and, on request, standardises.

    With ``flags`` each column also gets a 0/1 column saying that it was missing, for
    trees, which cannot take a missing value as such. The fitted stage is a plain SQL
    transformer, so fitted pipelines can be saved and loaded like any other.
    """

    def __init__(self, features: Sequence[str], scale: bool, flags: bool):
        super().__init__()
        self.features, self.scale, self.flags = list(features), scale, flags

    def outputs(self) -> list[str]:
        n = len(self.features)
        return [f"x{i}" for i in range(n)] + ([f"x{i}_missing" for i in range(n)] if self.flags else [])

    def _fit(self, dataset: DataFrame) -> Transformer:
        medians = fit_medians(dataset, self.features)
        scale = fit_scale(dataset, self.features, medians) if self.scale else {}
        parts = []
        for i, c in enumerate(self.features):
            x = f"CAST({quoted(c)} AS DOUBLE)"
            mean, deviation = scale.get(c, (0.0, 1.0))
            parts.append(f"(coalesce({x}, {medians[c]!r}D) - {mean!r}D) / {deviation!r}D AS x{i}")
            if self.flags:
                parts.append(f"CAST({x} IS NULL AS DOUBLE) AS x{i}_missing")
        return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")

    def copy(self, extra=None):
        return self


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out in parts of about ROWS_PER_TASK rows; as it is, if it has no more than that.

    A narrow table of many rows is one file of one row group, hence one task, however much its rows grow in memory.
    """
    parts = -(-df.count() // ROWS_PER_TASK)
    return df.repartition(parts) if parts > 1 else df


class SpreadPipeline(Pipeline):
    """Preparation, assembler and classifier; the classifier is fitted on spread rows of the columns that it reads."""

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        prepare, assemble, classifier = self.getStages()
        prepared = prepare.fit(dataset)
        read = [classifier.getOrDefault(p) for p in classifier.params if p.name in _READ and classifier.isDefined(p)]
        rows = assemble.transform(prepared.transform(dataset)).select(*dict.fromkeys(read))
        allow_checkpoints(dataset.sparkSession)
        return PipelineModel([prepared, assemble, classifier.fit(spread(rows))])


def _pipeline(prepare: Preparation, classifier: Estimator) -> Pipeline:
    assemble = VectorAssembler(inputCols=prepare.outputs(), outputCol="features_vector")
    return SpreadPipeline(stages=[prepare, assemble, classifier])


def logreg_train(
    features: Sequence[str], label: str, n_rows: int, c: float = LOGREG_C, penalty: str = "l2", weight: str | None = "weight"
) -> Pipeline:
    """Logistic regression with inverse penalty ``c``, the intercept unpenalised.

    ``n_rows`` is the total of the weights of the training rows: balanced weights add up to
    the number of rows, and Spark averages the loss where ``c`` multiplies its sum.
    """
    classifier = LogisticRegression(
        featuresCol="features_vector",
        labelCol=label,
        maxIter=LOGREG_MAX_ITER,
        tol=1e-8,
        regParam=1.0 / (c * n_rows),
        elasticNetParam=1.0 if penalty == "l1" else 0.0,
        standardization=False,
    )
    if weight:
        classifier.setWeightCol(weight)
    return _pipeline(Preparation(features, scale=True, flags=False), classifier)


def gbt_train(
    features: Sequence[str],
    label: str,
    trees: int = 500,
    rate: float = 0.05,
    leaves: int = 31,
    min_rows: int = 300,
    row_share: float = 0.8,
    column_share: float = 0.8,
    weight: str | None = "weight",
    validation: str | None = None,
    seed: int = SEED,
) -> Pipeline:
    """Boosted trees. A leaf budget becomes the depth that can hold it.

    ``validation`` names a boolean column; boosting stops once those rows stop improving.
    """
    classifier = GBTClassifier(
        featuresCol="features_vector",
        labelCol=label,
        maxIter=trees,
        stepSize=rate,
        maxDepth=max(1, math.ceil(math.log2(leaves))),
        minInstancesPerNode=min_rows,
        subsamplingRate=row_share,
        featureSubsetStrategy="all" if column_share >= 1 else str(column_share),
        seed=seed,
    )
    if weight:
        classifier.setWeightCol(weight)
    if validation:
        classifier.setValidationIndicatorCol(validation)
    return _pipeline(Preparation(features, scale=False, flags=True), classifier)


def score_with(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias("score"))


# ---- cross-validation and search --------------------------------------------------------


def cv_oof(
    df: DataFrame,
    make: Callable[[DataFrame], Pipeline],
    key: str,
    label: str,
    fold: str = "fold",
    folds: int = 5,
    validation: str | None = None,
    patience: int | None = None,
) -> DataFrame:
    """Out-of-fold scores ``(key, label, fold, score)`` for every row.

    The fold-tagged table is written once and read by every fit. The held-out fold also serves as
    the stopping rows of boosted models: with ``patience`` they are cut at the round of the best AUC, once
    so many rounds bring no better one; with ``validation`` boosting stops on their loss.
    """
    stored = materialise(spread(df), "folds")
    parts = []
    for f in range(folds):
        held_out = stored.where(F.col(fold) == f)
        if validation:
            train = stored.withColumn(validation, F.col(fold) == f)
        else:
            train = stored.where(F.col(fold) != f)
        if patience:
            model, _ = fit_early_stopping(make(train), train, held_out, label, patience)
        else:
            model = make(train).fit(train)
        parts.append(score_with(model, held_out, [key, label, fold]))
    return reduce(lambda a, b: a.unionByName(b), parts)


def param_rows(spark, results: Sequence[tuple[Mapping[str, object], float]]) -> DataFrame:
    """``(params, auc)``, best first."""
    rows = [({k: str(v) for k, v in p.items()}, float(a)) for p, a in results]
    table = spark.createDataFrame(rows, "params map<string,string>, auc double")
    return table.orderBy(F.col("auc").desc(), F.to_json("params"))


class PreparedFolds:
    """Folds prepared once, each on its own training rows, for candidates that differ in their classifier only."""

    def __init__(self, df: DataFrame, pipeline: Pipeline, label: str, fold: str, folds: int, parallel: int):
        prepare, assemble, self.classifier = pipeline.getStages()
        self.label, self.parallel = label, parallel
        weight = self.classifier.getOrDefault("weightCol") if self.classifier.isDefined("weightCol") else None
        columns = [label, assemble.getOutputCol(), *([weight] if weight else [])]
        stored = materialise(spread(df), "search")

        def prepared(f: int) -> tuple[DataFrame, DataFrame]:
            train, held_out = stored.where(F.col(fold) != f), stored.where(F.col(fold) == f)
            shape = Pipeline(stages=[prepare, assemble]).fit(train)
            train, held_out = (materialise(spread(shape.transform(d).select(*columns)), "fold") for d in (train, held_out))
            return train, held_out

        allow_checkpoints(df.sparkSession)
        with ThreadPool(parallel) as pool:
            self.parts = pool.map(prepared, range(folds))

    def mean_aucs(self, pipelines: Sequence[Pipeline]) -> list[float]:
        """Mean AUC over the folds of each candidate. Folds run side by side."""
        classifiers = [p.getStages()[-1] for p in pipelines]
        grids = [{getattr(self.classifier, p.name): c.getOrDefault(p) for p in c.params if c.isSet(p)} for c in classifiers]
        judge = BinaryClassificationEvaluator(labelCol=self.label, rawPredictionCol="rawPrediction", numBins=0)

        def one_fold(part: tuple[DataFrame, DataFrame]) -> list[float]:
            found = dict(self.classifier.fitMultiple(part[0], grids))
            return [judge.evaluate(found[i].transform(part[1])) for i in range(len(grids))]

        with ThreadPool(self.parallel) as pool:
            per_fold = pool.map(one_fold, self.parts)
        return [sum(aucs) / len(self.parts) for aucs in zip(*per_fold, strict=True)]


def _cross_validated(
    df: DataFrame,
    candidates: Sequence[Mapping[str, object]],
    make: Callable[..., Pipeline],
    label: str,
    fold: str,
    folds: int,
    parallel: int,
) -> DataFrame:
    """Mean AUC over the folds for every candidate."""
    pipelines = [make(**candidate) for candidate in candidates]
    means = PreparedFolds(df, pipelines[0], label, fold, folds, parallel).mean_aucs(pipelines)
    return param_rows(df.sparkSession, list(zip(candidates, means, strict=True)))


def grid_search(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    n_rows: int,
    grid: Sequence[float] = LOGREG_GRID,
    penalties: Sequence[str] = ("l2",),
    fold: str = "fold",
    folds: int = 5,
    parallel: int = 2,
) -> DataFrame:
    """Logistic regression over the inverse penalties and penalty kinds."""
    candidates = [{"c": c, "penalty": p} for c in grid for p in penalties]
    train_rows = n_rows * (folds - 1) // folds

    def make(c, penalty):
        return logreg_train(features, label, train_rows, c, penalty)

    return _cross_validated(df, candidates, make, label, fold, folds, parallel)


def draw_candidates(values: Mapping[str, Sequence], n: int = SEARCH_DRAWS, seed: int = SEED) -> list[dict]:
    """``n`` different combinations, drawn with a seed."""
    names = list(values)
    total = math.prod(len(values[k]) for k in names)
    picks = random.Random(seed).sample(range(total), min(n, total))
    candidates = []
    for pick in picks:
        candidate = {}
        for k in names:
            pick, at = divmod(pick, len(values[k]))
            candidate[k] = values[k][at]
        candidates.append(candidate)
    return candidates


def local_grid(best: Mapping[str, object]) -> list[dict]:
    """Leaves and minimum rows at half, once and twice the best values, within bounds."""
    leaves, rows = best["leaves"], best["min_rows"]
    return [
        {**best, "leaves": a, "min_rows": b}
        for a in sorted({max(4, leaves // 2), leaves, min(255, leaves * 2)})
        for b in sorted({max(10, rows // 2), rows, rows * 2})
    ]


def random_search(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    candidates: Sequence[Mapping[str, object]],
    fold: str = "fold",
    folds: int = 5,
    parallel: int = 2,
) -> DataFrame:
    """Boosted trees over the given candidates."""

    def make(**candidate):
        return gbt_train(features, label, **candidate)

    return _cross_validated(df, candidates, make, label, fold, folds, parallel)


def two_stage_search(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    values: Mapping[str, Sequence] = TREES_SEARCH,
    draws: int = SEARCH_DRAWS,
    seed: int = SEED,
    fold: str = "fold",
    folds: int = 5,
    parallel: int = 2,
) -> DataFrame:
    """Boosted trees: ``draws`` random combinations, then the local grid around the best of them.

    ``(stage, params, auc)``, one row per candidate and stage, best first within a stage. Both stages share the prepared
    folds. A candidate of the grid that was drawn before, as its centre was, keeps the AUC it has.
    """

    def make(candidate: Mapping[str, object]) -> Pipeline:
        return gbt_train(features, label, **candidate)

    drawn = draw_candidates(values, draws, seed)
    prepared = PreparedFolds(df, make(drawn[0]), label, fold, folds, parallel)
    known = [*zip(drawn, prepared.mean_aucs([make(c) for c in drawn]), strict=True)]
    # the same order as that of the result: ties by the text of the parameters
    best = min(known, key=lambda r: (-r[1], json.dumps({k: str(v) for k, v in r[0].items()}, separators=(",", ":"))))[0]
    near = local_grid(best)
    fresh = [c for c in near if c not in drawn]
    known += zip(fresh, prepared.mean_aucs([make(c) for c in fresh]) if fresh else [], strict=True)
    near_rows = [(c, next(auc for k, auc in known if k == c)) for c in near]
    spark = df.sparkSession
    stages = [param_rows(spark, rows).select(F.lit(n).alias("stage"), "params", "auc") for n, rows in ((1, known[: len(drawn)]), (2, near_rows))]
    return stages[0].unionByName(stages[1])


def refit_all(df: DataFrame, pipeline: Pipeline, split: str = "split") -> tuple[PipelineModel, PipelineModel]:
    """The model fitted on the training part, for the test score, and the one fitted on everything."""
    return pipeline.fit(df.where(F.col(split) == "train")), pipeline.fit(df)
