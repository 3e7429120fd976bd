"""Evaluation of scores against a 0/1 label.

Every function takes ``label`` and ``score`` column names and an optional list of grouping
columns ``by`` (model, fold, slice). Ranking metrics first count labels per distinct score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import guarded_ratio
from ..session import materialise
from .ordered import prefix_totals

# Costs of the two errors and the grid of thresholds.
FN_COST, FP_COST = 10, 1
GRID_START, GRID_STEP, GRID_SIZE = 0.01, 0.01, 98


def thresholds() -> list[float]:
    """0.01, 0.02, ... 0.98 exactly as start + i * step gives them in double precision."""
    return [GRID_START + i * GRID_STEP for i in range(GRID_SIZE)]


def _cases(label: str, predicted: Column) -> list[Column]:
    y = F.col(label) == 1
    return [
        F.count_if(~y & ~predicted).alias("tn"),
        F.count_if(~y & predicted).alias("fp"),
        F.count_if(y & ~predicted).alias("fn"),
        F.count_if(y & predicted).alias("tp"),
    ]


def confusion(df: DataFrame, label: str, score: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*_cases(label, F.col(score) >= F.lit(threshold)))


def cost(fn: Column | str = "fn", fp: Column | str = "fp", fn_cost: int = FN_COST, fp_cost: int = FP_COST) -> Column:
    fn = F.col(fn) if isinstance(fn, str) else fn
    fp = F.col(fp) if isinstance(fp, str) else fp
    return fn * F.lit(fn_cost) + fp * F.lit(fp_cost)


def business_cost(
    df: DataFrame,
    label: str,
    score: str,
    threshold: float,
    fn_cost: int = FN_COST,
    fp_cost: int = FP_COST,
    by: Sequence[str] = (),
) -> DataFrame:
    counted = confusion(df, label, score, threshold, by)
    return counted.select(*by, cost("fn", "fp", fn_cost, fp_cost).alias("cost"), "fn", "fp")


def precision_recall_f1(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """From ``confusion`` output; a zero denominator gives 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *by,
        guarded_ratio(tp, tp + fp, 0.0).alias("precision"),
        guarded_ratio(tp, tp + fn, 0.0).alias("recall"),
        guarded_ratio(tp * 2, tp * 2 + fp + fn, 0.0).alias("f1"),
    )


def grid_position(score: str) -> Column:
    """How many grid thresholds a score reaches.

    The product with 100 may round across a threshold, so the guess is checked against the
    thresholds on both sides of it.
    """
    cuts = F.array(*[F.lit(t) for t in thresholds()])
    s = F.col(score)
    guess = F.greatest(F.lit(0), F.least(F.floor(s * 100).cast("int"), F.lit(GRID_SIZE)))
    above = F.get(cuts, guess)
    below = F.get(cuts, guess - 1)
    return F.when(s >= above, guess + 1).when(s < below, guess - 1).otherwise(guess)


def threshold_sweep(
    df: DataFrame,
    label: str,
    score: str,
    by: Sequence[str] = (),
    fn_cost: int = FN_COST,
    fp_cost: int = FP_COST,
) -> DataFrame:
    """``(by, threshold, fn, fp, cost)`` for all grid thresholds, from one scan.

    Scores are counted per grid cell, 99 per group, before anything is shuffled.
    """
    y = F.col(label) == 1
    cells = (
        df.where(F.col(score).isNotNull())
        .groupBy(*by, grid_position(score).alias("cell"))
        .agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    )
    return sweep_cells(cells, by, fn_cost, fp_cost)


def sweep_cells(
    cells: DataFrame, by: Sequence[str] = (), fn_cost: int = FN_COST, fp_cost: int = FP_COST
) -> DataFrame:
    """Errors at each threshold from label counts per grid cell; a group is at most 99 rows."""
    packed = cells.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("cell", F.struct("pos", "neg").alias("v")))).alias("m")
    )
    # one row per group and cell, empty cells included
    full = packed.select(*by, F.col("m"), F.explode(F.sequence(F.lit(0), F.lit(GRID_SIZE))).alias("cell"))
    counted = full.select(
        *by,
        "cell",
        F.coalesce(F.try_element_at("m", F.col("cell"))["pos"], F.lit(0)).alias("pos"),
        F.coalesce(F.try_element_at("m", F.col("cell"))["neg"], F.lit(0)).alias("neg"),
    )
    group = Window.partitionBy(*(by or [F.lit(0)])).orderBy("cell")
    below = group.rowsBetween(Window.unboundedPreceding, -1)
    onward = group.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    swept = counted.select(
        *by,
        "cell",
        F.coalesce(F.sum("pos").over(below), F.lit(0)).alias("fn"),
        F.sum("neg").over(onward).alias("fp"),
    ).where(F.col("cell") > 0)
    cuts = F.array(*[F.lit(t) for t in thresholds()])
    return swept.select(
        *by,
        F.get(cuts, F.col("cell") - 1).alias("threshold"),
        "fn",
        "fp",
        cost("fn", "fp", fn_cost, fp_cost).alias("cost"),
    )


def best_threshold(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cheapest threshold, the lowest one on a tie, rounded to two places."""
    best = F.min(F.struct("cost", "threshold"))
    return sweep.groupBy(*by).agg(best.alias("b")).select(
        *by, F.round("b.threshold", 2).alias("threshold"), F.col("b.cost").alias("cost")
    )


def score_cells(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by, score, pos, neg)`` per distinct score."""
    y = F.col(label) == 1
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")
    )


def rank_cells(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return prefix_totals(cells, ["score"], ["pos", "neg"], by, descending=True, with_totals=True)


def ranked_cells(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Score cells with the positives and negatives at or above each score, and in all."""
    return rank_cells(score_cells(df, label, score, by), by)


def roc_points(ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, score, fpr, tpr)`` per distinct score, from ``ranked_cells``."""
    return ranked.select(
        *by,
        "score",
        guarded_ratio(F.col("neg_upto"), F.col("neg_total")).alias("fpr"),
        guarded_ratio(F.col("pos_upto"), F.col("pos_total")).alias("tpr"),
    )


def roc_auc(ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Chance that a positive outranks a negative, ties counting half."""
    positives_above = F.col("pos_upto") - F.col("pos")
    wins = F.sum(F.col("neg").cast("double") * (positives_above + F.col("pos") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.groupBy(*by).agg(guarded_ratio(wins, pairs).alias("auc"))


def average_precision(ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of precision times the step in recall, without interpolation."""
    precision = F.col("pos_upto") / F.nullif(F.col("pos_upto") + F.col("neg_upto"), F.lit(0))
    return ranked.groupBy(*by).agg(
        guarded_ratio(F.sum(precision * F.col("pos")), F.sum("pos")).alias("average_precision")
    )


def fold_auc_stats(fold_aucs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of the AUCs of the folds."""
    return fold_aucs.groupBy(*by).agg(F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"))


def metrics_table(scored: DataFrame, label: str, score: str, model: str, fold: str) -> DataFrame:
    """One row of metrics per model at its cheapest threshold, with the best values marked.

    ``scored`` holds out-of-fold scores of all models: ``(model, fold, label, score)``.
    """
    by = [model]
    # everything below comes from the label counts per score, which are kept once
    cells = materialise(score_cells(scored, label, score, [model, fold]), "scores")
    folds = roc_auc(rank_cells(cells, [model, fold]), [model, fold])
    overall = cells.groupBy(model, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    precision = average_precision(rank_cells(overall, by), by)
    grid = cells.groupBy(model, grid_position("score").alias("cell")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cut = best_threshold(sweep_cells(grid, by), by).select(*by, "threshold")
    # the rounded threshold may differ from the grid value in the last bit, so errors are recounted
    above = F.col("score") >= F.col("threshold")

    def total(measure: str, condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(measure))), F.lit(0))

    counts = cells.join(cut, by).groupBy(*by, "threshold").agg(
        total("neg", ~above).alias("tn"),
        total("neg", above).alias("fp"),
        total("pos", ~above).alias("fn"),
        total("pos", above).alias("tp"),
    )
    rates = precision_recall_f1(counts, by)
    table = (
        fold_auc_stats(folds, by)
        .join(precision, by)
        .join(rates, by)
        .join(counts.select(*by, "threshold", cost().alias("cost"), "fn", "fp"), by)
    )
    rounded = table.select(
        *by,
        *[F.round(c, 4).alias(c) for c in ("auc_mean", "auc_std", "average_precision", "recall", "precision", "f1")],
        "threshold",
        "cost",
        "fn",
        "fp",
    )
    return mark_best(rounded, highest=("auc_mean", "average_precision", "recall", "f1"), lowest=("cost", "fn", "fp"))


def mark_best(table: DataFrame, highest: Sequence[str], lowest: Sequence[str]) -> DataFrame:
    """Flags ``<metric>_best`` on a metrics table, one row per model."""
    # written first: the best values are a second look at it
    table = materialise(table, "metrics")
    best = table.agg(F.struct(*[F.max(c).alias(c) for c in highest], *[F.min(c).alias(c) for c in lowest]).alias("b")).scalar()
    return table.withColumns({f"{c}_best": F.col(c) == best[c] for c in [*highest, *lowest]})


def oof_test_gap(oof_mean: DataFrame, test_auc: DataFrame, by: Sequence[str]) -> DataFrame:
    """Out-of-fold mean AUC minus test AUC, the mean rounded first."""
    joined = oof_mean.join(test_auc, list(by))
    return joined.select(
        *by,
        F.round("auc_mean", 4).alias("auc_mean"),
        F.round("auc", 4).alias("auc_test"),
        F.round(F.round("auc_mean", 4) - F.col("auc"), 4).alias("gap"),
    )


def auc_by_slice(df: DataFrame, label: str, score: str, slice_col: str = "slice") -> DataFrame:
    """AUC on the reference and the current slice, and the loss between them."""
    per_slice = roc_auc(ranked_cells(df, label, score, [slice_col]), [slice_col])

    def on(name: str) -> Column:
        return F.max(F.when(F.col(slice_col) == name, F.col("auc")))

    pair = per_slice.agg(on("reference").alias("auc_reference"), on("current").alias("auc_current"))
    return pair.withColumn("auc_loss", F.col("auc_reference") - F.col("auc_current"))
