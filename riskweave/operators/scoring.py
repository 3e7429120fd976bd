"""Lookup, scoring and decision for batches of clients."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import ID_COL, quoted
from ..functions.numeric import guarded_ratio, sigmoid

# The decision rule.
THRESHOLD = 0.46
REFUSED, APPROVED = "refusé", "accordé"


def request_ids(df: DataFrame, column: str = "client_ids", key: str = ID_COL) -> DataFrame:
    """One row per requested id, from a column holding an array of text or integer ids.

    ``valid`` is false, and the id NULL, where the text is not a whole number.
    """
    text = df.select(F.explode(F.col(column).cast("array<string>")).alias("raw"))
    return text.select("raw", F.col("raw").try_cast("bigint").alias(key)).withColumn(
        "valid", F.col(key).isNotNull()
    )


def as_id_list(c: Column | str) -> Column:
    """A single id as a list of one."""
    return F.array(F.col(c) if isinstance(c, str) else c)


def lookup_batch(ids: DataFrame, features: DataFrame, key: str = ID_COL) -> DataFrame:
    """Feature rows of the requested ids, one per request."""
    return ids.join(features, key)


def lookup_not_found(ids: DataFrame, features: DataFrame, key: str = ID_COL) -> DataFrame:
    return ids.join(features.select(key), key, "left_anti")


def lookup_found(ids: DataFrame, features: DataFrame, key: str = ID_COL) -> DataFrame:
    return ids.join(features.select(key), key, "left_semi")


def align_schema(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Columns in model order as doubles: absent ones NULL, unknown ones left out."""
    have = set(df.columns)

    def aligned(c: str) -> Column:
        x = F.col(quoted(c)) if c in have else F.lit(None)
        return x.cast("double").alias(c)

    return df.select(*keep, *[aligned(c) for c in features])


def features_from_map(df: DataFrame, column: str, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The same from a sparse ``map<string,double>``; an absent key is missing."""
    m = F.col(column)
    return df.select(*keep, *[F.try_element_at(m, F.lit(c)).alias(c) for c in features])


def decide(score: Column | str, threshold: float = THRESHOLD) -> Column:
    """Decision on the unrounded score."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= F.lit(threshold), F.lit(REFUSED)).otherwise(F.lit(APPROVED))


def answer(df: DataFrame, probability: Column, keep: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """``(keep..., score, decision, threshold)`` with the score rounded to four places."""
    scored = df.withColumn("_p", probability)
    return scored.select(
        *keep,
        F.round("_p", 4).alias("score"),
        decide("_p", threshold).alias("decision"),
        F.lit(threshold).alias("threshold"),
    )


def score_batch(
    df: DataFrame,
    model: PipelineModel,
    features: Sequence[str],
    keep: Sequence[str] = (ID_COL,),
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Score feature rows with a fitted pipeline."""
    scored = model.transform(align_schema(df, features, keep))
    return answer(scored, vector_to_array("probability")[1], keep, threshold)


def score_new_map(
    df: DataFrame,
    model: PipelineModel,
    features: Sequence[str],
    column: str = "features",
    keep: Sequence[str] = ("client_id",),
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Score clients that are not in the feature table, given as sparse maps."""
    scored = model.transform(features_from_map(df, column, features, keep))
    return answer(scored, vector_to_array("probability")[1], keep, threshold)


def linear_terms(coefficients: Mapping[str, float], means: Mapping[str, float] | None = None) -> dict[str, Column]:
    """``coefficient * (x - mean)`` per feature; a missing value sits at the mean."""
    terms = {}
    for name, weight in coefficients.items():
        centre = (means or {}).get(name, 0.0)
        shifted = F.col(quoted(name)).cast("double") - F.lit(float(centre))
        terms[name] = F.coalesce(F.lit(float(weight)) * shifted, F.lit(0.0))
    return terms


def linear_score(coefficients: Mapping[str, float], intercept: float) -> Column:
    """Logistic score of a coefficient table as one expression: no join, no shuffle."""
    raw = F.lit(float(intercept))
    for term in linear_terms(coefficients).values():
        raw = raw + term
    return sigmoid(raw)


def group_stats_report(
    predictions: DataFrame, not_found: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Scored, refused, approved and unknown counts, mean score and refusal rate."""
    scored = predictions.select(*by, "score", "decision", F.lit(0).alias("missing"))
    if not_found is not None:
        absent = not_found.select(
            *by,
            F.lit(None).cast("double").alias("score"),
            F.lit(None).cast("string").alias("decision"),
            F.lit(1).alias("missing"),
        )
        scored = scored.unionByName(absent)
    known = F.col("missing") == 0
    refused = F.count_if(F.col("decision") == REFUSED)
    total = F.count_if(known)
    return scored.groupBy(*by).agg(
        total.alias("total_clients_scored"),
        refused.alias("total_refused"),
        (total - refused).alias("total_approved"),
        F.count_if(~known).alias("total_not_found"),
        F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 4).alias("avg_score"),
        F.round(guarded_ratio(refused, total, 0.0), 4).alias("refusal_rate"),
    )


def pick_extreme_case(
    df: DataFrame,
    key: str,
    label: str,
    score: str,
    low: tuple[float, float] = (0.20, 0.40),
    high: tuple[float, float] = (0.53, 0.30),
) -> DataFrame:
    """The safest good client and the riskiest defaulter, one row each.

    Each side has a strict bound and a fallback used when nobody meets the strict one.
    Ties go to the lowest key.
    """
    s, y = F.col(score), F.col(label)
    good = F.min(F.when((y == 0) & (s < low[0]), F.struct(s, F.col(key).alias("id"))))
    good_wide = F.min(F.when((y == 0) & (s < low[1]), F.struct(s, F.col(key).alias("id"))))
    bad = F.min(F.when((y == 1) & (s > high[0]), F.struct((-s).alias("n"), F.col(key).alias("id"))))
    bad_wide = F.min(F.when((y == 1) & (s > high[1]), F.struct((-s).alias("n"), F.col(key).alias("id"))))
    picks = df.agg(F.coalesce(good, good_wide).alias("g"), F.coalesce(bad, bad_wide).alias("b"))
    rows = F.array(
        F.struct(F.lit(0).alias("label"), F.col("g.id").alias("id"), F.col(f"g.{score}").alias("score")),
        F.struct(F.lit(1).alias("label"), F.col("b.id").alias("id"), (-F.col("b.n")).alias("score")),
    )
    return picks.select(F.explode(rows).alias("r")).select("r.*")
