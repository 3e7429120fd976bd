"""Exact, repeatable splits, folds and samples.

Rows are ordered by a hash of their key. A split is then a cut point in that order, found on
the narrow (label, hash, key) columns; the wide table is only filtered by it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import cut_rows, first_rows

SEED = 42
_HASH, _KEY = "_hash", "_key"


def key_hash(key: Column | str, seed: int = SEED) -> Column:
    """A fixed pseudo-random position for a key, the same in any engine that has md5."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(f"-{seed}")))


def label_counts(df: DataFrame, label: str, max_labels: int = 1000) -> dict[object, int]:
    """Rows per class; more than ``max_labels`` classes mean the column is no label."""
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(max_labels + 1).collect()
    if len(rows) > max_labels:
        raise ValueError(f"{label} has more than {max_labels} classes")
    return {r[label]: r["n"] for r in sorted(rows, key=lambda r: (r[label] is not None, r[label]))}


def proportional_quota(counts: Mapping[object, int], total: int) -> dict[object, int]:
    """``total`` shared out by class size; leftover rows go to the largest remainders."""
    size = sum(counts.values())
    quota = {k: total * n // size for k, n in counts.items()}
    leftover = total - sum(quota.values())
    for k in sorted(counts, key=lambda k: -(total * counts[k] % size))[:leftover]:
        quota[k] += 1
    return quota


def fold_sizes(counts: Mapping[object, int], folds: int) -> dict[object, list[int]]:
    """Rows of each class per fold: classes laid end to end and dealt round-robin."""
    sizes, start = {}, 0
    for k, n in counts.items():
        sizes[k] = [len(range((f - start) % folds, n, folds)) for f in range(folds)]
        start += n
    return sizes


def _hash_cuts(df: DataFrame, key: str, label: str, ranks: Mapping[object, Sequence[int]], seed: int):
    narrow = df.select(label, key_hash(key, seed).alias(_HASH), F.col(key).alias(_KEY))
    return cut_rows(narrow, [_HASH, _KEY], {k: [r for r in v if r > 0] for k, v in ranks.items()}, label)


def _up_to(key: str, seed: int, cut: tuple | None) -> Column:
    """True for rows at or before the cut in hash order."""
    if cut is None:
        return F.lit(False)
    h, k = key_hash(key, seed), F.col(key)
    return (h < F.lit(cut[0])) | ((h == F.lit(cut[0])) & (k <= F.lit(cut[1])))


def split_stratified(
    df: DataFrame, key: str, label: str, test_size: float = 0.2, seed: int = SEED, name: str = "split"
) -> DataFrame:
    """Tag every row ``train`` or ``test`` so that both keep the class shares.

    ``key`` is unique. The test part has ceil(n * test_size) rows in all.
    """
    counts = label_counts(df, label)
    size = sum(counts.values())
    n_test = -(-size * round(test_size * 10**6) // 10**6)
    quota = proportional_quota(counts, size - n_test)
    cuts = _hash_cuts(df, key, label, {k: [q] for k, q in quota.items()}, seed)
    in_train = F.lit(False)
    for k, q in quota.items():
        in_train = in_train | (F.col(label).eqNullSafe(F.lit(k)) & _up_to(key, seed, cuts.get((k, q))))
    return df.withColumn(name, F.when(in_train, F.lit("train")).otherwise(F.lit("test")))


def kfold_stratified(
    df: DataFrame, key: str, label: str, folds: int = 5, seed: int = SEED, name: str = "fold"
) -> DataFrame:
    """Tag every row with a fold 0..folds-1; class counts per fold differ by at most one."""
    sizes = fold_sizes(label_counts(df, label), folds)
    ends = {k: [sum(s[: f + 1]) for f in range(folds)] for k, s in sizes.items()}
    cuts = _hash_cuts(df, key, label, ends, seed)
    fold = F.lit(None).cast("int")
    for k, e in ends.items():
        in_class = F.col(label).eqNullSafe(F.lit(k))
        for f in reversed(range(folds)):
            fold = F.when(in_class & _up_to(key, seed, cuts.get((k, e[f]))), F.lit(f)).otherwise(fold)
    return df.withColumn(name, fold)


def sample_fraction(df: DataFrame, key: str, label: str, fraction: float, seed: int = SEED) -> DataFrame:
    """A stratified share of the table, exact in size."""
    part = split_stratified(df, key, label, 1 - fraction, seed, "_part")
    return part.where(F.col("_part") == "train").drop("_part")


def sample_n(df: DataFrame, key: str, n: int = 5000, seed: int = SEED) -> DataFrame:
    """``n`` rows in hash order."""
    hashed = df.withColumn(_HASH, key_hash(key, seed))
    return first_rows(hashed, [_HASH, key], n).drop(_HASH)


def split_by_key_order(df: DataFrame, key: str, share: float = 0.8, name: str = "slice") -> DataFrame:
    """Tag the first ``int(n * share)`` rows along the unique key ``reference``, the rest ``current``."""
    cut = int(df.count() * share)
    if cut == 0:
        return df.withColumn(name, F.lit("current"))
    last = cut_rows(df.select(key), [key], {None: [cut]})[(None, cut)][0]
    return df.withColumn(name, F.when(F.col(key) <= F.lit(last), F.lit("reference")).otherwise(F.lit("current")))


def dropna_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))
