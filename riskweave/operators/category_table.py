"""Categories without a list of them in the driver: codes from a joined table, shares as a map per client.

``encode`` turns categories into columns or literals, for which their values must be known when the plan is made. These
operators leave them in tables, so a column may have any number of values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import quoted, text_columns
from ..session import shuffle_width
from .ordered import prefix_totals

MISSING = "_nan"
#: Rows that a task gets, and tasks among which the rows of one client are dealt.
ROWS_PER_TASK, SALTS = 200_000, 16


def label_table(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """``(column, category, code)``: codes from 0 in order of the lowest key of a category, ties by its text.

    The order is that of ``encode.fit_labels``; here the categories are numbered slice by slice, none of them is collected.
    """
    long = df.select(F.col(quoted(key)).alias("_key"), *[F.col(quoted(c)).cast("string").alias(c) for c in columns])
    long = long.unpivot(["_key"], [F.col(quoted(c)) for c in columns], "column", "category").where("category IS NOT NULL")
    firsts = long.groupBy("column", "category").agg(F.min("_key").alias("first_key")).withColumn("one", F.lit(1).cast("long"))
    ranked = prefix_totals(firsts, ["first_key", "category"], ["one"], ["column"])
    return ranked.select("column", "category", (F.col("one_upto") - 1).alias("code"))


def label_encode(df: DataFrame, labels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the codes of ``labels`` in place of the columns; -1 for a null and for a category without a code.

    A category that most rows have is no hot key: equal rows of a join are split by the adaptive plan, or the
    table of codes is small enough to go to every task.
    """
    out = df
    for i, c in enumerate(columns):
        codes = labels.where(F.col("column") == c).select(F.col("category").alias(f"_category{i}"), F.col("code").alias(f"_code{i}"))
        out = out.join(codes, F.col(quoted(c)).cast("string") == F.col(f"_category{i}"), "left")
    coded = {c: F.coalesce(F.col(f"_code{i}"), F.lit(-1).cast("long")).alias(c) for i, c in enumerate(columns)}
    return out.select(*[coded.get(c, F.col(quoted(c))) for c in df.columns])


def _cells(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``(key, column, category, n)``, all rows of a client in one task.

    How many rows a task gets does not depend on the size of the table, nor on how well they compress: both exchanges
    have a number of partitions that follows from the number of rows. Rows are counted before a client's are
    gathered, and those of one client are dealt to SALTS tasks for it.
    """
    known = df.where(F.col(quoted(key)).isNotNull())
    tasks = max(shuffle_width(df.sparkSession), -(-known.count() // ROWS_PER_TASK))
    own = known.select(F.col(quoted(key)).alias(key), *[F.col(quoted(c)).cast("string").alias(c) for c in columns])
    dealt = own.withColumn("_salt", F.monotonically_increasing_id() % SALTS).repartition(tasks, quoted(key), "_salt")
    # unlike unpivot, this keeps the partitions
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(quoted(c)).alias("category")) for c in columns])
    long = dealt.select(quoted(key), "_salt", F.inline(pairs))
    counted = long.groupBy(quoted(key), "_salt", "column", "category").agg(F.count(F.lit(1)).alias("n"))
    gathered = counted.drop("_salt").repartition(tasks, quoted(key))
    return gathered.groupBy(quoted(key), "column", "category").agg(F.sum("n").alias("n"))


def share_rows(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``(key, column, category, n, share)``: the share of a client's rows in each category it has, null among them.

    Rows are counted per client and category before anything is gathered.
    """
    columns = list(columns if columns is not None else [c for c in text_columns(df) if c != key])
    # every column has all rows of a client
    rows = F.sum("n").over(Window.partitionBy(quoted(key), "column"))
    return _cells(df, key, columns).select(quoted(key), "column", "category", "n", (F.col("n") / rows).alias("share"))


def share_maps(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Per client one ``map<category, share>`` for each column, and ``<column>_nan``, the share of missing values.

    A category that a client does not have is absent from its map, where ``encode.one_hot_rate`` has a column of zeros. A map is
    as large as the number of categories of one client.
    """
    columns = list(columns if columns is not None else [c for c in text_columns(df) if c != key])
    found: list[Column] = []
    parts: list[Column] = []
    for i, c in enumerate(columns):
        own = F.col("column") == c
        found.append(F.collect_list(F.when(own & F.col("category").isNotNull(), F.struct("category", "n"))).alias(f"_list{i}"))
        found.append(F.coalesce(F.max(F.when(own & F.col("category").isNull(), F.col("n"))), F.lit(0)).alias(f"_null{i}"))
        shares = F.transform(f"_list{i}", lambda e: F.struct(e["category"], e["n"] / F.col("_rows")))
        parts += [F.map_from_entries(shares).alias(c), (F.col(f"_null{i}") / F.col("_rows")).alias(c + MISSING)]
    rows = F.sum(F.when(F.col("column") == columns[0], F.col("n"))).alias("_rows")
    return _cells(df, key, columns).groupBy(quoted(key)).agg(rows, *found).select(quoted(key), *parts)


def share_of(column: str, category: str) -> Column:
    """The share of a category in a column of ``share_maps``; 0 if the client has none of it."""
    return F.coalesce(F.try_element_at(F.col(quoted(column)), F.lit(category)), F.lit(0.0))
