"""Tables laid out by client: buckets that are joined and grouped without a shuffle, and Bloom filters for lookups.

All tables of a family have the same number of buckets of the same key, sorted within. Grouping by the key and
joining on it then read bucket by bucket. A lookup of listed ids opens only the files of their buckets, and in them
only the row groups whose Bloom filter may hold one.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import ID_COL, quoted

#: More ids than this are joined instead of being listed in the filter.
LISTED_IDS = 10_000


def _checked(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"{name!r} is no table name")
    return name


def store_by_key(df: DataFrame, name: str, path: str, buckets: int, key: str = ID_COL, distinct_keys: int | None = None) -> DataFrame:
    """Write ``df`` as the table ``name`` at ``path``, in sorted buckets of ``key``, one file each, and return it.

    ``distinct_keys`` is what a file's Bloom filter is sized for; by default the rows are counted for it.
    """
    spark = df.sparkSession
    n = distinct_keys if distinct_keys is not None else df.select(key).count()
    writer = (
        df.repartition(buckets, F.col(quoted(key)))  # the rows of a bucket in one task, so in one file
        .write.mode("error")
        .format("parquet")
        .option("path", path)
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{key}", str(max(1, -(-n // buckets))))
        .bucketBy(buckets, key)
        .sortBy(key)
    )
    writer.saveAsTable(_checked(name))
    return spark.table(name)


def open_by_key(spark: SparkSession, name: str, path: str, schema: str, buckets: int, key: str = ID_COL) -> DataFrame:
    """Make a table that another session has stored known to this one."""
    place = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_checked(name)} ({schema}) USING parquet "
        f"CLUSTERED BY ({quoted(key)}) SORTED BY ({quoted(key)}) INTO {int(buckets)} BUCKETS LOCATION '{place}'"
    )
    return spark.table(name)


def lookup_stored(table: DataFrame, ids: DataFrame | Sequence[int], key: str = ID_COL) -> DataFrame:
    """The rows of ``table`` with one of the ids, each once however often it is asked for.

    Up to LISTED_IDS ids become a filter that prunes buckets and row groups; more are joined.
    """
    if isinstance(ids, DataFrame):
        few = ids.select(key).distinct().limit(LISTED_IDS + 1).collect()
        if len(few) > LISTED_IDS:
            return table.join(ids.select(key).distinct(), key, "left_semi")
        ids = [r[0] for r in few if r[0] is not None]
    return table.where(F.col(quoted(key)).isin(sorted(set(ids)))) if ids else table.limit(0)


def files_read(df: DataFrame) -> int:
    """Files that the scans of a plan open, those of pruned buckets left out. Nothing is run."""
    nodes, files = [df.select("*")._jdf.queryExecution().executedPlan()], set()
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        if kind == "FileSourceScanExec":
            for part in node.inputRDD().partitions():
                files |= {f.filePath().toString() for f in part.files()}
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return len(files)
