"""Sharding by extendible hashing.

A shard is a bucket of a directory indexed by the leading bits of a hash of the key. Only a bucket
above the byte limit splits on one more bit, until every bucket fits. The tree is found from sums per
cell of leading bits: each round sums a few more bits of the buckets that are still too large, so no
round depends on the number of rows in a bucket, and rows are read again only for those buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Bytes of a shard at most.
LIMIT = 64 << 20
#: Bits of hash: 60 of the key, then 60 of key, text and a number of the row.
KEY_BITS = 60
ALL_BITS = 2 * KEY_BITS
#: Bits that one round adds.
ROUND_BITS = 20


def _hash(text: str) -> str:
    return f"cast(conv(substr(md5({text}), 1, 15), 16, 10) as long)"


#: The bits of a row as a string of ALL_BITS binary digits.
BITS = f"concat(lpad(bin(head), {KEY_BITS}, '0'), lpad(bin(tail), {KEY_BITS}, '0'))"


def keyed(documents: DataFrame, *more: str) -> DataFrame:
    """``doc_id, n_bytes, head, tail`` and the columns ``more`` per row: two hashes of KEY_BITS.

    ``head`` depends on the id alone. ``tail`` tells apart rows that share an id, which would
    never part on the key's bits.
    """
    rows = documents.select(
        F.col("doc_id"),
        F.expr("coalesce(octet_length(text), 0)").cast("long").alias("n_bytes"),
        F.expr(_hash("coalesce(cast(doc_id as string), '')")).alias("head"),
        F.expr("coalesce(md5(text), '')").alias("digest"),
        F.monotonically_increasing_id().alias("row"),
        *more,
    )
    return rows.select(
        "doc_id", "n_bytes", "head", F.expr(_hash("concat(head, digest, cast(row as string))")).alias("tail"), *more
    )


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Leaves ``depth, prefix, shard_bytes, n_rows`` of the directory over ``rows(bits, n_bytes)``.

    A bucket is a leaf if it fits the limit, holds a single row, or has no bits left.
    """
    leaves, depth = None, 0
    open_rows = rows
    while True:
        to = min(depth + ROUND_BITS, ALL_BITS)
        cells = open_rows.groupBy(F.substring("bits", 1, to).alias("cell")).agg(
            F.sum("n_bytes").alias("bytes"), F.count("*").alias("n")
        )
        first = 0 if depth == 0 else depth + 1
        levels = (
            cells.select(F.explode(F.sequence(F.lit(first), F.lit(to))).alias("depth"), "cell", "bytes", "n")
            .groupBy("depth", F.expr("left(cell, depth)").alias("prefix"))
            .agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("n_rows"))
            .withColumn("fits", F.expr(f"shard_bytes <= {limit} or n_rows = 1 or depth = {ALL_BITS}"))
        )
        levels = materialise(levels, "shard-levels")
        # a fitting bucket is a leaf if the bucket one bit shorter does not fit
        parents = levels.where(f"not fits and depth < {to}").select(
            (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent")
        )
        fitting = levels.where("fits")
        below = fitting.where(f"depth > {first}").withColumn("parent", F.expr("left(prefix, depth - 1)"))
        found = (
            fitting.where(f"depth = {first}")
            .unionByName(below.join(parents, ["depth", "parent"], "left_semi").drop("parent"))
            .select("depth", "prefix", "shard_bytes", "n_rows")
        )
        leaves = found if leaves is None else leaves.unionByName(found)
        large = levels.where(f"not fits and depth = {to}").select(F.col("prefix").alias("_large"))
        if to == ALL_BITS or large.isEmpty():
            return leaves
        cell = open_rows.withColumn("_large", F.substring("bits", 1, to))
        open_rows = cell.join(large, "_large", "left_semi").drop("_large")
        depth = to


def shards(documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, shard, depth, shard_bytes`` for every row of ``documents(doc_id, text)``.

    ``shard`` is the leaf's prefix of binary digits (empty for a directory of one bucket). Bytes
    are those of the UTF-8 text, none for null. A shard exceeds the limit only if it is a single
    row that does. Rows with equal ids (also null) share a shard while it fits, then part on
    further bits. Other columns are ignored.
    """
    return placed_rows(documents, limit)


def placed_rows(documents: DataFrame, limit: int, *more: str) -> DataFrame:
    """What ``shards`` gives, with the columns ``more`` of ``documents``."""
    rows = materialise(keyed(documents, *more), "shard-rows").withColumn("bits", F.expr(BITS))
    leaves = materialise(directory(rows, limit), "shard-leaves")
    deepest = leaves.agg(F.max("depth")).first()[0]
    if deepest is None:
        return rows.selectExpr("doc_id", "n_bytes", "'' AS shard", "0 AS depth", "n_bytes AS shard_bytes", *more)
    # a row's leaf is at one of the depths that the directory has
    depths = [r[0] for r in leaves.select("depth").distinct().orderBy("depth").collect()]
    probes = rows.select("*", F.explode(F.array(*[F.lit(d) for d in depths])).alias("depth")).withColumn(
        "prefix", F.expr("left(bits, depth)")
    )
    return probes.join(leaves, ["depth", "prefix"]).select(
        "doc_id", "n_bytes", F.col("prefix").alias("shard"), "depth", "shard_bytes", *more
    )


def write_shards(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Write the rows of ``documents`` below ``path``, a folder per shard, and return what ``shards`` does.

    Ids may be null or repeated: each row has a number of its own, by which it goes to its shard. A column
    ``shard_folder`` is replaced by the name of the folder.
    """
    kept = [F.col(f"`{c}`") for c in documents.columns if c != "shard_folder"]
    # the row is one column, so that none of its columns can clash
    numbered = documents.select(F.struct(*kept).alias("own"), F.monotonically_increasing_id().alias("shard_row"))
    rows = materialise(numbered, "shard-documents")
    placed = materialise(placed_rows(rows.select("own.doc_id", "own.text", "shard_row"), limit, "shard_row"), "shard-places")
    folders = placed.select("shard_row", F.concat(F.lit("s"), "shard").alias("shard_folder"))
    out = rows.join(folders, "shard_row").select("own.*", "shard_folder")
    out.repartition("shard_folder").write.partitionBy("shard_folder").parquet(path)
    return placed.drop("shard_row")


def shards_sql(limit: int = LIMIT) -> str:
    """``shards`` in DuckDB, for unique ids and directories of at most 40 bits."""
    return f"""
WITH rows AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
levels AS (
  SELECT d AS depth, h >> (60 - d) AS cell, sum(n_bytes) AS shard_bytes, count(*) AS n
  FROM rows, range(0, 41) AS r(d) GROUP BY 1, 2),
placed AS (
  SELECT r.doc_id, r.n_bytes, r.h, min(l.depth) AS depth
  FROM rows r JOIN levels l ON l.cell = (r.h >> (60 - l.depth))
  WHERE l.shard_bytes <= {limit} OR l.n = 1 GROUP BY ALL)
SELECT p.doc_id, p.n_bytes,
       CASE WHEN p.depth = 0 THEN '' ELSE right(lpad(bin(p.h >> (60 - p.depth)), 60, '0'), CAST(p.depth AS INT)) END AS shard,
       CAST(p.depth AS INT) AS depth, CAST(l.shard_bytes AS BIGINT) AS shard_bytes
FROM placed p JOIN levels l ON l.depth = p.depth AND l.cell = (p.h >> (60 - p.depth))
"""
