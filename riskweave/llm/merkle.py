"""Merkle manifest of a table of documents.

Every document is a leaf: the SHA-256 of its fields. Per source the leaves stand in order of their id, and
every ARITY consecutive nodes of a level become the hash of their concatenated digests, until one is left; the
sources' roots are joined the same way into the root of the table.

A level is never a row per node. An aligned block of ``ARITY ** DEPTH`` nodes keeps each of its levels as one
string of hexadecimal digests: parents are hashes of its substrings of fixed width, and the siblings of a node are
the substrings on both sides of it. The last digests of the blocks are the nodes of the next round, so a table
of n rows takes log(n) / log(ARITY ** DEPTH) rounds. A block has a bounded size, however many rows a source has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, settle

ARITY = 3
#: Levels of a block, which thus holds up to 243 nodes.
DEPTH = 5
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_BLOCK = ARITY**DEPTH
_RUN = ARITY * DIGEST


def leaf(*fields: Column | str) -> Column:
    """SHA-256 (lowercase hex) of the fields: ``-`` for a null, else byte count, ``:`` and the value as text."""
    parts = []
    for field in fields:
        x = (F.col(field) if isinstance(field, str) else field).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def proof(path: Column | str) -> Column:
    """SHA-256 of all siblings of a path, from the leaf up and from left to right."""
    path = F.col(path) if isinstance(path, str) else path
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def folded(start: Column | str, path: Column | str) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    start = F.col(start) if isinstance(start, str) else start
    path = F.col(path) if isinstance(path, str) else path
    return F.aggregate(path, start, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def _parents(level: str) -> str:
    """The string of the level above."""
    return (
        f"array_join(transform(sequence(0, (length({level}) - 1) div {_RUN}), "
        f"i -> sha2(substring({level}, i * {_RUN} + 1, {_RUN}), 256)), '')"
    )


def blocked(nodes: DataFrame) -> DataFrame:
    """``grp, block, total, levels, members`` of ``nodes(grp, pos, total, hash, load)``, one row per aligned block.

    A group of several blocks takes all DEPTH levels of each; a group of one ends at its single node.
    """
    blocks = nodes.groupBy("grp", F.expr(f"pos div {_BLOCK}").alias("block"), "total").agg(
        F.array_sort(F.collect_list(F.struct("pos", "hash", "load"))).alias("members")
    )
    last = "element_at(acc, -1)"
    above = f"if(total <= {_BLOCK} and length({last}) = {DIGEST}, acc, concat(acc, array({_parents(last)})))"
    first = "array(array_join(transform(members, m -> m.hash), ''))"
    return blocks.withColumn("levels", F.expr(f"aggregate(sequence(1, {DEPTH}), {first}, (acc, k) -> {above})"))


def climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``grp, pos, hash, load, path, top`` of ``nodes(grp, pos, total, hash, load)``, and ``grp, top``.

    ``path`` holds per level the digests left and right of the node in its run, ``top`` the root of the group.
    """
    blocks = settle(blocked(nodes), "merkle-blocks")
    many = blocks.where(f"total > {_BLOCK}")
    none = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    ends = blocks.where(f"total <= {_BLOCK}").select("grp", "block", F.expr("element_at(levels, -1)").alias("top"), none.alias("above"))
    if not many.isEmpty():
        upper = many.select(
            "grp",
            F.col("block").alias("pos"),
            F.expr(f"(total + {_BLOCK - 1}) div {_BLOCK}").alias("total"),
            F.expr("element_at(levels, -1)").alias("hash"),
            F.lit(None).cast("string").alias("load"),
        )
        ends = ends.unionByName(climb(upper)[0].select("grp", F.col("pos").alias("block"), "top", F.col("path").alias("above")))
    powers = ", ".join(str(ARITY**k) for k in range(DEPTH))
    at = f"(m.pos % {_BLOCK} div array({powers})[k])"
    left = f"substring(levels[k], cast({at} div {ARITY} * {_RUN} + 1 as int), cast({at} % {ARITY} * {DIGEST} as int))"
    right = f"substring(levels[k], cast({at} * {DIGEST} + {DIGEST + 1} as int), cast(({ARITY - 1} - {at} % {ARITY}) * {DIGEST} as int))"
    own = f"transform(sequence(0, size(levels) - 2), k -> struct({left} AS left, {right} AS right))"
    path = f"if(size(levels) > 1, concat({own}, above), above)"
    member = f"struct(m.pos AS pos, m.hash AS hash, m.load AS load, {path} AS path)"
    found = blocks.join(ends, ["grp", "block"]).select("grp", "top", F.explode(F.expr(f"transform(members, m -> {member})")).alias("m"))
    return found.select("grp", "m.*", "top"), ends.where("block = 0").select("grp", "top")


def manifest(documents: DataFrame, fields: tuple[str, ...] = FIELDS, **carried: Column) -> DataFrame:
    """``doc_id, source, place, leaf, path, subroot, root`` of each row, and the columns ``carried``.

    ``path`` lists per level, from the leaf to the root of the table, the digests ``left`` and ``right`` of the node
    within its run (both empty for a node alone in its run); ``proof`` and ``folded`` work on it. Within a source leaves
    stand by doc_id, null first, then by digest, which settles ties of repeated ids; equal rows get a leaf
    each. Sources stand in the order of their bytes, a null source first. A null and an empty text have
    different leaves. An empty table gives no rows. Other columns of ``documents`` are ignored, whatever their names.
    """
    leaves = documents.select(
        # null, which is no text, sorts before all that begins with s
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("grp"),
        F.col("doc_id").alias("id"),
        leaf(*fields).alias("hash"),
        F.struct("doc_id", "source", *[c.alias(name) for name, c in carried.items()]).alias("load"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = settle(leaves, "merkle-leaves")
    ordered = numbered(leaves, "grp", ["id", "hash", "row"]).select("grp", "pos", "total", "hash", "load")
    low, tops = climb(ordered)
    roots = tops.select(F.lit("").alias("grp"), F.col("grp").alias("load"), F.col("top").alias("hash"))
    high, _ = climb(numbered(roots, "grp", ["load"]).select("grp", "pos", "total", "hash", "load"))
    high = high.select(F.col("load").alias("grp"), F.col("path").alias("above"), F.col("top").alias("root"))
    return low.join(high, "grp").select(
        "load.doc_id",
        "load.source",
        F.col("pos").alias("place"),
        F.col("hash").alias("leaf"),
        F.concat("path", "above").alias("path"),
        F.col("top").alias("subroot"),
        "root",
        *[F.col("load")[name].alias(name) for name in carried],
    )


#: Rows whose id has an even checksum are changed for the check of the proofs.
TAMPERED = "crc32(cast(cast(doc_id as string) as binary)) % 2 = 0"


def proof_report(documents: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of ``documents`` with some texts tampered with.

    Where the checksum of the id is even, the line ends of the text are deleted before its proof is folded; a null
    id or text is left as it is. ``verified`` says whether the proof still leads to the root.
    """
    text = F.when(F.expr(TAMPERED), F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    # only a text that does change is hashed again
    changed = F.expr(TAMPERED) & F.contains(F.col("text"), F.lit("\n"))
    tampered = F.when(changed, leaf(*[text if f == "text" else f for f in FIELDS]))
    listed = manifest(documents, tampered=tampered)
    reached = listed.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), "path"))
    return reached.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof("path").alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


#: The same over the whole table ``documents`` (ids without repeats) in plain SQL.
REPORT_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS grp, text,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda c, b: list_reduce(list_concat([xor(c, b)], [CAST(x AS BIGINT) FOR x IN [0, 0, 0, 0, 0, 0, 0, 0]]),
        lambda e, z: xor(e >> 1, 3988292384 * (e & 1)))) % 2 = 1 AS tampered
  FROM documents),
leaves AS (
  SELECT doc_id, grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
    sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS th, tampered
  FROM d),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
low AS (
  SELECT grp, 0 AS lvl, pos, h, n FROM placed
  UNION ALL
  SELECT grp, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY grp, lvl, pos // 3, n),
subroots AS (
  SELECT grp, lvl, h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, pos, h, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM high WHERE n > 1 GROUP BY lvl, pos // 3, n),
top AS (SELECT h FROM high WHERE n = 1),
sides AS (
  SELECT grp, lvl, pos, coalesce(string_agg(o, '' ORDER BY opos) FILTER (WHERE opos < pos), '') AS l,
    coalesce(string_agg(o, '' ORDER BY opos) FILTER (WHERE opos > pos), '') AS r
  FROM (
    SELECT a.grp, a.lvl, a.pos, b.pos AS opos, b.h AS o FROM low a LEFT JOIN low b
      ON a.grp = b.grp AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 AND a.pos <> b.pos WHERE a.n > 1
    UNION ALL
    SELECT s.grp, s.lvl + a.lvl, a.pos, b.pos, b.h FROM subroots s
      JOIN high a ON a.n > 1 AND s.pos // CAST(pow(3, a.lvl) AS BIGINT) = a.pos
      LEFT JOIN high b ON a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 AND a.pos <> b.pos)
  GROUP BY grp, lvl, pos),
-- per level, the place of the node above a document
way AS (
  SELECT p.doc_id, s.lvl, s.l, s.r FROM placed p JOIN subroots t USING (grp) JOIN sides s
    ON s.grp = p.grp AND s.pos = CASE WHEN s.lvl < t.lvl THEN p.pos // CAST(pow(3, s.lvl) AS BIGINT) ELSE t.pos // CAST(pow(3, s.lvl - t.lvl) AS BIGINT) END),
fold AS (
  SELECT doc_id, 0 AS lvl, CASE WHEN tampered THEN th ELSE h END AS h FROM placed
  UNION ALL
  SELECT f.doc_id, f.lvl + 1, sha256(w.l || f.h || w.r) FROM fold f JOIN way w ON f.doc_id = w.doc_id AND f.lvl = w.lvl),
proofs AS (SELECT doc_id, sha256(string_agg(l || r, '' ORDER BY lvl)) AS proof_sha256 FROM way GROUP BY doc_id),
folded AS (SELECT doc_id, arg_max(h, lvl) AS folded_root FROM fold GROUP BY doc_id)
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, top.h AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256,
  f.folded_root, f.folded_root = top.h AS verified
FROM placed p JOIN subroots s USING (grp) LEFT JOIN proofs q USING (doc_id) JOIN folded f USING (doc_id), top
"""
