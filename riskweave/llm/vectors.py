"""Near-duplicate vectors by product quantisation.

Vectors of length one are dealt to inverted lists by their nearest coarse centroid. The residual to it
is cut into subspaces, each coded by its nearest of 256 centroids. Every vector searches the lists it
could share a link with: a table of its distances to all subspace centroids turns codes into
approximate distances, and what these cannot rule out is ranked by the exact cosine in double precision.

A code's distance differs from the true one by at most the length of what the code leaves out, which
is stored, so the codes lose no link. Two linked vectors of different lists lie on either side of the
plane between the lists' centroids, so one of them is within half their distance of it; a pair counts
from the nearer side. Probing every list whose plane is that near would lose no link, but few links
point straight across a plane. So the distance is set plane by plane: by how much vectors of one list vary
along the normal, times a factor that the links of MEASURED vectors, searched for among all rows, show to be
enough. It never exceeds half a link. Up to MEASURED vectors every link is measured and none is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, column, components, settle

COSINE = 0.9
#: Vectors that the centroids are fitted on, lowest hash of the id first, or SAMPLE_A_LIST for each list if that is more.
#: All vectors are indexed.
SAMPLE = 8192
SAMPLE_A_LIST = 4
SUBSPACES = 16
CODES = 256
#: Aimed-at vectors of a list. The number of lists follows the number n of vectors to SAMPLE / 16, then 2 sqrt(n), which
#: balances the search for lists and within them.
LIST_SIZE = 256
ITERATIONS = 8
#: Rows times centres up to which centres are moved to means; beyond it they are rows of the sample.
MOVED = 1 << 25
#: Numbers in a matrix of rows and centres that are worked on at a time.
CELLS = 1 << 22
#: Least factor of the typical part of half a link across a plane that probing allows for; None allows for half a link.
SPREAD = 3.0
#: Vectors whose links are searched for among all rows to find the factor, and the allowance on what they show.
MEASURED = 2048
MARGIN = 1.25
#: Entries of a list, and searches of it, that meet in one task; more of them meet block by block.
BLOCK = 2048
#: Searches whose distance tables are in memory at a time.
TABLES = 128
#: Allowance for rounding in the bounds.
SLACK = 1e-3


@dataclass(frozen=True)
class Quantiser:
    coarse: np.ndarray  # lists x dimensions
    books: np.ndarray  # subspaces x codes x width
    #: lists x dimensions: the distance of two rows is their centroids' times the deviation along the line between them,
    #: which is 1 over all directions (as a sum of squares)
    scaled: np.ndarray


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    step = max(1, CELLS // len(centres))
    return np.concatenate([np.argmax(x[i : i + step] @ centres.T - half, axis=1) for i in range(0, max(1, len(x)), step)])


def _means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from k random rows; a centre without rows stays where it is."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].astype(np.float32)
    for _ in range(ITERATIONS if len(x) * k <= MOVED else 0):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def _widths(dimensions: int) -> int:
    return -(-dimensions // SUBSPACES)


def _folded(x: np.ndarray) -> np.ndarray:
    """Rows cut into subspaces of equal width, filled up with zeros."""
    width = _widths(x.shape[1])
    out = np.zeros((len(x), SUBSPACES * width), np.float32)
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), SUBSPACES, width)


def lists_for(vectors: int) -> int:
    """Inverted lists for that many vectors."""
    return max(1, min(vectors // LIST_SIZE, max(SAMPLE // 16, int(2 * np.sqrt(vectors)))))


def fit(sample: np.ndarray, vectors: int) -> Quantiser:
    """Centroids from unit rows ``sample``, with lists for ``vectors`` rows."""
    coarse = _means(sample, max(1, min(lists_for(vectors), len(sample) // SAMPLE_A_LIST)), 1)
    left = sample - coarse[_nearest(sample, coarse)]
    spread = left.T.astype(np.float64) @ left + 1e-9 * np.eye(left.shape[1])
    values, axes = np.linalg.eigh(spread / np.trace(spread))
    # no direction counts as flat
    scaled = coarse @ (axes * np.sqrt(np.maximum(values, 1e-3 / len(values))))
    folded = _folded(left)
    return Quantiser(coarse, np.stack([_means(folded[:, s], CODES, 2 + s) for s in range(SUBSPACES)]), scaled)


def _rows(values: pa.Array, dimensions: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


def _unit(values: pa.Array, dimensions: int) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    x = _rows(values, dimensions)
    scaled = x / np.abs(x).max(axis=1, initial=0)[:, None]  # first, lest squares leave the range of doubles
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def usable(embeddings: DataFrame, dimensions: int) -> DataFrame:
    """Rows with ``dimensions`` finite components, not all zero."""
    fine = F.expr(
        f"size(embedding) = {dimensions} and forall(embedding, x -> x is not null and abs(x) < double('inf'))"
        " and exists(embedding, x -> x <> 0)"
    )
    return embeddings.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select("vec_id", "embedding")


def encoded(vectors: DataFrame, q: Quantiser, dimensions: int) -> DataFrame:
    """``vec_id, embedding, copies, list, code, left_out``: the index entry of every distinct vector."""

    def run(batches):
        for batch in batches:
            x = _unit(column(batch, "embedding"), dimensions)
            own = _nearest(x.astype(np.float32), q.coarse)
            left = _folded(x - q.coarse[own])
            code = np.stack([_nearest(left[:, s], q.books[s]) for s in range(SUBSPACES)], axis=1)
            rest = left - q.books[np.arange(SUBSPACES), code]
            left_out = np.sqrt((rest.astype(np.float64) ** 2).sum(axis=(1, 2)))
            codes = pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own.astype(np.int32)), codes, pa.array(left_out)],
                names=[*batch.schema.names, "list", "code", "left_out"],
            )

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select("vec_id", "embedding", "copies").mapInArrow(
        run, f"vec_id long, embedding {kind}, copies long, list int, code binary, left_out double"
    )


def _behind(x: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Distance of rows ``x``, nearest to centres ``own``, from the plane between these and centres ``other``."""
    way = (own - other).astype(np.float64)
    middle = (own + other).astype(np.float64) / 2
    length = np.sqrt(np.einsum("ij,ij->i", way, way))
    return np.einsum("ij,ij->i", x - middle, way) / np.maximum(length, 1e-12)


def _deviation(q: Quantiser, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Typical part, of a difference of length one, across the plane between lists ``own`` and ``other``."""
    way = np.linalg.norm(q.coarse[own].astype(np.float64) - q.coarse[other], axis=1)
    return np.linalg.norm(q.scaled[own] - q.scaled[other], axis=1) / np.maximum(way, 1e-12)


def measured_spread(index: DataFrame, q: Quantiser, asked: np.ndarray, dimensions: int, cosine: float) -> float:
    """The greatest part across a plane of half a link, in typical ones, over all links of the unit rows ``asked``."""
    half = np.sqrt(2 - 2 * cosine) / 2
    lists = _nearest(asked.astype(np.float32), q.coarse)

    def run(batches):
        for batch in batches:
            x, own = _unit(column(batch, "embedding"), dimensions), column(batch, "list").to_numpy()
            a, b = np.nonzero(x @ asked.T >= cosine)
            apart = own[a] != lists[b]
            a, b = a[apart], b[apart]
            mine, yours = q.coarse[own[a]], q.coarse[lists[b]]
            near = np.minimum(_behind(x[a], mine, yours), _behind(asked[b], yours, mine))
            most = (near / (half * _deviation(q, own[a], lists[b]))).max(initial=0)
            yield pa.RecordBatch.from_arrays([pa.array([most], pa.float64())], names=["most"])

    most = index.select("embedding", "list").mapInArrow(run, "most double").agg(F.max("most")).first()[0]
    return float(most or 0.0)


def probes(index: DataFrame, q: Quantiser, dimensions: int, cosine: float, spread: float | None) -> DataFrame:
    """``list, vec_id, embedding, copies, own`` for each list that a vector searches; ``own`` is the list it is in.

    These are the lists whose plane is within ``spread`` typical parts of half a link, or within half a link.
    """
    half = np.sqrt(2 - 2 * cosine) / 2
    coarse = q.coarse.astype(np.float64)

    def distances(centres, own):
        squares = (centres * centres).sum(axis=1)
        return np.sqrt(np.maximum(squares[own][:, None] + squares[None, :] - 2 * centres[own] @ centres.T, 1e-12))

    def run(batches):
        squares = (coarse * coarse).sum(axis=1)
        step = max(1, min(512, CELLS // len(coarse)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = _unit(column(part, "embedding"), dimensions)
                own = column(part, "list").to_numpy()
                rows = np.arange(len(x))
                far = squares[None, :] - 2 * x @ coarse.T  # squared distances, less the length of x
                apart = distances(coarse, own)
                near = half * apart
                if spread is not None:
                    near = np.minimum(near, spread * half * distances(q.scaled, own))
                behind = (far - far[rows, own][:, None]) / 2
                behind[rows, own] = 0
                row, target = np.nonzero(behind <= near + SLACK * apart)
                picked = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(target.astype(np.int32)), *picked.columns],
                    names=["list", "vec_id", "embedding", "copies", "own"],
                )

    kind = index.schema["embedding"].dataType.simpleString()
    return index.select("vec_id", "embedding", "copies", "list").mapInArrow(
        run, f"list int, vec_id long, embedding {kind}, copies long, own int"
    )


def _groups(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component; pairs ``a, b`` number the nodes from 0."""
    label = np.arange(max(a.max(), b.max()) + 1)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def search(asked: pa.RecordBatch, entries: pa.RecordBatch, q: Quantiser, cosine: float) -> dict[str, np.ndarray]:
    """Links between searches and entries of one list, each link from one side only.

    Gives, for every vector in a link, the vectors it has links with here (copies counted), and the
    smallest id of its component here.
    """
    dimensions = q.coarse.shape[1]
    x, y = _unit(column(asked, "embedding"), dimensions), _unit(column(entries, "embedding"), dimensions)
    x_id, y_id = (column(t, "vec_id").to_numpy() for t in (asked, entries))
    x_copies, y_copies = (column(t, "copies").to_numpy() for t in (asked, entries))
    own = column(asked, "own").to_numpy()
    centre = int(column(entries, "list")[0].as_py())
    code = np.frombuffer(b"".join(column(entries, "code").to_pylist()), np.uint8).reshape(-1, SUBSPACES)
    bound = (np.sqrt(2 - 2 * cosine) + SLACK + column(entries, "left_out").to_numpy()).astype(np.float32) ** 2
    lengths = (q.books * q.books).sum(axis=2)
    pairs = []
    for at in range(0, len(x), TABLES):
        left = _folded(x[at : at + TABLES] - q.coarse[centre])
        # one row of a table holds the distances of all searches to one code, so entries take whole rows
        near = np.broadcast_to((left * left).sum(axis=(1, 2)), (len(y), len(left))).copy()
        for s in range(SUBSPACES):
            table = lengths[s][:, None] - 2 * (q.books[s] @ left[:, s].T)
            near += table[code[:, s]]
        b, a = np.nonzero(near <= bound[:, None])
        a += at
        exact = np.einsum("ij,ij->i", x[a], y[b])
        good = (exact >= cosine) & (x_id[a] != y_id[b])
        a, b = a[good], b[good]
        here = np.broadcast_to(q.coarse[centre], (len(a), dimensions))
        mine, yours = _behind(x[a], q.coarse[own[a]], here), _behind(y[b], here, q.coarse[own[a]])
        first = np.where((own[a] == centre) | (np.abs(mine - yours) < 1e-9), x_id[a] < y_id[b], mine < yours)
        pairs.append(np.stack([a[first], b[first]]))
    a, b = np.concatenate(pairs, axis=1)
    if not len(a):
        return {"vec_id": x_id[:0], "n": x_copies[:0], "root": x_id[:0]}
    nodes, place = np.unique(np.concatenate([x_id[a], y_id[b]]), return_inverse=True)
    n = np.zeros(len(nodes), np.int64)
    np.add.at(n, place[: len(a)], y_copies[b])
    np.add.at(n, place[len(a) :], x_copies[a])
    return {"vec_id": nodes, "n": n, "root": nodes[_groups(place[: len(a)], place[len(a) :])]}


def _batch(table: pa.Table) -> pa.RecordBatch:
    return table.combine_chunks().to_batches()[0]


def _dealt(rows: DataFrame, name: str, others: str, sizes: DataFrame) -> DataFrame:
    """``rows`` of a list dealt to blocks ``name`` and repeated for each block of the others."""
    return (
        rows.join(sizes, "list")
        .withColumn(name, F.expr(f"cast(pmod(xxhash64(vec_id), n_{name}) as int)"))
        .withColumn(others, F.explode(F.sequence(F.lit(0), F.col(f"n_{others}") - 1)))
        .drop("n_block", "n_part")
    )


def links(vectors: DataFrame, dimensions: int, cosine: float = COSINE, spread: float | None = SPREAD) -> DataFrame:
    """``vec_id, n, root`` of the distinct ``vectors(vec_id, embedding, copies)`` that have links.

    A vector appears once for each task that found links of it: ``n`` adds up to its links, and the pairs
    ``vec_id, root`` join the same components as the links do.
    """
    total = vectors.count()
    if not total:
        return vectors.sparkSession.createDataFrame([], "vec_id long, n long, root long")
    size = max(SAMPLE, MEASURED, SAMPLE_A_LIST * lists_for(total))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).select("embedding").toArrow()
    sample = _unit(sample.column("embedding").combine_chunks(), dimensions)
    q = fit(sample.astype(np.float32), total)
    index = settle(encoded(vectors, q, dimensions), "vector-index")
    if spread is not None:
        spread = max(spread, MARGIN * measured_spread(index, q, sample[:MEASURED], dimensions, cosine))
    asked = probes(index, q, dimensions, cosine, spread)
    blocks = lambda rows, name: rows.groupBy("list").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias(f"n_{name}"))
    sizes = settle(blocks(index, "block").join(blocks(asked, "part"), "list"), "vector-lists")
    keys = ["list", "block", "part"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        return pa.table(search(_batch(left), _batch(right), q, cosine), schema)

    schema = pa.schema([("vec_id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])
    return (
        _dealt(asked, "part", "block", sizes)
        .groupBy(*keys)
        .cogroup(_dealt(index, "block", "part", sizes).groupBy(*keys))
        .applyInArrow(run, "vec_id long, n long, root long")
    )


def vector_classes(embeddings: DataFrame, cosine: float = COSINE, spread: float | None = SPREAD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``embeddings(vec_id, embedding)``.

    Vectors with cosine at or above ``cosine`` are linked, whatever their length. Null and zero vectors,
    those with null or non-finite components, and rows without an id link with nothing; the latter have
    a null component and are not kept. Rows with the same id count as one vector (the smallest); all
    rows are returned. Vectors must agree in their number of components. Other columns are ignored.
    """
    bound_batches(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    lengths = rows.select(F.size("embedding").alias("d")).where("d > 0").distinct().limit(2).collect()
    if len(lengths) > 1:
        raise ValueError("vectors differ in their number of components")
    dimensions = lengths[0][0] if lengths else 1
    single = usable(rows, dimensions).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    # copies are searched for once
    copies = single.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    vectors = settle(copies, "distinct-vectors")
    found = settle(links(vectors, dimensions, cosine, spread), "vector-links")
    groups = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")), "vector-components")
    classes = (
        vectors.join(found.groupBy("vec_id").agg(F.sum("n").alias("n")), "vec_id", "left")
        .join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select(
            "embedding",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
    )
    each = single.join(classes, "embedding").select("vec_id", "n_links", "component_id")
    return (
        rows.select("vec_id")
        .join(each, "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.expr("coalesce(vec_id = component_id, false)"))
    )


#: ``vector_classes`` in DuckDB, for distinct ids: all pairs, then all that can be reached.
CLASSES_SQL = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y
  ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= {COSINE}),
reached AS (
  SELECT a, b AS c FROM pairs UNION SELECT r.a, p.b FROM reached r JOIN pairs p ON p.a = r.c),
classes AS (SELECT a, min(c) AS c FROM reached GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(c.c, e.vec_id)) AS component_id,
       coalesce(e.vec_id = least(e.vec_id, coalesce(c.c, e.vec_id)), false) AS kept
FROM embeddings e LEFT JOIN counts n ON n.a = e.vec_id LEFT JOIN classes c ON c.a = e.vec_id
"""
