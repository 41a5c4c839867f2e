"""Embedding near-duplicates: classes and links of vectors, and an index by iterative quantisation.

``op3_itq`` gives one row an id: vec_id, class_id (the least id of those that links
connect it with, its own without any) and links (the number of other ids whose cosine
with it is at least ``COSINE``). All pairs are compared, by products of matrices in
single precision that only sift; what counts is computed in double. The vectors are
broadcast in slabs of at most ``BROADCAST_BYTES``, one after the other. So no link is
lost, and work grows with the square of the table.

``near_pairs`` is the search by an index, whose recall is below one (README). Vectors are
scaled to length one. A PCA of all vectors and a rotation learned
by iterative quantisation over all of them (``ITERATIONS`` distributed passes,
each sums a 64 x 64 matrix) give balanced codes of 64 bits. Vectors shorter than
that get further bits from random rotations (learned ones would end in the same
place, and pairs that one bit parts would be parted by many).
The code is cut into ``TABLES`` substrings. Codes within ``RADIUS`` bits have a
substring within RADIUS // TABLES = 2 bits, so each vector stands in each table
under its substring and under those one bit away: two such meet. Of the
buckets in which a pair meets one is canonical, so a pair is looked at once.
Pairs within the radius are reranked by the cosine of the original vectors;
those of at least ``COSINE`` are the result. Near pairs beyond the radius are not found.

The original vectors are broadcast for reranking, in single precision, if they are
below ``BROADCAST_BYTES``, else joined to the candidate pairs.

Defined cases. A null, empty or zero vector, one with a null, nan or infinite
component, and a null vec_id: no pairs (such a vector's id is a row without links, a
null id isn't one). Vectors of different lengths are never a pair; each length has its own codes and search. Repeated rows: a vector is no partner of its own id; of
different vectors of one id the best cosine counts. Equal vectors: a pair of
cosine 1. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .components import connected_components
from .shared import cut, table

TABLES, RADIUS, COSINE, ITERATIONS = 4, 11, 0.95, 10
BROADCAST_BYTES = 32 << 20
PAIRS = 1 << 20
ROWS, COLUMNS = 512, 8192  # of one product of matrices
U = np.uint64


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _sum_over(vectors: DataFrame, dim: int, f: Callable[[np.ndarray], np.ndarray], like: np.ndarray) -> np.ndarray:
    """The sum of f over all vectors: summed in each task, then in 32 groups, then here."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(like), 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), dim)
                total += f(x)
                n += int(x[0, 0] * 1e6) % 32
        yield pa.RecordBatch.from_arrays([pa.array([n % 32], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["g", "s"])

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [np.sum([np.frombuffer(x) for x in rows["s"]], axis=0).tobytes()]})

    rows = vectors.select("x").mapInArrow(part, "g int, s binary").groupBy("g").applyInPandas(join, "s binary").collect()
    return np.sum([np.frombuffer(r["s"]) for r in rows] or [like.ravel()], axis=0).reshape(like.shape)


def learn(vectors: DataFrame, dim: int, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray] | None:
    """(mean, projection): code bits are the signs of (x - mean) @ projection."""
    moments = _sum_over(vectors, dim, lambda x: np.concatenate([np.append(len(x), x.sum(0)), (x.T @ x).ravel()]), np.zeros(1 + dim + dim * dim))
    n = moments[0]
    if not n:
        return None
    mean = moments[1 : dim + 1] / n
    cov = moments[dim + 1 :].reshape(dim, dim) / n - np.outer(mean, mean)
    bits = min(dim, 64)
    pca = np.linalg.eigh(cov)[1][:, ::-1][:, :bits]
    rng = np.random.default_rng(11)
    rotation, *more = [np.linalg.qr(rng.standard_normal((bits, bits)))[0] for _ in range(-(-64 // bits))]
    for _ in range(iterations):

        def cross(x: np.ndarray, r: np.ndarray = rotation) -> np.ndarray:
            v = (x - mean) @ pca
            return np.where(v @ r > 0, 1.0, -1.0).T @ v

        left, _, right = np.linalg.svd(_sum_over(vectors, dim, cross, np.zeros((bits, bits))))
        rotation = (left @ right).T
    return mean, np.concatenate([pca @ r for r in (rotation, *more)], 1)[:, :64]


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    on = (x - mean) @ projection > 0
    full = np.zeros((len(x), 64), bool)
    full[:, : on.shape[1]] = on
    return np.packbits(full, axis=1, bitorder="little").view(U).ravel()


def substring_rows(code: np.ndarray, tables: int = TABLES) -> tuple[np.ndarray, np.ndarray]:
    """(row of code, bucket): each substring and its neighbours one bit away, the table on top."""
    width = 64 // tables
    out = []
    for t in range(tables):
        sub = (code >> U(t * width)) & U((1 << width) - 1)
        near = np.stack([sub, *(sub ^ U(1 << i) for i in range(width))], 1)
        out.append((U(t) << U(width)) | near)
    bucket = np.concatenate(out, 1)
    return np.repeat(np.arange(len(code)), bucket.shape[1]), bucket.ravel()


def canonical(a: np.ndarray, b: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """The one bucket in which a pair of codes is to be looked at; all ones if they never meet."""
    width = 64 // tables
    out = np.full(len(a), np.iinfo(np.uint64).max, U)
    for t in reversed(range(tables)):
        x, y = ((c >> U(t * width)) & U((1 << width) - 1) for c in (a, b))
        diff = x ^ y
        d = K.popcount(diff)
        low = diff & (~diff + U(1))
        at = np.where(d < 2, np.minimum(x, y), np.minimum(x ^ low, y ^ low))
        out = np.where(d <= 2, (U(t) << U(width)) | at, out)
    return out


def bucket_pairs(bucket: np.ndarray, ident: np.ndarray, code: np.ndarray, radius: int, tables: int = TABLES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(id, id) of the pairs within the radius whose canonical bucket it is; rows sorted by bucket."""
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    start = np.repeat(first, np.diff(np.append(first, len(bucket))))
    earlier = np.arange(len(bucket)) - start
    ends, at = np.cumsum(earlier), 0
    while at < len(bucket):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        k = earlier[at:to]
        i = np.repeat(np.arange(at, to), k)
        j = np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(start[at:to], k)
        ok = K.popcount(code[i] ^ code[j]) <= radius
        i, j = i[ok], j[ok]
        ok = (canonical(code[i], code[j], tables) == bucket[i]) & (ident[i] != ident[j])
        yield ident[i[ok]], ident[j[ok]]
        at = to


def lengths(embeddings: DataFrame) -> list[int]:
    """Those that two vectors at least have, the most frequent first."""
    sized = embeddings.where("vec_id is not null and size(embedding) > 0").groupBy(F.size("embedding").alias("d")).count()
    return [r["d"] for r in sized.where("count > 1").orderBy(F.desc("count"), F.desc("d")).collect()]


def usable(embeddings: DataFrame, dim: int | None = None) -> tuple[DataFrame, int]:
    """(vec_id, x): unit vectors of the length (by default the most frequent one), and the length."""
    dim = dim or next(iter(lengths(embeddings)), 1)
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = embeddings.where(f"vec_id is not null and size(embedding) = {dim}").select("vec_id", x.alias("x"))
    rows = rows.withColumn("r", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)))
    rows = rows.where("r > 0 and r < double('infinity') and not isnan(r)")
    return rows.select("vec_id", F.transform("x", lambda v: v / F.col("r")).alias("x")), dim


def near_pairs(embeddings: DataFrame, cosine: float = COSINE, radius: int = RADIUS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(vec_a, vec_b, cosine) of each pair of ids, vec_a < vec_b."""
    found = [_pairs_of_length(embeddings, dim, cosine, radius, broadcast_bytes) for dim in lengths(embeddings)]
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    pairs = embeddings.sparkSession.createDataFrame([], f"vec_a {kind}, vec_b {kind}, cosine double")
    if not found:
        return pairs
    # An id may have vectors of several lengths.
    return found[0] if len(found) == 1 else reduce(DataFrame.unionByName, found).groupBy("vec_a", "vec_b").agg(F.max("cosine").alias("cosine"))


def _pairs_of_length(embeddings: DataFrame, dim: int, cosine: float, radius: int, broadcast_bytes: int) -> DataFrame:
    spark = embeddings.sparkSession
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    vectors, _ = usable(embeddings, dim)
    vectors = cut(vectors.withColumn("n", F.monotonically_increasing_id()))
    model = learn(vectors, dim)
    empty = spark.createDataFrame([], f"vec_a {kind}, vec_b {kind}, cosine double")
    if model is None:
        return empty
    mean, projection = model

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                code = codes(_matrix(K.column_of(part, "x"), dim), mean, projection)
                row, bucket = substring_rows(code)
                n = K.column_of(part, "n").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(n[row]), pa.array(code.view(np.int64)[row])], ["bucket", "n", "code"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def found(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a, b in bucket_pairs(cols[0].view(U), cols[1], cols[2].view(U), radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            if sum(len(x[0]) for x in held) < 1 << 16:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            done = int(np.searchsorted(cols[0], cols[0][-1]))
            yield from found([x[:done] for x in cols])
            held = [tuple(x[done:] for x in cols)]
        if held:
            yield from found([np.concatenate(x) for x in zip(*held, strict=True)])

    rows = vectors.select("n", "x").mapInArrow(spread, "bucket long, n long, code long")
    pairs = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(search, "a long, b long")
    count = vectors.count()
    if count * (dim * 4 + 16) <= broadcast_bytes:
        all_rows = vectors.select("n", F.col("x").cast("array<float>").alias("x")).toArrow().combine_chunks()
        n, x = all_rows["n"].to_numpy(), all_rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        order = np.argsort(n)
        shared = spark.sparkContext.broadcast((n[order], x[order]))

        def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, x = shared.value
            for batch in batches:
                i, j = (np.searchsorted(n, c.to_numpy()) for c in batch.columns)
                c = np.einsum("ij,ij->i", x[i], x[j]).astype(np.float64)
                # Single precision only sifts; what may count is computed in double.
                near = c >= cosine - 1e-4
                yield pa.RecordBatch.from_arrays([y.filter(pa.array(near)) for y in batch.columns], ["a", "b"])

        pairs = pairs.mapInArrow(rerank, "a long, b long")
    left = vectors.select(F.col("n").alias("a"), F.col("vec_id").alias("va"), F.col("x").alias("xa"))
    right = vectors.select(F.col("n").alias("b"), F.col("vec_id").alias("vb"), F.col("x").alias("xb"))
    both = pairs.join(left, "a").join(right, "b").where("va != vb")
    dot = F.aggregate(F.zip_with("xa", "xb", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    scored = both.select(F.least("va", "vb").alias("vec_a"), F.greatest("va", "vb").alias("vec_b"), dot.alias("cosine")).where(F.col("cosine") >= cosine)
    return scored.groupBy("vec_a", "vec_b").agg(F.max("cosine").alias("cosine"))


def all_pairs(embeddings: DataFrame, cosine: float = COSINE, slab_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(vec_a, vec_b) of each pair of ids, vec_a < vec_b: every pair of vectors is compared."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    pairs = embeddings.sparkSession.createDataFrame([], f"vec_a {kind}, vec_b {kind}")
    return reduce(DataFrame.unionByName, [_all_pairs_of_length(embeddings, dim, cosine, slab_bytes) for dim in lengths(embeddings)], pairs).distinct()


def _all_pairs_of_length(embeddings: DataFrame, dim: int, cosine: float, slab_bytes: int) -> DataFrame:
    spark = embeddings.sparkSession
    vectors = cut(usable(embeddings, dim)[0].withColumn("n", F.monotonically_increasing_id()))
    slabs = max(1, -(-vectors.count() * (dim * 8 + 8) // slab_bytes))

    def of_slab(k: int) -> DataFrame:
        rows = vectors.where(F.pmod(F.xxhash64("n"), F.lit(slabs)) == k).select("n", "x").toArrow()
        n, x = rows["n"].to_numpy(), _matrix(rows["x"], dim) if rows.num_rows else np.zeros((0, dim))
        order = np.argsort(n)
        sent = spark.sparkContext.broadcast((n[order], x[order]))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, x = sent.value
            single = x.astype(np.float32)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    own, y = K.column_of(part, "n").to_numpy(), _matrix(K.column_of(part, "x"), dim)
                    left = y.astype(np.float32)
                    # A pair is looked at once, from its earlier vector.
                    for c in range(int(np.searchsorted(n, own.min(), "right")), len(n), COLUMNS):
                        i, j = np.nonzero(left @ single[c : c + COLUMNS].T >= cosine - 1e-4)
                        j += c
                        later = n[j] > own[i]
                        i, j = i[later], j[later]
                        near = np.einsum("ij,ij->i", y[i], x[j]) >= cosine
                        yield pa.RecordBatch.from_arrays([pa.array(own[i[near]]), pa.array(n[j[near]])], ["a", "b"])

        found = cut(vectors.select("n", "x").mapInArrow(compare, "a long, b long"))
        sent.unpersist()
        return found

    pairs = reduce(DataFrame.unionByName, [of_slab(k) for k in range(slabs)])
    left, right = (vectors.select(F.col("n").alias(c), F.col("vec_id").alias(f"v{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").where("va != vb")
    return both.select(F.least("va", "vb").alias("vec_a"), F.greatest("va", "vb").alias("vec_b"))


def classes(embeddings: DataFrame, cosine: float = COSINE, slab_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(vec_id, class_id, links): one row an id."""
    pairs = cut(all_pairs(embeddings, cosine, slab_bytes))
    ids = embeddings.where("vec_id is not null").select("vec_id").distinct()
    none = ids.select("vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    if pairs.isEmpty():
        return none
    ends = pairs.select(F.col("vec_a").alias("vec_id")).unionAll(pairs.select(F.col("vec_b").alias("vec_id")))
    links = ends.groupBy("vec_id").agg(F.count("*").alias("links"))
    roots = connected_components(pairs.select(F.col("vec_a").alias("u"), F.col("vec_b").alias("v")))
    linked = roots.select(F.col("id").alias("vec_id"), F.col("root").alias("class_id")).join(links, "vec_id")
    return linked.unionByName(none.join(linked.select("vec_id"), "vec_id", "left_anti"))


def op3_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "embeddings"))


#: All pairs by brute force; the index finds a part of these (README).
PAIRS_SQL = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL),
u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS r FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0)
SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, max(list_dot_product(a.x, b.x) / (a.r * b.r)) AS cosine
FROM u a JOIN u b ON a.vec_id < b.vec_id AND len(a.x) = len(b.x)
WHERE a.r > 0 AND b.r > 0 AND list_dot_product(a.x, b.x) / (a.r * b.r) >= {COSINE} GROUP BY ALL
"""

ORACLE_SQL = f"""
WITH RECURSIVE near AS MATERIALIZED ({PAIRS_SQL}),
e AS MATERIALIZED (SELECT vec_a AS a, vec_b AS b FROM near UNION ALL SELECT vec_b, vec_a FROM near),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
classes AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT i.vec_id, coalesce(classes.c, i.vec_id) AS class_id, coalesce(links.n, 0) AS links
FROM (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id IS NOT NULL) i
LEFT JOIN classes ON classes.a = i.vec_id LEFT JOIN links ON links.a = i.vec_id
"""
