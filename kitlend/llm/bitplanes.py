"""Centroid clustering by bit planes and popcounts (operator 12).

Components become whole numbers, floor(``SCALE`` * x). With B bits in two's
complement, bit plane b of a vector packs bit b of its ``WIDTH`` components into
one 64-bit number; a component is the sum of its bits times the planes' weights
(2^b, the last one negative). For vector planes X and centroid planes C

    x . c = sum over a, b of weight(a) * weight(b) * popcount(X[a] & C[b])

is exact, and so is |x|^2 - 2 x . c + |c|^2. B is the least that holds every
component of the table; planes and |x|^2 are computed once and stored beside the
vectors.

Centroids start as the ``CLUSTERS`` vectors with the smallest SHA-256 of
``2:<vec_id>``. Each round assigns every vector to its nearest centroid (the smaller
number on ties) and moves every non-empty centroid to the floor of its vectors'
mean. A round is one pass over the stored vectors; tasks give sums by cluster,
Spark adds them, and only the centroids meet on the driver.

Vectors of another length than WIDTH, null ones, and those with null or non-finite
components take no part. Null vec_ids are drawn last, repeated ones in the order
of their components; equal rows are rows of their own. Components beyond 32 bits, or whose squared
distances would leave 64 bits, are an error. Fewer vectors than CLUSTERS give
as many centroids as there are; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kitlend.llm.common import own_columns, prepare, stored
from kitlend.llm.vectors import check_exact, extent, floored, matrix, row_blocks, usable

SCALE, WIDTH, CLUSTERS, ROUNDS, SEED = 256, 64, 40, 5, 2


def bits_for(top: int) -> int:
    """Bits in two's complement that hold every number of at most this size."""
    return int(top).bit_length() + 1


def planes_of(x: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes (rows x bits, uint64) of a matrix of WIDTH whole numbers a row."""
    place = np.uint64(1) << np.arange(x.shape[1], dtype=np.uint64)
    out = np.empty((len(x), bits), np.uint64)
    for b in range(bits):
        out[:, b] = (((x >> b) & 1).astype(np.uint64) * place).sum(1, dtype=np.uint64)
    return out


def weights(bits: int) -> np.ndarray:
    """What a set bit of each plane adds; the last plane is the sign."""
    w = np.int64(1) << np.arange(bits, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of vectors and centroids from their planes."""
    wx, wc = weights(x.shape[1]), weights(c.shape[1])
    out = np.zeros((len(x), len(c)), np.int64)
    for a in range(x.shape[1]):
        part = np.zeros_like(out)
        for b in range(c.shape[1]):
            part += np.bitwise_count(x[:, a, None] & c[None, :, b]) * wc[b]
        out += part * wx[a]
    return out


def nearest(x: np.ndarray, norms: np.ndarray, c: np.ndarray, c_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector, and the squared distance."""
    d = norms[:, None] - 2 * dots(x, c) + c_norms[None, :]
    at = d.argmin(1)
    return at, d[np.arange(len(d)), at]


def _packed(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """vec_id, q, planes, norm."""
    for batch in batches:
        x = matrix(batch.column("q"), WIDTH)
        ends = np.arange(len(batch) + 1, dtype=np.int32) * bits
        planes = pa.ListArray.from_arrays(pa.array(ends), pa.array(planes_of(x, bits).reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q"), planes, pa.array((x * x).sum(1))],
                                         ["vec_id", "q", "planes", "norm"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray,
              bits: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of a block, their clusters and squared distances."""
    c, c_norms = planes_of(centroids, bits), (centroids * centroids).sum(1)
    for batch in batches:
        for a, b in row_blocks(len(batch), max(len(centroids), WIDTH)):
            rows = batch.slice(a, b - a)
            x = matrix(rows.column("planes"), bits).view(np.uint64)
            yield rows, *nearest(x, rows.column("norm").to_numpy(zero_copy_only=False), c, c_norms)


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """slot ((cluster, position) as one number), n, total over the task's rows."""
    n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    for rows, cluster, _ in _assigned(batches, centroids, bits):
        n += np.bincount(cluster, minlength=len(n))
        np.add.at(total, cluster, matrix(rows.column("q"), WIDTH))
    n = np.repeat(n, WIDTH)
    slots = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(n[slots]), pa.array(total.reshape(-1)[slots])],
                                     ["slot", "n", "total"])


def _clustered(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    for rows, cluster, distance in _assigned(batches, centroids, bits):
        yield pa.RecordBatch.from_arrays([rows.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)],
                                         ["vec_id", "cluster", "distance"])


def clusters(vectors: DataFrame, count: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE,
             seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance of the vectors that take part, and the final centroids."""
    spark = vectors.sparkSession
    prepare(spark)
    x = F.col("embedding")
    q = stored(own_columns(vectors, "vec_id", "embedding").where(usable(x) & (F.size(x) == WIDTH))
               .select("vec_id", floored(x, scale).alias("q")), "planes-vectors")
    kind = q.schema["vec_id"].dataType.simpleString()
    out = f"vec_id {kind}, cluster int, distance long"
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = q.orderBy(draw.asc_nulls_last(), "q").limit(count).select("q").collect()  # CLUSTERS rows
    if not first:
        return spark.createDataFrame([], out), np.zeros((0, WIDTH), np.int64)
    _, top = extent(q)
    check_exact(WIDTH, top)
    bits = bits_for(top)
    now = np.array([r.q for r in first], np.int64)
    rows = stored(q.mapInArrow(lambda b: _packed(b, bits), f"vec_id {kind}, q array<int>, planes array<long>, norm long"),
                  "planes")
    for _ in range(rounds):
        sums = (rows.mapInArrow(lambda b, c=now: _sums(b, c, bits), "slot long, n long, total long")
                .groupBy("slot").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
        now = now.copy()
        for r in sums.collect():  # clusters x positions
            now.reshape(-1)[r.slot] = int(r.total) // r.n
    final = now
    return rows.mapInArrow(lambda b: _clustered(b, final, bits), out), final


def clustered_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found, centroids = clusters(vectors)
    spark = vectors.sparkSession
    found = stored(found, "planes-clusters")
    per = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # a row a cluster
    whole = sum(per.values())
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = spark.createDataFrame([(c, n, whole, sha[c]) for c, n in per.items()],
                                  "of int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), F.col("cluster") == F.col("of")).drop("of")  # at most CLUSTERS rows
