"""Exact top-k search by inner product with block pruning (operator 8).

Each component is a term: a vector is a document of 64 quantised term weights,
floor(64 * x). Vectors are cut into blocks of ``BLOCK_ROWS`` rows that are
consecutive in vec_id order; a block keeps its forward index (the matrix of
its rows) and the largest and smallest weight of each term. For a query the
block's bound is the sum over terms of max(q * largest, q * smallest); blocks
are taken in falling order of bound, scored through the forward index, and the
query is done once the next bound falls below its kth score (a bound equal to
the kth score is still scored, since a tie may go to a smaller vec_id).

Queries (rows whose vec_id is divisible by ``QUERY_EVERY``) meet all blocks in
a grid: shards of blocks on one side, groups of queries on the other, one task
a cell, so no side is broadcast and no cell holds more than ``SHARD_ROWS``
vectors and ``QUERY_ROWS`` queries. Cells give each query's best k of their
shard; the last top k keeps the partial order on both sides of its shuffle.

Sums are exact: float64 products of whole numbers while the sums stay below
2**53, else 64-bit integers, or Python's where those could overflow; a score of the
result beyond 64 bits is an error. Vectors that are null, or hold null or non-finite
components, take no part; missing trailing components count as zero. Equal
scores rank the smaller vec_id first. A row is told by its place in the order, not
by its id: rows with a repeated vec_id are queries and candidates of their own, and
a query meets every row but itself. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kitlend.llm.common import own_columns, prepare, stored

K = 20
QUERY_EVERY = 20
SCALE = 64
BLOCK_ROWS = 256
SHARD_ROWS = 16384
QUERY_ROWS = 512


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, q: whole-number components of the vectors that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (own_columns(vectors, "vec_id", "embedding")
            .where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad)
            .select("vec_id", F.transform(x, lambda v: F.when(
                F.abs(v.cast("double")) * SCALE < 2 ** 62, F.floor(v.cast("double") * SCALE)).otherwise(
                F.raise_error(F.lit("a component is beyond 64 bits")).cast("long"))).alias("q")))


def _matrix(rows: pd.Series) -> np.ndarray:
    width = max((len(r) for r in rows), default=0)
    m = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        m[i, :len(r)] = r
    return m


def _kind(a: np.ndarray, b: np.ndarray) -> type:
    """The number type in which inner products of rows of a and b are exact."""
    top = [max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0 for x in (a, b)]
    most = top[0] * top[1] * max(a.shape[1], 1)
    return np.float64 if most < 2 ** 53 else np.int64 if most < 2 ** 63 else object


def search_cell(ids: np.ndarray, rows: np.ndarray, qids: np.ndarray, queries: np.ndarray,
                k: int = K, block_rows: int = BLOCK_ROWS, places: np.ndarray | None = None,
                qplaces: np.ndarray | None = None) -> tuple[list[np.ndarray], int]:
    """Best k of ``rows`` for each query as arrays (query_id, vec_id, score), and
    the number of (query, block) pairs scored. A query leaves out the row of its
    own place (by default, of its id)."""
    places, qplaces = (ids if places is None else places), (qids if qplaces is None else qplaces)
    width = max(rows.shape[1], queries.shape[1])
    rows = np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    kind = _kind(rows, queries)
    order = np.argsort(ids, kind="stable")
    ids, places, rows, queries = ids[order], places[order], rows[order].astype(kind), queries.astype(kind)
    cut = range(0, len(ids), block_rows)
    blocks = [(ids[a:a + block_rows], places[a:a + block_rows], np.ascontiguousarray(rows[a:a + block_rows].T)) for a in cut]
    high = np.array([b.max(1) for _, _, b in blocks]).T
    low = np.array([b.min(1) for _, _, b in blocks]).T
    bounds = np.maximum(queries, 0) @ high + np.minimum(queries, 0) @ low
    out, scored = [], 0
    for i, (qid, own) in enumerate(zip(qids, qplaces, strict=True)):
        best = np.empty((0, 2), np.int64)
        kth = None
        for b in np.argsort(-bounds[i], kind="stable"):
            if kth is not None and bounds[i, b] < kth:
                break
            scored += 1
            bid, place, forward = blocks[b]
            s = queries[i] @ forward
            near = place != own if kth is None else (s >= kth) & (place != own)
            if not near.any():
                continue
            best = np.concatenate([best, np.stack([bid[near], s[near].astype(np.int64)], 1)])
            best = best[np.lexsort((best[:, 0], -best[:, 1]))[:k]]
            if len(best) == k:
                kth = best[-1, 1]
        out.append(np.column_stack([np.full(len(best), qid, np.int64), best]))
    return out, scored


def _cell(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    names = ["query_row", "query_id", "vec_id", "score"]
    if left.empty or right.empty:
        return pd.DataFrame({n: np.zeros(0, np.int64) for n in names})
    at = right["row"].to_numpy(np.int64)
    out, _ = search_cell(left["vec_id"].to_numpy(np.int64), _matrix(left["q"]), right["vec_id"].to_numpy(np.int64),
                         _matrix(right["q"]), k, places=left["row"].to_numpy(np.int64), qplaces=at)
    row = np.repeat(at, [len(x) for x in out])
    return pd.DataFrame(np.column_stack([row, np.concatenate(out)]), columns=names)


def _sharded(q: DataFrame, shard_rows: int) -> DataFrame:
    """Adds ``row``, the row's place by vec_id, and ``shard``: place // shard_rows.
    Places are counted in the partitions of a range shuffle, each at its running offset."""
    parted = stored(q.repartitionByRange("vec_id", F.xxhash64("q"))
                    .withColumn("part", F.spark_partition_id()), "topk-ranges")
    counts = parted.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("vec_id"))
    return (parted.join(counts.select("part", before.alias("off")), "part")
            .withColumn("row", F.col("off") + inside - 1)
            .select("vec_id", "q", "row", F.floor(F.col("row") / shard_rows).cast("int").alias("shard")))


def top_k(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, shard_rows: int = SHARD_ROWS,
          query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best candidates."""
    prepare(vectors.sparkSession)
    q = stored(quantised(vectors), "topk-vectors")
    is_query = F.col("vec_id") % every == 0
    sums = q.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("nq")).first()
    shards, groups = -(-int(sums["n"]) // shard_rows) or 1, -(-int(sums["nq"]) // query_rows) or 1
    placed = stored(_sharded(q, shard_rows), "topk-places")
    left = placed.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = (placed.where(is_query).drop("shard").withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    cells = left.groupBy("shard", "grp").cogroup(right.groupBy("shard", "grp")).applyInPandas(
        lambda a, b: _cell(a, b, k), "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return (cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
