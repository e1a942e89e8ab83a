"""Product codes of vectors, assigned by LAESA (operator 11).

Components become whole numbers, floor(``SCALE`` * x); a vector is cut into
``PARTS`` equal consecutive parts, and each part position has a codebook of at
most ``ENTRIES`` entries, which start as that part of the vectors with the
smallest vec_ids. Each round assigns every part to its nearest entry and moves
every used entry to the floor of its parts' mean.

LAESA: each part position has ``PIVOTS`` fixed pivots, drawn from the first
codebook, the farthest from those before it each time. The distances of all
parts to their pivots are computed once and stored beside the vectors. A round
computes only the distances of pivots to entries; by the triangle inequality
|d(part, pivot) - d(pivot, entry)|, largest over the pivots, is a lower bound of
d(part, entry). Entries are tried in rising order of bound; the exact squared
distance, in whole numbers, is evaluated while the bound doesn't exceed the
smallest one found, so that equal distances are seen and go to the lower index.
Bounds are lowered by more than the rounding error of stored distances.

A round is one pass over the stored vectors; tasks give sums by (part, entry,
position), Spark adds them, and only the codebooks (ENTRIES rows of a vector's
width, whatever the table's size) meet on the driver.

Vectors that are null or hold null or non-finite components take no part. Shorter
vectors, and widths that are no multiple of PARTS, count as if filled up with
zeros. Null vec_ids come last in the order of the first entries, and repeated ones by
their components; equal rows are rows of their own. Components
beyond 32 bits, or vectors whose squared distances would leave 64 bits, are an
error. An empty table gives no rows.
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

SCALE, PARTS, ENTRIES, ROUNDS, PIVOTS = 4096, 8, 16, 6, 5
#: Relative error of a stored distance (float32) and of the bounds made from it.
SLACK = 2.0 ** -21


def pivots_of(codebook: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Of the entries (rows) the first, then each time the one farthest from
    those taken; the lower index on ties. Equal entries are taken once."""
    taken = [0]
    near = ((codebook - codebook[0]) ** 2).sum(1)
    while len(taken) < count and near.max() > 0:
        taken.append(int(near.argmax()))
        near = np.minimum(near, ((codebook - codebook[taken[-1]]) ** 2).sum(1))
    return codebook[taken]


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances (float64) of whole-number rows to points."""
    return np.stack([np.sqrt(((rows - p) ** 2).sum(1).astype(np.float64)) for p in points], 1)


def lower_bounds(to_pivots: np.ndarray, pivot_entries: np.ndarray) -> np.ndarray:
    """Lower bounds of the distances of parts (rows) to entries (columns)."""
    out = np.zeros((len(to_pivots), pivot_entries.shape[1]))
    for j in range(pivot_entries.shape[0]):
        a, b = to_pivots[:, j, None].astype(np.float64), pivot_entries[None, j]
        np.maximum(out, np.abs(a - b) - SLACK * (a + b), out=out)
    return out


def nearest(rows: np.ndarray, to_pivots: np.ndarray, codebook: np.ndarray,
            pivot_entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry of each row, its exact squared distance, and
    the number of exact evaluations."""
    bounds = lower_bounds(to_pivots, pivot_entries)
    order = np.argsort(bounds, axis=1, kind="stable")
    best = np.full(len(rows), np.iinfo(np.int64).max)
    index = np.zeros(len(rows), np.int64)
    left, tried = np.arange(len(rows)), 0
    for step in range(len(codebook)):
        entry = order[left, step]
        low = bounds[left, entry]
        open_ = low * low * (1 - SLACK) <= best[left]
        left, entry = left[open_], entry[open_]
        if not len(left):
            break
        tried += len(left)
        d = ((rows[left] - codebook[entry]) ** 2).sum(1)
        better = (d < best[left]) | ((d == best[left]) & (entry < index[left]))
        best[left[better]], index[left[better]] = d[better], entry[better]
    return index, best, tried


def _assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray,
              pivots: list[np.ndarray]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a block, their components, indexes and distances by part."""
    parts, _, w = books.shape
    between = [distances(books[p], pivots[p]).T for p in range(parts)]
    ends = np.cumsum([0, *(len(p) for p in pivots)])
    for batch in batches:
        for a, b in row_blocks(len(batch), parts * w):
            part_of = batch.slice(a, b - a)
            x = matrix(part_of.column("q"), parts * w).reshape(-1, parts, w)
            flat = part_of.column("far").flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
            index, error = np.empty((b - a, parts), np.int64), np.empty((b - a, parts), np.int64)
            for p in range(parts):
                index[:, p], error[:, p], _ = nearest(x[:, p], flat[:, ends[p]:ends[p + 1]], books[p], between[p])
            yield part_of, x, index, error


def _with_pivots(batches: Iterator[pa.RecordBatch], pivots: list[np.ndarray], w: int) -> Iterator[pa.RecordBatch]:
    """The rows and ``far``, the distances of each part to its pivots."""
    parts = len(pivots)
    for batch in batches:
        x = matrix(batch.column("q"), parts * w).reshape(-1, parts, w)
        far = np.concatenate([distances(x[:, p], pivots[p]) for p in range(parts)], 1).astype(np.float32)
        ends = np.arange(len(batch) + 1, dtype=np.int32) * far.shape[1]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(far.reshape(-1)))],
            [*batch.schema.names, "far"])


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray, pivots: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """slot ((part, entry, position) as one number), n, total over the task's rows."""
    parts, k, w = books.shape
    n, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, w), np.int64)
    for _, x, index, _ in _assigned(batches, books, pivots):
        for p in range(parts):
            n[p] += np.bincount(index[:, p], minlength=k)
            np.add.at(total[p], index[:, p], x[:, p])
    used = np.repeat(n.reshape(-1) > 0, w)
    slots = np.flatnonzero(used)
    yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(np.repeat(n.reshape(-1), w)[slots]),
                                      pa.array(total.reshape(-1)[slots])], ["slot", "n", "total"])


_HEX = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint8).reshape(256, 2)


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray, pivots: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    parts = len(books)
    for rows, _, index, error in _assigned(batches, books, pivots):
        text = np.ascontiguousarray(_HEX[index]).reshape(-1)
        ends = np.arange(len(index) + 1, dtype=np.int32) * (2 * parts)
        code = pa.StringArray.from_buffers(len(index), pa.py_buffer(ends), pa.py_buffer(text))
        yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), code, pa.array(error.sum(1))],
                                         ["vec_id", "label", "code", "error"])


def product_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
                  scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error of the vectors that take part, and the
    codebooks (part, entry, position); at most 256 entries."""
    spark = vectors.sparkSession
    prepare(spark)
    q = stored(own_columns(vectors, "vec_id", "label", "embedding").where(usable(F.col("embedding")))
               .select("vec_id", "label", floored(F.col("embedding"), scale).alias("q")), "codes-vectors")
    kinds = {f.name: f.dataType.simpleString() for f in q.schema}
    width, top = extent(q)
    w = -(-width // parts)
    check_exact(parts * w, top)
    first = q.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()  # ENTRIES rows
    if not first:
        none = spark.createDataFrame([], f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
        return none, np.zeros((parts, 0, w), np.int64)
    start = np.zeros((len(first), parts * w), np.int64)
    for i, r in enumerate(first):
        start[i, :len(r.q)] = r.q
    books = np.ascontiguousarray(start.reshape(-1, parts, w).transpose(1, 0, 2))
    pivots = [pivots_of(b) for b in books]
    rows = stored(q.mapInArrow(lambda b: _with_pivots(b, pivots, w), ", ".join(
        [f"{c} {t}" for c, t in kinds.items()] + ["far array<float>"])), "codes-pivots")
    for _ in range(rounds):
        sums = (rows.mapInArrow(lambda b, now=books: _sums(b, now, pivots), "slot long, n long, total long")
                .groupBy("slot").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
        books = books.copy()
        for r in sums.collect():  # parts x entries x positions
            books.reshape(-1)[r.slot] = int(r.total) // r.n
    final = books
    coded = rows.mapInArrow(lambda b: _coded(b, final, pivots),
                            f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    return coded, final


def digest(books: np.ndarray) -> str:
    """SHA-256 of the codebooks' components in order, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def coded_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    coded, books = product_codes(vectors)
    coded = stored(coded, "codes")
    per = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "codes-labels")
    per = per.withColumnRenamed("label", "of")
    return coded.join(per, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
