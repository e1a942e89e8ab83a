"""Toxicity: a character n-gram linear classifier over naive Bayes log-count
ratios (operator 6).

Features are the 4 to 7 byte n-grams of a text, ASCII letters made small, runs
of white space made one space and one put at either end, hashed to ``2**BITS``
features and marked present or absent. The model is fitted on a bounded sample:
at most ``SAMPLE`` labelled training rows of each class, drawn by a hash of
doc_id.

1. The sample's documents of each class that hold a feature are counted in the
   scan's tasks and summed by feature (at most 2**BITS rows a task), which gives
   the log-count ratio r of each feature. Ratios within ``SIGNIFICANT``
   standard errors of 0 count as 0.
2. About ``FIT`` of the rows of each class have their features scaled by r and fit
   a logistic regression in one task.
3. The product of r and the fitted weights is one weight a feature; the array
   of 2**BITS weights (a fixed bound) goes along with the scoring function.

A text's score is the probability of label 1. Only its text is read. Null text
is scored as the empty text. Rows of ``labels`` without a label, and documents
without a row there, train nothing; a document with several labels takes the
highest. Without rows of both classes every score is 0. Repeated rows each give
a row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kitlend.llm.common import LOWER, PIECE, SPACE, own_columns, prepare, stored, text_buffers

BITS = 18
ORDERS = (4, 5, 6, 7)
#: Most labelled rows of each class whose features are counted, and of these about
#: how many fit the regression.
SAMPLE, FIT = 8000, 2000
#: Standard errors that a log-count ratio must differ from 0 by.
SIGNIFICANT = 4.0
THRESHOLD = 0.7
#: Added to each count before the ratio.
SMOOTHING = 1.0
#: Passes of the optimiser, and the strength of its penalty.
STEPS = 150
PENALTY = 1e-3

_MULT = np.uint32(0x9E3779B1)


def normal(data: np.ndarray) -> np.ndarray:
    """A text's bytes with small ASCII letters and single spaces."""
    space = SPACE[data]
    keep = ~space
    keep[1:] |= ~space[:-1]  # the first of a run of white space stays
    text = np.where(space, np.uint8(32), LOWER[data])[keep]
    return np.concatenate(([32], text, [32])).astype(np.uint8)


def features(data: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed n-grams of one text's bytes (with repeats), in pieces, so that a
    very long text needs no arrays of its own length for each order."""
    whole, longest = normal(data), max(ORDERS)
    for a in range(0, len(whole), PIECE):
        text = whole[a:a + PIECE + longest - 1].astype(np.uint32)
        h = np.zeros(len(text), np.uint32)
        for n in range(1, min(longest, len(text)) + 1):
            h = (h[:len(text) - n + 1] + text[n - 1:]) * _MULT
            h ^= h >> np.uint32(15)
            if n in ORDERS:
                yield (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def _present(flags: np.ndarray, data: np.ndarray) -> np.ndarray:
    for f in features(data):
        flags[f] = True
    seen = np.flatnonzero(flags)
    flags[seen] = False
    return seen


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32(doc_id as text) % 3 = 1."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def drawn_labels(labels: DataFrame, sample: int) -> DataFrame:
    """of, toxic, fits: at most ``sample`` labelled training rows of each class, those
    first in the order of a hash of doc_id."""
    own = stored(own_columns(labels, "doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
                 .where(~held_out(F.col("doc_id")))
                 .groupBy(F.col("doc_id").alias("of")).agg(F.max("toxic").cast("int").alias("toxic"))
                 .withColumn("place", F.xxhash64("of", F.lit("sample"))), "toxic-labels")
    n = {row["toxic"]: row["count"] for row in own.groupBy("toxic").count().collect()}
    parts = []
    for c in (0, 1):  # thin out first, so that the ordered limit meets few rows more than it keeps
        near = own.where((F.col("toxic") == c) & (F.pmod("place", F.lit(max(n.get(c, 0), 1))) < 2 * sample))
        parts.append(near.withColumn("place", F.pmod("place", F.lit(max(n.get(c, 0), 1))))
                     .orderBy("place", "of").limit(sample))
    return parts[0].unionByName(parts[1]).select("of", "toxic", (F.col("place") < FIT).alias("fits"))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic, fits of the drawn training rows. The drawn labels are at most twice
    ``sample`` rows of two numbers and so are broadcast; texts stay where they
    are scanned."""
    drawn = F.broadcast(drawn_labels(labels, sample))
    return own_columns(docs, "doc_id", "text").join(drawn, F.col("doc_id") == F.col("of")).select(
        F.coalesce("text", F.lit("")).alias("text"), "toxic", "fits")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, documents of class 0, of class 1; feature -1 counts documents."""
    flags = np.zeros(1 << BITS, bool)
    n = np.zeros((2, (1 << BITS) + 1), np.int64)
    for batch in batches:
        data, offsets = text_buffers(batch.column(0))
        toxic = np.asarray(batch.column(1))
        for i in range(batch.num_rows):
            n[toxic[i], _present(flags, data[offsets[i]:offsets[i + 1]])] += 1
            n[toxic[i], -1] += 1
    at = np.flatnonzero(n.any(0))
    f = np.where(at == 1 << BITS, -1, at)
    for a in range(0, len(at), 50_000):
        part = slice(a, a + 50_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(f[part], pa.int32()), pa.array(n[0, at[part]]), pa.array(n[1, at[part]])],
            ["feature", "n0", "n1"])


def log_count_ratios(train: DataFrame) -> np.ndarray | None:
    """r by feature from the sample; None without rows of both classes."""
    rows = (train.select("text", "toxic").mapInArrow(_counts, "feature int, n0 long, n1 long")
            .groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))).toArrow()
    f = rows.column("feature").to_numpy()
    counts = np.zeros((2, (1 << BITS) + 1))
    for k in (0, 1):
        counts[k, f] = rows.column(f"n{k}").to_numpy()
    if not counts[:, -1].all():
        return None
    p = (counts[:, :-1] + SMOOTHING) / (counts[:, -1:] + 2 * SMOOTHING)
    r = np.log(p[1]) - np.log(p[0])
    error = np.sqrt(1 / (counts[0, :-1] + SMOOTHING) + 1 / (counts[1, :-1] + SMOOTHING))
    r[np.abs(r) < SIGNIFICANT * error] = 0
    return r.astype(np.float32)


def _sparse(batches: Iterator[pa.RecordBatch], r: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The present features of each sampled row whose ratio isn't 0, packed."""
    used = r != 0
    flags = np.zeros(1 << BITS, bool)
    for batch in batches:
        data, offsets = text_buffers(batch.column(0))
        seen = []
        for i in range(batch.num_rows):
            f = _present(flags, data[offsets[i]:offsets[i + 1]])
            seen.append(f[used[f]].astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.binary()), batch.column(1)], ["seen", "toxic"])


def _fit(batches: Iterator[pa.RecordBatch], r: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Weights of the logistic regression over the bounded sample, by Adam on the
    whole sample, each class weighing the same."""
    seen, toxic = [], []
    for batch in batches:
        seen += [np.frombuffer(v.as_py(), np.int32) for v in batch.column(0)]
        toxic += batch.column(1).to_pylist()
    order = sorted(range(len(seen)), key=lambda i: (toxic[i], seen[i].tobytes()))
    seen, y = [seen[i] for i in order], np.array([toxic[i] for i in order], np.float64)
    at = np.concatenate([*seen, np.zeros(0, np.int32)])
    row_of = np.repeat(np.arange(len(seen), dtype=np.int32), [len(s) for s in seen])
    scaled = r[at]
    row_weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, m, v, b = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(3)
    for step in range(1, STEPS + 1):
        z = np.bincount(row_of, w[at] * scaled, len(seen)) + b[0]
        err = (1 / (1 + np.exp(-z)) - y) * row_weight
        g = np.bincount(at, scaled * err[row_of], 1 << BITS) + PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        rate = 0.02 / (1 + step / 20)
        w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        gb = err.sum()
        b[1], b[2] = 0.9 * b[1] + 0.1 * gb, 0.99 * b[2] + 0.01 * gb * gb
        b[0] -= rate * (b[1] / (1 - 0.9 ** step)) / (np.sqrt(b[2] / (1 - 0.99 ** step)) + 1e-8)
    yield pa.RecordBatch.from_arrays(
        [pa.array([(w * r).astype(np.float32).tobytes()], pa.binary()), pa.array([float(b[0])])],
        ["weights", "bias"])


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model from the labelled training rows; None without both classes."""
    prepare(docs.sparkSession)
    kept = stored(labelled(docs, labels, sample), "toxic-train")
    r = log_count_ratios(kept)
    if r is None:
        return None
    packed = kept.where("fits").select("text", "toxic").mapInArrow(lambda b: _sparse(b, r), "seen binary, toxic int")
    fitted = packed.repartition(1).mapInArrow(lambda b: _fit(b, r), "weights binary, bias double").first()
    return Model(np.frombuffer(fitted["weights"], np.float32), fitted["bias"])


def _score(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    flags = np.zeros(1 << BITS, np.float32)
    for batch in batches:
        data, offsets = text_buffers(batch.column(0))
        z = np.empty(batch.num_rows)
        for i in range(batch.num_rows):
            for f in features(data[offsets[i]:offsets[i + 1]]):
                flags[f] = 1
            z[i] = flags @ weights + bias
            flags[:] = 0
        score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(np.round(score, 6))], [*batch.schema.names[1:], "score"])


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score of every document."""
    rows = own_columns(docs, "text", "doc_id")
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    weights, bias = model.weights, model.bias
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _score(b, weights, bias), f"doc_id {kind}, score double")


def _below(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bias: float, text: int,
           threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        only = pa.RecordBatch.from_arrays([batch.column(text)], ["text"])
        score = next(_score(iter([only]), weights, bias)).column(0)
        yield batch.filter(pa.array(np.asarray(score) < threshold))


def kept_rows(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold."""
    prepare(docs.sparkSession)
    if model is None:
        return docs
    weights, bias, text = model.weights, model.bias, docs.columns.index("text")
    return docs.mapInArrow(lambda b: _below(b, weights, bias, text, threshold), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    s = scored(docs, train(docs, labels))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted"))
