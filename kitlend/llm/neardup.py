"""Near-duplicates by improved consistent weighted sampling (operator 5).

A text's elements are its runs of ``SHINGLE`` words (a shorter text: all its
words as one), small ASCII letters, each weighing its count in the text times
an inverse document frequency. The frequency weight is 1 up to a document share
of ``COMMON_SHARE`` and falls with the logarithm of the share to ``IDF_FLOOR``:
wording found all over the corpus weighs less, and a large group of near copies
doesn't lose its similarity to its own size.

1. Common elements: a run of documents proposes the elements that half the share
   or more of its texts hold, so one over the share misses less than half the share of
   all texts in the runs that don't propose it, and its proposals reach half the share.
   That holds for runs of any length; short ones (long texts, small files) propose
   all their elements. The proposals that reach half the share are at most twice the
   mean text length over the share, whatever the corpus' size; a second pass counts
   just these in all documents.
2. Signatures: for each of BANDS * ROWS draws the element (and its quantised
   weight) with the smallest consistent sample. Equal texts share a node, the
   SHA-256 of the text; only nodes and samples leave the scan.
3. Bands: nodes with an equal band hash form a bucket. The first round links
   every node to the bucket's smallest one; the links are verified by the exact
   weighted Jaccard similarity of the texts (``THRESHOLD`` or more) and joined
   to components. So a group of thousands costs a few links a node and never all
   its pairs.
4. Buckets that still hold several components: all their pairs across components
   are verified. Those of at most ``SMALL`` nodes give their pairs as rows. Larger
   ones are cut into blocks, by component, and each pair of blocks that holds several
   components is a task's work: the weighted overlaps of all its texts are a product
   of two matrices, and it gives at most one link a component. So no pair that
   shares a band is left out, however large the bucket; the products grow with the
   square of a mixed bucket, spread over the pairs of blocks, the rows do not.
5. A class is a component, named by its smallest doc_id.

Null and empty texts hold no elements and form one class; texts of white space
alone, equal ones a class each. Null doc_ids take part but name no class unless
all of it are null. Repeated rows are one class. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kitlend.llm.common import (LOWER, blocks, mix, own_columns, prepare, span_hashes, stored, text_buffers,
                                window_hashes, word_spans)
from kitlend.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 3
COMMON_SHARE = 0.05
IDF_FLOOR = 0.9
SMALL = 16
#: Buckets of more nodes are joined by a broadcast of their few rows (at most
#: MOST_HOT, counted), so that one of them doesn't meet in one task.
HOT, MOST_HOT = 512, 200_000
#: Bytes and rows of a block.
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 2048
#: Documents of a run that proposes common elements, from where on it proposes none that is
#: in one text alone; elements that end a run before.
RUN_DOCS, RUN_ELEMENTS = math.ceil(4 / COMMON_SHARE), 1 << 21
#: Columns of a matrix product, and the most tasks over pairs of blocks.
WIDTH, MOST_TASKS = 1024, 8192
#: Texts or links with texts of a task, where their number is known beforehand.
TEXTS_A_TASK = 2000

_ID_BITS = 53


def elements(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of the rows of a block (at most BLOCK_ROWS): their
    53-bit ids, their counts, and the offsets of each row's elements."""
    n = len(offsets) - 1
    small = LOWER[data]
    starts, ends = word_spans(small, offsets)
    at = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(at))
    words = span_hashes(small, starts, ends)
    win = window_hashes(words, SHINGLE)
    inside = row[:len(win)] == row[SHINGLE - 1:] if len(win) else np.zeros(0, bool)
    ids, rows = [win[inside]], [row[:len(win)][inside]]
    count = np.diff(at)
    for i in np.flatnonzero((count > 0) & (count < SHINGLE)):
        ids.append(window_hashes(words[at[i]:at[i + 1]], int(count[i])))
        rows.append(np.array([i], np.uint64))
    key = (np.concatenate(rows) << np.uint64(_ID_BITS)) | (np.concatenate(ids) >> np.uint64(64 - _ID_BITS))
    key, times = np.unique(key, return_counts=True)
    bounds = np.append(np.searchsorted(key, np.arange(n, dtype=np.uint64) << np.uint64(_ID_BITS)), len(key))
    return key & np.uint64((1 << _ID_BITS) - 1), times, bounds


class Weights:
    """Inverse document frequency weights of the common elements; 1 elsewhere."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.weights = ids[order].astype(np.uint64), weights[order]

    def of(self, ids: np.ndarray) -> np.ndarray:
        out = np.ones(len(ids))
        if len(self.ids):
            at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
            hit = self.ids[at] == ids
            out[hit] = self.weights[at[hit]]
        return out


def idf_weight(df: np.ndarray, n: int) -> np.ndarray:
    """1 up to COMMON_SHARE, then log(n/df) / log(1/COMMON_SHARE), at least IDF_FLOOR."""
    return np.clip(np.log(n / np.maximum(df, 1)) / math.log(1 / COMMON_SHARE), IDF_FLOOR, 1.0)


def _each_block(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(column))
        for a, b in blocks(offsets, BLOCK_BYTES):
            for c in range(a, b, BLOCK_ROWS):
                d = min(c + BLOCK_ROWS, b)
                lo = offsets[c]
                yield batch, c, d, *elements(data[lo:offsets[d]], offsets[c:d + 1] - lo)


def _proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, n of the elements frequent in a run of blocks; id -1 counts its documents."""
    def proposals() -> pa.RecordBatch:
        found, at = np.unique(np.concatenate(held), return_inverse=True)
        n = np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)
        often = n >= COMMON_SHARE / 2 * docs
        return pa.RecordBatch.from_arrays(
            [pa.array([-1, *found[often].tolist()], pa.int64()), pa.array([docs, *n[often].tolist()], pa.int64())],
            ["id", "n"])
    held, counts, docs, size = [], [], 0, 0
    for _, a, b, ids, _, _ in _each_block(batches, 0):
        found, n = np.unique(ids, return_counts=True)
        held.append(found)
        counts.append(n)
        docs, size = docs + b - a, size + len(found)
        if docs >= RUN_DOCS or size >= RUN_ELEMENTS:
            yield proposals()
            held, counts, docs, size = [], [], 0, 0
    if docs:
        yield proposals()


def _counted(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(wanted), np.int64)
    for _, _, _, ids, _, _ in _each_block(batches, 0):
        at = np.minimum(np.searchsorted(wanted, ids), len(wanted) - 1)
        total += np.bincount(at[wanted[at] == ids], minlength=len(wanted))
    yield pa.RecordBatch.from_arrays([pa.array(wanted.view(np.int64)), pa.array(total)], ["id", "n"])


def common_weights(rows: DataFrame) -> Weights:
    """Weights of the elements in more than COMMON_SHARE of the rows' texts."""
    texts = rows.select("text")
    proposed = stored(texts.mapInArrow(_proposed, "id long, n long")
                      .groupBy("id").agg(F.sum("n").alias("n")), "neardup-proposed")
    n = proposed.where(F.col("id") == -1).agg(F.max("n")).first()[0] or 0
    found = proposed.where((F.col("id") >= 0) & (F.col("n") >= COMMON_SHARE / 2 * n)).select("id").toArrow()
    wanted = np.sort(found.column("id").to_numpy().astype(np.uint64))
    if not len(wanted):
        return Weights(np.zeros(0, np.uint64), np.zeros(0))
    counts = (texts.mapInArrow(lambda b: _counted(b, wanted), "id long, n long")
              .groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") > COMMON_SHARE * n)).toArrow()
    return Weights(counts.column("id").to_numpy().astype(np.uint64),
                   idf_weight(counts.column("n").to_numpy().astype(float), n))


# --- consistent samples --------------------------------------------------------

def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) at the middles of 2**16 equal steps: its value
    and its logarithm. The distribution function is 1 - (1 + x) exp(-x)."""
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    lo, hi = np.zeros(len(u)), np.full(len(u), 64.0)
    for _ in range(60):
        x = (lo + hi) / 2
        below = 1 - (1 + x) * np.exp(-x) < u
        lo, hi = np.where(below, x, lo), np.where(below, hi, x)
    return ((lo + hi) / 2).astype(np.float32), np.log((lo + hi) / 2).astype(np.float32)


_TABLES: list[np.ndarray] = []


def samples(ids: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """BANDS * ROWS sample hashes of each row with elements: for draw k and
    element e of weight S, with r and c from Gamma(2, 1) and b from [0, 1) given
    by (e, k): t = floor(ln S / r + b), ln a = ln c - r (t - b + 1); the element
    with the smallest a and its t are the sample."""
    if not _TABLES:
        _TABLES.extend(_quantiles())
    gamma, log_gamma = _TABLES
    at = bounds[:-1][np.diff(bounds) > 0]
    log_s = np.log(weights).astype(np.float32)
    odd = np.flatnonzero(log_s)
    name = mix(ids).astype(np.uint32).astype(np.uint64)
    out = np.empty((len(at), BANDS * ROWS), np.uint64)
    for k in range(BANDS * ROWS):
        x = (ids + np.uint64(2 * k + 1)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        f = x.view(np.uint16).reshape(-1, 4)
        r, b = gamma[f[:, 0]], f[:, 1].astype(np.float32) * np.float32(1 / 65536)
        log_a = log_gamma[f[:, 2]] - r * (np.float32(1) - b)
        tag = name
        if len(odd):
            t = np.floor(log_s[odd] / r[odd] + b[odd])
            log_a[odd] = log_gamma[f[odd, 2]] - r[odd] * (t - b[odd] + 1)
            tag = name.copy()
            tag[odd] = mix(ids[odd] + (t.astype(np.int64).view(np.uint64) << np.uint64(_ID_BITS))).astype(np.uint32)
        bits = log_a.view(np.uint32)
        bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
        out[:, k] = np.minimum.reduceat((bits << np.uint64(32)) | tag, at) & np.uint64(0xFFFFFFFF) if len(at) else 0
    return out


def _signed(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[pa.RecordBatch]:
    """The other columns, and the samples (empty without elements)."""
    for batch, a, b, ids, times, bounds in _each_block(batches, 0):
        sig = samples(ids, times * weights.of(ids), bounds).astype(np.uint32).view(np.int32)
        ends = np.concatenate(([0], np.cumsum((np.diff(bounds) > 0) * (BANDS * ROWS)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(sig.reshape(-1)))
        yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns[1:]), lists], [*batch.schema.names[1:], "sig"])


def band_hashes(sig: Column) -> Column:
    """The buckets of a node by band; none without samples."""
    bands = [F.xxhash64(F.lit(b), *[sig[b * ROWS + r] for r in range(ROWS)]) for b in range(BANDS)]
    return F.when(F.size(sig) > 0, F.array(*bands))


# --- verification --------------------------------------------------------------

def similarities(ids: np.ndarray, weights: np.ndarray, bounds: np.ndarray, left: np.ndarray,
                 right: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of the rows left[i] and right[i], whose elements
    (ids ascending) lie between the rows' bounds; at most BLOCK_ROWS pairs."""
    def of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = bounds[rows + 1] - bounds[rows]
        at = np.arange(n.sum()) + np.repeat(bounds[rows] - (np.cumsum(n) - n), n)
        pair = np.repeat(np.arange(len(rows)), n)
        return (pair.astype(np.uint64) << np.uint64(_ID_BITS)) | ids[at], weights[at], pair
    (lk, lw, lp), (rk, rw, rp), n = of(left), of(right), len(left)
    at = np.minimum(np.searchsorted(lk, rk), max(len(lk) - 1, 0))
    hit = np.flatnonzero(lk[at] == rk) if len(lk) else np.zeros(0, np.int64)
    low = np.bincount(rp[hit], np.minimum(lw[at[hit]], rw[hit]), n)
    whole = np.bincount(lp, lw, n) + np.bincount(rp, rw, n) - low
    return np.where(whole > 0, low / np.where(whole > 0, whole, 1), 0.0)


def overlaps(ids: np.ndarray, times: np.ndarray, idf: np.ndarray, bounds: np.ndarray, left: np.ndarray,
             right: np.ndarray) -> np.ndarray:
    """Sum of the smaller weights of the elements of each row of left with each other one of
    right. A row holds an element once for every time it counts, so the sum is a product of
    matrices over these; those that meet nothing on the other side are left out."""
    copy = np.repeat(np.arange(len(ids)), times)
    nth = np.arange(len(copy)) - np.repeat(np.cumsum(times) - times, times)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[copy]
    key, at = np.unique(ids[copy] ^ mix(nth.astype(np.uint64)), return_inverse=True)
    weight = np.empty(len(key))
    weight[at] = idf[copy]
    place = np.full((2, len(bounds) - 1), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    met = np.bincount(at, minlength=len(key)) > 1
    for side in place:
        met &= np.bincount(at[side[row] >= 0], minlength=len(key)) > 0
    column = np.cumsum(met) - 1
    held = np.flatnonzero(met[at])
    held = held[np.argsort(column[at[held]], kind="stable")]
    cols, rows, weight = column[at[held]], row[held], weight[met]
    out = np.zeros((len(left), len(right)))
    for lo in range(0, len(weight), WIDTH):
        a, b = np.searchsorted(cols, [lo, lo + WIDTH])
        sides = []
        for side, n in zip(place, out.shape, strict=True):
            r = side[rows[a:b]]
            dense = np.zeros((n, min(WIDTH, len(weight) - lo)))
            dense[r[r >= 0], cols[a:b][r >= 0] - lo] = 1
            sides.append(dense)
        sides[0] *= weight[lo:lo + WIDTH]
        out += sides[0] @ sides[1].T
    return out


def _links_of_blocks(table: pa.Table, weights: Weights, threshold: float) -> pa.Table:
    """a, b: links between the components of two blocks (or within one) that join those
    with near texts; no more than the components less one."""
    codec, texts, names, ends = pa.Codec("zstd"), [], [], [0]
    for held in table.column("held").to_pylist():
        names += [h["component"] for h in held]
        texts.append([codec.decompress(h["frame"], h["size"], asbytes=True) if h["size"] else b"" for h in held])
        ends.append(len(names))
    each = [elements(np.frombuffer(b"".join(t), np.uint8), np.cumsum([0, *map(len, t)])) for t in texts]
    ids, times = (np.concatenate([e[k] for e in each]) for k in (0, 1))
    bounds = np.concatenate([each[0][2], *(e[2][1:] + len(each[0][0]) for e in each[1:])])
    idf = weights.of(ids)
    left, right = np.arange(ends[1]), np.arange(ends[-2], ends[-1])
    low = overlaps(ids, times, idf, bounds, left, right)
    whole = np.bincount(np.repeat(np.arange(len(names)), np.diff(bounds)), times * idf, len(names))
    near = low >= (threshold - 1e-9) * (whole[left][:, None] + whole[right] - low)
    near &= low > 0
    known, label = np.unique(np.array(names, object), return_inverse=True)
    links = []
    for i in left:
        own = label[i]
        others = np.unique(label[right[near[i]]])
        others = others[others != own]
        if len(others):
            links += [(known[own], known[o]) for o in others]
            label[np.isin(label, others)] = own
    return pa.table({"a": pa.array([x for x, _ in links], pa.string()), "b": pa.array([x for _, x in links], pa.string())})


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``part``, the block of each row (bucket, component, node, size) in order: at most
    BLOCK_ROWS rows of a bucket and BLOCK_BYTES of text (one row at least)."""
    bucket = part = None
    rows = room = 0
    for batch in batches:
        parts = []
        for at, own, node, size in zip(*(batch.column(c).to_pylist() for c in ("bucket", "component", "node", "size")),
                                       strict=True):
            if at != bucket or rows == BLOCK_ROWS or size > room:
                bucket, part, rows, room = at, f"{at}:{own}:{node}", 0, BLOCK_BYTES
            rows, room = rows + 1, room - size
            parts.append(part)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.string())], [*batch.schema.names, "part"])


def _block_links(many: DataFrame, frames: DataFrame, weights: Weights, threshold: float) -> DataFrame | None:
    """a, b: links that join the components with near texts in the same bucket (bucket, node,
    component); None without a pair of blocks."""
    text, rows = frames.select(F.col("node").alias("_n"), "frame", "size"), many.count()
    whole = rows + frames.count()
    sized = stored(many.select("bucket", "component", "node").join(text.select("_n", "size"), F.col("node") == F.col("_n")).drop("_n"),
                   "neardup-sized", whole)
    placed = stored(sized.repartitionByRange("bucket", "component", "node").sortWithinPartitions("bucket", "component", "node")
                    .mapInArrow(_parts, "bucket long, component string, node string, size long, part string"), "neardup-parts", rows)
    of = placed.groupBy("part").agg(F.first("bucket").alias("bucket"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    a, b = (of.select(*[F.col(c).alias(f"{c}_{side}") for c in of.columns]) for side in "ab")
    pairs = stored(a.join(b, (F.col("bucket_a") == F.col("bucket_b")) & (F.col("part_a") <= F.col("part_b"))
                          & (F.least("lo_a", "lo_b") != F.greatest("hi_a", "hi_b"))).select("part_a", "part_b"), "neardup-block-pairs", rows)
    n = pairs.count()
    if not n:
        return None
    wanted = pairs.select(F.col("part_a").alias("_part")).union(pairs.select("part_b")).distinct()
    blocks_ = stored(placed.join(wanted, F.col("part") == F.col("_part"), "left_semi").select("part", "component", "node")
                     .join(text, F.col("node") == F.col("_n")).groupBy("part")
                     .agg(F.collect_list(F.struct("component", "frame", "size")).alias("held")), "neardup-blocks",
                     whole, TEXTS_A_TASK)
    sides = pairs.select("part_a", "part_b", F.explode(F.array_distinct(F.array("part_a", "part_b"))).alias("_part"))
    return stored(sides.join(blocks_, F.col("part") == F.col("_part")).select("part_a", "part_b", "held")
                  .repartition(min(n, MOST_TASKS), "part_a", "part_b").groupBy("part_a", "part_b")
                  .applyInArrow(lambda t: _links_of_blocks(t, weights, threshold), "a string, b string"), "neardup-block-links")


def _verified(batches: Iterator[pa.RecordBatch], weights: Weights, threshold: float,
              extra: list[str]) -> Iterator[pa.RecordBatch]:
    """a, b, near of candidate links with both texts. Pairs are taken in blocks of
    BLOCK_BYTES of text and BLOCK_ROWS texts (one pair at least), in which a text
    is read once; rows come sorted by a."""
    codec, kept = pa.Codec("zstd"), ["a", "b", *extra]
    for batch in batches:
        size = sum(batch.column(c).to_numpy() for c in ("size_a", "size_b"))
        sides = [[batch.column(c + side) for c in ("", "frame_", "size_")] for side in "ab"]
        for lo, hi in blocks(np.concatenate(([0], np.cumsum(size))), 2 * BLOCK_BYTES):
            for c in range(lo, hi, BLOCK_ROWS // 2):
                d = min(c + BLOCK_ROWS // 2, hi)
                row_of: dict[str, int] = {}
                texts, rows = [], np.empty((2, d - c), np.int64)
                for side, (names, frames, sizes) in enumerate(sides):
                    for i in range(c, d):
                        row = row_of.setdefault(names[i].as_py(), len(texts))
                        if row == len(texts):
                            n = sizes[i].as_py()
                            texts.append(codec.decompress(frames[i].as_buffer(), n, asbytes=True) if n else b"")
                        rows[side, i - c] = row
                ends = np.cumsum([0, *map(len, texts)])
                ids, times, bounds = elements(np.frombuffer(b"".join(texts), np.uint8), ends)
                near = similarities(ids, times * weights.of(ids), bounds, *rows) >= threshold - 1e-9
                yield pa.RecordBatch.from_arrays([*(batch.column(x)[c:d] for x in kept), pa.array(near, pa.bool_())],
                                                 [*kept, "near"])


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", compression_level=1)
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        for a in range(0, len(texts), 512):
            raw = [v.as_buffer() for v in texts[a:a + 512]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[a:a + 512], pa.array([codec.compress(r, asbytes=True) if r.size else b"" for r in raw],
                                                      pa.binary()),
                 pa.array([r.size for r in raw], pa.int64())], ["node", "frame", "size"])


def node_of(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 40)


def _of_buckets(places: DataFrame, table: DataFrame) -> DataFrame:
    """places joined with a table (of, n, ...) of their buckets."""
    same, hot = F.col("bucket") == F.col("of"), table.where(F.col("n") > HOT)
    if not 0 < hot.count() <= MOST_HOT:
        return places.join(table, same)
    rest = places.join(F.broadcast(hot.select("of")), same, "left_anti").join(table.where(F.col("n") <= HOT), same)
    return rest.unionByName(places.join(F.broadcast(hot), same))


def _merged(places: DataFrame, links: DataFrame) -> DataFrame:
    """places with ``component`` moved on by links (a, b) between components, of a stored table."""
    moved = components(links).select(F.col("node").alias("_was"), F.col("component").alias("_now"))
    return (places.join(moved, F.col("component") == F.col("_was"), "left")
            .withColumn("component", F.coalesce("_now", "component")).drop("_was", "_now"))


def _mixed(places: DataFrame, rows: int) -> DataFrame:
    """The places, ``rows`` at most, of buckets that hold several components."""
    spread = (places.groupBy(F.col("bucket").alias("of")).agg(
        F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where(F.col("lo") != F.col("hi")).select("of", "n"))
    return _of_buckets(places.drop("n"), stored(spread, "neardup-spread", rows)).drop("of")


def _small_pairs(few: DataFrame) -> DataFrame:
    """All pairs across components inside buckets of at most SMALL nodes."""
    other = few.select(F.col("bucket").alias("bk"), F.col("node").alias("b"), F.col("component").alias("cb"))
    return (few.join(other, (F.col("bucket") == F.col("bk")) & (F.col("node") < F.col("b")) & (F.col("component") != F.col("cb")))
            .select(F.col("node").alias("a"), "b", F.col("component").alias("ca"), "cb"))


def _linked_nodes(signed: DataFrame, n: int, verify, compare) -> DataFrame:
    """node, component of the nodes that share a bucket with another one; signed holds n rows."""
    nodes = signed.groupBy("node").agg(F.first("sig").alias("sig"))
    places = nodes.select("node", F.posexplode(band_hashes(F.col("sig"))).alias("band", "bucket"))
    shared = stored(places.groupBy(F.col("bucket").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("center"))
                    .where(F.col("n") > 1), "neardup-shared", BANDS * n)
    held = stored(_of_buckets(places, shared).select("bucket", "node", "center"), "neardup-buckets", BANDS * n)
    rows = held.count()
    tried = verify(held.select("node"), held.where(F.col("center") != F.col("node"))
                   .select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), rows)
    names = stored(_merged(held.select("node", F.col("node").alias("component")).distinct(),
                           tried.where("near").select("a", "b")), "neardup-names", rows)
    own = names.select(F.col("node").alias("_n"), "component")
    mixed = stored(_mixed(held.select("bucket", "node").join(own, F.col("node") == F.col("_n")).drop("_n"), rows),
                   "neardup-mixed", rows)
    left = mixed.count()
    few = mixed.where(F.col("n") <= SMALL)
    bridges = compare(held.select("node"), mixed.where(F.col("n") > SMALL))
    if bridges is not None:
        few = stored(_mixed(_merged(few, bridges), left), "neardup-few", left)
    done = tried.select(F.col("a").alias("ta"), F.col("b").alias("tb"))
    fresh = stored(_small_pairs(few.select("bucket", "node", "component")).distinct()
                   .join(done, (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left_anti"), "neardup-pairs",
                   SMALL // 2 * left + rows)
    found = (verify(held.select("node"), fresh, fresh.count()).where("near")  # names components of after the blocks: all are nodes
             .select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    return _merged(names, found if bridges is None else bridges.unionByName(found))


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, node (of the text), class_id (smallest doc_id of its class),
    component (of nodes),
    class_size (documents) and kept (whether it has the smallest doc_id)."""
    spark = docs.sparkSession
    prepare(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = own_columns(docs, "text", "doc_id").select(
        F.coalesce("text", F.lit("")).alias("text"), "doc_id", node_of(F.col("text")).alias("node"))
    weights = common_weights(rows)
    signed = stored(rows.mapInArrow(lambda b: _signed(b, weights),
                                    f"doc_id {id_type}, node string, sig array<int>"), "neardup-signed")
    n = signed.count()
    texts: list[DataFrame] = []

    def framed(active: DataFrame) -> DataFrame:
        if not texts:
            of = active.select(F.col("node").alias("_n")).distinct()
            texts.append(stored(rows.select("node", "text").mapInArrow(_frames, "node string, frame binary, size long")
                                .groupBy("node").agg(F.first("frame").alias("frame"), F.first("size").alias("size"))
                                .join(of, F.col("node") == F.col("_n"), "left_semi"), "neardup-texts",
                                n, TEXTS_A_TASK))
        return texts[0]

    def compare(active: DataFrame, many: DataFrame) -> DataFrame | None:
        return None if many.isEmpty() else _block_links(many, framed(active), weights, threshold)

    def verify(active: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
        frames, extra = framed(active), [c for c in pairs.columns if c not in ("a", "b")]
        a = frames.select(F.col("node").alias("na"), F.col("frame").alias("frame_a"), F.col("size").alias("size_a"))
        b = frames.select(F.col("node").alias("nb"), F.col("frame").alias("frame_b"), F.col("size").alias("size_b"))
        both = (pairs.join(b, F.col("b") == F.col("nb")).join(a, F.col("a") == F.col("na"))
                .select("a", "b", *extra, "frame_a", "size_a", "frame_b", "size_b").sortWithinPartitions("a"))
        return stored(both.mapInArrow(lambda x: _verified(x, weights, threshold, extra),
                                      ", ".join(f"{c} string" for c in ("a", "b", *extra)) + ", near boolean"),
                      "neardup-links", most + frames.count(), TEXTS_A_TASK)

    named = _linked_nodes(signed, n, verify, compare).select(F.col("node").alias("member"), "component")
    own = (signed.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
           .join(named, F.col("node") == F.col("member"), "left")
           .select("node", "least", "n", F.coalesce("component", "node").alias("component")))
    classes = own.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    of_node = (own.select("node", F.col("component").alias("at")).join(classes, F.col("at") == F.col("component"))
               .select(F.col("node").alias("of"), F.col("at").alias("component"), "class_id", "class_size"))
    return signed.select("doc_id", "node").join(of_node, F.col("node") == F.col("of")).select(
        "doc_id", "node", "component", "class_id", "class_size",
        F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def one_row_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, without near-duplicates: of each class one
    row with the smallest doc_id (then the smallest node) stays."""
    def key(doc_id: Column, node: Column) -> Column:
        return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), node)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    kept = (near_duplicate_classes(docs, threshold).groupBy("component").agg(F.min(first).alias("row"))
            .select(key(F.col("row.doc_id"), F.col("row.node")).alias("_row")))
    named = docs.withColumn("_row", key(F.col("doc_id"), node_of(F.col("text"))))
    return named.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")
