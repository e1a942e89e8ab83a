"""Token counts with overlap resynchronisation for huge documents (operator 2).

Documents of at most ``chunk_bytes`` are counted where they are scanned. Longer
ones are cut into chunks of that size that overlap by ``overlap`` bytes; the
chunks are spread over the cluster and encoded apart, and each reports the
stable boundaries in its two overlaps: their byte offset in the document, the
tokens before them, and a hash of the ids of the word that follows. A boundary
is proven stable where a non-space follows white space inside the chunk: no
token of the vocabulary crosses it, whatever stands on either side. Adjacent
chunks are spliced at the first boundary that both report with the same ids.
Documents with a junction that has no such boundary (a run without white space
that fills the overlap) are cut anew with chunks and overlaps ``WIDEN`` times
as large, until they align or are one chunk.

Equal long texts are counted once (by their SHA-256). Null text counts as
empty. Other columns are ignored; repeated rows each give a row; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kitlend.llm.common import own_columns, prepare, stored
from kitlend.llm.encoder import Encoder, encoder

CHUNK_BYTES = 1 << 14
OVERLAP = 256
WIDEN = 8
LIMIT = 2048
#: Boundaries that a chunk reports in each overlap.
REPORTED = 8

_SPACES = b" \t\n\r\v\f"


def _short(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for b in batches:
        counts = [enc.count(v.as_buffer().to_pybytes() if v.is_valid else b"")
                  for v in b.column(1).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
    enc.memo.clear()  # the worker lives on, for other stages


def cut(text: bytes, chunk: int, overlap: int) -> list[tuple[int, bytes]]:
    """(offset, bytes) of the overlapping chunks, cut between characters."""
    def edge(p: int) -> int:
        while p < len(text) and text[p] & 0xC0 == 0x80:
            p += 1
        return min(p, len(text))
    starts = [edge(p) for p in range(0, max(len(text) - overlap, 1), chunk)]
    return [(s, text[s:edge(s2 + overlap)]) for s, s2 in zip(starts, [*starts[1:], len(text)], strict=True)]


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for key, text in zip(b.column(0), b.column(1).cast(pa.large_binary()), strict=True):
            pieces = cut(text.as_py(), chunk, overlap)
            for a in range(0, len(pieces), 64):
                part = pieces[a:a + 64]
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()] * n), pa.array(range(a, a + n), pa.int32()),
                     pa.array([len(pieces)] * n, pa.int32()), pa.array([p for p, _ in part], pa.int64()),
                     pa.array([t for _, t in part], pa.binary())], ["key", "i", "n", "start", "piece"])


def stable_places(piece: bytes, lo: int, hi: int) -> list[tuple[int, int]]:
    """The first REPORTED stable boundaries between byte lo and byte hi of a piece,
    and the ends of the words that follow them."""
    out, p = [], max(lo, 1)
    while p < hi and len(out) < REPORTED:
        if piece[p] not in _SPACES and piece[p - 1] in _SPACES:
            end = p
            while end < len(piece) and piece[end] not in _SPACES:
                end += 1
            if end == len(piece):  # the word may go on in the next chunk
                break
            out.append((p, end))
            p = end
        p += 1
    return out


def counted(enc: Encoder, piece: bytes, places: list[tuple[int, int]]) -> tuple[list[tuple[int, int, str]], int]:
    """(offset in the piece, tokens before, hash of the following word's ids) of
    ascending boundaries, and the tokens of the piece: the tokens between the
    boundaries are counted once and summed up."""
    if not enc.drops_space:  # a token may begin with the space before its word
        return [(p, enc.count(piece[:p]), enc.packed(piece[p:end]).hex()[:64]) for p, end in places], enc.count(piece)
    out, before, last = [], 0, 0
    for p, end in places:
        before += enc.count(piece[last:p])
        out.append((p, before, enc.packed(piece[p:end]).hex()[:64]))
        last = p
    return out, before + enc.count(piece[last:])


def _encode(batches: Iterator[pa.RecordBatch], path: str, overlap: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    marks = pa.list_(pa.struct([("at", pa.string()), ("before", pa.int64())]))
    for b in batches:
        rows = []
        for key, i, n, start, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
            left = stable_places(piece, 0, min(overlap, len(piece))) if i else []
            right = stable_places(piece, max(len(piece) - overlap, 0), len(piece)) if i < n - 1 else []
            found, total = counted(enc, piece, sorted({*left, *right}))
            named = {p: {"at": f"{start + p}:{sig}", "before": before} for p, before, sig in found}
            rows.append((key, i, n, total, [named[p] for p, _ in left], [named[p] for p, _ in right]))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.int64(), marks, marks]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                         ["key", "i", "n", "tokens", "left_marks", "right_marks"])


def _spliced(parts: DataFrame) -> DataFrame:
    """key, n_tokens, aligned from the chunks' reports."""
    w = Window.partitionBy("key").orderBy("i")
    ats = lambda c: F.transform(c, lambda m: m["at"])
    before = lambda c, at: F.get(F.filter(c, lambda m: m["at"] == at), F.lit(0))["before"]
    s = parts.withColumn("at", F.when(F.col("i") < F.col("n") - 1, F.try_element_at(
        F.array_intersect(ats(F.col("right_marks")), ats(F.lead("left_marks").over(w))), F.lit(1))))
    s = s.withColumn("from_at", F.lag("at").over(w))
    first = F.when(F.col("i") == 0, 0).otherwise(before(F.col("left_marks"), F.col("from_at")))
    last = F.when(F.col("i") == F.col("n") - 1, F.col("tokens")).otherwise(
        before(F.col("right_marks"), F.col("at")))
    return s.groupBy("key").agg(F.sum(last - first).alias("n_tokens"),
                                F.every((F.col("i") == F.col("n") - 1) | F.col("at").isNotNull()).alias("aligned"))


def long_counts(texts: DataFrame, path: str, chunk_bytes: int, overlap: int) -> DataFrame:
    """key, n_tokens for distinct long texts (key, text)."""
    done, left = None, texts
    while True:
        pieces = left.mapInArrow(lambda b, c=chunk_bytes, o=overlap: _chunks(b, c, o),
                                 "key binary, i int, n int, start long, piece binary")
        marks = "array<struct<at:string,before:long>>"
        parts = pieces.repartition("key", "i").mapInArrow(
            lambda b, o=overlap: _encode(b, path, o),
            f"key binary, i int, n int, tokens long, left_marks {marks}, right_marks {marks}")
        result = stored(_spliced(parts), "token-splices")
        good = result.where("aligned").select("key", "n_tokens")
        done = good if done is None else done.unionByName(good)
        bad = result.where(~F.col("aligned")).select("key")
        if bad.isEmpty():
            return done
        chunk_bytes, overlap = chunk_bytes * WIDEN, overlap * WIDEN
        left = texts.join(bad, "key", "left_semi")


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, chunk_bytes: int = CHUNK_BYTES,
                 overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    if chunk_bytes < 2 * overlap:
        raise ValueError("chunks must be at least two overlaps long")
    prepare(docs.sparkSession)
    rows = own_columns(docs, "doc_id", "text").withColumn(
        "n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    short = rows.where(F.col("n_bytes") <= chunk_bytes).mapInArrow(
        lambda b: _short(b, path), f"doc_id {id_type}, n_bytes long, n_tokens long")
    long = rows.where(F.col("n_bytes") > chunk_bytes).withColumn("key", F.unhex(F.sha2("text", 256)))
    texts = long.groupBy("key").agg(F.first("text").alias("text"))
    counted = long_counts(texts, path, chunk_bytes, overlap)
    long = long.select("doc_id", "n_bytes", "key").join(counted, "key").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)
