"""BPE encoding and decoding with content-defined chunk reuse (operator 3).

1. Texts are cut where a rolling (gear) hash of the last 32 bytes ends in
   ``CUT_BITS`` zero bits, so equal passages are cut alike wherever they stand.
   Only (text key, start, length, 128-bit chunk hash) leave the scan.
2. A chunk that stands at two places of the corpus' distinct texts is shared.
   One place is its owner; the owner's text is sliced there and each shared
   chunk is encoded once.
3. The ids travel to every place of the chunk, are gathered by text and joined
   there: what lies between shared chunks is encoded in place, and every join
   is repaired. A join that falls inside a word is re-encoded over a window
   that starts and ends at white space; the ids that the pieces hold for the
   window must agree with the library's ids of the two halves, else the window
   grows a word further, until they agree or both pieces are one.
4. Ids are decoded by the library and both sides are hashed.

Texts travel once through one shuffle, compressed; equal texts are one row of
it. Null text counts as empty. Repeated rows each give a row; other columns are
ignored; an empty table gives no rows. A text's rows of shared places are
bounded by its length. Only vocabularies that drop white space are taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kitlend.llm.common import blocks, mix, own_columns, prepare, stored, text_buffers
from kitlend.llm.encoder import Encoder, encoder

CUT_BITS = 10
MIN_CHUNK = 256
MAX_CHUNK = 1 << 14

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _gear(data: np.ndarray) -> np.ndarray:
    """sum of gear[data[i - k]] << k over the 32 bytes that end at i."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        g = h.copy()
        g[k:] += h[:-k] << np.uint32(k)
        h = g
    return h


def cut_points(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Chunk ends of each row, as offsets in the row."""
    marks = np.flatnonzero((_gear(data) & np.uint32((1 << CUT_BITS) - 1)) == 0) + 1
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        ends, start = [], int(a)
        for m in [*marks[np.searchsorted(marks, a):np.searchsorted(marks, b)].tolist(), int(b)]:
            while m - start > MAX_CHUNK:  # no mark for long
                start = _edge(data, start + MAX_CHUNK, int(b))
                ends.append(start - int(a))
            if m - start >= MIN_CHUNK and m < b:
                m = _edge(data, m, int(b))
                if m < b:
                    ends.append(m - int(a))
                    start = m
        if b > a:
            ends.append(int(b - a))
        out.append(ends)
    return out


def _edge(data: np.ndarray, p: int, end: int) -> int:
    """The next position that starts a character."""
    while p < end and data[p] & 0xC0 == 0x80:
        p += 1
    return p


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, start, length, hash of every chunk."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for a, b in blocks(offsets):
            lo = offsets[a]
            part, off = data[lo:offsets[b]], offsets[a:b + 1] - lo
            keys, starts, lengths, hashes = [], [], [], []
            raw = part.tobytes()
            for row, ends in enumerate(cut_points(part, off)):
                key, at = batch.column(0)[a + row].as_py(), int(off[row])
                for s, e in zip([0, *ends], ends, strict=False):
                    keys.append(key)
                    starts.append(s)
                    lengths.append(e - s)
                    hashes.append(hashlib.blake2b(raw[at + s:at + e], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32()),
                 pa.array(hashes, pa.binary())], ["key", "start", "length", "hash"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and the text as zstd frames; the length goes along for the reader."""
    codec = pa.Codec("zstd", compression_level=1)
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        for a in range(0, len(texts), 512):
            part = texts[a:a + 512]
            raw = [v.as_buffer() if v.is_valid else pa.py_buffer(b"") for v in part]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[a:a + 512].cast(pa.binary()),
                 pa.array([codec.compress(r, asbytes=True) if r.size else b"" for r in raw], pa.binary()),
                 pa.array([r.size for r in raw], pa.int64())], ["key", "frame", "size"])


def _unpacked(frame: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(frame, size, asbytes=True) if size else b""


def _owned(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """hash and ids of the shared chunks that a text owns."""
    enc = encoder(path)
    for batch in batches:
        hashes, ids = [], []
        for frame, size, own in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            text = _unpacked(frame.as_py(), size.as_py())
            for c in own.as_py():
                hashes.append(c["hash"])
                ids.append(enc.packed(text[c["start"]:c["start"] + c["length"]]))
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(ids, pa.binary())],
                                         ["hash", "ids"])
    enc.memo.clear()  # the worker lives on, for other stages


_SPACES = frozenset(b" \t\n\r\v\f")


def _word(text: bytes, p: int, lo: int, hi: int) -> tuple[int, int]:
    """The run without white space around byte p, within [lo, hi)."""
    s = e = p
    while s > lo and text[s - 1] not in _SPACES:
        s -= 1
    while e < hi and text[e] not in _SPACES:
        e += 1
    return s, e


def join_pieces(enc: Encoder, text: bytes, pieces: list[tuple[int, int, bytes]]) -> bytes:
    """Ids of the whole text from (start, end, ids) of pieces that cover it.

    ``done`` holds the ids of text[begin:s], where begin is a proven boundary.
    """
    out, begin, done = [], 0, b""
    for s, e, ids in pieces:
        if s == 0 or text[s - 1] in _SPACES or text[s] in _SPACES:
            out.append(done)
            begin, done = s, ids
            continue
        lo, hi = _word(text, s, begin, e)
        while True:
            left, right = enc.packed(text[lo:s]), enc.packed(text[s:hi])
            if done.endswith(left) and ids.startswith(right):
                done = done[:len(done) - len(left)] + enc.packed(text[lo:hi]) + ids[len(right):]
                break
            if lo == begin and hi == e:
                done = enc.packed(text[begin:e])
                break
            lo = _word(text, lo - 1, begin, e)[0] if lo > begin else lo
            hi = _word(text, hi + 1, begin, e)[1] if hi + 1 < e else e
    return b"".join([*out, done])


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """key, n_tokens and hashes of each text from its frame and shared pieces."""
    enc = encoder(path)
    number = [str(i) for i in range(enc.lib.get_vocab_size())]
    for batch in batches:
        rows = []
        for key, frame, size, shared in zip(*(batch.column(i) for i in range(4)), strict=True):
            text = _unpacked(frame.as_py(), size.as_py())
            pieces, at = [], 0
            for c in sorted(shared.as_py() or [], key=lambda c: c["start"]):
                if c["start"] > at:
                    pieces.append((at, c["start"], enc.packed(text[at:c["start"]])))
                at = c["start"] + c["length"]
                pieces.append((c["start"], at, c["ids"]))
            if at < len(text):
                pieces.append((at, len(text), enc.packed(text[at:])))
            ids = np.frombuffer(join_pieces(enc, text, pieces), enc.kind).tolist()
            said = " ".join([number[i] for i in ids])
            back = enc.lib.decode(ids, skip_special_tokens=False)
            rows.append((key.as_py(), len(ids), hashlib.sha256(said.encode()).hexdigest(),
                         hashlib.sha256(back.encode()).hexdigest(), len(pieces)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = [pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                         ["key", "n_tokens", "ids_sha256", "decoded_sha256", "n_pieces"])
    enc.memo.clear()


def encoded_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, and
    n_pieces: the pieces that its ids were joined from."""
    prepare(docs.sparkSession)
    rows = own_columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn(
        "key", F.unhex(F.md5("text")))
    if not encoder(path).drops_space:
        raise ValueError("joins are proven only for vocabularies that drop white space")
    places = stored(rows.select("key", "text").mapInArrow(
        _places, "key binary, start int, length int, hash binary")
        .groupBy("key", "start").agg(F.first("length").alias("length"), F.first("hash").alias("hash")),
        "bpe-places")
    place = F.struct("key", "start", "length")
    shared = stored(places.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                    .where(F.col("first") != F.col("last")).select("hash", F.col("first").alias("own")),
                    "bpe-shared")
    owned = shared.groupBy(F.col("own.key").alias("of")).agg(F.collect_list(F.struct(
        F.col("own.start").alias("start"), F.col("own.length").alias("length"), "hash")).alias("own"))
    texts = (rows.select("key", "text").mapInArrow(_packed, "key binary, frame binary, size long")
             .groupBy("key").agg(F.first("frame").alias("frame"), F.first("size").alias("size"))
             .where(F.col("key").isNotNull()))  # as inner joins ask: both uses then share one exchange
    ids = (texts.join(owned, F.col("key") == F.col("of")).select("frame", "size", "own")
           .mapInArrow(lambda b: _owned(b, path), "hash binary, ids binary").withColumnRenamed("hash", "of_hash"))
    again = (places.join(ids, F.col("hash") == F.col("of_hash"))
             .groupBy(F.col("key").alias("at_key"))
             .agg(F.collect_list(F.struct("start", "length", "ids")).alias("shared")))
    coded = (texts.join(again, F.col("key") == F.col("at_key"), "left").select("key", "frame", "size", "shared")
             .mapInArrow(lambda b: _digests(b, path),
                         "key binary, n_tokens long, ids_sha256 string, decoded_sha256 string, n_pieces int"))
    return rows.select("doc_id", F.col("key").alias("of")).join(coded, F.col("of") == F.col("key")).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_pieces")
