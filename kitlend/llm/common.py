"""Helpers shared by the operators: tables written in the cluster's shared
folder, and word and hash arrays taken straight from Arrow text buffers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kitlend.session import ensure_checkpoint_dir, ship_package

#: Bytes of text hashed at once; bounds the arrays that stand for single bytes.
PIECE = 1 << 20
#: Bytes of text of the documents handled together by an Arrow batch function.
BLOCK = 1 << 20
#: Rows of a file of a table whose rows are known beforehand, and the files it may have anyway.
FILE_ROWS, LEAST_FILES = 20_000, 8


def prepare(spark: SparkSession) -> None:
    """Make the shared folder and this package known to the session."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def in_files(df: DataFrame, rows: int, each: int = FILE_ROWS) -> DataFrame:
    """``df``, whose last step handles ``rows`` rows at most, in no more partitions than
    these fill, ``each`` rows a partition: a shuffle dealt out to more would write a file
    of next to nothing for each. Never in more partitions than the shuffle has."""
    return df.coalesce(max(LEAST_FILES, -(-rows // each)))


def stored(df: DataFrame, name: str, rows: int | None = None, each: int = FILE_ROWS) -> DataFrame:
    """``df`` written as a table in the shared folder and read back, in files as
    ``in_files`` says if its rows are known.

    Cuts the lineage, survives lost executors, and gives later plans the
    table's true size, so that a join broadcasts it only under Spark's own
    size limit.
    """
    path = new_folder(df.sparkSession, name)
    df = df if rows is None else in_files(df, rows, each)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Shelf:
    """Stored tables of a loop: a table kept under the name of an earlier one
    replaces it, whose folder is deleted once the new one is written. Nothing that
    is still to be computed may read the earlier one."""

    def __init__(self) -> None:
        self.paths: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        spark, path = df.sparkSession, new_folder(df.sparkSession, name)
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
        self.drop(spark, name)
        self.paths[name] = path
        return out

    def drop(self, spark: SparkSession, name: str) -> None:
        if old := self.paths.pop(name, None):
            folder = spark._jvm.org.apache.hadoop.fs.Path(old)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns under their own names alone, so that extra columns of
    the input can clash with nothing an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


# --- text in Arrow buffers ---------------------------------------------------

def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string or binary column; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string_view(column.type) or pa.types.is_binary_view(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.cast(pa.large_binary()).fill_null(b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    n = len(column)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes of text each (one row at least)."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


#: White space of the word pattern [^\x20\x09-\x0D]+ by byte.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII capitals as small letters, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse mod 2**64, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        m = max(n, PIECE + 4096)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, b in (("up", _BASE), ("down", inverse)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs without white space within a row)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SPACE[data]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = word[:-1]
    before[edge] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[edge - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans (in order, not overlapping): equal bytes
    give equal hashes. Spans are taken in pieces of about PIECE bytes."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        lo = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, lo + PIECE, "right")))
        hi = ends[b - 1]
        up, down = _powers(int(hi - lo) + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[:hi - lo], out=sums[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        a = b
    return mix(out)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes (len(words) - n + 1)."""
    m = max(0, len(words) - n + 1)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = (h + words[k:k + m]) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h)
