"""Line de-duplication across documents by keep bitmaps (operator 13).

A line's key is the line without ASCII white space at both ends, with small
ASCII letters; keys of fewer than ``MIN_CHARS`` code points are left alone. All
work is DataFrame functions:

1. Every line with a key gives a row of its key's hash (the first 128 bits of
   SHA-256), its document and its position; texts stay behind.
2. The rows are range-partitioned by hash and document and sorted by hash,
   document and position. A stream over that order marks the first occurrence of a
   hash in each document; a hash that fills many documents runs on through several
   partitions, so none has to hold it whole. Marks are added by hash, partly
   before their shuffle.
3. Hashes in ``MIN_DOCS`` documents or more mark their lines as dropped, all of
   them or, with ``keep_first``, all but the first one in the order of documents.
4. The answer is a keep bitmap a document, compressed: the runs of cleared bits
   as (start, stop) line numbers. ``without_common_lines`` applies it to the texts.

Defined results: a null or empty text is one empty line; documents that lose no
line have no bitmap; rows are documents each, also with equal doc_id and text (a
line found in ten equal rows is dropped from all), and with ``keep_first`` equal rows
keep the same lines. Null doc_ids come first. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kitlend.llm.common import own_columns, prepare, stored

MIN_DOCS, MIN_CHARS = 10, 1

#: The white space of a key's ends, capitals and small letters.
_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_BLANK)), _UPPER, _LOWER)


def _digest(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, text, doc: a digest that names the row's doc_id and text."""
    name = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("null"))
    rows = own_columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("doc", _digest(F.concat(name, F.lit("\n"), F.col("text"))))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """hash, doc_id, doc, row (a number of the row alone), pos of every line with a key."""
    key = key_of(F.col("line"))
    return (_named(docs).withColumn("row", F.monotonically_increasing_id())
            .select("doc_id", "doc", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
            .withColumn("key", key).where(F.length("key") >= min_chars)
            .select(_digest(F.col("key")).alias("hash"), "doc_id", "doc", "row", "pos"))


def common_hashes(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """hash, docs, first (its first line by document and position) of the hashes
    that at least ``min_docs`` documents hold."""
    parted = lines.repartitionByRange("hash", "doc_id", "row").sortWithinPartitions("hash", "doc_id", "row", "pos")
    inside = Window.partitionBy("hash", "doc_id", "row").orderBy("pos")
    firsts = parted.withColumn("nth", F.row_number().over(inside)).where(F.col("nth") == 1)
    return (firsts.groupBy("hash").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("doc_id", "doc", "pos")).alias("first"))
            .where(F.col("docs") >= min_docs))


def _runs(positions: Column) -> Column:
    """The runs of consecutive numbers of an ascending array as (start, stop)."""
    starts = F.filter(positions, lambda x, i: ~F.get(positions, i - 1).eqNullSafe(x - 1))
    stops = F.filter(positions, lambda x, i: ~F.get(positions, i + 1).eqNullSafe(x + 1))
    return F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("stop")))


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                 keep_first: bool = False) -> DataFrame:
    """doc (the digest of doc_id and text), drop_runs: the keep bitmap of each
    document that loses lines, as the runs of its cleared bits."""
    prepare(docs.sparkSession)
    lines = stored(line_hashes(docs, min_chars), "lines")
    common = stored(common_hashes(lines, min_docs), "lines-common").withColumnRenamed("hash", "of")
    hits = lines.join(common, F.col("hash") == F.col("of"))
    if keep_first:
        hits = hits.where((F.col("doc") != F.col("first.doc")) | (F.col("pos") != F.col("first.pos")))
    cleared = hits.groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias("positions"))
    return cleared.select("doc", _runs(F.col("positions")).alias("drop_runs"))


def without_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                         keep_first: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (the kept lines), a row for each of docs."""
    bitmaps = stored(keep_bitmaps(docs, min_docs, min_chars, keep_first), "lines-bitmaps").withColumnRenamed("doc", "of")
    runs, lines, n = F.col("drop_runs"), F.col("lines"), F.col("n_lines")

    def kept(i: Column) -> Column:
        """The lines between dropped run i - 1 and dropped run i."""
        start = F.coalesce(F.get(runs, i - 1)["stop"], F.lit(0))
        return F.slice(lines, start + 1, F.coalesce(F.get(runs, i)["start"], n) - start)
    parts = F.transform(F.sequence(F.lit(0), F.size(runs)), kept)
    dropped = F.aggregate(runs, F.lit(0).cast("long"), lambda s, r: s + (r["stop"] - r["start"]))
    return (_named(docs).join(bitmaps, F.col("doc") == F.col("of"), "left")
            .withColumn("lines", F.split("text", "\n")).withColumn("n_lines", F.size("lines"))
            .select("doc_id", n.cast("long").alias("n_lines"), F.coalesce(dropped, F.lit(0)).cast("long").alias("n_dropped"),
                    F.when(runs.isNull(), F.col("text")).otherwise(F.array_join(F.flatten(parts), "\n")).alias("text")))


def cleaned_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    return without_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
