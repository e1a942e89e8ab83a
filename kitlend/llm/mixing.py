"""Mixing sources to target weights by capped water-filling (operator 4).

The mix is as large as the corpus. Each source wants a share in proportion to
its weight; a source stops at ``max_epochs`` times its own size, and the excess
goes to the others by weight until none is above its cap. One level of water
fits all: target = min(cap, level * weight). Each round clamps the sources that
the level overflows and lets the level of the others rise; a round needs three
sums over the table of sources, so nothing but sums reaches the driver.

A source with target t and size s is repeated floor(t / s) times whole, and a
seeded part of its documents once more. The part is drawn by size class, large
documents first: in each class the hash order of the documents (in
``BUCKETS`` buckets) is cut where the words taken so far come nearest to the
part due, and what a class misses is made up by the next smaller one. Only the
histogram (source, class, bucket) is gathered, at most 64 * BUCKETS rows for a
source whatever its size, summed before the shuffle; no window runs over a
source's documents.

Null text: size 0. Null source: a source of its own, last in order. Empty
documents are taken as often as their source is repeated whole. Rows that
repeat (same doc_id) draw alike. An empty table gives an empty mix.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kitlend.llm.common import own_columns, prepare, stored

#: Buckets of the seeded hash order within a size class.
BUCKETS = 256
#: Sources by code point, null last, weigh 1, 2, 3, repeating.
WEIGHTS = 3
MAX_EPOCHS = 3
SEED = "mix-1"

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """floor(log2(size)), from the length of the binary form; -1 for size 0."""
    return F.when(size == 0, F.lit(-1)).otherwise(F.length(F.bin(size)) - 1).cast("int")


def bucket_of(doc_id: Column, seed: str = SEED) -> Column:
    """Bucket of a document in the seeded order."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 7), 16, 10).cast("int") % BUCKETS).cast("int")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """One row a source: source, source_size, rank from 1 by code point, null last.

    The rank is counted by range partitions of the source table, each at its
    running offset, so that many sources need no single task.
    """
    per = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    order = [F.col("source").isNull(), F.col("source")]
    parted = stored(per.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("part", F.spark_partition_id()), "mix-ranked")
    counts = parted.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return (parted.join(counts.select("part", before.alias("off")), "part")
            .select("source", "source_size", (F.col("off") + inside).alias("rank")))


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): capped water-filling."""
    cap = F.col("source_size") * max_epochs
    state = stored(sources.withColumn("clamped", F.lit(False)), "mix-level")
    total = state.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s")).first()["s"]
    while True:
        free = state.agg(
            F.coalesce(F.sum(F.when(~F.col("clamped"), F.col("weight"))), F.lit(0)).alias("w"),
            F.coalesce(F.sum(F.when(F.col("clamped"), cap)), F.lit(0)).alias("c")).first()
        rest, weight = int(total) - int(free["c"]), int(free["w"])
        # weight * rest / free weight > cap, in whole numbers
        wide = "decimal(38,0)"
        above = (~F.col("clamped") & (F.col("weight").cast(wide) * F.lit(rest).cast("decimal(20,0)")
                                      > cap.cast(wide) * F.lit(weight).cast("decimal(12,0)")))
        if not weight or state.where(above).isEmpty():
            break
        state = stored(state.withColumn("clamped", F.col("clamped") | above), "mix-level")
    target = F.when(F.col("clamped") | F.lit(weight == 0), cap.cast("double")).otherwise(
        F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(max(weight, 1))))
    return state.withColumn("target", target).drop("clamped")


def cuts(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one source's histogram, the buckets of each size class that are taken
    once more: those below ``cut``."""
    size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    whole = int(target // max(size, 1))
    due_all, taken, seen, out = math.floor(target + 0.5) - whole * size, 0, 0, []
    for cls, rows in sorted(pdf.groupby("cls"), reverse=True):
        seen += int(rows["words"].sum())
        due = due_all * seen // max(size, 1) - taken
        cut, got, best = 0, 0, 0
        for b, w in sorted(zip(rows["bucket"], rows["words"], strict=True)):
            got += int(w)
            if abs(got - due) < abs(best - due):
                cut, best = int(b) + 1, got
        taken += best
        out.append((pdf["source"].iloc[0], int(cls), cut, whole))
    return pd.DataFrame(out, columns=["source", "cls", "cut", "whole"])


def _placed(docs: DataFrame, seed: str) -> DataFrame:
    """Adds size, bucket and cls of each row."""
    rows = docs.withColumns({"_size": size_of(F.col("text")), "_bucket": bucket_of(F.col("doc_id"), seed)})
    return rows.withColumn("_cls", size_class(F.col("_size")))


def mix_plan(rows: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """of, of_cls, cut, whole, source_size, target: how a source's size class is
    taken, from (source, _size, _bucket, _cls)."""
    ranked = ranked_sources(rows.select("source", F.col("_size").alias("size")))
    weighed = ranked.select("source", "source_size",
                            ((F.col("rank") - 1) % WEIGHTS + 1).cast("long").alias("weight"))
    t = stored(water_fill(weighed, max_epochs).select(F.col("source").alias("src"), "source_size", "target"),
               "mix-targets")
    histogram = rows.groupBy("source", F.col("_cls").alias("cls"), F.col("_bucket").alias("bucket")).agg(
        F.sum("_size").alias("words"))
    cut = stored(histogram.join(t, F.col("source").eqNullSafe(F.col("src"))).drop("src")
                 .groupBy("source").applyInPandas(cuts, "source string, cls int, cut int, whole int"),
                 "mix-cuts")
    plan = cut.select(F.col("source").alias("of"), F.col("cls").alias("of_cls"), "cut", "whole")
    return stored(plan.join(t, F.col("of").eqNullSafe(F.col("src"))).drop("src"), "mix-plan")


def _copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds the plan and ``_copies`` to rows."""
    p = plan.select(*[F.col(c).alias(f"_{c}") for c in plan.columns])
    once_more = (F.col("_bucket") < F.col("_cut")) & (F.col("_size") > 0)
    return (rows.join(p, F.col("source").eqNullSafe(F.col("_of")) & (F.col("_cls") == F.col("_of_cls")))
            .withColumn("_copies", (F.col("_whole") + F.when(once_more, 1).otherwise(0)).cast("int")))


def mix_sources(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every document.

    ``copies`` is how often the mix takes the document (0 to ``max_epochs``).
    """
    prepare(docs.sparkSession)
    rows = stored(_placed(own_columns(docs, "doc_id", "text", "source"), seed).drop("text"), "mix-sizes")
    return _copies(rows, mix_plan(rows, max_epochs)).select(
        "doc_id", "source", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), F.col("_copies").alias("copies"))


def mixed_documents(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: each document's row as often as it is taken."""
    prepare(docs.sparkSession)
    sizes = stored(_placed(own_columns(docs, "doc_id", "text", "source"), seed).drop("text"), "mix-sizes")
    taken = _copies(_placed(docs, seed), mix_plan(sizes, max_epochs)).where(F.col("_copies") > 0)
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns],
                        F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).drop("_copy")
