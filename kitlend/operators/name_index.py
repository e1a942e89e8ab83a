"""An index of item names for substring search.

Every name, in small letters, is cut into its runs of one, two, three and six
characters; a posting says that an item's name holds a run. Postings are stored by
the bucket of their run and sorted by it, so that a search reads only the buckets,
and in these the row groups, of the term's runs. A term is looked up by its runs of the
largest size that it has; candidates are verified by ``contains``, so the results are
those of a scan. Runs of six keep the candidates of many long terms, as of numbers,
near their hits: a run of three is in a fixed share of all names. A change of items
replaces their postings by a new index over the changed table.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZES = (1, 2, 3, 6)
BUCKETS = 64


def _runs(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text."""
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(size)))))


def _bucket(run: Column) -> Column:
    return F.crc32(run.cast("binary")).cast("long") % BUCKETS


def _postings(items: DataFrame) -> DataFrame:
    """id, run of the names, each run once a name: where it is first. The names are dealt
    out before, since few files hold many of them."""
    name = F.lower("item_name")
    places = (items.select("id", name.alias("_name")).where(F.length("_name") > 0).repartition("id", "_name")
              .select("id", "_name", F.explode(F.sequence(F.lit(1), F.length("_name"))).alias("_at")))
    runs = F.array(*[F.when(F.col("_at") <= F.length("_name") - k + 1, F.substr("_name", "_at", F.lit(k))) for k in SIZES])
    return places.select("id", "_name", "_at", F.explode(runs).alias("run")).where(
        F.position("run", "_name") == F.col("_at")).select("id", "run")


def build_name_index(items: DataFrame, path: str) -> None:
    """Write the postings of ``items`` (id, item_name); names that are NULL have none."""
    postings = _postings(items).withColumn("bucket", _bucket(F.col("run")).cast("int"))
    (postings.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "run", "id")
     .write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path))


def runs_of(term: str) -> list[str]:
    """The runs by which a term (small, without blanks at its ends) is looked up."""
    size = max(k for k in SIZES if k <= max(len(term), 1))
    return sorted({term[i:i + size] for i in range(len(term) - size + 1)})


def hit_postings(spark: SparkSession, path: str, term: str) -> DataFrame:
    """id, run of the postings of a term's runs."""
    runs = runs_of(term)
    buckets = sorted({zlib.crc32(r.encode()) % BUCKETS for r in runs})
    return spark.read.parquet(path).where(F.col("bucket").isin(buckets) & F.col("run").isin(runs)).select("id", "run")


def search_names(items: DataFrame, path: str, term: str) -> DataFrame:
    """The rows of ``items`` whose name contains the term, case folded; an empty
    term finds all of them that have a name."""
    asked = term.strip().lower()
    found = items.where(F.lower(F.col("item_name")).contains(asked))
    if not asked:
        return found
    hits = hit_postings(items.sparkSession, path, asked).groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    return found.join(hits.where(F.col("_n") == len(runs_of(asked))), F.col("id") == F.col("_id"), "left_semi")


def search_terms(items: DataFrame, path: str, terms: DataFrame) -> DataFrame:
    """Many searches at once: ``term`` of the terms with each ``id``, ``item_name`` that
    contains it. Candidates come from a term's rarest run alone. Empty and NULL terms
    find nothing."""
    asked = F.lower(F.trim("term"))
    distinct = terms.select("term", asked.alias("_asked")).where(F.length("_asked") > 0).distinct()
    size = F.array_max(F.filter(F.array(*[F.lit(k) for k in SIZES]), lambda k: k <= F.length(asked)))
    used = [r[0] for r in terms.where(F.length(asked) > 0).select(size).distinct().collect()]  # at most one of each of SIZES
    runs_by_size = F.coalesce(*[F.when(F.length("_asked") >= k, _runs(F.col("_asked"), k)) for k in reversed(SIZES)])
    runs = distinct.select("term", "_asked", F.explode(runs_by_size).alias("_run"))
    postings = items.sparkSession.read.parquet(path).where(F.length("run").isin(used))
    # files are in the order of runs, so that a task's counts are few and no posting moves
    sizes = postings.groupBy(F.col("run").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    rarest = (runs.join(sizes, F.col("_run") == F.col("_of"), "left").groupBy("term", "_asked")
              .agg(F.min_by("_run", F.struct(F.coalesce("_n", F.lit(0)), F.col("_run"))).alias("_run")))
    near = rarest.join(postings.select(F.col("run").alias("_of"), F.col("id").alias("_id")), F.col("_run") == F.col("_of"))
    return (near.join(items.select("id", "item_name"), F.col("id") == F.col("_id"))
            .where(F.lower(F.col("item_name")).contains(F.col("_asked"))).select("term", "id", "item_name"))
