"""Writing change jobs back to the stored tables (S4 to S7), copy-on-write.

A batch of changes replaces only the partitions that hold a changed row, before or
after the change: their other rows are copied, all other partitions keep their
files. A batch has an id and two steps. The first freezes the changes and the new
content of those partitions under ``_changes/<table>/<batch>``; the second overwrites the
partitions from there and removes those left empty. A batch that is run again, or
whose run broke off in either step, ends in the same table: a finished one changes
nothing, a frozen one is only applied. Tables without partitions are one partition.

Batches of one table run one after the other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kitlend import schema as S
from kitlend.operators import snapshots
from kitlend.sources.tables import PARTITIONS, as_stored, placed, read_lending, stored_schema

#: Partitions up to which the copied ones are named in the scan's filter; beyond,
#: they are joined.
MOST_NAMED = 500


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _done(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(stored_schema(name)).parquet(path)


def _named(parts: list[str], rows: list) -> Column:
    """The rows' partitions as a filter that prunes the scan."""
    return reduce(lambda a, b: a | b, [
        reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(r[c])) for c in parts]) for r in rows], F.lit(False))


def _freeze(spark: SparkSession, path: str, name: str, changes: DataFrame, stage: str) -> None:
    parts = PARTITIONS.get(name, [])
    flat = as_stored(changes, name).columns
    changes.select(*[F.col(c).cast(S.STORED[name][c].dataType).alias(c) for c in flat], "deleted").write.mode(
        "overwrite").parquet(f"{stage}/changes")
    frozen = spark.read.parquet(f"{stage}/changes")
    ids = frozen.select(F.col("id").alias("_id"))
    new = placed(frozen.where(~F.col("deleted")).select(*flat), name)
    table = _table(spark, f"{path}/{name}", name)
    same = F.col("id") == F.col("_id")
    if not parts:
        table.join(ids, same, "left_anti").unionByName(new).write.mode("overwrite").parquet(f"{stage}/rows")
        spark.range(1).write.mode("overwrite").parquet(f"{stage}/touched")
        return
    touched = table.select("id", *parts).join(ids, same, "left_semi").select(*parts).unionByName(
        new.select(*parts)).distinct().checkpoint(eager=True)
    few = touched.limit(MOST_NAMED + 1).collect()
    if len(few) <= MOST_NAMED:
        copied = table.where(_named(parts, few))
    else:
        keys = touched.select(*[F.col(c).alias(f"_{c}") for c in parts])
        copied = table.join(keys, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in parts]), "left_semi")
    rows = copied.join(ids, same, "left_anti").unionByName(new)
    rows.hint("rebalance", *[F.col(c) for c in parts]).write.mode("overwrite").partitionBy(*parts).parquet(f"{stage}/rows")
    touched.write.mode("overwrite").parquet(f"{stage}/touched")


def _apply(spark: SparkSession, path: str, name: str, stage: str) -> None:
    parts, out = PARTITIONS.get(name, []), f"{path}/{name}"
    rows = _table(spark, f"{stage}/rows", name)
    if not parts:
        rows.write.mode("overwrite").parquet(out)
        return
    (rows.hint("rebalance", *[F.col(c) for c in parts]).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(out))
    there = rows.select(*[F.col(c).alias(f"_{c}") for c in parts]).distinct()
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in parts])
    for r in spark.read.parquet(f"{stage}/touched").join(there, match, "left_anti").toLocalIterator():  # folders, not rows
        fs, p = _folder(spark, "/".join([out, *[f"{c}={'__HIVE_DEFAULT_PARTITION__' if r[c] is None else r[c]}" for c in parts]]))
        fs.delete(p, True)


def write_back(spark: SparkSession, path: str, name: str, changes: DataFrame, batch: str) -> bool:
    """Apply ``changes`` (the table's columns and ``deleted``) to the stored table;
    rows are told by id. False if the batch was applied before."""
    stage = f"{path}/_changes/{name}/{batch}"
    if _done(spark, f"{stage}/applied"):
        return False
    if not _done(spark, f"{stage}/touched"):  # written last
        _freeze(spark, path, name, changes, stage)
    _apply(spark, path, name, stage)
    spark.createDataFrame([], T.StructType([T.StructField("batch", T.StringType())])).write.mode("overwrite").parquet(f"{stage}/applied")
    return True


def changed(after: DataFrame) -> DataFrame:
    """The rows that a snapshot job changed."""
    return after.where("changed").drop("changed").withColumn("deleted", F.lit(False))


def gone(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows that a snapshot job left out."""
    left = after.select(F.col("id").alias("_id"))
    return before.join(left, F.col("id") == F.col("_id"), "left_anti").withColumn("deleted", F.lit(True))


def apply_promises(spark: SparkSession, path: str, requests: DataFrame, batch: str) -> bool:
    """R6 on stored loans."""
    return write_back(spark, path, "transactions", changed(snapshots.loans_after_promises(read_lending(spark, path), requests)),
                      batch)


def apply_closures(spark: SparkSession, path: str, settled: DataFrame, batch: str) -> bool:
    """R3 on stored loans: those that a settled batch of returns closes."""
    return write_back(spark, path, "transactions", changed(snapshots.loans_after_settlement(read_lending(spark, path), settled)),
                      batch)


def apply_user_deletes(spark: SparkSession, path: str, requests: DataFrame, batch: str) -> bool:
    """S6 on stored tables: members who may go, their notifications and holds; the
    members last, so that a run that broke off finds them again."""
    l = read_lending(spark, path)
    after = snapshots.after_user_deletes(l, requests)
    done = [write_back(spark, path, name, gone(getattr(l, name), after[name]), batch)
            for name in ("notifications", "user_holds", "users")]
    return any(done)


def apply_item_deletes(spark: SparkSession, path: str, requests: DataFrame, at, batch: str) -> bool:
    """S7 on the stored items: deleted ones go, archived ones change."""
    l = read_lending(spark, path)
    after = snapshots.inventory_after_deletes(l, requests, at).checkpoint(eager=True)
    return write_back(spark, path, "inventory", changed(after).unionByName(gone(l.inventory, after.drop("changed"))), batch)
