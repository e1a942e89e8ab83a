"""Stored lending tables: read with the declared schemas, write with a layout
that lets the jobs prune, and append new rows with generated ids (S1, S3).

Layout: loans are partitioned by ``loan_state`` (open/closed) and borrow month, so the many
jobs that read only open loans skip the closed history; notifications are
partitioned by ``created_date``, so a daily run reads one day for the daily
uniqueness rule. Writes are rebalanced on the partition columns, so a day is a
few files and a large day several. Ids are stored as text. Reads pass the
declared schema and infer nothing; a column missing from some files comes back
NULL for those files alone, which is how the reference's ``ADD COLUMN IF NOT
EXISTS`` drift reads here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kitlend import schema as S
from kitlend.sources.fixtures import Lending

PARTITIONS = {
    "transactions": ["loan_state", "borrow_month"],
    "notifications": ["created_date"],
}


# Layout columns that are no fields of the table.
_LAYOUT = {"transactions": T.StructType([T.StructField("loan_state", T.StringType()),
                                         T.StructField("borrow_month", T.StringType())])}


def as_stored(df: DataFrame, name: str) -> DataFrame:
    """The table's declared columns, ids as text."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.STORED[name].fields])


def placed(df: DataFrame, name: str) -> DataFrame:
    """Adds the layout's own columns."""
    if name != "transactions":
        return df
    return (df.withColumn("loan_state", F.when(F.col("return_date").isNull(), "open").otherwise("closed"))
            .withColumn("borrow_month", F.date_format("borrow_date", "yyyy-MM")))


def stored_schema(name: str) -> T.StructType:
    """The declared columns and the layout's, all nullable."""
    fields = [*S.STORED[name].fields, *(_LAYOUT[name].fields if name in _LAYOUT else [])]
    return T.StructType([T.StructField(f.name, f.dataType) for f in fields])


def write_table(df: DataFrame, path: str, name: str, mode: str = "overwrite") -> None:
    df = placed(as_stored(df, name), name)
    parts = PARTITIONS.get(name, [])
    if not parts:
        df.write.mode(mode).parquet(f"{path}/{name}")
        return
    df.hint("rebalance", *[F.col(c) for c in parts]).write.mode(mode).partitionBy(*parts).parquet(f"{path}/{name}")


def write_lending(l: Lending, path: str, mode: str = "overwrite") -> None:
    for name in Lending.NAMES:
        write_table(getattr(l, name), path, name, mode)


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(stored_schema(name)).parquet(f"{path}/{name}")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return _read(spark, path, name).select(*S.STORED[name].fieldNames())


def read_lending(spark: SparkSession, path: str) -> Lending:
    """Stored tables as a lazy ``Lending``; open-loan jobs read only the
    ``loan_state=open`` partitions."""
    def open_loans():
        df = _read(spark, path, "transactions").where(F.col("loan_state") == "open")
        return df.select(*S.STORED["transactions"].fieldNames())
    tables = {n: (lambda n=n: read_table(spark, path, n)) for n in Lending.NAMES}
    tables["open_transactions"] = open_loans
    return Lending(**tables)


def append_with_ids(rows: DataFrame, path: str, name: str) -> None:
    """S3: append rows to a stored table, generating a UUID id where it is missing
    (at the sink only; ids never appear in a compared query)."""
    write_table(rows.withColumn("id", F.coalesce(F.col("id").cast("string"), F.expr("uuid()"))), path, name, mode="append")
