"""Loans and returns stored by buckets of the loan id.

Both tables are cut by the same hash of the loan id into the same number of
buckets, one sorted file a bucket (and loan state), and registered in the session's
catalog. The sum of returns per loan and its join to the loans then read bucket by
bucket, without an exchange, however large the tables are; open-loan jobs still read
the open loans alone. Loans and returns are the two tables that grow; the others stay
as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kitlend.sources.fixtures import Lending

#: Each bucketed table's column of the loan id.
KEYS = {"transactions": "id", "transaction_returns": "transaction_id"}
#: Rows that a bucket of the larger table should hold, and the least buckets.
BUCKET_ROWS, LEAST_BUCKETS = 100_000, 8


def buckets_for(l: Lending) -> int:
    """So many buckets that those of neither table hold many more than BUCKET_ROWS rows,
    however large the tables are; no more than the session allows."""
    spark = l.transactions.sparkSession
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    rows = max(getattr(l, name).count() for name in KEYS)
    return min(most, max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS)))


def write_bucketed(l: Lending, prefix: str, path: str, buckets: int) -> None:
    """Save both tables as ``<prefix>_<name>`` under ``path``. A bucket should hold about
    as much as a task handles (``buckets_for``); the number can't differ between the two."""
    for name, key in KEYS.items():
        df: DataFrame = getattr(l, name)
        state = []
        if name == "transactions":
            df, state = df.withColumn("loan_state", F.when(F.col("return_date").isNull(), "open").otherwise("closed")), ["loan_state"]
        writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
        if state:
            writer = writer.partitionBy(*state)
        writer.option("path", f"{path}/{name}").saveAsTable(f"{prefix}_{name}")


def read_bucketed(spark: SparkSession, prefix: str, rest: Lending) -> Lending:
    """A ``Lending`` whose loans and returns are the bucketed ones."""
    def loans() -> DataFrame:
        return spark.table(f"{prefix}_transactions")
    tables = {n: (lambda n=n: getattr(rest, n)) for n in Lending.NAMES if n not in KEYS}
    return Lending(**tables, transactions=lambda: loans().drop("loan_state"),
                   transaction_returns=lambda: spark.table(f"{prefix}_transaction_returns"),
                   open_transactions=lambda: loans().where(F.col("loan_state") == "open").drop("loan_state"))
