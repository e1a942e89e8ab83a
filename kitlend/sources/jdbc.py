"""Reading the lending tables from the reference's PostgreSQL database.

Ids there are UUIDs, so a numeric split is not possible; each table is read as
parallel JDBC queries over equal ranges of its indexed UUID key, by the key's
first byte, so that a query reads its range of the index. Needs the PostgreSQL
JDBC driver on the classpath; not exercised against a database, since none is
available here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kitlend import schema as S
from kitlend.sources.fixtures import Lending

# Tables without a UUID key are read in one query: roles are a handful of rows.
RANGE_KEY = {n: "id" for n in S.TABLES if n != "roles"}


def uuid_ranges(key: str, ranges: int) -> list[str]:
    """Predicates that cut the UUIDs into equal ranges by their first byte (1 to 256)."""
    firsts = [k * 256 // ranges for k in range(ranges)]
    at = [f"{b:02x}000000-0000-0000-0000-000000000000" for b in firsts]
    out = [f"{key} >= '{lo}' AND {key} < '{hi}'" for lo, hi in zip(at, at[1:], strict=False)]
    return [*out, f"{key} >= '{at[-1]}'"]


def read_table_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str],
                    buckets: int = 64) -> DataFrame:
    predicates = uuid_ranges(RANGE_KEY[table], buckets) if table in RANGE_KEY else ["TRUE"]
    df = spark.read.jdbc(url, table, predicates=predicates, properties=properties)
    if table == "notifications":
        df = df.withColumn("meta", F.col("meta").cast("string"))
    def typed(f):
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        return c.cast(f.dataType).alias(f.name)
    return df.select(*[typed(f) for f in S.STORED[table].fields])


def read_lending_jdbc(spark: SparkSession, url: str, properties: dict[str, str],
                      buckets: int = 64) -> Lending:
    """The eight tables as a lazy ``Lending`` over JDBC; UUID ids are read as text."""
    return Lending(**{n: (lambda n=n: read_table_jdbc(spark, url, n, properties, buckets))
                      for n in Lending.NAMES})
