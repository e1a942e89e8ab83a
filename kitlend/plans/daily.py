"""The daily overdue run (T3) as one batch job over stored tables.

The reference fires at 08:00 Asia/Bangkok and once at start-up. Here any
scheduler calls ``run_daily`` with the folder of the stored tables and the as-of
day: the de-duplicated notices are appended to the notifications table's day
partition, and the mail outbox and the addresses of its staff audience overwrite
their run-date partition. A second run on the same day therefore adds no
notification rows (the uniqueness rules see the first run's rows, audience rows
too) and rewrites the same mail, which the reference sends again.
"""

from __future__ import annotations

import datetime as dt

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kitlend.operators import notify as N
from kitlend.sources.tables import append_with_ids, read_lending


def notices_as_rows(new: DataFrame) -> DataFrame:
    """The run's rows of the notifications table, without ids: the 7+ day notice
    is a row for the staff audience, the others name their recipient."""
    return new.select(
        F.lit(None).cast("string").alias("id"), F.col("recipient_id").alias("user_id"), "type", "title",
        "message", "meta", "created_at", F.lit(None).cast("timestamp_ntz").alias("read_at"),
        "created_date", "audience")


def _observed(rows: Observation) -> int:
    """The rows counted while they were written. Adaptive execution drops the counting
    node, and with it the metric, where it finds that no row can reach it."""
    try:
        return rows.get["n"]
    except Py4JJavaError:
        return 0


def run_daily(spark: SparkSession, path: str, as_of: dt.date) -> dict[str, int]:
    l = read_lending(spark, path)
    candidates = N.overdue_candidates(l, as_of).checkpoint(eager=True)
    notices, mails = Observation("notices"), Observation("mails")
    rows = notices_as_rows(N.notification_dedupe(l, as_of, candidates))
    append_with_ids(rows.observe(notices, F.count(F.lit(1)).alias("n")), path, "notifications")
    N.write_outbox(N.mail_outbox(l, as_of, candidates).observe(mails, F.count(F.lit(1)).alias("n")), f"{path}/outbox")
    N.write_outbox(N.staff_addresses(l, as_of), f"{path}/outbox_addresses")
    done = {"notices": _observed(notices), "mails": _observed(mails)}
    run = spark.range(1).select(F.lit(as_of).alias("run_date"), *[F.lit(n).cast("long").alias(k) for k, n in done.items()])
    run.write.mode("append").parquet(f"{path}/runs")
    return done
