"""Keyed updates re-aimed as change-set jobs.

Each job joins a batch of requests to the stored snapshot and gives one
outcome row per request; the new column values come from ``coalesce`` (first
write wins) or ``when`` (overwrite). Of several valid requests for one loan the
earliest (by request id) wins.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kitlend.operators.balances import loan_age
from kitlend.operators.history import ref_of
from kitlend.operators.notify import MEMBER_OVERDUE, ts_lit
from kitlend.session import stored
from kitlend.sources.fixtures import Lending

DATE_TEXT = r"^\d{4}-\d{2}-\d{2}$"


def set_promise(l: Lending, changes: DataFrame) -> DataFrame:
    """Set (YYYY-MM-DD) or clear (empty) the promised date of open loans.
    Outcomes: not_found, invalid_date, closed (no row updated), set, cleared,
    and conflict for a loan's later valid changes: the first by req_id wins."""
    t = l.transactions.select(F.col("id").alias("_tid"), "return_date", "promised_return_date")
    j = changes.join(t, changes["tx_id"] == t["_tid"], "left")
    text = F.trim(F.coalesce(F.col("date"), F.lit("")))
    parsed = F.when(text.rlike(DATE_TEXT), F.try_to_date(text, "yyyy-MM-dd"))
    j = stored(j.withColumn("_why", F.when(F.col("_tid").isNull(), "not_found")
                            .when((text != "") & parsed.isNull(), "invalid_date")
                            .when(F.col("return_date").isNotNull(), "closed")), "promises")
    first = (j.where(F.col("_why").isNull()).groupBy(F.col("tx_id").alias("_ftx"))
             .agg(F.min("req_id").alias("_first")))
    j = j.join(first, j["tx_id"] == first["_ftx"], "left")
    outcome = (F.when(F.col("_why").isNotNull(), F.col("_why"))
               .when(F.col("req_id") != F.col("_first"), "conflict")
               .when(text == "", "cleared")
               .otherwise("set"))
    return j.select("req_id", "tx_id", F.col("date"), outcome.alias("outcome"),
                    F.when(outcome == "set", parsed)
                    .when(outcome == "cleared", F.lit(None).cast("date"))
                    .otherwise(F.col("promised_return_date")).alias("promised_return_date"))


def mark_escalated(l: Lending, requests: DataFrame, at: dt.datetime) -> DataFrame:
    """Mark the faculty letter as sent; first time only, any open loan.
    Outcomes: not_found, already_returned, already_marked, marked."""
    req = requests.select("tx_id").distinct()
    t = l.transactions.select(F.col("id").alias("_tid"), "return_date", "escalated_at")
    j = req.join(t, req["tx_id"] == t["_tid"], "left")
    outcome = (F.when(F.col("_tid").isNull(), "not_found")
               .when(F.col("return_date").isNotNull(), "already_returned")
               .when(F.col("escalated_at").isNotNull(), "already_marked")
               .otherwise("marked"))
    return j.select("tx_id", outcome.alias("outcome"),
                    F.when(outcome == "marked", ts_lit(at)).otherwise(F.col("escalated_at"))
                    .alias("escalated_at"))


def manual_notice(l: Lending, as_of: dt.date, requests: DataFrame) -> DataFrame:
    """Staff asks to notify the member of one loan. Outcomes in order:
    not_found, already_returned, not_overdue_enough (under 2 days; no borrow
    date counts as 0), already (the loan already has a member notice, or an
    earlier request in the batch inserted it), inserted."""
    t = l.transactions
    items = l.inventory.select(F.col("id").alias("_iid"))
    loans = (t.join(items, t["inventory_id"] == items["_iid"], "left_semi")
             .select(F.col("id").alias("_tid"), "return_date", "borrow_date"))
    told = (l.notifications.where(F.col("type") == MEMBER_OVERDUE)
            .select(ref_of(F.col("meta")).alias("_ref")).where(F.col("_ref").isNotNull()).distinct())
    first = requests.groupBy(F.col("tx_id").alias("_ftx")).agg(F.min("req_id").alias("_first"))
    j = (requests.join(loans, requests["tx_id"] == loans["_tid"], "left")
         .join(told, requests["tx_id"] == told["_ref"], "left")
         .join(first, requests["tx_id"] == first["_ftx"]))
    days = F.coalesce(loan_age(as_of), F.lit(0))
    status = (F.when(F.col("_tid").isNull(), "not_found")
              .when(F.col("return_date").isNotNull(), "already_returned")
              .when(days < 2, "not_overdue_enough")
              .when(F.col("_ref").isNotNull() | (F.col("req_id") != F.col("_first")), "already")
              .otherwise("inserted"))
    return j.select("req_id", "tx_id", status.alias("status"))
