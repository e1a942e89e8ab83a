"""Overdue tiers, loan status and promise rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kitlend.operators.balances import loan_age, open_loans, with_returned
from kitlend.sources.fixtures import Lending

# Fixed status names of the loan-status rule, in precedence order.
STATUSES = ("returned", "escalated", "promised", "overdue_7_plus", "overdue_2_plus", "open")


def _items(l: Lending) -> DataFrame:
    return l.inventory.select(F.col("id").alias("_iid"), "item_name")


def overdue_tier(l: Lending, as_of: dt.date, lo: int, hi: int | None = None) -> DataFrame:
    """Open loans whose age is in [lo, hi] (hi None: no upper bound), full qty,
    joined to their item (``overdue_2_6_days`` / ``overdue_7_plus``)."""
    age = loan_age(as_of)
    cond = age.between(lo, hi) if hi is not None else age >= lo
    loans = open_loans(l).where(cond)
    items = _items(l)
    return (loans.join(items, loans["inventory_id"] == items["_iid"])
            .select(F.col("id").alias("tx_id"), "user_id", "inventory_id", "qty", "item_name",
                    age.alias("days_overdue")))


def overdue_2_6_days(l: Lending, as_of: dt.date) -> DataFrame:
    return overdue_tier(l, as_of, 2, 6)


def overdue_7_plus(l: Lending, as_of: dt.date) -> DataFrame:
    return overdue_tier(l, as_of, 7)


def urgent_top10(l: Lending, as_of: dt.date, n: int = 10) -> DataFrame:
    """K1: the n most overdue 7+ loans; loan id breaks ties."""
    return (overdue_7_plus(l, as_of)
            .select("tx_id", "user_id", "item_name", "qty", "days_overdue")
            .orderBy(F.col("days_overdue").desc(), F.col("tx_id").asc())
            .limit(n))


def promised_today(l: Lending, as_of: dt.date, n: int = 20) -> DataFrame:
    """Open loans promised for the as-of day, oldest borrow first."""
    loans = open_loans(l).where(F.col("promised_return_date") == F.lit(as_of))
    users = l.users.select(F.col("id").alias("_uid"), "full_name")
    items = _items(l)
    j = (loans.join(users, loans["user_id"] == users["_uid"])
         .join(items, loans["inventory_id"] == items["_iid"]))
    return (j.select(F.col("id").alias("tx_id"), "full_name", "item_name", "qty", "borrow_date")
            .orderBy(F.col("borrow_date").asc_nulls_last(), F.col("tx_id").asc())
            .limit(n))


def promise_missed_by_date(as_of: dt.date) -> Column:
    """Outstanding page rule: the promised day is before the as-of day."""
    return F.col("promised_return_date") < F.lit(as_of)


def promise_missed_by_instant(as_of: dt.date) -> Column:
    """History rule: the promised day's midnight has passed, so the day itself counts."""
    return F.col("promised_return_date") <= F.lit(as_of)


def outstanding_all(l: Lending, as_of: dt.date) -> DataFrame:
    """Every open loan with something left, with member and item, oldest first."""
    loans = with_returned(open_loans(l), l.transaction_returns).where(F.col("remaining") > 0)
    users = l.users.select(F.col("id").alias("_uid"), "full_name")
    items = _items(l)
    j = (loans.join(users, loans["user_id"] == users["_uid"])
         .join(items, loans["inventory_id"] == items["_iid"]))
    return (j.select(F.col("id").alias("tx_id"), "user_id", "full_name", "item_name",
                     F.col("qty").alias("borrowed_qty"), "returned_qty",
                     F.col("remaining").alias("outstanding_qty"), "borrow_date",
                     "promised_return_date",
                     F.coalesce(promise_missed_by_date(as_of), F.lit(False)).alias("promise_missed"))
            .orderBy(F.col("borrow_date").asc_nulls_last(), F.col("tx_id")))


def promise_state(l: Lending, as_of: dt.date) -> DataFrame:
    """Both promise rules for open loans that carry a promise."""
    loans = open_loans(l).where(F.col("promised_return_date").isNotNull())
    return loans.select(F.col("id").alias("tx_id"), "promised_return_date",
                        promise_missed_by_date(as_of).alias("missed_by_date"),
                        promise_missed_by_instant(as_of).alias("missed_by_instant"))


def status_column(as_of: dt.date) -> Column:
    """First match wins; a NULL age counts as 0 days."""
    d = F.coalesce(loan_age(as_of), F.lit(0))
    return (F.when(F.col("return_date").isNotNull(), STATUSES[0])
            .when(F.col("escalated_at").isNotNull(), STATUSES[1])
            .when(F.col("promised_return_date").isNotNull(), STATUSES[2])
            .when(d >= 7, STATUSES[3])
            .when(d >= 2, STATUSES[4])
            .otherwise(STATUSES[5]))


def loan_status(l: Lending, as_of: dt.date) -> DataFrame:
    """P7 over every loan, with remaining units (clamped) and the instant promise rule."""
    loans = with_returned(l.transactions, l.transaction_returns)
    status = status_column(as_of)
    return loans.select(
        F.col("id").alias("tx_id"), "user_id", status.alias("status"),
        F.coalesce(loan_age(as_of), F.lit(0)).alias("days"),
        F.greatest(F.col("remaining"), F.lit(0)).alias("remaining_qty"),
        ((status == "promised") & promise_missed_by_instant(as_of)).alias("promise_missed"),
    )
