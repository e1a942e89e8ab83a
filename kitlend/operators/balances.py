"""Balances: returns per loan, outstanding loans, item availability, item status.

Partial returns are summed once per loan (one aggregate, map-side combined)
and joined back; the reference's correlated scalar sum written three times
becomes a single ``groupBy(transaction_id)``. Item dimensions are left to the
optimizer: AQE broadcasts them when their runtime size is under the threshold
and falls back to a sort-merge join when an item table grows large.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kitlend.sources.fixtures import Lending


def loan_age(as_of: dt.date) -> Column:
    """Whole days from borrow date to the as-of date (NULL borrow date gives NULL)."""
    return F.datediff(F.lit(as_of), F.col("borrow_date"))


def returned_per_loan(returns: DataFrame) -> DataFrame:
    return (returns.groupBy(F.col("transaction_id"))
            .agg(F.sum("return_qty").alias("returned_qty")))


def with_returned(loans: DataFrame, returns: DataFrame) -> DataFrame:
    """Loans with ``returned_qty`` (0 when none) and signed ``remaining`` = qty - returned."""
    sums = returned_per_loan(returns)
    j = loans.join(sums, loans["id"] == sums["transaction_id"], "left").drop("transaction_id")
    returned = F.coalesce(F.col("returned_qty"), F.lit(0)).cast("bigint")
    return (j.withColumn("returned_qty", returned)
            .withColumn("remaining", F.col("qty").cast("bigint") - returned))


def open_loans(l: Lending) -> DataFrame:
    """Loans not closed (``return_date IS NULL``)."""
    return l.open_transactions


def _outstanding_core(l: Lending) -> DataFrame:
    """Open loans with something left to return, without the item join."""
    return (with_returned(open_loans(l), l.transaction_returns)
            .where(F.col("remaining") > 0))


def tx_outstanding(l: Lending) -> DataFrame:
    """One row per open loan with a positive remainder (``v_tx_outstanding``)."""
    items = l.inventory.select(F.col("id").alias("_iid"), "item_name")
    core = _outstanding_core(l)
    return (core.join(items, core["inventory_id"] == items["_iid"])
            .select(F.col("id").alias("tx_id"), "user_id", "inventory_id", "item_name",
                    "borrow_date", "promised_return_date",
                    F.col("qty").alias("borrowed_qty"), "returned_qty",
                    F.greatest(F.col("remaining"), F.lit(0)).alias("outstanding_qty")))


def outstanding_by_item(l: Lending) -> DataFrame:
    core = _outstanding_core(l)
    return (core.groupBy("inventory_id")
            .agg(F.sum("remaining").alias("out_using")))


def inventory_available(l: Lending) -> DataFrame:
    """Physical stock, units out, clamped availability per item
    (``v_inventory_available``; inactive and archived items included)."""
    out = outstanding_by_item(l)
    inv = l.inventory
    j = inv.join(out, inv["id"] == out["inventory_id"], "left")
    out_using = F.coalesce(F.col("out_using"), F.lit(0)).cast("bigint")
    return j.select(
        inv["id"], "item_name", F.col("stock").alias("physical_stock"),
        out_using.alias("outstanding_in_use"),
        F.greatest(F.col("stock") - out_using, F.lit(0)).alias("available_for_new_borrow"),
        "active",
    )


def item_status(l: Lending, as_of: dt.date) -> DataFrame:
    """A4 (flagship): per active, not archived item, units in use (net of part
    returns), units in 2-6 and 7+ day overdue loans (full qty, part returns
    not subtracted), and clamped availability. One pass over open loans."""
    loans = with_returned(open_loans(l), l.transaction_returns)
    age = loan_age(as_of)
    per_item = loans.groupBy("inventory_id").agg(
        F.sum(F.when(F.col("remaining") > 0, F.col("remaining"))).alias("_in_use"),
        F.sum(F.when(age.between(2, 6), F.col("qty"))).alias("_od2"),
        F.sum(F.when(age >= 7, F.col("qty"))).alias("_od7"),
    )
    inv = l.inventory.where(F.col("deleted_at").isNull() & F.col("active"))
    j = inv.join(per_item, inv["id"] == per_item["inventory_id"], "left")
    in_use = F.coalesce(F.col("_in_use"), F.lit(0)).cast("int")
    return j.select(
        inv["id"], "item_name", F.col("stock").alias("stock_total"),
        in_use.alias("in_use"),
        F.coalesce(F.col("_od2"), F.lit(0)).cast("int").alias("overdue_2_6"),
        F.coalesce(F.col("_od7"), F.lit(0)).cast("int").alias("overdue_7_plus"),
        F.greatest(F.col("stock") - in_use, F.lit(0)).alias("available"),
    )


def stock_level(l: Lending) -> DataFrame:
    """Availability class per item: out (0), low (1-2), ok."""
    a = inventory_available(l)
    avail = F.col("available_for_new_borrow")
    return a.select("id", "item_name", "available_for_new_borrow",
                    F.when(avail == 0, "out").when(avail <= 2, "low").otherwise("ok").alias("stock_level"))


def equipment_status(l: Lending) -> DataFrame:
    """P10: borrowable = active and availability > 0."""
    a = inventory_available(l)
    return a.select("id", "item_name", "physical_stock", "outstanding_in_use",
                    "available_for_new_borrow", "active",
                    (F.col("active") & (F.col("available_for_new_borrow") > 0)).alias("can_borrow"))


def inventory_kpis(l: Lending) -> DataFrame:
    """Totals over all items (inactive included); available sums clamped values."""
    a = inventory_available(l)
    return a.agg(
        F.sum("physical_stock").cast("bigint").alias("total_stock"),
        F.sum("outstanding_in_use").cast("bigint").alias("total_out"),
        F.sum("available_for_new_borrow").cast("bigint").alias("total_available"),
        F.count(F.lit(1)).alias("items"),
    )


def inventory_list(l: Lending) -> DataFrame:
    """K6: availability listing ordered by active first, then name."""
    return inventory_available(l).orderBy(F.col("active").desc(), F.col("item_name").asc(),
                                          F.col("id").asc())


def inventory_search(l: Lending, term: str) -> DataFrame:
    """Case-folded substring search on the item name (no wildcard escapes)."""
    a = inventory_available(l)
    return a.where(F.lower(F.col("item_name")).contains(term.strip().lower()))


def lendable_items(l: Lending) -> DataFrame:
    """Active items with physical stock > 0, with the form's quantity cap."""
    inv = l.inventory.where(F.col("active") & (F.col("stock") > 0))
    return inv.select("id", F.col("item_name").alias("name"), "stock",
                      F.greatest(F.lit(0), F.least(F.col("stock"), F.lit(10))).alias("max_qty"))


def item_list(l: Lending) -> DataFrame:
    """Plain item list by name."""
    return l.inventory.select("id", "item_name", "stock", "active").orderBy("item_name", "id")


def role_list(l: Lending) -> DataFrame:
    """Roles by id."""
    return l.roles.select("id", "name").orderBy("id")
