"""Bulk request jobs: loan admission (R2), return settlement (R3), hold
release (R9), visit pricing (R5) and registration intake (R1)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kitlend.operators.balances import inventory_available, open_loans, with_returned
from kitlend.operators.fold import ADMISSION, CLOSED, SETTLEMENT, ordered_fold
from kitlend.operators.history import active_holds
from kitlend.operators.notify import ts_lit
from kitlend.session import stored
from kitlend.sources.fixtures import Lending

# Fixed hold-release notes of the reference.
NOTE_BORROW = "auto-clear on borrow: no open loans"
NOTE_MANUAL = "manual"
#: The outcomes of accepted returns, which are the types of their notices.
RETURN_TYPES = ("return_completed", "return_partial")


def _flag(df: DataFrame, keys: DataFrame, on: str, flag: str) -> DataFrame:
    k = keys.select(F.col(keys.columns[0]).alias("_k")).distinct()
    return df.join(k, df[on] == k["_k"], "left").withColumn(flag, F.col("_k").isNotNull()).drop("_k")


def admit_loans(l: Lending, requests: DataFrame) -> DataFrame:
    """R2: decide a batch of loan requests in (ts, req_id) order per item.

    Checks in the reference's order: missing or bad fields -> invalid; active
    hold with an open loan -> hold (a hold without open loans is released and
    the request goes on); unknown item -> item; quantity above what is left
    of the item's clamped availability -> stock; unknown member -> user. Only
    accepted requests use availability."""
    r = requests
    r = _flag(r, active_holds(l).select("user_id"), "user_id", "_hold")
    r = _flag(r, open_loans(l).select("user_id"), "user_id", "_open")
    r = _flag(r, l.users.select("id"), "user_id", "user_known")
    avail = inventory_available(l).select(F.col("id").alias("_iid"),
                                          F.col("available_for_new_borrow").alias("_avail"))
    r = r.join(avail, r["inventory_id"] == avail["_iid"], "left")
    invalid = (F.col("user_id").isNull() | F.col("inventory_id").isNull() | F.col("qty").isNull()
               | (F.col("qty") <= 0) | F.col("borrow_date").isNull())
    pre = (F.when(invalid, "invalid")
           .when(F.col("_hold") & F.col("_open"), "hold")
           .when(F.col("_iid").isNull(), "item"))
    # Decided once and stored: both the fold and the refused rows read it.
    r = r.withColumn("_pre", pre).checkpoint(eager=True)
    cols = ["req_id", "ts", "user_id", "inventory_id", "qty", "borrow_date"]
    folded = ordered_fold(r.where(F.col("_pre").isNull()).select(*cols, "user_known", "_avail"),
                          "inventory_id", ["ts", "req_id"], "_avail", ADMISSION)
    decided = folded.select(*cols, F.col("code").alias("reason"),
                            F.col("state_before").alias("available_before"),
                            F.col("state_after").alias("available_after"))
    refused = r.where(F.col("_pre").isNotNull()).select(
        *cols, F.col("_pre").alias("reason"),
        F.lit(None).cast("long").alias("available_before"),
        F.lit(None).cast("long").alias("available_after"))
    out = decided.unionByName(refused)
    return out.withColumn("accepted", F.col("reason").isNull())


def borrow_hold_releases(l: Lending, requests: DataFrame) -> DataFrame:
    """Members whose active hold a borrow request releases (no open loan)."""
    req = requests.where(F.col("user_id").isNotNull() & F.col("inventory_id").isNotNull()
                         & (F.col("qty") > 0) & F.col("borrow_date").isNotNull())
    holders = active_holds(l).select("user_id").distinct()
    rel = (req.select("user_id").distinct()
           .join(holders, "user_id", "left_semi")
           .join(open_loans(l).select("user_id"), "user_id", "left_anti"))
    # released silently: the borrow path sends no notice (ref NULL)
    return rel.select("user_id", F.lit(NOTE_BORROW).alias("note"), F.lit(2).alias("priority"),
                      F.lit(None).cast("string").alias("ref"))


def settle_returns(l: Lending, events: DataFrame) -> DataFrame:
    """Decide a batch of return events in (ts, event_id) order per loan.

    Unknown loan -> not_found; closed (before or during the batch) -> closed;
    open with nothing left -> fully_returned; a missing, zero or negative
    quantity means all that is left; more than is left -> over. A return that
    leaves nothing closes the loan (return_completed), else return_partial."""
    loans = with_returned(l.transactions.select("id", "user_id", "qty", F.col("return_date").isNotNull().alias("_closed")),
                          l.transaction_returns)
    start = F.when(F.col("_closed"), F.lit(CLOSED)).otherwise(F.greatest(F.col("remaining"), F.lit(0)))
    lk = loans.select(F.col("id").alias("_tid"), F.col("user_id"), start.alias("_start_state"))
    cols = ["event_id", "ts", "tx_id", "return_qty", "note"]
    # Events meet their loans and are gathered by loan in one deal; unknown loans start from null.
    e = stored(events.select(*cols), "returns")
    named = e.where(F.col("tx_id").isNotNull())
    folded = ordered_fold(named.join(lk, named["tx_id"] == lk["_tid"], "left").drop("_tid"),
                          "tx_id", ["ts", "event_id"], "_start_state", SETTLEMENT, counted=named)
    known = F.col("state_before").isNotNull()
    ok = known & F.col("code").isNull()
    decided = folded.select(
        *cols, "user_id", F.when(known, F.col("code")).otherwise("not_found").alias("reason"),
        F.when(ok, F.col("state_before") - F.greatest(F.col("state_after"), F.lit(0)))
        .alias("returned_qty"),
        F.when(known, F.greatest(F.col("state_after"), F.lit(0))).alias("remaining_after"),
        F.when(ok & (F.col("state_after") == CLOSED), "return_completed")
        .when(ok, "return_partial").alias("outcome"))
    unknown = e.where(F.col("tx_id").isNull()).select(
        *cols, F.lit(None).cast(lk.schema["user_id"].dataType).alias("user_id"), F.lit("not_found").alias("reason"),
        F.lit(None).cast("long").alias("returned_qty"), F.lit(None).cast("long").alias("remaining_after"),
        F.lit(None).cast("string").alias("outcome"))
    return stored(decided.unionByName(unknown).withColumn("accepted", F.col("reason").isNull()), "settled")


def return_notices(l: Lending, settled: DataFrame) -> DataFrame:
    """R3 notices: each accepted return notifies the borrower with type
    return_partial or return_completed and ref 'ret-<loan>'. The stored rule
    "one row per (member, type, ref)" keeps only the first partial-return
    notice of a loan (against stored rows, then first in the batch); later
    ones are dropped silently. Mail goes out for every accepted return."""
    from kitlend.operators.history import ref_of
    acc = settled.where(F.col("accepted")).select(
        "event_id", "ts", "tx_id", "user_id", F.col("outcome").alias("type"), "returned_qty", "remaining_after")
    ref = ref_of(F.col("meta"))
    told = (l.notifications.where(F.col("type").isin(*RETURN_TYPES) & ref.startswith("ret-"))
            .select(F.col("user_id").alias("_su"), F.col("type").alias("_st"), F.substring(ref, 5, 2**31 - 1).alias("_sr"))
            .distinct())
    # One deal by (member, type, loan) serves the first notice and the stored ones; a notice needs all three.
    acc = acc.where(F.col("user_id").isNotNull() & F.col("type").isNotNull() & F.col("tx_id").isNotNull())
    acc = acc.withColumn("_first", F.min(F.struct("ts", "event_id")).over(Window.partitionBy("user_id", "type", "tx_id")))
    j = acc.join(told, (acc["user_id"] == told["_su"]) & (acc["type"] == told["_st"])
                 & (acc["tx_id"] == told["_sr"]), "left")
    inserted = F.col("_su").isNull() & (F.struct("ts", "event_id") == F.col("_first"))
    j = j.select("event_id", "tx_id", "user_id", "type", "returned_qty", "remaining_after", inserted.alias("inserted"))
    users = l.users.select(F.col("id").alias("_uid"), "email")
    j = j.join(users, j["user_id"] == users["_uid"], "left")
    message = F.when(F.col("type") == "return_completed",
                     F.concat(F.lit("All items returned (loan "), F.col("tx_id"), F.lit(")"))) \
        .otherwise(F.concat(F.lit("Returned "), F.col("returned_qty").cast("string"), F.lit(" item(s), "),
                            F.col("remaining_after").cast("string"), F.lit(" still out")))
    return j.select("event_id", "tx_id", "user_id", "type", F.concat(F.lit("ret-"), F.col("tx_id")).alias("ref"),
                    message.alias("message"), "inserted",
                    (F.col("_uid").isNotNull() & F.coalesce(F.col("email") != "", F.lit(False))).alias("mailed"))


def return_hold_releases(l: Lending, settled: DataFrame) -> DataFrame:
    """Members with an accepted return and nothing outstanding after the batch;
    the note names the last accepted loan, the one that emptied the account."""
    # Decided once: both the per-member and the per-loan summaries read it.
    acc = stored(settled.where(F.col("accepted")).select("user_id", "ts", "event_id", "tx_id", "remaining_after"), "accepted")
    last = (acc.groupBy("user_id")
            .agg(F.max(F.struct("ts", "event_id", "tx_id")).alias("_last"))
            .select("user_id", F.col("_last.tx_id").alias("_tx")))
    final = (acc.groupBy("tx_id").agg(F.min("remaining_after").alias("_final_left")))
    loans = with_returned(open_loans(l), l.transaction_returns)
    items = l.inventory.select(F.col("id").alias("_iid"))
    loans = loans.join(items, loans["inventory_id"] == items["_iid"], "left_semi")
    after = (loans.join(final, loans["id"] == final["tx_id"], "left")
             .withColumn("_left", F.coalesce(F.col("_final_left"), F.col("remaining"))))
    still = after.where(F.col("_left") > 0).select("user_id")
    rel = last.join(still, "user_id", "left_anti")
    return rel.select("user_id", F.concat(F.lit("auto-clear: returned tx "), F.col("_tx")).alias("note"),
                      F.lit(3).alias("priority"), F.concat(F.lit("clear-"), F.col("_tx")).alias("ref"))


def clear_holds(l: Lending, releases: DataFrame, at: dt.datetime) -> DataFrame:
    """Apply hold releases (manual, borrow-time, return-time) to the
    holds snapshot. The first release per member (by priority) clears the
    active hold and appends its note to the reason; cleared holds stay."""
    best = (releases.groupBy("user_id").agg(F.min(F.struct("priority", "note")).alias("_b"))
            .select(F.col("user_id").alias("_ruid"), F.col("_b.note").alias("_note")))
    h = l.user_holds
    j = h.join(best, h["user_id"] == best["_ruid"], "left")
    hit = F.col("cleared_at").isNull() & F.col("_ruid").isNotNull()
    suffix = F.when(F.col("_note") != "", F.concat(F.lit(" | cleared: "), F.col("_note"))).otherwise("")
    return j.select(
        "id", "user_id",
        F.when(hit, F.concat(F.coalesce(F.col("reason"), F.lit("")), suffix)).otherwise(F.col("reason"))
        .alias("reason"),
        "created_at",
        F.when(hit, ts_lit(at)).otherwise(F.col("cleared_at")).alias("cleared_at"),
        hit.alias("cleared_now"))


def hold_release_notices(l: Lending, releases: DataFrame) -> DataFrame:
    """R9 notices: a member whose active hold is cleared is told (type
    hold_cleared) unless the release came from a borrow request, which clears
    silently. The notice ref is 'hold-clear-<member>' (manual) or
    'clear-<loan>' (after a return); the once-per-(member, type, ref) rule
    drops a repeat. Staff hold_cleared notices fall outside the default staff
    allow-list and are not produced."""
    from kitlend.operators.history import ref_of
    best = (releases.groupBy("user_id").agg(F.min(F.struct("priority", "note", "ref")).alias("_b"))
            .select("user_id", F.col("_b.ref").alias("ref")))
    cleared = best.join(active_holds(l).select("user_id").distinct(), "user_id", "left_semi")
    stored = (l.notifications.where(F.col("type") == "hold_cleared")
              .select(F.col("user_id").alias("_su"), ref_of(F.col("meta")).alias("_sr")).distinct())
    out = (cleared.where(F.col("ref").isNotNull())
           .join(stored, (F.col("user_id") == F.col("_su")) & (F.col("ref") == F.col("_sr")), "left_anti"))
    return out.select("user_id", F.lit("hold_cleared").alias("type"), "ref",
                      F.when(F.col("ref").startswith("hold-clear-"),
                             F.lit("A staff member lifted your borrowing hold"))
                      .otherwise(F.lit("Nothing is outstanding any more, so your borrowing hold is lifted"))
                      .alias("message"))


def borrow_notices(l: Lending, admitted: DataFrame) -> DataFrame:
    """R2 notices: each accepted loan notifies the borrower (borrow_created,
    ref = the new loan's id, here the request id that becomes it) and mails
    them when they have an address."""
    acc = admitted.where(F.col("accepted"))
    items = l.inventory.select(F.col("id").alias("_iid"), "item_name")
    users = l.users.select(F.col("id").alias("_uid"), "email")
    j = (acc.join(items, acc["inventory_id"] == items["_iid"], "left")
         .join(users, acc["user_id"] == users["_uid"], "left"))
    msg = F.concat(F.lit("You borrowed "), F.coalesce(F.col("item_name"), F.lit("-")), F.lit(" x "),
                   F.col("qty").cast("string"), F.lit(" on "), F.col("borrow_date").cast("string"))
    return j.select("req_id", "user_id", F.lit("borrow_created").alias("type"),
                    F.col("req_id").alias("ref"), msg.alias("message"),
                    F.coalesce(F.col("email") != "", F.lit(False)).alias("mailed"))


def visit_notices(priced: DataFrame) -> DataFrame:
    """R5 notices: each accepted visit tells the member the day, fee and pay
    method; the notice carries no ref, so it is never de-duplicated."""
    acc = priced.where(F.col("accepted"))
    label = F.when(F.col("pay_method") == "qr", "QR scan").otherwise("cash")
    msg = F.concat(F.lit("Fitness visit on "), F.col("visit_date").cast("string"), F.lit(", paid "),
                   F.col("amount").cast("string"), F.lit(" baht ("), label, F.lit(")"))
    return acc.select("req_id", "user_id", F.lit("fitness_visit").alias("type"), msg.alias("message"))


# Fixed fee table (baht) and accepted lists of the visit form.
VISIT_FEES = {"student": 5, "external": 30}
PAY_METHODS = ("cash", "qr")


def price_visits(l: Lending, requests: DataFrame) -> DataFrame:
    """Validate visit requests and price them from the declared member type
    (the form's amount is ignored); the pay method defaults to cash."""
    pay = F.coalesce(F.nullif(F.trim(F.col("pay_method")), F.lit("")), F.lit("cash"))
    r = _flag(requests, l.users.select("id"), "user_id", "_known")
    reason = (F.when(F.col("user_id").isNull() | F.col("visit_date").isNull()
                     | F.col("member_type").isNull() | (F.col("member_type") == ""), "missing")
              .when(~F.col("member_type").isin(*VISIT_FEES), "member_type")
              .when(~pay.isin(*PAY_METHODS), "pay_method")
              .when(~F.col("_known"), "user"))
    amount = F.when(F.col("member_type") == "student", VISIT_FEES["student"]).otherwise(VISIT_FEES["external"])
    return r.select("req_id", "user_id", "member_type", "visit_date", pay.alias("pay_method"),
                    F.when(reason.isNull(), amount).alias("amount"),
                    reason.isNull().alias("accepted"), reason.alias("reason"))
