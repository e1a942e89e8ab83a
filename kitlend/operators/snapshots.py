"""Table snapshots and notices after a batch of change requests (S4-S7, R2, R3,
R7, R8, R12): the rows that the reference's handlers leave behind. New rows carry
a NULL id; the sink assigns ids."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kitlend.operators import notify as N
from kitlend.operators.balances import loan_age
from kitlend.operators.changes import apply_role_changes, delete_or_archive_items, delete_users
from kitlend.operators.history import ref_of
from kitlend.operators.updates import manual_notice, mark_escalated, set_promise
from kitlend.sources.fixtures import Lending

FACULTY = "overdue_faculty"


def _replaced(table: DataFrame, news: DataFrame, key: str, *columns: str) -> DataFrame:
    """``table`` with ``columns`` taken from ``news`` (_key, _new_...) where it has
    the row, and ``changed``."""
    j = table.join(news, table[key] == news["_key"], "left")
    hit = F.col("_key").isNotNull()
    return j.select(*[F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
                      for c in table.columns], hit.alias("changed"))


def loans_after_promises(l: Lending, changes: DataFrame) -> DataFrame:
    """The loans after the accepted promise changes."""
    done = set_promise(l, changes).where(F.col("outcome").isin("set", "cleared"))
    news = done.select(F.col("tx_id").alias("_key"), F.col("promised_return_date").alias("_new_promised_return_date"))
    return _replaced(l.transactions, news, "id", "promised_return_date")


def loans_after_escalations(l: Lending, requests: DataFrame, at: dt.datetime) -> DataFrame:
    """The loans after their letters were marked as sent."""
    done = mark_escalated(l, requests, at).where(F.col("outcome") == "marked")
    news = done.select(F.col("tx_id").alias("_key"), F.col("escalated_at").alias("_new_escalated_at"))
    return _replaced(l.transactions, news, "id", "escalated_at")


def users_after_role_changes(l: Lending, changes: DataFrame) -> DataFrame:
    """The users after the accepted role changes."""
    done = apply_role_changes(l, changes).where(F.col("outcome") == "role_updated")
    news = done.select(F.col("user_id").alias("_key"), F.col("role_id").alias("_new_role_id"),
                       F.col("member_type").alias("_new_member_type"))
    return _replaced(l.users, news, "id", "role_id", "member_type")


def after_user_deletes(l: Lending, requests: DataFrame) -> dict[str, DataFrame]:
    """Users, notifications and user_holds without the deleted members."""
    gone = delete_users(l, requests).where(F.col("outcome") == "deleted").select(
        F.col("user_id").alias("_gone")).checkpoint(eager=True)

    def left(df: DataFrame, key: str) -> DataFrame:
        return df.join(gone, df[key] == gone["_gone"], "left_anti")
    return {"users": left(l.users, "id"), "notifications": left(l.notifications, "user_id"),
            "user_holds": left(l.user_holds, "user_id")}


def inventory_after_deletes(l: Lending, requests: DataFrame, at: dt.datetime) -> DataFrame:
    """The items left, archived ones inactive with their deletion time."""
    done = delete_or_archive_items(l, requests, at).checkpoint(eager=True)
    gone = done.where(F.col("outcome") == "deleted").select(F.col("id").alias("_gone"))
    news = done.where(F.col("outcome") == "archived").select(
        F.col("id").alias("_key"), F.col("active").alias("_new_active"), F.col("deleted_at").alias("_new_deleted_at"))
    kept = l.inventory.join(gone, F.col("id") == F.col("_gone"), "left_anti")
    return _replaced(kept, news, "id", "active", "deleted_at")


def toggle_items(l: Lending, requests: DataFrame) -> DataFrame:
    """The items after each request flipped ``active``; an even number of
    requests leaves it, unknown ids change nothing."""
    odd = requests.groupBy(F.col("id").alias("_key")).agg((F.count(F.lit(1)) % 2 == 1).alias("_odd"))
    j = l.inventory.join(odd, F.col("id") == F.col("_key"), "left")
    flip = F.coalesce(F.col("_odd"), F.lit(False))
    return j.select("id", "item_name", "stock", (F.col("active") != flip).alias("active"), "deleted_at",
                    flip.alias("changed"))


def create_staff(l: Lending, requests: DataFrame) -> DataFrame:
    """Accounts made by an admin. The role (case-folded) must exist; the e-mail
    (trimmed) must be new to the users and to the valid requests before it."""
    r = requests.select("req_id", F.trim(F.col("email")).alias("email"), F.trim(F.col("full_name")).alias("full_name"),
                        F.lower(F.col("role")).alias("role"))
    roles = l.roles.select(F.col("id").alias("_rid"), F.col("name").alias("_rname"))
    used = l.users.select(F.col("email").alias("_ue")).distinct()
    j = (r.join(roles, F.col("role") == F.col("_rname"), "left").join(used, F.col("email") == F.col("_ue"), "left")
         .withColumn("_why", F.when(F.col("_rid").isNull(), "role_not_found")
                     .when(F.col("email").isNull() | F.col("full_name").isNull() | F.col("_ue").isNotNull(),
                           "dup_or_invalid")).checkpoint(eager=True))
    first = j.where(F.col("_why").isNull()).groupBy(F.col("email").alias("_fe")).agg(F.min("req_id").alias("_first"))
    j = j.join(first, F.col("email") == F.col("_fe"), "left")
    why = F.coalesce("_why", F.when(F.col("req_id") != F.col("_first"), "dup_or_invalid"))
    ok = why.isNull()
    return j.select("req_id", "email", "full_name", ok.alias("accepted"), why.alias("reason"),
                    F.when(ok, F.col("_rid")).alias("role_id"), F.when(ok, F.col("role")).alias("member_type"))


def escalation_notices(l: Lending, requests: DataFrame, as_of: dt.date) -> DataFrame:
    """The notice rows of marking letters as sent, for every open loan asked
    for, marked before or not. The member's row is once per (member, type, ref)
    and once a day per (ref, type); the staff row is for the staff audience and
    shares the once rule with the 7+ day notice, so it reaches only those whom
    neither has told."""
    items = l.inventory.select(F.col("id").alias("_iid"), "item_name")
    asked = requests.select(F.col("tx_id").alias("_asked")).distinct()
    loans = (l.open_transactions.join(asked, F.col("id") == F.col("_asked"), "left_semi")
             .join(items, F.col("inventory_id") == F.col("_iid")))
    qty, ref = F.col("qty").cast("string"), F.col("id")
    users = l.users.select(F.col("id").alias("_uid"))
    days = F.coalesce(loan_age(as_of).cast("string"), F.lit("-"))
    member = loans.join(users, F.col("user_id") == F.col("_uid"), "left_semi").select(
        ref.alias("ref"), "user_id", F.lit(FACULTY).alias("type"), F.lit(1).cast("long").alias("recipients"),
        F.lit("Sent to your faculty").alias("title"),
        F.concat(F.lit("Loan "), F.col("item_name"), F.lit(" x "), qty, F.lit(" is "), days,
                 F.lit(" days overdue; the letter to your faculty is recorded as sent")).alias("message"),
        F.to_json(F.struct(ref.alias("ref"), F.lit("/history").alias("goto"))).alias("meta"),
        F.lit(None).cast("string").alias("audience"))
    told = l.notifications.where(F.col("type") == FACULTY).select(
        F.col("user_id").alias("_tu"), ref_of(F.col("meta")).alias("_tr"), F.col("created_date").alias("_td"))
    same = (F.col("ref") == F.col("_tr")) & ((F.col("user_id") == F.col("_tu")) | (F.col("_td") == F.lit(as_of)))
    member = member.join(told, same, "left_anti")
    staff = loans.select(
        ref.alias("ref"), F.lit(None).cast(l.users.schema["id"].dataType).alias("user_id"),
        F.lit(N.STAFF_7_PLUS).alias("type"), F.lit("Marked as sent to the faculty").alias("title"),
        F.concat(F.lit("Loan "), ref, F.lit(" ("), F.col("item_name"), F.lit(" x "), qty,
                 F.lit(") was marked as sent to the faculty")).alias("message"),
        F.to_json(F.struct(ref.alias("ref"), F.col("user_id").cast("string").alias("user_id"))).alias("meta"),
        F.lit(N.STAFF).alias("audience"))
    staff = N.untold_staff(l, staff)
    cols = ["ref", "user_id", "type", "recipients", "title", "message", "meta", "audience"]
    return (member.select(*cols).unionByName(staff.select(*cols)).withColumn("created_at", N.ts_lit(N.run_timestamp(as_of)))
            .withColumn("created_date", F.lit(as_of)))


def manual_notice_rows(l: Lending, as_of: dt.date, requests: DataFrame) -> DataFrame:
    """The notice rows that accepted manual requests insert."""
    done = manual_notice(l, as_of, requests).where(F.col("status") == "inserted").select(F.col("tx_id").alias("_tx"))
    items = l.inventory.select(F.col("id").alias("_iid"), "item_name")
    j = (l.open_transactions.join(done, F.col("id") == F.col("_tx"), "left_semi")
         .join(items, F.col("inventory_id") == F.col("_iid")))
    days = loan_age(as_of)
    return j.select(
        "user_id", F.lit(N.MEMBER_OVERDUE).alias("type"), F.lit("Overdue: please return the equipment").alias("title"),
        F.concat(F.lit("Your loan of "), F.col("item_name"), F.lit(" is "), days.cast("string"),
                 F.lit(" days overdue; please return it")).alias("message"),
        F.to_json(F.struct(F.col("id").alias("ref"), days.alias("days_overdue"), F.col("item_name").alias("item"),
                           "qty")).alias("meta"),
        N.ts_lit(N.run_timestamp(as_of)).alias("created_at"), F.lit(as_of).alias("created_date"))


def loans_after_settlement(l: Lending, settled: DataFrame) -> DataFrame:
    """The loans after a settled batch; the closing return's time closes a loan."""
    closed = settled.where(F.col("outcome") == "return_completed").select(
        F.col("tx_id").alias("_key"), F.col("ts").alias("_new_return_date"))
    return _replaced(l.transactions, closed, "id", "return_date")


def returns_of(settled: DataFrame) -> DataFrame:
    """The rows that a settled batch adds to transaction_returns."""
    return settled.where(F.col("accepted")).select(
        F.lit(None).cast("string").alias("id"), F.col("tx_id").alias("transaction_id"),
        F.col("returned_qty").cast("int").alias("return_qty"), F.col("ts").alias("returned_at"),
        F.nullif(F.col("note"), F.lit("")).alias("note"))


def loans_of(admitted: DataFrame) -> DataFrame:
    """R2: the rows that admitted requests add to the loans; the request id becomes
    the loan's."""
    none = F.lit(None)
    return admitted.where(F.col("accepted")).select(
        F.col("req_id").alias("id"), "user_id", "inventory_id", "qty", "borrow_date",
        none.cast("timestamp_ntz").alias("return_date"), F.col("ts").alias("created_at"),
        none.cast("timestamp_ntz").alias("escalated_at"), none.cast("date").alias("promised_return_date"))
