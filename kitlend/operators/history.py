"""Borrow and visit history with flags, member listings and dashboards
(J3, J4, J5, J8, A2, A5, A8, K4, K5, P5, P11, P12, P15, P17)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kitlend.operators.balances import loan_age, open_loans, tx_outstanding, with_returned
from kitlend.operators.members import resolve_members
from kitlend.sources.fixtures import Lending


def ref_of(meta: Column) -> Column:
    """``meta->>'ref'`` of a JSON text column."""
    return F.get_json_object(meta, "$.ref")


def display_code() -> Column:
    """Student id for students, citizen id otherwise, '-' when missing."""
    return F.coalesce(F.when(F.col("member_type") == "student", F.col("student_id"))
                      .otherwise(F.col("citizen_id")), F.lit("-"))


def active_holds(l: Lending) -> DataFrame:
    """Holds not cleared."""
    return l.user_holds.where(F.col("cleared_at").isNull())


def _flag_join(df: DataFrame, keys: DataFrame, left_key: str, flag: str) -> DataFrame:
    """Left join to distinct keys, leaving a boolean flag (J7/J8 set membership)."""
    k = keys.select(F.col(keys.columns[0]).alias("_k")).distinct()
    return (df.join(k, df[left_key] == k["_k"], "left")
            .withColumn(flag, F.col("_k").isNotNull()).drop("_k"))


def history_loans(l: Lending, as_of: dt.date, user_id=None, date_from: dt.date | None = None,
                  date_to: dt.date | None = None) -> DataFrame:
    """J3 + A2 + J8 + K5: every loan (orphans kept) with member, item, returned and
    remaining units, age, ever-notified and active-hold flags; optional filters
    (P5) on member and on borrow date, both ends inclusive."""
    t = l.transactions
    if user_id is not None:
        t = t.where(F.col("user_id") == F.lit(user_id))
    if date_from is not None:
        t = t.where(F.col("borrow_date") >= F.lit(date_from))
    if date_to is not None:
        t = t.where(F.col("borrow_date") <= F.lit(date_to))
    loans = with_returned(t, l.transaction_returns).drop("remaining")
    users = l.users.select(F.col("id").alias("_uid"), "full_name", "member_type",
                           "student_id", "citizen_id")
    items = l.inventory.select(F.col("id").alias("_iid"), "item_name")
    told = (l.notifications.where(F.col("type") == "overdue_student")
            .select(ref_of(F.col("meta")).alias("ref")).where(F.col("ref").isNotNull()))
    # Joins on one key follow each other, the widest rows last: loans move once a key. What
    # follows from other columns is added after the last move, the sort.
    j = _flag_join(loans, told, "id", "notified_ever")
    j = j.join(items, j["inventory_id"] == items["_iid"], "left").drop("inventory_id", "_iid")
    j = _flag_join(j, active_holds(l).select("user_id"), "user_id", "has_active_hold")
    j = j.join(users, j["user_id"] == users["_uid"], "left").withColumn("_known", F.col("_uid").isNotNull()).drop("_uid")
    remaining = F.col("qty").cast("bigint") - F.col("returned_qty")
    return (j.orderBy(F.col("borrow_date").desc_nulls_first(), F.col("created_at").desc_nulls_last(), F.col("id"))
            .select("id", "user_id", "full_name", "member_type", "student_id", "citizen_id", "item_name",
                    "qty", "returned_qty", F.greatest(remaining, F.lit(0)).alias("remaining_qty"),
                    "borrow_date", "return_date", "escalated_at", "promised_return_date",
                    loan_age(as_of).alias("days_overdue"), "notified_ever", "has_active_hold",
                    F.when(F.col("_known"), display_code()).alias("display_code")))


def histories_by_code(l: Lending, scans: DataFrame, as_of: dt.date) -> DataFrame:
    """P5: the loans of the member that each scanned code names (J9), as the staff
    history's member filter takes it. A code that names nobody gives no rows."""
    who = (resolve_members(scans, l.users).where(F.col("user_id").isNotNull())
           .select("scan_id", "code", F.col("user_id").alias("_member")))
    return (history_loans(l, as_of).join(who, F.col("user_id") == F.col("_member"))
            .select("scan_id", "code", "user_id", "id", "item_name", "qty", "returned_qty", "remaining_qty", "borrow_date",
                    "days_overdue"))


# Fixed pay-method labels of the visit table.
PAY_LABELS = {"qr": "QR / transfer", "cash": "cash"}


def history_visits(l: Lending, user_id=None, date_from: dt.date | None = None,
                   date_to: dt.date | None = None) -> DataFrame:
    """J4 + F14: visits with member (left join), newest first, optional filters."""
    v = l.fitness_visits
    if user_id is not None:
        v = v.where(F.col("user_id") == F.lit(user_id))
    if date_from is not None:
        v = v.where(F.col("visit_date") >= F.lit(date_from))
    if date_to is not None:
        v = v.where(F.col("visit_date") <= F.lit(date_to))
    users = l.users.select(F.col("id").alias("_uid"), "full_name", "member_type",
                           "student_id", "citizen_id")
    j = v.join(users, v["user_id"] == users["_uid"], "left")
    return (j.select(
        "id", "user_id", "full_name", "member_type", "student_id", "citizen_id", "visit_date",
        "amount", "pay_method",
        F.when(F.col("pay_method") == "qr", PAY_LABELS["qr"]).otherwise(PAY_LABELS["cash"])
        .alias("pay_label"),
        F.when(F.col("_uid").isNotNull(), display_code()).alias("display_code"))
        .orderBy(F.col("visit_date").desc_nulls_first(), F.col("created_at").desc_nulls_first(),
                 F.col("id")))


def members_recent(l: Lending, n: int = 100) -> DataFrame:
    """K4 + P11: newest n users; id breaks ties."""
    return (l.users.select("id", "full_name", "member_type", "student_id", "citizen_id", "email",
                           "created_at", display_code().alias("display_code"))
            .orderBy(F.col("created_at").desc_nulls_first(), F.col("id")).limit(n))


def admin_users(l: Lending, n: int = 200) -> DataFrame:
    """J5 + P12 + K4: newest n users with role name and effective role."""
    r = l.roles.select(F.col("id").alias("_rid"), F.col("name").alias("role"))
    u = l.users
    j = u.join(r, u["role_id"] == r["_rid"], "left")
    return (j.select("id", "full_name", "email", "member_type", "created_at", "role",
                     F.coalesce(F.col("role"), F.col("member_type")).alias("effective_role"))
            .orderBy(F.col("created_at").desc_nulls_first(), F.col("id")).limit(n))


def member_profiles(l: Lending) -> DataFrame:
    """Student and external profile rows, renamed fields."""
    u = l.users
    students = u.where(F.col("member_type") == "student").select(
        "id", F.lit("student").alias("profile"), "full_name", "email",
        F.col("student_id").alias("code"), "faculty", "qr_code_value")
    externals = u.where(F.col("member_type") == "external").select(
        "id", F.lit("external").alias("profile"), "full_name", "email",
        F.col("citizen_id").alias("code"), F.lit(None).cast("string").alias("faculty"),
        "qr_code_value")
    return students.unionByName(externals)


def member_flags(l: Lending) -> DataFrame:
    """J7 + R10: per member, active hold, any open loan, anything outstanding, and
    the student borrow block (student with anything outstanding)."""
    u = l.users.select("id", "member_type")
    u = _flag_join(u, active_holds(l).select("user_id"), "id", "has_active_hold")
    u = _flag_join(u, open_loans(l).select("user_id"), "id", "has_open_loan")
    u = _flag_join(u, tx_outstanding(l).select("user_id"), "id", "has_outstanding")
    return u.select(F.col("id").alias("user_id"), "member_type", "has_active_hold",
                    "has_open_loan", "has_outstanding",
                    ((F.col("member_type") == "student") & F.col("has_outstanding"))
                    .alias("borrow_blocked"))


def member_summary(l: Lending) -> DataFrame:
    """Per member, visits and paid amount, outstanding loan rows and units."""
    visits = (l.fitness_visits.groupBy("user_id")
              .agg(F.count(F.lit(1)).alias("visits"), F.sum("amount").alias("visit_amount")))
    out = (tx_outstanding(l).groupBy("user_id")
           .agg(F.count(F.lit(1)).alias("outstanding_loans"),
                F.sum("outstanding_qty").alias("outstanding_units")))
    u = l.users.select(F.col("id").alias("user_id"))
    j = u.join(visits, "user_id", "left").join(out, "user_id", "left")
    z = F.lit(0).cast("bigint")
    return j.select("user_id",
                    F.coalesce("visits", z).alias("visits"),
                    F.coalesce("visit_amount", z).alias("visit_amount"),
                    F.coalesce("outstanding_loans", z).alias("outstanding_loans"),
                    F.coalesce("outstanding_units", z).alias("outstanding_units"))


def member_open_loans(l: Lending) -> DataFrame:
    """Outstanding loans per member, newest first. Sorted globally by
    (member, borrow date) so a busy member spans several range partitions."""
    return (tx_outstanding(l)
            .orderBy(F.col("user_id"), F.col("borrow_date").desc_nulls_first(), F.col("tx_id")))


def admin_dashboard(l: Lending, as_of: dt.date) -> DataFrame:
    """A5: the nine dashboard counts as (metric, value) rows. Each table is read
    once with conditional counts; the small per-table results are unioned."""
    roles = l.roles.select(F.col("id").alias("_rid"), F.col("name").alias("_role"))
    per_role = (l.users.groupBy("role_id", "member_type").agg(F.count(F.lit(1)).alias("n")))
    pr = per_role.join(roles, per_role["role_id"] == roles["_rid"], "left")
    users_m = pr.agg(
        F.sum("n").alias("users_total"),
        F.sum(F.when(F.col("member_type") == "student", F.col("n"))).alias("users_student"),
        F.sum(F.when(F.col("_role") == "staff", F.col("n"))).alias("users_staff"),
        F.sum(F.when(F.col("_role") == "admin", F.col("n"))).alias("users_admin"))
    inv_m = l.inventory.agg(F.count(F.when(F.col("active"), 1)).alias("inv_active"))
    item_ids = l.inventory.select(F.col("id").alias("_iid"))
    loans = with_returned(open_loans(l), l.transaction_returns)
    loans = loans.join(item_ids, loans["inventory_id"] == item_ids["_iid"], "left_semi")
    age = loan_age(as_of)
    loan_m = loans.agg(
        F.count(F.when(F.col("remaining") > 0, 1)).alias("outstanding"),
        F.count(F.when(age.between(2, 6), 1)).alias("overdue_2_6"),
        F.count(F.when(age >= 7, 1)).alias("overdue_7_plus"))
    hold_m = active_holds(l).agg(F.count(F.lit(1)).alias("holds"))

    def longform(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("value"))
            for c in df.columns])).alias("m")).select("m.*")

    return (longform(users_m).unionByName(longform(inv_m)).unionByName(longform(loan_m))
            .unionByName(longform(hold_m)))
