"""Lending tables derived from the driver's TPC-H-like tables (FIXTURES.md section 3).

The mapped tables stand in for stored ones. Each is a lazy projection over the
driver's parquet files, so a query scans only the columns and rows it needs.
Bulk job inputs are lazy frames over the same files. Stand-in inputs only shape
rows into the schema a job expects; none of them does the job's work.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed as-of date of the fixtures: four days after the last order date.
AS_OF = dt.date(2001, 8, 5)

def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _date(text: str) -> Column:
    return F.lit(text).cast("date")


def _at_day_offset(day_col: Column, days: Column | int) -> Column:
    days = days if isinstance(days, Column) else F.lit(days)
    return F.date_add(day_col, days.cast("int")).cast("timestamp_ntz")


def _member_type(seg: Column, key: Column) -> Column:
    return (F.when(seg == "MACHINERY", F.when(key % 10 == 0, "admin").otherwise("staff"))
            .when(seg == "FURNITURE", "external")
            .otherwise("student"))


def _role_id(member_type: Column) -> Column:
    return (F.when(member_type == "student", 1).when(member_type == "external", 2)
            .when(member_type == "staff", 3).otherwise(4))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    key, seg = F.col("c_custkey"), F.col("c_mktsegment")
    mt = _member_type(seg, key)
    student_id = F.when(mt == "student", F.lpad(key.cast("string"), 12, "0"))
    citizen_id = F.when(mt == "external", F.lpad(key.cast("string"), 13, "9"))
    return c.select(
        key.alias("id"),
        _role_id(mt).cast("int").alias("role_id"),
        mt.alias("member_type"),
        F.concat(F.lit("M"), key.cast("string"), F.lit("@mail.example.edu")).alias("email"),
        student_id.alias("student_id"),
        citizen_id.alias("citizen_id"),
        F.col("c_name").alias("full_name"),
        F.when(mt == "student", seg).alias("faculty"),
        F.lit(None).cast("string").alias("phone"),
        F.coalesce(student_id, citizen_id).alias("qr_code_value"),
        _at_day_offset(_date("2000-01-01"), key % 365).alias("created_at"),
        F.when((mt == "student") & (key % 3 != 0), F.sha2(student_id, 256)).alias("student_id_hash"),
    )


def roles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(1, "student"), (2, "external"), (3, "staff"), (4, "admin")], "id int, name string")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    promo = F.col("p_type") == "PROMO"
    return p.select(
        F.col("p_partkey").alias("id"),
        F.concat_ws(" ", "p_name", "p_brand", F.col("p_partkey").cast("string")).alias("item_name"),
        (F.col("p_size") * 10).cast("int").alias("stock"),
        (~promo).alias("active"),
        F.when(promo & (F.col("p_size") > 40), _ts("2001-01-01 00:00:00")).alias("deleted_at"),
    )


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables as a file stream."""
    return (spark.readStream.schema(_read(spark, sf_dir, name).schema)
            .option("pathGlobFilter", f"{name}*.parquet").parquet(sf_dir))


def _order_lines(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """lineitem (or a stream of it) joined to its order, with the five-part line id."""
    li = (_read(spark, sf_dir, "lineitem") if lineitem is None else lineitem).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_returnflag", "l_linestatus", "l_shipdate")
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    qty = F.col("l_quantity").cast("int")
    lines = (li.join(o, li.l_orderkey == o.o_orderkey)
             .withColumn("qty", qty)
             .withColumn("line_id", F.concat_ws(
                 "-", *[F.col(c).cast("string") for c in
                        ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], qty.cast("string"))))
    return lines


def _loan_lines(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    lines = _order_lines(spark, sf_dir, lineitem).where(F.col("l_returnflag") != "R")
    is_open = F.col("l_linestatus") == "O"
    return lines.select(
        "*",
        is_open.alias("_open"),
        F.to_date("o_orderdate").alias("borrow_date"),
    )


def transactions(spark: SparkSession, sf_dir: str, open_only: bool = False) -> DataFrame:
    ll = _loan_lines(spark, sf_dir)
    if open_only:  # return_date IS NULL, as a filter that reaches the scan
        status = F.col("l_linestatus")
        ll = ll.where((status == "O") | status.isNull() | F.col("l_shipdate").isNull())
    is_open = F.col("_open")
    return ll.select(
        F.col("line_id").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("inventory_id"),
        F.col("qty"),
        F.col("borrow_date"),
        F.when(~is_open, F.col("l_shipdate")).alias("return_date"),
        F.when(F.col("l_linenumber") != 7,
               F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.col("l_linenumber")))
        .alias("created_at"),
        F.when(is_open & (F.col("l_returnflag") == "N") & (F.col("l_suppkey") % 4 == 0),
               F.col("l_shipdate")).alias("escalated_at"),
        F.when(is_open & (F.col("l_returnflag") == "A") & (F.col("l_linenumber") <= 5),
               F.to_date("l_shipdate")).alias("promised_return_date"),
    )


def transaction_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed loans: one row of qty. Open loans with suppkey % 3 = 0 and qty >= 2:
    half, and when suppkey % 5 = 1 also the rest (open with nothing left)."""
    ll = _loan_lines(spark, sf_dir)
    is_open, supp, qty = F.col("_open"), F.col("l_suppkey"), F.col("qty")
    half = F.floor(qty / 2).cast("int")
    n_rows = (F.when(~is_open, 1)
              .when((supp % 3 == 0) & (qty >= 2), F.when(supp % 5 == 1, 2).otherwise(1))
              .otherwise(0))
    rows = ll.where(n_rows > 0).select(
        "line_id", "qty", "borrow_date", "l_shipdate", is_open.alias("o"),
        F.explode(F.sequence(F.lit(1), n_rows)).alias("n"))
    return rows.select(
        F.concat(F.col("line_id"), F.lit("-"), F.col("n").cast("string")).alias("id"),
        F.col("line_id").alias("transaction_id"),
        F.when(~F.col("o"), qty).when(F.col("n") == 1, half).otherwise(qty - half)
        .cast("int").alias("return_qty"),
        F.when(~F.col("o"), F.col("l_shipdate"))
        .otherwise(_at_day_offset(F.col("borrow_date"), F.col("n"))).alias("returned_at"),
        F.when(F.col("o"), F.when(F.col("n") == 1, "part").otherwise("rest")).alias("note"),
    )


def user_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.where((F.col("c_acctbal") < 0) | (key % 7 == 0)).select(
        key.alias("id"), key.alias("user_id"), F.lit("overdue").alias("reason"),
        _ts("2001-07-01 00:00:00").alias("created_at"),
        F.when(key % 2 == 0, _ts("2001-07-15 00:00:00")).alias("cleared_at"),
    )


def fitness_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    u = users(spark, sf_dir).select(F.col("id").alias("uid"), "member_type")
    j = e.join(u, e.user_id == u.uid).where(F.col("member_type").isin("student", "external"))
    return j.select(
        F.col("event_id").alias("id"), "user_id",
        F.to_date("ts").alias("visit_date"),
        F.when(F.col("member_type") == "student", 5).otherwise(30).cast("int").alias("amount"),
        F.when(F.col("event_id") % 2 == 0, "qr").otherwise("cash").alias("pay_method"),
        F.col("ts").alias("created_at"),
    )


# Fixed mapping of event types to notification types (FIXTURES.md section 3).
EVENT_NOTIFICATION_TYPES = {
    "click": "borrow_created",
    "view": "return_partial",
    "signup": "overdue_staff_2_6",
    "error": "overdue_staff",
    "purchase": "fitness_visit",
}


def _ref_meta(ref: Column) -> Column:
    return F.concat(F.lit('{"ref":"'), ref, F.lit('"}'))


def notifications(spark: SparkSession, sf_dir: str, events: DataFrame | None = None,
                  lineitem: DataFrame | None = None) -> DataFrame:
    """Notices from events and from first lines; both may be streams."""
    e = _read(spark, sf_dir, "events") if events is None else events
    mapping = F.create_map(*[F.lit(x) for kv in EVENT_NOTIFICATION_TYPES.items() for x in kv])
    ntype = mapping[F.col("event_type")]
    from_events = e.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
        "user_id",
        ntype.alias("type"),
        F.col("event_type").alias("title"),
        F.lit(None).cast("string").alias("message"),
        F.when(ntype != "fitness_visit", _ref_meta(F.get_json_object("props", "$.k"))).alias("meta"),
        F.col("ts").alias("created_at"),
        F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("read_at"),
        F.when(F.col("event_id") % 11 != 0, F.to_date("ts")).alias("created_date"),
        F.lit(None).cast("string").alias("audience"),
    )
    return from_events.unionByName(_loan_notices(spark, sf_dir, lineitem))


def _loan_notices(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None) -> DataFrame:
    """Notices of earlier runs about open loans: lines 1 told their member, lines
    2 the member as staff (2-6 days), lines 3 the staff audience (7+ days)."""
    n = F.col("l_linenumber")
    ll = _loan_lines(spark, sf_dir, lineitem).where(F.col("_open") & n.isin(1, 2, 3))
    at = _at_day_offset(F.col("borrow_date"), F.when(n == 1, 2).when(n == 2, 3).otherwise(7))
    none = F.lit(None)
    return ll.select(
        F.concat(F.when(n == 1, "os-").when(n == 2, "sl-").otherwise("sa-"), F.col("line_id")).alias("id"),
        F.when(n != 3, F.col("o_custkey")).alias("user_id"),
        F.when(n == 1, "overdue_student").when(n == 2, "overdue_staff_2_6").otherwise("overdue_staff").alias("type"),
        F.lit("overdue").alias("title"),
        none.cast("string").alias("message"),
        _ref_meta(F.col("line_id")).alias("meta"),
        at.alias("created_at"),
        none.cast("timestamp_ntz").alias("read_at"),
        F.to_date(at).alias("created_date"),
        F.when(n == 3, "staff").alias("audience"),
    )


def notification_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member of every second audience notice has read it."""
    ll = _loan_lines(spark, sf_dir).where(
        F.col("_open") & (F.col("l_linenumber") == 3) & (F.col("l_suppkey") % 2 == 0))
    return ll.select(F.concat(F.lit("sa-"), F.col("line_id")).alias("notification_id"),
                     F.col("o_custkey").alias("user_id"), _at_day_offset(F.col("borrow_date"), 8).alias("read_at"))


# ---------------------------------------------------------------- bulk inputs

def loan_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _order_lines(spark, sf_dir).where(F.col("l_returnflag") == "R")
    return lines.select(
        F.col("line_id").alias("req_id"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("inventory_id"),
        F.col("qty"),
        F.to_date("o_orderdate").alias("borrow_date"),
    )


def return_events(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Every line gives an event at the ship date with quantity (partkey % 5) * 4,
    zero meaning "all that is left"; suppkey % 6 = 0 adds a second event a day
    later without quantity. R-flag lines are not loans (unknown loan ids)."""
    lines = _order_lines(spark, sf_dir, lineitem)
    n = F.when(F.col("l_suppkey") % 6 == 0, 2).otherwise(1)
    rows = lines.select("line_id", "l_shipdate", "l_partkey",
                        F.explode(F.sequence(F.lit(1), n)).alias("n"))
    first = F.col("n") == 1
    return rows.select(
        F.concat(F.col("line_id"), F.when(first, "-a").otherwise("-b")).alias("event_id"),
        F.when(first, F.col("l_shipdate"))
        .otherwise(F.col("l_shipdate") + F.make_dt_interval(F.lit(1))).alias("ts"),
        F.col("line_id").alias("tx_id"),
        F.when(first, F.nullif(F.col("l_partkey") % 5, F.lit(0)) * 4).cast("int").alias("return_qty"),
        F.lit(None).cast("string").alias("note"),
    )


def scan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key % 5: 0 the member's code; 1 the code with dashes (NBSP-padded when the
    key is even); 2 a link with ?member=; 3 SHA-256 of the id; 4 no match."""
    u = users(spark, sf_dir)
    key = F.col("id")
    code = F.coalesce(F.col("qr_code_value"), key.cast("string"))
    dashed = F.concat_ws("-", F.substring(code, 1, 4), F.substring(code, 5, 4),
                         F.substring(code, F.lit(9), F.length(code)))
    nbsp = "\u00a0"
    raw = (F.when(key % 5 == 0, code)
           .when(key % 5 == 1, F.when(key % 2 == 0, F.concat(F.lit(nbsp), dashed, F.lit(" ")))
                 .otherwise(dashed))
           .when(key % 5 == 2, F.concat(F.lit("https://lend.example.org/return?member="), code))
           .when(key % 5 == 3, F.sha2(key.cast("string"), 256))
           .otherwise(F.concat(F.lit("X"), key.cast("string"), F.lit("Z"))))
    return u.select(key.alias("scan_id"), raw.alias("raw"))


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attempt per customer. Pairs of keys share an e-mail (2j, 2j+1), keys
    3k+1 and 3k+2 share a student id, 6k and 6k+3 share a citizen id; some
    reuse an existing member's e-mail in another case or break a format rule."""
    c = _read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    student = key % 3 != 0
    email = (F.when(key % 10 == 7, F.concat(F.lit("m"), (key - 7).cast("string"), F.lit("@mail.example.edu")))
             .otherwise(F.concat(F.lit("N"), F.floor(key / 2).cast("string"),
                                 F.when(key % 4 == 1, "@MAIL.EXAMPLE.EDU").otherwise("@mail.example.edu"))))
    student_id = F.when(student, F.when(key % 13 == 0, F.lpad(key.cast("string"), 11, "0"))
                        .otherwise(F.lpad((F.floor(key / 3) * 5).cast("string"), 12, "0")))
    citizen_id = F.when(~student, F.lpad(F.floor(key / 6).cast("string"), 13, "9"))
    return c.select(
        key.alias("req_id"),
        (_ts("2001-08-01 00:00:00") + F.make_dt_interval(F.lit(0), F.lit(0), (key % 97).cast("int")))
        .alias("ts"),
        F.when(key % 29 != 0, F.when(student, "student").otherwise("external")).alias("kind"),
        email.alias("email"),
        student_id.alias("student_id"),
        citizen_id.alias("citizen_id"),
        F.col("c_name").alias("full_name"),
        F.when(student, F.col("c_mktsegment")).alias("faculty"),
        F.lit(None).cast("string").alias("phone"),
    )


def visit_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    eid = F.col("event_id")
    return e.select(
        eid.alias("req_id"),
        F.when(eid % 17 == 0, F.col("user_id") + 1_000_000_000).otherwise(F.col("user_id")).alias("user_id"),
        (F.when(eid % 7 == 0, "staff").when(F.col("user_id") % 2 == 0, "student")
         .otherwise("external")).alias("member_type"),
        F.to_date("ts").alias("visit_date"),
        (F.when(eid % 4 == 0, "qr").when(eid % 4 == 1, "cash").when(eid % 4 == 3, "card"))
        .alias("pay_method"),
    )


def promise_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change for every line; lines of suppkey % 7 = 2 ask twice more, first
    with a bad date, then with a good one."""
    lines = _order_lines(spark, sf_dir)
    n = F.when(F.col("l_suppkey") % 7 == 2, 3).otherwise(1)
    rows = lines.select("line_id", "l_linenumber", "o_orderdate", F.explode(F.sequence(F.lit(1), n)).alias("n"))
    which = F.when(F.col("n") == 1, F.col("l_linenumber") % 3).when(F.col("n") == 2, 2).otherwise(1)
    date_text = (F.when(which == 0, F.lit(""))
                 .when(which == 1, F.date_format(F.date_add(F.to_date("o_orderdate"), 9 + F.col("n")), "yyyy-MM-dd"))
                 .otherwise(F.lit("5/8/2001")))
    return rows.select(F.concat(F.col("line_id"), F.lit("-p"), F.col("n").cast("string")).alias("req_id"),
                       F.col("line_id").alias("tx_id"), date_text.alias("date"))


def inventory_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    create = key % 4 == 0
    own_name = F.concat_ws(" ", "p_name", "p_brand", key.cast("string"))
    other_name = F.upper(F.concat_ws(" ", "p_name", "p_brand", (key + 1).cast("string")))
    return p.select(
        key.alias("req_id"),
        F.when(create, F.lit(None).cast("long"))
        .when(key % 9 == 1, key - 1).otherwise(key).alias("id"),
        F.when(create, F.col("p_name")).when(key % 5 == 0, other_name).otherwise(own_name).alias("name"),
        (F.col("p_size") * 10 - (key % 7) * 25).cast("int").alias("stock"),
        (key % 2 == 0).alias("active"),
    )


def role_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change for every customer; every third asks again, for another role."""
    c = _read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    names = F.array(F.lit("student"), F.lit("external"), F.lit("Staff"), F.lit("admin"), F.lit("owner"))
    role = lambda k: F.element_at(names, (k % 5 + 1).cast("int"))
    first = c.select(key.alias("req_id"), key.alias("user_id"), role(key).alias("role"))
    again = c.select((key + 1_000_000_000).alias("req_id"), key.alias("user_id"), role(key + 1).alias("role"))
    return first.unionByName(again.where(F.col("user_id") % 3 == 0))


def mark_read_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Viewers marking their borrow and return notices read, plus requests naming
    someone else's visit notices (user id + 1), which must change nothing, and
    members reading notices to all staff, who may or may not see them."""
    n = notifications(spark, sf_dir)
    own = n.where(F.col("type").isin("borrow_created", "return_partial")).select("id", "user_id")
    other = (n.where(F.col("type") == "fitness_visit")
             .select("id", (F.col("user_id") + 1).alias("user_id")))
    shared = n.where(F.col("audience").isNotNull()).select(
        "id", (F.conv(F.substring(F.md5("id"), 1, 7), 16, 10).cast("long") % 1500 + 1).alias("user_id"))
    return own.unionByName(other).unionByName(shared)


def manual_notice_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staff pressing "notify member" on every line (R lines are unknown loans);
    suppkey % 9 = 1 presses twice."""
    lines = _order_lines(spark, sf_dir)
    n = F.when(F.col("l_suppkey") % 9 == 1, 2).otherwise(1)
    rows = lines.select("line_id", F.explode(F.sequence(F.lit(1), n)).alias("n"))
    return rows.select(F.concat(F.col("line_id"), F.lit("-n"), F.col("n").cast("string")).alias("req_id"),
                       F.col("line_id").alias("tx_id"))


def escalation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staff marking the letter of every line as sent (R lines are unknown loans)."""
    lines = _order_lines(spark, sf_dir)
    return lines.select(F.col("line_id").alias("tx_id"))


def manual_hold_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staff clearing holds by hand for customers with a balance below -500."""
    c = _read(spark, sf_dir, "customer").where(F.col("c_acctbal") < -500)
    return c.select(F.col("c_custkey").alias("user_id"), F.lit("manual").alias("note"),
                    F.lit(1).alias("priority"),
                    F.concat(F.lit("hold-clear-"), F.col("c_custkey").cast("string")).alias("ref"))


def delete_user_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delete asked for every customer, and for unknown ids."""
    c = _read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    known = c.select(key.alias("user_id"))
    unknown = c.where(key % 26 == 0).select((key + 1_000_000_000).alias("user_id"))
    return known.unionByName(unknown)


def item_delete_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delete asked for every part, and for unknown ids."""
    p = _read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return (p.select(key.alias("id"))
            .unionByName(p.where(key % 12 == 0).select((key + 1_000_000_000).alias("id"))))


def item_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key % 3 requests to flip each part, and some for unknown ids."""
    p = _read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    known = p.where(key % 3 > 0).select(key.alias("id"), F.explode(F.sequence(F.lit(1), key % 3)).alias("n")).select("id")
    return known.unionByName(p.where(key % 12 == 0).select((key + 1_000_000_000).alias("id")))


def staff_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An account asked for in every customer's name: some e-mails are taken, pairs
    share one, and some roles don't exist."""
    c = _read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    names = F.array(*[F.lit(x) for x in ("staff", "Admin", "owner", "staff", "ADMIN", "external", "")])
    email = (F.when(key % 11 == 0, F.concat(F.lit("M"), key.cast("string"), F.lit("@mail.example.edu")))
             .otherwise(F.concat(F.lit(" s"), F.floor(key / 2).cast("string"), F.lit("@mail.example.edu "))))
    return c.select(key.alias("req_id"), F.when(key % 17 != 0, email).alias("email"),
                    F.concat(F.col("c_name"), F.lit(" ")).alias("full_name"),
                    F.element_at(names, (key % 7 + 1).cast("int")).alias("role"))


class Lending:
    """The lending tables. Each entry is a DataFrame or a zero-argument
    callable that builds it on first use, so a job analyses only the tables
    it reads."""

    NAMES = ("roles", "users", "inventory", "transactions", "transaction_returns",
             "fitness_visits", "notifications", "user_holds", "notification_reads")

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        if "notifications" in tables:  # nobody has read an audience notice yet
            tables.setdefault("notification_reads", lambda: self.notifications.where(F.lit(False)).select(
                F.col("id").alias("notification_id"), "user_id", "read_at"))
        missing = set(self.NAMES) - set(tables)
        if missing:
            raise ValueError(f"missing tables: {sorted(missing)}")
        self._tables = dict(tables)
        #: The ranked staff roster and its count, once a job has built it.
        self.roster: tuple[DataFrame, int] | None = None
        self._tables.setdefault("open_transactions", lambda: self.transactions.where(
            F.col("return_date").isNull()))

    def _get(self, name: str) -> DataFrame:
        v = self._tables[name]
        if not isinstance(v, DataFrame):
            v = self._tables[name] = v()
        return v

    roles = property(lambda self: self._get("roles"))
    users = property(lambda self: self._get("users"))
    inventory = property(lambda self: self._get("inventory"))
    transactions = property(lambda self: self._get("transactions"))
    transaction_returns = property(lambda self: self._get("transaction_returns"))
    fitness_visits = property(lambda self: self._get("fitness_visits"))
    notifications = property(lambda self: self._get("notifications"))
    user_holds = property(lambda self: self._get("user_holds"))
    notification_reads = property(lambda self: self._get("notification_reads"))
    # Open loans (``return_date IS NULL``); a stored layout partitioned by
    # open/closed supplies a pruned read here.
    open_transactions = property(lambda self: self._get("open_transactions"))


def lending(spark: SparkSession, sf_dir: str) -> Lending:
    """Lending tables mapped from the driver's tables in ``sf_dir`` (lazy)."""
    return Lending(
        roles=lambda: roles(spark), users=lambda: users(spark, sf_dir),
        inventory=lambda: inventory(spark, sf_dir), transactions=lambda: transactions(spark, sf_dir),
        open_transactions=lambda: transactions(spark, sf_dir, open_only=True),
        transaction_returns=lambda: transaction_returns(spark, sf_dir),
        fitness_visits=lambda: fitness_visits(spark, sf_dir),
        notifications=lambda: notifications(spark, sf_dir), user_holds=lambda: user_holds(spark, sf_dir),
        notification_reads=lambda: notification_reads(spark, sf_dir),
    )


def raw_lending(spark: SparkSession, sf_dir: str) -> Lending:
    """Tables as an import without constraints would bring them: every table also
    holds copies of some rows (by a key % 50 = 1) with broken values."""
    far = 1_000_000_000
    none = F.lit(None)

    def broken(df: DataFrame, number: Column, **values: Column) -> DataFrame:
        some = df.where(number % 50 == 1)
        return df.unionByName(some.withColumns({n: v.cast(df.schema[n].dataType) for n, v in values.items()}))

    def tail(c: str) -> Column:  # supplier key inside a line id
        return F.split_part(F.col(c), F.lit("-"), F.lit(4)).cast("long")
    k = F.col("id")
    l = lending(spark, sf_dir)
    return Lending(
        roles=lambda: spark.createDataFrame([(1, "student"), (2, "external"), (3, "staff"), (4, "admin"), (5, "staff"),
                                             (4, "a role with a long name"), (6, None)], "id int, name string"),
        users=lambda: broken(l.users, k, role_id=F.lit(9), member_type=F.lit("guest"), student_id=F.lit("12AB"),
                             full_name=F.repeat(F.lit("x"), 201), email=F.when(k % 100 != 1, F.col("email"))),
        inventory=lambda: broken(l.inventory, k, stock=F.lit(-5), active=none),
        transactions=lambda: broken(l.transactions, tail("id"), user_id=F.col("user_id") + far,
                                    inventory_id=F.col("inventory_id") + far, qty=F.lit(0)),
        transaction_returns=lambda: broken(l.transaction_returns, tail("id"), return_qty=F.lit(0), returned_at=none,
                                           transaction_id=F.concat(F.col("id"), F.lit("-x"))),
        fitness_visits=lambda: broken(l.fitness_visits, k, user_id=F.col("user_id") + far, pay_method=F.lit("card"), amount=none),
        notifications=lambda: broken(l.notifications, F.coalesce(F.expr("try_cast(substr(id, 2) as bigint)"), F.lit(0)),
                                     user_id=F.when(F.col("type") != "fitness_visit", F.col("user_id") + far), type=none),
        user_holds=lambda: broken(l.user_holds, k, user_id=F.col("user_id") + far, reason=none, cleared_at=none))
