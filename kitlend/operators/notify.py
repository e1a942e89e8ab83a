"""Overdue notification run, de-duplication, mail outbox, feeds and badges
(N1-N4, J10, K2, A9, S9, S10, F11, F12).

Staff fan-out is kept per loan: the 2-6 day staff notice reaches exactly one
staff member per loan and day (the unique (ref, type, day) rule lets the first
untold staff member through, so staff are told in rotation); the winner is
the smallest staff rank not yet told, found by a gap search over the told
ranks of that loan. The 7+ day notice reaches every staff member not yet told;
it is stored as one row a loan for the audience ``staff``, which stands for all
who had joined by its ``created_at``, instead of loans x staff pairs. De-duplication,
the staff feed, the badges and ``mark_read`` all read it so. The staff roster is broadcast
only after its size is counted against a bound.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kitlend.operators.history import ref_of
from kitlend.operators.balances import loan_age, open_loans
from kitlend.operators.overdue import overdue_2_6_days, overdue_7_plus
from kitlend.operators.ranking import global_rank, running_sum
from kitlend.sources.fixtures import Lending

# Fixed notification types and rules of the reference.
MEMBER_OVERDUE = "overdue_student"
STAFF_2_6 = "overdue_staff_2_6"
STAFF_7_PLUS = "overdue_staff"
DAILY_UNIQUE_TYPES = ("overdue_student", "overdue_faculty", "overdue_staff_2_6")
STAFF_ALLOWED_TYPES = ("overdue_staff", "overdue_staff_2_6")
STAFF_ROLES = ("staff", "admin")
STAFF_ALERT_EMAIL = "staff@example.com"
MAX_BROADCAST_STAFF = 200_000
MAX_BROADCAST_INSTANTS = 200_000
#: The audience of notices for all staff.
STAFF = "staff"


def run_timestamp(as_of: dt.date) -> dt.datetime:
    """The daily run fires at 08:00 Asia/Bangkok, 01:00 UTC of the as-of day."""
    return dt.datetime.combine(as_of, dt.time(1, 0))


def ts_lit(t: dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal (the tables keep wall-clock UTC without zone)."""
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def staff_roster(l: Lending) -> tuple[DataFrame, int]:
    """Staff and admin users with a rank by id, and their count.

    The count is the size check that allows broadcasting the roster; a roster
    over the bound is joined with a shuffle instead. It is counted and ranked once
    for a ``Lending``, which stands for one state of the tables.
    """
    if l.roster is None:
        l.roster = _ranked_staff(l)
    return l.roster


def _ranked_staff(l: Lending) -> tuple[DataFrame, int]:
    roles = l.roles.where(F.col("name").isin(*STAFF_ROLES)).select(F.col("id").alias("_rid"))
    staff = (l.users.join(roles, F.col("role_id") == F.col("_rid"), "left_semi")
             .select(F.col("id").alias("staff_id"), F.col("email").alias("staff_email"),
                     F.col("created_at").alias("joined")))
    n = staff.count()
    ranked = global_rank(staff, "staff_id", "staff_rank", partitions=max(1, -(-n // 100_000)))
    return (F.broadcast(ranked) if n <= MAX_BROADCAST_STAFF else ranked), n


def _int_str(c: Column) -> Column:
    return c.cast("string")


def overdue_candidates(l: Lending, as_of: dt.date) -> DataFrame:
    """One member notice and one staff notice per 2-6 day loan, one staff
    notice per 7+ day loan, before de-duplication. Member notices need the
    member to exist (the reference looks the member up first)."""
    users = l.users.select(F.col("id").alias("_uid"), "full_name", "email")
    d26 = overdue_2_6_days(l, as_of)
    d7 = overdue_7_plus(l, as_of)
    qty, days, item = _int_str(F.col("qty")), _int_str(F.col("days_overdue")), F.col("item_name")
    ref = F.col("tx_id")
    member = (d26.join(users, d26["user_id"] == users["_uid"])
              .select(F.lit("member_2_6").alias("kind"), ref.alias("ref"),
                      F.lit(MEMBER_OVERDUE).alias("type"), F.col("user_id").alias("recipient_id"),
                      F.col("email").alias("recipient_email"),
                      F.lit("Overdue equipment reminder").alias("title"),
                      F.concat(F.lit("Loan "), item, F.lit(" x "), qty, F.lit(" is "), days,
                               F.lit(" days overdue; please return it soon")).alias("message"),
                      "user_id", "item_name", "qty", "days_overdue"))
    staff26 = d26.select(
        F.lit("staff_2_6").alias("kind"), ref.alias("ref"), F.lit(STAFF_2_6).alias("type"),
        F.lit(None).cast(d26.schema["user_id"].dataType).alias("recipient_id"),
        F.lit(None).cast("string").alias("recipient_email"),
        F.lit("Loans 2-6 days overdue").alias("title"),
        F.concat(F.lit("A member has "), item, F.lit(" x "), qty, F.lit(" out for "), days,
                 F.lit(" days")).alias("message"),
        "user_id", "item_name", "qty", "days_overdue")
    d7u = d7.join(users, d7["user_id"] == users["_uid"], "left")
    who = F.coalesce(F.col("full_name"), _int_str(F.col("user_id")))
    staff7 = d7u.select(
        F.lit("staff_7_plus").alias("kind"), ref.alias("ref"), F.lit(STAFF_7_PLUS).alias("type"),
        F.lit(None).cast(d7.schema["user_id"].dataType).alias("recipient_id"),
        F.lit(None).cast("string").alias("recipient_email"),
        F.lit("Loans over 7 days overdue").alias("title"),
        F.concat(F.lit("Member "), who, F.lit(" has "), item, F.lit(" x "), qty, F.lit(" out for "),
                 days, F.lit(" days. Letter for the faculty: /reports/overdue/print?tx="), _encoded(ref)).alias("message"),
        "user_id", "item_name", "qty", "days_overdue")
    return member.unionByName(staff26).unionByName(staff7)


def _encoded(c: Column) -> Column:
    return F.replace(F.url_encode(c.cast("string")), F.lit("+"), F.lit("%20"))


def _meta() -> Column:
    """The JSON fields of a candidate's notice: a member's row leads to the
    loan in their history; a staff row tells the loan and links the member's
    history, over 7 days the letter too."""
    ref, kind = F.col("ref"), F.col("kind")
    loan = [ref.alias("ref"), ref.alias("tx_id")]
    told = [*loan, F.col("user_id").alias("user_id"), F.col("item_name").alias("item"), F.col("qty").alias("qty"),
            F.col("days_overdue").alias("days_overdue")]
    letter = F.concat(F.lit("/reports/overdue/print?tx="), _encoded(ref)).alias("print_url")
    history = F.concat(F.lit("/staff/history?member="), _encoded(F.col("user_id"))).alias("history_url")
    return (F.when(kind == "member_2_6", F.to_json(F.struct(*loan, F.concat(F.lit("/history#tx="), ref).alias("goto"))))
            .when(kind == "staff_2_6", F.to_json(F.struct(*told, history)))
            .otherwise(F.to_json(F.struct(*told, letter, history))))


def _stored_refs(l: Lending, ntype: str) -> DataFrame:
    n = l.notifications.where(F.col("type") == ntype)
    return n.select("user_id", ref_of(F.col("meta")).alias("ref"), "created_date", "created_at", "audience") \
        .where(F.col("ref").isNotNull())


#: Stands for a missing time: before all others.
NEVER = "0001-01-01 00:00:00"


def _since(c: Column) -> Column:
    return F.coalesce(c, F.lit(NEVER).cast("timestamp_ntz"))


def _joined_by(roster: DataFrame, instants: DataFrame) -> DataFrame:
    """at, joined_n: how many of the staff had joined by each of the instants (at)."""
    marks = instants.select("at", F.lit(0).alias("n"), F.lit(True).alias("mark"))
    staff = roster.select(_since(F.col("joined")).alias("at"), F.lit(1).alias("n"), F.lit(False).alias("mark"))
    return running_sum(marks.unionByName(staff), "at", "n", "joined_n").where("mark").select("at", "joined_n")


def untold_staff(l: Lending, s7: DataFrame) -> DataFrame:
    """Adds ``recipients``, the staff whom no 7+ day row has told of the loan in
    ``ref``, alone or by an audience row since they joined; rows without any go."""
    roster, n_staff = staff_roster(l)
    stored7 = _stored_refs(l, STAFF_7_PLUS)
    to_all = stored7.where(F.col("audience") == STAFF).groupBy(F.col("ref").alias("_r7")).agg(
        F.max("created_at").alias("_at7"))
    # Instants are few and shared by many loans, most loans have none: no loan is dealt by its instant.
    instants = to_all.select(F.col("_at7").alias("at")).where(F.col("at").isNotNull()).distinct().checkpoint(eager=True)
    joined = _joined_by(roster, instants)
    joined = F.broadcast(joined) if instants.count() <= MAX_BROADCAST_INSTANTS else joined
    reached = to_all.join(joined, F.col("_at7") == F.col("at"), "left").select(F.col("_r7").alias("_rj"), "joined_n")
    s7 = s7.join(reached, s7["ref"] == reached["_rj"], "left")
    alone = stored7.join(roster.select("staff_id", "joined"), stored7["user_id"] == F.col("staff_id"))
    alone = (alone.join(to_all, alone["ref"] == to_all["_r7"], "left")
             .where(F.col("_at7").isNull() | (F.col("joined") > F.col("_at7")))
             .select(F.col("ref").alias("_ra"), "staff_id").distinct()
             .groupBy("_ra").agg(F.count(F.lit(1)).alias("_n7")))
    told = F.coalesce(F.col("joined_n"), F.lit(0)) + F.coalesce(F.col("_n7"), F.lit(0))
    s7 = (s7.join(alone, s7["ref"] == alone["_ra"], "left")
          .withColumn("recipients", (F.lit(n_staff) - told).cast("bigint"))
          .where(F.col("recipients") > 0))
    return s7


def notification_dedupe(l: Lending, as_of: dt.date,
                        candidates: DataFrame | None = None) -> DataFrame:
    """The rows the run inserts, after the three uniqueness rules.

    - member notice: blocked for ever once the loan has one (K3);
    - 2-6 staff notice: blocked for the day once any row has (ref, type, day)
      (K1); else goes to the first staff member by id not yet told (K2);
    - 7+ staff notice: reaches each staff member not yet told (K2), alone or by
      an earlier audience row; one row per loan for the audience ``staff`` with
      ``recipients`` = how many it newly reaches.
    """
    c = candidates if candidates is not None else overdue_candidates(l, as_of)
    run_ts = run_timestamp(as_of)
    roster, _ = staff_roster(l)

    member = (c.where(F.col("kind") == "member_2_6")
              .join(_stored_refs(l, MEMBER_OVERDUE).select(F.col("ref").alias("_r")),
                    F.col("ref") == F.col("_r"), "left_anti")
              .withColumn("recipients", F.lit(1).cast("bigint")))

    s26 = c.where(F.col("kind") == "staff_2_6")
    stored26 = _stored_refs(l, STAFF_2_6)
    today = stored26.where(F.col("created_date") == F.lit(as_of)).select(F.col("ref").alias("_r"))
    s26 = s26.join(today, F.col("ref") == F.col("_r"), "left_anti")
    told = (stored26.join(roster, stored26["user_id"] == roster["staff_id"])
            .select(F.col("ref").alias("_tref"), "staff_rank").distinct())
    w = Window.partitionBy("_tref").orderBy("staff_rank")
    gaps = (told.withColumn("_j", F.row_number().over(w))
            .groupBy("_tref")
            .agg(F.min(F.when(F.col("staff_rank") != F.col("_j"), F.col("_j"))).alias("_gap"),
                 F.count(F.lit(1)).alias("_told")))
    s26 = (s26.join(gaps, s26["ref"] == gaps["_tref"], "left")
           .withColumn("_next", F.coalesce(F.col("_gap"), F.col("_told") + 1, F.lit(1))))
    s26 = (s26.join(roster, s26["_next"] == roster["staff_rank"])
           .withColumn("recipient_id", F.col("staff_id"))
           .withColumn("recipient_email", F.col("staff_email"))
           .withColumn("recipients", F.lit(1).cast("bigint")))

    s7 = c.where(F.col("kind") == "staff_7_plus")
    s7 = untold_staff(l, s7)

    def shown(rows: DataFrame) -> DataFrame:
        return rows.select("kind", "ref", "type", "recipient_id", "recipients", "title", "message", _meta().alias("meta"))
    out = shown(member).unionByName(shown(s26)).unionByName(shown(s7))
    return (out.withColumn("audience", F.when(F.col("kind") == "staff_7_plus", STAFF))
            .withColumn("created_at", ts_lit(run_ts))
            .withColumn("created_date", F.lit(as_of)))


def staff_rotation_schedule(l: Lending, start: dt.date, end: dt.date) -> DataFrame:
    """N2 over many days with no stored history (a backfill): the 2-6 day staff
    notice of a loan goes, on its k-th due day, to the k-th staff member by id
    (the daily rule lets one through per day; the once rule blocks those told).
    At most five rows per open loan; days outside [start, end] are dropped.
    Assumes the loans stay open over the window, as the overdue view does on
    each run day."""
    roster, _ = staff_roster(l)
    loans = open_loans(l).where(F.col("borrow_date").isNotNull())
    due = (loans.select(F.col("id").alias("ref"), "user_id", "borrow_date",
                        F.explode(F.sequence(F.lit(2), F.lit(6))).alias("days_overdue"))
           .withColumn("day", F.date_add(F.col("borrow_date"), F.col("days_overdue")))
           .where(F.col("day").between(F.lit(start), F.lit(end))))
    return (due.withColumn("k", (F.col("days_overdue") - 1).cast("int"))
            .join(roster, F.col("k") == roster["staff_rank"])
            .select("ref", "user_id", "day", "days_overdue",
                    F.col("staff_id").alias("recipient_id")))


def mail_outbox(l: Lending, as_of: dt.date, candidates: DataFrame | None = None) -> DataFrame:
    """Mail is not de-duplicated: every candidate mails on every run.
    Member notices go to the member's address; staff notices go to the run's
    staff audience (one row per notice with the audience's id and recipient
    count; ``staff_addresses`` holds its addresses) and to the fixed alert
    address."""
    c = candidates if candidates is not None else overdue_candidates(l, as_of)
    roster, _ = staff_roster(l)
    n_mail = roster.where(F.col("staff_email") != "").count()
    none = F.lit(None).cast("string")
    subject = (F.when(F.col("kind") == "member_2_6", F.lit("Overdue equipment reminder"))
               .when(F.col("kind") == "staff_2_6", F.lit("[Alert] 2-6 days overdue"))
               .otherwise(F.lit("[Alert] over 7 days overdue")))
    member = (c.where((F.col("kind") == "member_2_6") & (F.col("recipient_email") != ""))
              .select("kind", "ref", F.col("recipient_email").alias("to_address"),
                      F.lit("member").alias("audience"), none.alias("audience_id"), F.lit(1).cast("bigint").alias("recipients"),
                      subject.alias("subject"), F.col("message").alias("body")))
    staff = c.where(F.col("kind") != "member_2_6")
    staff_rows = staff.select("kind", "ref", F.lit(None).cast("string").alias("to_address"),
                              F.lit("staff").alias("audience"), F.lit(audience_id(as_of)).alias("audience_id"),
                              F.lit(n_mail).cast("bigint").alias("recipients"),
                              subject.alias("subject"), F.col("message").alias("body"))
    alert_rows = staff.select("kind", "ref", F.lit(STAFF_ALERT_EMAIL).alias("to_address"),
                              F.lit("alert").alias("audience"), none.alias("audience_id"),
                              F.lit(1).cast("bigint").alias("recipients"),
                              subject.alias("subject"), F.col("message").alias("body"))
    return (member.unionByName(staff_rows).unionByName(alert_rows)
            .withColumn("run_date", F.lit(as_of)))


def audience_id(as_of: dt.date) -> str:
    """Name of a run's staff audience."""
    return f"{STAFF}-{as_of.isoformat()}"


def staff_addresses(l: Lending, as_of: dt.date) -> DataFrame:
    """The addresses of a run's staff audience, one row a staff member with one."""
    roster, _ = staff_roster(l)
    return roster.where(F.col("staff_email") != "").select(
        F.lit(audience_id(as_of)).alias("audience_id"), "staff_id", F.col("staff_email").alias("to_address"),
        F.lit(as_of).alias("run_date"))


def write_outbox(outbox: DataFrame, path: str) -> None:
    """Sink: a second run on the same day replaces that day's partition only."""
    (outbox.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_date").parquet(path))


FEED_MAX = 100
POLL_OVERLAP_SECONDS = 5


def notification_feed(l: Lending, n: int = 20, staff_only: bool = False,
                      since: dt.datetime | None = None) -> DataFrame:
    """K2: newest n (at most 100) notifications per viewer, id breaking ties.
    With ``since`` (the poll cursor) only rows created at most 5 seconds
    before it are read, the overlap the client de-duplicates by id. Staff also
    see the audience notices since they joined, of which the newest n are enough
    for any of them. The rank filter plans as a WindowGroupLimit, so each map task
    keeps at most n rows per viewer before the shuffle."""
    n = min(n, FEED_MAX)
    notes = l.notifications
    if since is not None:
        notes = notes.where(F.col("created_at") >= ts_lit(since - dt.timedelta(seconds=POLL_OVERLAP_SECONDS)))
    if staff_only:
        notes = notes.where(F.col("type").isin(*STAFF_ALLOWED_TYPES))
    viewers = staff_roster(l)[0].select("staff_id", "joined")
    own = notes.where(F.col("audience").isNull() & F.col("user_id").isNotNull())
    if staff_only:
        own = own.join(viewers, own["user_id"] == F.col("staff_id"), "left_semi")
    return feed_of(viewers, own, newest_shared(notes, n), l.notification_reads, n)


FEED_COLUMNS = ["user_id", "id", "type", "title", "message", "meta", "created_at", "read_at"]


def newest_shared(notes: DataFrame, n: int) -> DataFrame:
    """The newest n notices to the staff audience."""
    return notes.where(F.col("audience") == STAFF).orderBy(F.col("created_at").desc_nulls_first(), "id").limit(n)


def newest_first():
    """A viewer's notifications in feed order."""
    return Window.partitionBy("user_id").orderBy(F.col("created_at").desc_nulls_first(), F.col("id"))


def feed_of(viewers: DataFrame, own: DataFrame, newest: DataFrame, reads: DataFrame, n: int) -> DataFrame:
    """The newest n of each viewer's own rows and, for staff (``staff_id``, ``joined``),
    of the newest audience notices (at most FEED_MAX)."""
    member_of = viewers.withColumn("_of", F.when(F.col("staff_id").isNotNull(), F.lit(STAFF)))
    shared = member_of.join(F.broadcast(newest), F.col("_of") == F.col("audience")).where(
        F.col("joined").isNull() | F.col("created_at").isNull() | (F.col("joined") <= F.col("created_at")))
    reads = reads.select(F.col("notification_id").alias("_nid"), F.col("user_id").alias("_nu"),
                         F.col("read_at").alias("_read")).distinct()
    shared = (shared.drop("user_id", "read_at", "_of", "audience").join(
        reads, (F.col("id") == F.col("_nid")) & (F.col("staff_id") == F.col("_nu")), "left")
        .withColumnsRenamed({"staff_id": "user_id", "_read": "read_at"}))
    return (own.select(*FEED_COLUMNS).unionByName(shared.select(*FEED_COLUMNS))
            .withColumn("pos", F.row_number().over(newest_first())).where(F.col("pos") <= n)
            .select("user_id", "pos", *FEED_COLUMNS[1:]))


def unread_badges(l: Lending) -> DataFrame:
    """Unread count per member with the 99+ cap on the badge text. For staff it
    includes the audience notices since they joined that they haven't read."""
    notes = l.notifications
    own = (notes.where(F.col("audience").isNull() & F.col("user_id").isNotNull()).groupBy("user_id")
           .agg(F.count(F.when(F.col("read_at").isNull(), 1)).alias("unread")))
    read = seen_audience(l, l.notification_reads).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return badges_of(staff_roster(l)[0], own, audience_marks(notes), read)


def audience_marks(notes: DataFrame) -> DataFrame:
    """at, n: how many notices went to the staff audience at each instant."""
    return (notes.where(F.col("audience") == STAFF).groupBy(_since(F.col("created_at")).alias("at"))
            .agg(F.count(F.lit(1)).alias("n")))


def seen_audience(l: Lending, reads: DataFrame) -> DataFrame:
    """notification_id, user_id of the reads of audience notices that the staff
    member can see, once each."""
    to_all = l.notifications.where(F.col("audience") == STAFF).select("id", "created_at")
    return (reads.select("notification_id", "user_id").distinct()
            .join(to_all, F.col("notification_id") == F.col("id"))
            .join(staff_roster(l)[0], F.col("user_id") == F.col("staff_id"))
            .where(F.col("joined").isNull() | (F.col("created_at") >= F.col("joined"))).select("notification_id", "user_id"))


def badges_of(roster: DataFrame, own: DataFrame, marks: DataFrame, read: DataFrame) -> DataFrame:
    """The badges of own unread rows (user_id, unread), the audience notices by instant
    (at, n) and those that each staff member has read (user_id, n)."""
    # how many notices were sent since each joined: one running sum over both, newest first
    marks = marks.select("at", "n").withColumn("staff_id", F.lit(None).cast(roster.schema["staff_id"].dataType))
    staff = roster.select(_since(F.col("joined")).alias("at"), F.lit(0).cast("long").alias("n"), "staff_id")
    seen = running_sum(marks.unionByName(staff), "at", "n", "unread", descending=True)
    shared = seen.where(F.col("staff_id").isNotNull() & (F.col("unread") > 0)).select(
        F.col("staff_id").alias("user_id"), "unread")
    members = roster.select(F.col("staff_id").alias("_s"))
    less = read.join(members, F.col("user_id") == F.col("_s"), "left_semi").select("user_id", (-F.col("n")).alias("unread"))
    total = (own.select("user_id", "unread").unionByName(shared).unionByName(less)
             .groupBy("user_id").agg(F.sum("unread").alias("unread")))
    u = F.col("unread")
    return total.select("user_id", "unread",
                        F.when(u > 99, "99+").when(u > 0, u.cast("string")).alias("badge"))


def mark_read(l: Lending, requests: DataFrame, at: dt.datetime) -> DataFrame:
    """The notifications after the requesters' own unread rows got a
    read_at; first write wins. All columns stay, and ``changed`` is added."""
    req = requests.select(F.col("id").alias("_rid"), F.col("user_id").alias("_ruid")).distinct()
    n = l.notifications
    j = n.join(req, (n["id"] == req["_rid"]) & (n["user_id"] == req["_ruid"]), "left")
    hit = F.col("_rid").isNotNull() & F.col("read_at").isNull()
    return j.withColumns({"changed": hit, "read_at": F.when(hit, ts_lit(at)).otherwise(F.col("read_at"))}).drop("_rid", "_ruid")


def read_audience(l: Lending, requests: DataFrame, at: dt.datetime) -> DataFrame:
    """N4 for audience notices: the ``notification_reads`` after the batch; a staff
    member's first reading of a notice that they can see counts."""
    roster, _ = staff_roster(l)
    shown = l.notifications.where(F.col("audience") == STAFF).select(F.col("id").alias("_nid"), "created_at")
    asked = requests.select(F.col("id").alias("notification_id"), "user_id").distinct()
    fresh = (asked.join(shown, F.col("notification_id") == F.col("_nid"))
             .join(roster, F.col("user_id") == F.col("staff_id"))
             .where(F.col("joined").isNull() | (F.col("created_at") >= F.col("joined")))
             .join(l.notification_reads.select(F.col("notification_id").alias("_on"), F.col("user_id").alias("_ou")),
                   (F.col("notification_id") == F.col("_on")) & (F.col("user_id") == F.col("_ou")), "left_anti"))
    return l.notification_reads.select("notification_id", "user_id", "read_at").unionByName(
        fresh.select("notification_id", "user_id", ts_lit(at).alias("read_at")))


def thai_date(c: Column) -> Column:
    """d/m/yyyy with the Buddhist-era year."""
    return F.concat_ws("/", F.dayofmonth(c).cast("string"), F.month(c).cast("string"),
                       (F.year(c) + 543).cast("string"))


def faculty_letters(l: Lending, as_of: dt.date) -> DataFrame:
    """One letter row per 7+ day loan, addressed to the member's faculty.
    Reads the loan columns it needs in the same pass (no re-join to loans)."""
    age = loan_age(as_of)
    d7 = open_loans(l).where(age >= 7)
    items = l.inventory.select(F.col("id").alias("_iid"), "item_name")
    u = l.users.select(F.col("id").alias("_uid"), "full_name", "email", "faculty")
    j = (d7.join(items, d7["inventory_id"] == items["_iid"])
         .join(u, d7["user_id"] == u["_uid"], "left"))
    return j.select(
        F.col("id").alias("tx_id"), F.coalesce(F.col("faculty"), F.lit("(unspecified)")).alias("faculty"),
        F.coalesce(F.col("full_name"), F.lit("-")).alias("full_name"),
        F.coalesce(F.col("email"), F.lit("-")).alias("email"),
        "item_name", "qty", thai_date(F.col("borrow_date")).alias("borrow_date_th"),
        age.alias("days_overdue"), F.col("escalated_at").isNotNull().alias("escalated"))


def write_letters(letters: DataFrame, path: str) -> None:
    letters.write.mode("overwrite").partitionBy("faculty").parquet(path)
