"""Registration intake (R1), inventory and role change sets (R4, R12, S5),
deletes and archives (S6, S7), backfills (S8) and seed rows (S2)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kitlend.operators.balances import inventory_available
from kitlend.operators.notify import ts_lit
from kitlend.sources.fixtures import Lending

# Fixed intake patterns; the student mail domain is a parameter.
STUDENT_ID_RE = r"^[0-9]{12}$"
CITIZEN_ID_RE = r"^[0-9]{13}$"
DEFAULT_MAIL_DOMAIN = "@mail.example.edu"


def _roles_by_name(l: Lending) -> DataFrame:
    # A dimension of a few rows; AQE broadcasts it after measuring it.
    return l.roles.select(F.col("id").alias("_role_id"), F.col("name").alias("_role"))


def _first_two(und: DataFrame, key: str) -> DataFrame:
    """_k, _f, _s: the two earliest undecided rows of each key."""
    first = und.groupBy(F.col(key).alias("_k")).agg(F.min("_me").alias("_f"))
    rest = und.join(first, und[key] == first["_k"]).where(F.col("_me") != F.col("_f"))
    second = rest.groupBy(F.col("_k").alias("_k2")).agg(F.min("_me").alias("_s"))
    return first.join(second, first["_k"] == second["_k2"], "left").drop("_k2")


def _chains(marked: DataFrame) -> DataFrame:
    """req_id, take for the rows of pure chains that hang on an accepted row.

    A pure row has exactly one earlier undecided row to share a key with, so it
    is taken just if that one is refused: its fate is the parity of its distance
    from the chain's first row, found by pointer jumping in a logarithmic number
    of joins.
    """
    links = marked.where(F.col("_prev").isNotNull()).select(
        "req_id", F.col("_prev.req_id").alias("_to"), F.lit(1).alias("_odd")).checkpoint(eager=True)
    while True:
        ahead = links.select(F.col("req_id").alias("_at"), F.col("_to").alias("_to2"), F.col("_odd").alias("_odd2"))
        jumped = links.join(ahead, links["_to"] == ahead["_at"], "left")
        if jumped.where(F.col("_at").isNotNull()).isEmpty():
            break
        links = jumped.select("req_id", F.coalesce("_to2", "_to").alias("_to"),
                              F.when(F.col("_at").isNull(), F.col("_odd"))
                              .otherwise((F.col("_odd") + F.col("_odd2")) % 2).alias("_odd")).checkpoint(eager=True)
    roots = marked.where("_root").select(F.col("req_id").alias("_rid"))
    return links.join(roots, links["_to"] == roots["_rid"], "left_semi").select(
        "req_id", (F.col("_odd") == 0).alias("take"))


def register_members(l: Lending, regs: DataFrame, mail_domain: str = DEFAULT_MAIL_DOMAIN) -> DataFrame:
    """Intake of a registration batch, arrival order (ts, req_id).

    Row rules (missing fields, mail domain for students, 12/13-digit ids),
    then keys already used by a stored member (case-blind e-mail, the id, or
    the QR value), then first-wins inside the batch on two keys (case-blind
    e-mail and id). A refused row frees its keys, so the batch is decided in
    rounds: a row first among undecided rows on both keys is accepted, pure chains
    behind such rows are decided by parity (``_chains``), and rows sharing a key
    with an accepted one are refused. A chain of any length takes one round.
    Round state is checkpointed to cut lineage."""
    spark = regs.sparkSession
    kind = F.col("kind")
    id_value = F.when(kind == "student", F.col("student_id")).otherwise(F.col("citizen_id"))
    email = F.col("email")
    rule = (F.when(email.isNull() | (email == "") | F.col("full_name").isNull(), "missing")
            .when(kind.isNull() | ~kind.isin("student", "external"), "kind")
            .when((kind == "student") & ~email.endswith(mail_domain), "email_domain")
            .when((kind == "student") & ~F.coalesce(F.col("student_id"), F.lit("")).rlike(STUDENT_ID_RE),
                  "student_id_format")
            .when((kind == "external") & ~F.coalesce(F.col("citizen_id"), F.lit("")).rlike(CITIZEN_ID_RE),
                  "citizen_id_format"))
    r = regs.select("*", email.alias("_email"), F.lower(email).alias("_ek"), id_value.alias("_ik"),
                    rule.alias("_rule"))
    u = l.users
    used_e = u.select(F.lower(F.col("email")).alias("_k"))
    used_i = (u.select(F.col("student_id").alias("_k")).unionByName(u.select(F.col("citizen_id").alias("_k")))
              .unionByName(u.select(F.col("qr_code_value").alias("_k"))).where(F.col("_k").isNotNull()))
    r = (r.join(used_e.distinct().withColumn("_te", F.lit(True)), r["_ek"] == F.col("_k"), "left").drop("_k")
         .join(used_i.distinct().withColumn("_ti", F.lit(True)), r["_ik"] == F.col("_k"), "left").drop("_k"))
    pre = F.coalesce(F.col("_rule"), F.when(F.col("_te") | F.col("_ti"), F.lit("taken")))
    r = r.withColumn("_pre", pre)

    und = r.where(F.col("_pre").isNull()).select("req_id", "ts", "_ek", "_ik").checkpoint(eager=True)
    und = und.withColumn("_me", F.struct("ts", "req_id"))
    decided_parts = []
    while not und.isEmpty():
        e, i = _first_two(und, "_ek"), _first_two(und, "_ik")
        j = (und.join(e.withColumnsRenamed({"_k": "_k1", "_f": "_fe", "_s": "_se"}), und["_ek"] == F.col("_k1"))
             .join(i.withColumnsRenamed({"_k": "_k2", "_f": "_fi", "_s": "_si"}), und["_ik"] == F.col("_k2")))
        first_e, first_i = F.col("_me") == F.col("_fe"), F.col("_me") == F.col("_fi")
        prev = (F.when(first_i & (F.col("_me") == F.col("_se")), F.col("_fe"))
                .when(first_e & (F.col("_me") == F.col("_si")), F.col("_fi")))
        marked = j.select("req_id", "_ek", "_ik", (first_e & first_i).alias("_root"),
                          prev.alias("_prev")).checkpoint(eager=True)
        fates = _chains(marked)
        acc = marked.where("_root").select("req_id", "_ek", "_ik").unionByName(
            marked.join(fates.where("take"), "req_id", "left_semi").select("req_id", "_ek", "_ik")).checkpoint(eager=True)
        rest = und.join(acc.select("req_id"), "req_id", "left_anti")
        hit_e = acc.select(F.col("_ek").alias("_he")).distinct()
        hit_i = acc.select(F.col("_ik").alias("_hi")).distinct()
        blocked = (rest.join(hit_e, rest["_ek"] == hit_e["_he"], "left")
                   .join(hit_i, rest["_ik"] == hit_i["_hi"], "left")
                   .where(F.col("_he").isNotNull() | F.col("_hi").isNotNull()).select("req_id")).checkpoint(eager=True)
        decided_parts += [acc.select("req_id", F.lit(None).cast("string").alias("_batch")),
                          blocked.select("req_id", F.lit("taken_in_batch").alias("_batch"))]
        und = rest.join(blocked, "req_id", "left_anti").checkpoint(eager=True)

    if decided_parts:
        decided = decided_parts[0]
        for p in decided_parts[1:]:
            decided = decided.unionByName(p)
    else:
        decided = spark.createDataFrame([], "req_id " + dict(regs.dtypes)["req_id"] + ", _batch string")
    out = r.join(decided, "req_id", "left")
    reason = F.coalesce(F.col("_pre"), F.col("_batch"))
    roles = _roles_by_name(l)
    out = out.join(roles, F.col("kind") == F.col("_role"), "left")
    ok = reason.isNull()
    return out.select(
        "req_id", "kind", F.col("_email").alias("email"), ok.alias("accepted"), reason.alias("reason"),
        F.when(ok, F.col("_role_id")).alias("role_id"),
        F.when(ok, F.col("_ik")).alias("qr_code_value"),
        F.when(ok & (kind == "student"), F.sha2(F.col("student_id"), 256)).alias("student_id_hash"))


def check_inventory_changes(l: Lending, changes: DataFrame) -> DataFrame:
    """Create (id NULL) or edit item rows, checked against the stored
    snapshot: name given and stock >= 0; edit of an unknown id; stock below
    the units out; name (case-blind) used by another item. Inside the batch a
    second change to one id is refused, then a second use of one name by the
    rows left. The checked rows are stored once; both rules read them."""
    name = F.trim(F.coalesce(F.col("name"), F.lit("")))
    c = changes.select("*", name.alias("_name"), F.lower(name).alias("_lname"))
    avail = inventory_available(l).select(F.col("id").alias("_iid"), F.col("outstanding_in_use").alias("_out"))
    names = l.inventory.select(F.lower(F.col("item_name")).alias("_lk"), F.col("id").alias("_owner"))
    owners = names.groupBy("_lk").agg(F.min("_owner").alias("_o1"), F.max("_owner").alias("_o2"),
                                      F.count(F.lit(1)).alias("_on"))
    c = (c.join(avail, c["id"] == avail["_iid"], "left")
         .join(owners, c["_lname"] == owners["_lk"], "left"))
    create = F.col("id").isNull()
    taken_by_other = F.col("_lk").isNotNull() & (
        create | (F.col("_on") > 1) | (F.col("_o1") != F.col("id")))
    reason = (F.when((F.col("_name") == "") | F.col("stock").isNull() | (F.col("stock") < 0), "invalid")
              .when(~create & F.col("_iid").isNull(), "not_found")
              .when(~create & (F.col("stock") < F.col("_out")), "below_in_use")
              .when(taken_by_other, "name_taken"))
    c = c.select("req_id", "id", "_name", "_lname", "stock", "active", reason.alias("_r")).checkpoint(eager=True)
    ok = c.where(F.col("_r").isNull())
    first_id = (ok.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("_fid"))
                .agg(F.min("req_id").alias("_first_id")))
    c = c.join(first_id, c["id"] == first_id["_fid"], "left").withColumn(
        "_r", F.coalesce("_r", F.when(F.col("req_id") != F.col("_first_id"), "duplicate_change"))).drop(
        "_fid", "_first_id").checkpoint(eager=True)
    first_name = (c.where(F.col("_r").isNull()).groupBy(F.col("_lname").alias("_fn"))
                  .agg(F.min("req_id").alias("_first_name")))
    c = c.join(first_name, c["_lname"] == first_name["_fn"], "left")
    batch = F.coalesce("_r", F.when(F.col("req_id") != F.col("_first_name"), "name_taken_in_batch"))
    return c.select("req_id", "id", F.col("_name").alias("name"), "stock", "active",
                    batch.isNull().alias("accepted"), batch.alias("reason"))


def apply_inventory_changes(l: Lending, checked: DataFrame) -> DataFrame:
    """The new inventory snapshot: accepted edits overwrite name, stock and
    active; accepted creates are appended with ``id`` NULL (the sink assigns
    ids); other rows are unchanged."""
    acc = checked.where(F.col("accepted")).checkpoint(eager=True)
    edits = acc.where(F.col("id").isNotNull()).select(
        F.col("id").alias("_eid"), F.col("name").alias("_n"), F.col("stock").alias("_s"),
        F.col("active").alias("_a"))
    inv = l.inventory
    j = inv.join(edits, inv["id"] == edits["_eid"], "left")
    hit = F.col("_eid").isNotNull()
    kept = j.select("id",
                    F.when(hit, F.col("_n")).otherwise(F.col("item_name")).alias("item_name"),
                    F.when(hit, F.col("_s")).otherwise(F.col("stock")).alias("stock"),
                    F.when(hit, F.col("_a")).otherwise(F.col("active")).alias("active"),
                    "deleted_at", hit.alias("changed"))
    created = acc.where(F.col("id").isNull()).select(
        F.lit(None).cast(inv.schema["id"].dataType).alias("id"), F.col("name").alias("item_name"),
        "stock", F.lit(True).alias("active"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
        F.lit(True).alias("changed"))
    return kept.unionByName(created)


def apply_role_changes(l: Lending, changes: DataFrame) -> DataFrame:
    """Set role and member type together; the role name (case-folded)
    must exist; an unknown member changes nothing; the first valid change per
    member (by request id) wins."""
    c = changes.withColumn("_rn", F.lower(F.trim(F.col("role"))))
    roles = _roles_by_name(l)
    u = l.users.select(F.col("id").alias("_uid"), F.col("role_id").alias("_old_role"),
                       F.col("member_type").alias("_old_type"))
    known = c.join(roles, c["_rn"] == roles["_role"])
    first = known.groupBy(F.col("user_id").alias("_fu")).agg(F.min("req_id").alias("_first"))
    j = (c.join(roles, c["_rn"] == roles["_role"], "left")
         .join(u, c["user_id"] == u["_uid"], "left")
         .join(first, c["user_id"] == first["_fu"], "left"))
    outcome = (F.when(F.col("_role_id").isNull(), "role_not_found")
               .when(F.col("_uid").isNull(), "not_found")
               .when(F.col("req_id") != F.col("_first"), "duplicate_change")
               .otherwise("role_updated"))
    ok = outcome == "role_updated"
    return j.select("req_id", "user_id", "role", outcome.alias("outcome"),
                    F.when(ok, F.col("_role_id")).otherwise(F.col("_old_role")).alias("role_id"),
                    F.when(ok, F.col("_rn")).otherwise(F.col("_old_type")).alias("member_type"))


def delete_users(l: Lending, requests: DataFrame) -> DataFrame:
    """A member with loans or visits cannot be deleted (no cascade there);
    otherwise the member goes with their notifications and holds (cascade)."""
    req = requests.select("user_id").distinct()
    u = l.users.select(F.col("id").alias("_uid"))
    loans = l.transactions.select(F.col("user_id").alias("_lu")).distinct()
    visits = l.fitness_visits.select(F.col("user_id").alias("_vu")).distinct()
    notes = l.notifications.groupBy(F.col("user_id").alias("_nu")).agg(F.count(F.lit(1)).alias("_nn"))
    holds = l.user_holds.groupBy(F.col("user_id").alias("_hu")).agg(F.count(F.lit(1)).alias("_hn"))
    j = (req.join(u, req["user_id"] == u["_uid"], "left")
         .join(loans, req["user_id"] == loans["_lu"], "left")
         .join(visits, req["user_id"] == visits["_vu"], "left")
         .join(notes, req["user_id"] == notes["_nu"], "left")
         .join(holds, req["user_id"] == holds["_hu"], "left"))
    outcome = (F.when(F.col("_uid").isNull(), "not_found")
               .when(F.col("_lu").isNotNull(), "refused_loans")
               .when(F.col("_vu").isNotNull(), "refused_visits")
               .otherwise("deleted"))
    gone = outcome == "deleted"
    z = F.lit(0).cast("bigint")
    return j.select("user_id", outcome.alias("outcome"),
                    F.when(gone, F.coalesce(F.col("_nn"), z)).otherwise(z).alias("notifications_removed"),
                    F.when(gone, F.coalesce(F.col("_hn"), z)).otherwise(z).alias("holds_removed"))


def delete_or_archive_items(l: Lending, requests: DataFrame, at: dt.datetime) -> DataFrame:
    """Delete an item; when loans reference it, archive it instead
    (inactive, ``deleted_at`` kept if already set)."""
    req = requests.select("id").distinct()
    inv = l.inventory.select(F.col("id").alias("_iid"), "active", "deleted_at")
    used = l.transactions.select(F.col("inventory_id").alias("_used")).distinct()
    j = (req.join(inv, req["id"] == inv["_iid"], "left")
         .join(used, req["id"] == used["_used"], "left"))
    outcome = (F.when(F.col("_iid").isNull(), "not_found")
               .when(F.col("_used").isNotNull(), "archived").otherwise("deleted"))
    arch = outcome == "archived"
    return j.select("id", outcome.alias("outcome"),
                    F.when(arch, F.lit(False)).otherwise(F.col("active")).alias("active"),
                    F.when(arch, F.coalesce(F.col("deleted_at"), ts_lit(at)))
                    .otherwise(F.col("deleted_at")).alias("deleted_at"))


def backfill_created_date(l: Lending) -> DataFrame:
    """Fill a missing notification day from its creation time."""
    n = l.notifications
    miss = F.col("created_date").isNull()
    return n.select("id", F.coalesce(F.col("created_date"), F.to_date("created_at")).alias("created_date"),
                    miss.alias("backfilled"))


def backfill_student_hash(l: Lending) -> DataFrame:
    """SHA-256 hex of the student id where the hash is missing (students only)."""
    u = l.users
    fill = ((F.col("member_type") == "student") & F.col("student_id").isNotNull()
            & F.col("student_id_hash").isNull())
    return u.select("id", F.when(fill, F.sha2(F.col("student_id"), 256))
                    .otherwise(F.col("student_id_hash")).alias("student_id_hash"),
                    fill.alias("backfilled"))


# Fixed seed rows of the reference's setup script.
SEED_ROLES = ("student", "external", "staff", "admin")
SEED_USERS = (("staff", "staff@example.com", "Staff User"), ("admin", "admin@example.com", "Admin User"))


def seed_missing(l: Lending) -> DataFrame:
    """Seed rows an idempotent insert would add: roles missing by name, seed
    staff and admin users missing by e-mail (anti joins, then append)."""
    spark = l.users.sparkSession
    roles = spark.createDataFrame([(n,) for n in SEED_ROLES], "name string")
    missing_roles = roles.join(l.roles.select("name"), "name", "left_anti").select(
        F.lit("roles").alias("table"), F.col("name").alias("key"), F.lit(None).cast("string").alias("role"))
    users = spark.createDataFrame(list(SEED_USERS), "role string, email string, full_name string")
    missing_users = users.join(l.users.select("email"), "email", "left_anti").select(
        F.lit("users").alias("table"), F.col("email").alias("key"), "role")
    return missing_roles.unionByName(missing_users).withColumnRenamed("table", "target")
