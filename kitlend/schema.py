"""Declared schemas of the lending tables and of the bulk-job inputs.

Ids are UUID text in a live system, and the stored tables (``STORED``) keep them
as text. The fixture tables keep the driver's number types; every operator is
agnostic to the id type.
"""

from pyspark.sql import types as T

S, L, I, B, D, TS = (T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(),
                     T.DateType(), T.TimestampNTZType())


def _st(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


ROLES = _st(("id", I, False), ("name", S, False))

USERS = _st(
    ("id", L, False), ("role_id", I, True), ("member_type", S, True), ("email", S, False),
    ("student_id", S, True), ("citizen_id", S, True), ("full_name", S, False),
    ("faculty", S, True), ("phone", S, True), ("qr_code_value", S, True),
    ("created_at", TS, True), ("student_id_hash", S, True),
)

INVENTORY = _st(("id", L, False), ("item_name", S, False), ("stock", I, False),
                ("active", B, False), ("deleted_at", TS, True))

TRANSACTIONS = _st(
    ("id", S, False), ("user_id", L, False), ("inventory_id", L, False), ("qty", I, False),
    ("borrow_date", D, True), ("return_date", TS, True), ("created_at", TS, True),
    ("escalated_at", TS, True), ("promised_return_date", D, True),
)

TRANSACTION_RETURNS = _st(("id", S, False), ("transaction_id", S, False),
                          ("return_qty", I, False), ("returned_at", TS, False),
                          ("note", S, True))

FITNESS_VISITS = _st(("id", L, False), ("user_id", L, False), ("visit_date", D, False),
                     ("amount", I, False), ("pay_method", S, True), ("created_at", TS, True))

NOTIFICATIONS = _st(
    ("id", S, False), ("user_id", L, True), ("type", S, False), ("title", S, True),
    ("message", S, True), ("meta", S, True), ("created_at", TS, True), ("read_at", TS, True),
    ("created_date", D, True), ("audience", S, True),
)
# A row with audience 'staff' and no user_id is for every staff member who had
# joined by its created_at; who has read it is kept here, one row a reader.
NOTIFICATION_READS = _st(("notification_id", S, False), ("user_id", L, False), ("read_at", TS, True))

USER_HOLDS = _st(("id", L, False), ("user_id", L, False), ("reason", S, False),
                 ("created_at", TS, False), ("cleared_at", TS, True))

# Bulk-job inputs (field lists of the request handlers).
LOAN_REQUESTS = _st(("req_id", S, False), ("ts", TS, False), ("user_id", L, True),
                    ("inventory_id", L, True), ("qty", I, True), ("borrow_date", D, True))
RETURN_EVENTS = _st(("event_id", S, False), ("ts", TS, False), ("tx_id", S, True),
                    ("return_qty", I, True), ("note", S, True))
SCAN_CODES = _st(("scan_id", L, False), ("raw", S, True))

TABLES = {
    "roles": ROLES, "users": USERS, "inventory": INVENTORY, "transactions": TRANSACTIONS,
    "transaction_returns": TRANSACTION_RETURNS, "fitness_visits": FITNESS_VISITS,
    "notifications": NOTIFICATIONS, "user_holds": USER_HOLDS,
    "notification_reads": NOTIFICATION_READS,
}

# Stored form: every id but that of a role is text, as UUIDs are.
_ID_COLUMNS = {"id", "user_id", "inventory_id", "transaction_id", "notification_id"}
STORED = {name: T.StructType([
    T.StructField(f.name, S if f.name in _ID_COLUMNS and name != "roles" else f.dataType, f.nullable)
    for f in table.fields]) for name, table in TABLES.items()}
