"""Constraint audits."""

from __future__ import annotations

from kitlend.operators import audit as AU
from kitlend.plans.catalog import register
from kitlend.plans.q_balances import oracle
from kitlend.sources.fixtures import lending, raw_lending

# The tables with broken copies of some rows, under the names r_<table>.
RAW = {
    "r_roles": """
  SELECT CAST(id AS INTEGER) AS id, name FROM (VALUES (1, 'student'), (2, 'external'), (3, 'staff'), (4, 'admin'), (5, 'staff'),
    (4, 'a role with a long name'), (6, NULL)) r(id, name)""",
    "r_users": """
  SELECT * FROM users UNION ALL BY NAME
  SELECT * REPLACE (9 AS role_id, 'guest' AS member_type, '12AB' AS student_id, repeat('x', 201) AS full_name,
                    CASE WHEN id % 100 <> 1 THEN email END AS email) FROM users WHERE id % 50 = 1""",
    "r_inventory": """
  SELECT * FROM inventory UNION ALL BY NAME
  SELECT * REPLACE (-5 AS stock, CAST(NULL AS BOOLEAN) AS active) FROM inventory WHERE id % 50 = 1""",
    "r_transactions": """
  SELECT * FROM transactions UNION ALL BY NAME
  SELECT * REPLACE (user_id + 1000000000 AS user_id, inventory_id + 1000000000 AS inventory_id, 0 AS qty)
  FROM transactions WHERE CAST(split_part(id, '-', 4) AS BIGINT) % 50 = 1""",
    "r_transaction_returns": """
  SELECT * FROM transaction_returns UNION ALL BY NAME
  SELECT * REPLACE (0 AS return_qty, CAST(NULL AS TIMESTAMP) AS returned_at, id || '-x' AS transaction_id)
  FROM transaction_returns WHERE CAST(split_part(id, '-', 4) AS BIGINT) % 50 = 1""",
    "r_fitness_visits": """
  SELECT * FROM fitness_visits UNION ALL BY NAME
  SELECT * REPLACE (user_id + 1000000000 AS user_id, 'card' AS pay_method, CAST(NULL AS INTEGER) AS amount)
  FROM fitness_visits WHERE id % 50 = 1""",
    "r_notifications": """
  SELECT * FROM notifications UNION ALL BY NAME
  SELECT * REPLACE (CASE WHEN type <> 'fitness_visit' THEN user_id + 1000000000 END AS user_id, CAST(NULL AS VARCHAR) AS type)
  FROM notifications WHERE TRY_CAST(substr(id, 2) AS BIGINT) % 50 = 1""",
    "r_user_holds": """
  SELECT * FROM user_holds UNION ALL BY NAME
  SELECT * REPLACE (user_id + 1000000000 AS user_id, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS TIMESTAMP) AS cleared_at)
  FROM user_holds WHERE id % 50 = 1""",
}


def raw(body: str) -> str:
    return oracle(body, RAW)


_REF = "json_extract_string(meta, '$.ref')"


def _dup(rule: str, key: str, where: str = "TRUE") -> str:
    table = rule.split(".")[0]
    return (f"SELECT '{rule}' AS rule, k AS key, COUNT(*) AS n FROM "
            f"(SELECT CAST({key} AS VARCHAR) AS k FROM r_{table} WHERE {where}) d "
            f"WHERE k IS NOT NULL GROUP BY k HAVING COUNT(*) > 1")


_SINGLE = ("roles.id roles.name users.id users.email users.student_id users.citizen_id users.qr_code_value "
           "users.student_id_hash inventory.id inventory.item_name transactions.id transaction_returns.id "
           "fitness_visits.id notifications.id user_holds.id").split()


@register("audit_unique", raw("\nUNION ALL ".join([
    *[_dup(r, r.split(".")[1]) for r in _SINGLE],
    _dup("user_holds.one_active", "user_id", "cleared_at IS NULL"),
    _dup("notifications.daily", f"to_json({{'ref': {_REF}, 'type': type, 'day': created_date}})",
         f"type IN ('overdue_student', 'overdue_faculty', 'overdue_staff_2_6') AND {_REF} IS NOT NULL "
         "AND created_date IS NOT NULL"),
    _dup("notifications.once", f"to_json({{'user': user_id, 'type': type, 'ref': {_REF}}})",
         f"{_REF} IS NOT NULL AND user_id IS NOT NULL AND type IS NOT NULL"),
    _dup("notifications.member_once", _REF, f"type = 'overdue_student' AND {_REF} IS NOT NULL"),
])))
def q_audit_unique(spark, sf_dir):
    return AU.audit_unique(raw_lending(spark, sf_dir))


def _orphan(rule: str, child: str, row_id: str, fk: str, parent: str, pk: str) -> str:
    return (f"SELECT '{rule}' AS rule, CAST({row_id} AS VARCHAR) AS row_id, "
            f"CAST({fk} AS VARCHAR) AS missing_key FROM r_{child} "
            f"WHERE {fk} IS NOT NULL AND {fk} NOT IN (SELECT {pk} FROM r_{parent} WHERE {pk} IS NOT NULL)")


@register("audit_foreign_keys", raw("\nUNION ALL ".join([
    _orphan("users.role_id", "users", "id", "role_id", "roles", "id"),
    _orphan("transactions.user_id", "transactions", "id", "user_id", "users", "id"),
    _orphan("transactions.inventory_id", "transactions", "id", "inventory_id", "inventory", "id"),
    _orphan("transaction_returns.transaction_id", "transaction_returns", "id", "transaction_id",
            "transactions", "id"),
    _orphan("fitness_visits.user_id", "fitness_visits", "id", "user_id", "users", "id"),
    _orphan("notifications.user_id", "notifications", "id", "user_id", "users", "id"),
    _orphan("user_holds.user_id", "user_holds", "id", "user_id", "users", "id"),
])))
def q_audit_foreign_keys(spark, sf_dir):
    return AU.audit_foreign_keys(raw_lending(spark, sf_dir))


_NULLS = ("roles.id roles.name users.id users.email users.full_name inventory.id inventory.item_name inventory.stock "
          "inventory.active transactions.id transactions.user_id transactions.inventory_id transactions.qty "
          "transaction_returns.id transaction_returns.transaction_id transaction_returns.return_qty "
          "transaction_returns.returned_at fitness_visits.id fitness_visits.user_id fitness_visits.visit_date "
          "fitness_visits.amount notifications.id notifications.type user_holds.id user_holds.user_id user_holds.reason "
          "user_holds.created_at").split()
_LENGTHS = {"roles.name": 20, "inventory.item_name": 150, "users.member_type": 20, "users.email": 255, "users.student_id": 12,
            "users.citizen_id": 13, "users.full_name": 200, "users.faculty": 100, "users.phone": 30}
_CHECKS = {
    "users.member_type": "member_type NOT IN ('student', 'external', 'staff', 'admin')",
    "users.student_id": "NOT regexp_matches(student_id, '^[0-9]{12}$')",
    "inventory.stock": "stock < 0", "transactions.qty": "qty <= 0", "transaction_returns.return_qty": "return_qty <= 0",
    "fitness_visits.pay_method": "pay_method NOT IN ('cash', 'qr')",
    "notifications.user_id.not_null": "user_id IS NULL AND audience IS NULL",
} | {f"{r}.not_null": f"{r.split('.')[1]} IS NULL" for r in _NULLS} | {
    f"{r}.length": f"length({r.split('.')[1]}) > {n}" for r, n in _LENGTHS.items()}


@register("audit_checks", raw("\nUNION ALL ".join(
    f"SELECT '{rule}' AS rule, CAST(id AS VARCHAR) AS row_id FROM r_{rule.split('.')[0]} WHERE {bad}"
    for rule, bad in _CHECKS.items())))
def q_audit_checks(spark, sf_dir):
    return AU.audit_checks(raw_lending(spark, sf_dir))


@register("audit_balances", oracle("""
SELECT b.rule, t.id AS tx_id, t.qty, t.came_back AS returned_qty
FROM _ledger t, LATERAL (SELECT 'over_returned' AS rule WHERE t.missing < 0
                         UNION ALL SELECT 'open_nothing_left' WHERE t.return_date IS NULL AND t.missing <= 0) b"""))
def q_audit_balances(spark, sf_dir):
    return AU.audit_balances(lending(spark, sf_dir))
