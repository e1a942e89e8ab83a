"""Snapshots and notice rows after change jobs."""

from __future__ import annotations

from kitlend.operators import jobs as J
from kitlend.operators import snapshots as SN
from kitlend.operators.notify import run_timestamp
from kitlend.plans.catalog import register
from kitlend.plans.oracle_fixtures import AS_OF_SQL as A
from kitlend.plans.q_changes import DELETE_SQL, ITEM_DELETE_SQL, ROLE_SQL
from kitlend.plans.q_jobs import ADMIT_CTES, SETTLE_CTES
from kitlend.plans.q_balances import oracle as plain
from kitlend.plans.q_notify import MANUAL_SQL, PROMISE_SQL, RUN_TS_SQL, oracle
from kitlend.sources import fixtures as fx
from kitlend.sources.fixtures import AS_OF, lending


@register("loans_after_promises", oracle("""
SELECT t.* REPLACE (CASE WHEN p.tx_id IS NULL THEN t.promised_return_date ELSE p.promised_return_date END AS promised_return_date),
       p.tx_id IS NOT NULL AS changed
FROM transactions t LEFT JOIN (SELECT * FROM _outcome WHERE outcome IN ('set', 'cleared')) p ON p.tx_id = t.id""",
                                          {"_outcome": PROMISE_SQL}))
def q_loans_after_promises(spark, sf_dir):
    return SN.loans_after_promises(lending(spark, sf_dir), fx.promise_changes(spark, sf_dir))


@register("loans_after_escalations", oracle(f"""
SELECT t.* EXCLUDE (c) REPLACE (CASE WHEN c THEN {RUN_TS_SQL} ELSE t.escalated_at END AS escalated_at), c AS changed
FROM (SELECT *, return_date IS NULL AND escalated_at IS NULL AND id IN (SELECT tx_id FROM escalation_requests) AS c
      FROM transactions) t"""))
def q_loans_after_escalations(spark, sf_dir):
    return SN.loans_after_escalations(lending(spark, sf_dir), fx.escalation_requests(spark, sf_dir), run_timestamp(AS_OF))


@register("users_after_role_changes", oracle("""
SELECT u.* REPLACE (COALESCE(o.role_id, u.role_id) AS role_id, COALESCE(o.member_type, u.member_type) AS member_type),
       o.user_id IS NOT NULL AS changed
FROM users u LEFT JOIN (SELECT * FROM _outcome WHERE outcome = 'role_updated') o ON o.user_id = u.id""",
                                              {"_outcome": ROLE_SQL}))
def q_users_after_role_changes(spark, sf_dir):
    return SN.users_after_role_changes(lending(spark, sf_dir), fx.role_changes(spark, sf_dir))


_GONE = {"_outcome": DELETE_SQL, "_gone": "SELECT user_id AS g FROM _outcome WHERE outcome = 'deleted'"}


@register("users_after_deletes", oracle("SELECT * FROM users WHERE id NOT IN (SELECT g FROM _gone)", _GONE))
def q_users_after_deletes(spark, sf_dir):
    return SN.after_user_deletes(lending(spark, sf_dir), fx.delete_user_requests(spark, sf_dir))["users"]


@register("notifications_after_deletes", oracle(
    "SELECT * FROM notifications WHERE user_id IS NULL OR user_id NOT IN (SELECT g FROM _gone)", _GONE))
def q_notifications_after_deletes(spark, sf_dir):
    return SN.after_user_deletes(lending(spark, sf_dir), fx.delete_user_requests(spark, sf_dir))["notifications"]


@register("holds_after_deletes", oracle("SELECT * FROM user_holds WHERE user_id NOT IN (SELECT g FROM _gone)", _GONE))
def q_holds_after_deletes(spark, sf_dir):
    return SN.after_user_deletes(lending(spark, sf_dir), fx.delete_user_requests(spark, sf_dir))["user_holds"]


@register("inventory_after_deletes", oracle("""
SELECT i.* REPLACE (CASE WHEN o.id IS NULL THEN i.active ELSE o.active END AS active,
                    CASE WHEN o.id IS NULL THEN i.deleted_at ELSE o.deleted_at END AS deleted_at), o.id IS NOT NULL AS changed
FROM inventory i LEFT JOIN (SELECT * FROM _outcome WHERE outcome = 'archived') o ON o.id = i.id
WHERE i.id NOT IN (SELECT id FROM _outcome WHERE outcome = 'deleted')""", {"_outcome": ITEM_DELETE_SQL}))
def q_inventory_after_deletes(spark, sf_dir):
    return SN.inventory_after_deletes(lending(spark, sf_dir), fx.item_delete_requests(spark, sf_dir), run_timestamp(AS_OF))


@register("toggle_items", oracle("""
SELECT i.* EXCLUDE (f) REPLACE (i.active <> f AS active), f AS changed
FROM (SELECT *, (SELECT COUNT(*) FROM item_toggles t WHERE t.id = inventory.id) % 2 = 1 AS f FROM inventory) i"""))
def q_toggle_items(spark, sf_dir):
    return SN.toggle_items(lending(spark, sf_dir), fx.item_toggles(spark, sf_dir))


@register("create_staff", oracle("""
SELECT req_id, email, full_name, why IS NULL AS accepted, why AS reason,
       CASE WHEN why IS NULL THEN rid END AS role_id, CASE WHEN why IS NULL THEN role END AS member_type
FROM (SELECT *, COALESCE(w, CASE WHEN row_number() OVER (PARTITION BY email, w IS NULL ORDER BY req_id) > 1
                                 THEN 'dup_or_invalid' END) AS why
      FROM (SELECT q.req_id, trim(q.email) AS email, trim(q.full_name) AS full_name, lower(q.role) AS role, r.id AS rid,
                   CASE WHEN r.id IS NULL THEN 'role_not_found'
                        WHEN q.email IS NULL OR trim(q.email) IN (SELECT email FROM users) THEN 'dup_or_invalid' END AS w
            FROM staff_requests q LEFT JOIN roles r ON r.name = lower(q.role)) a) b"""))
def q_create_staff(spark, sf_dir):
    return SN.create_staff(lending(spark, sf_dir), fx.staff_requests(spark, sf_dir))


@register("escalation_notices", oracle(f"""
SELECT o.*, {RUN_TS_SQL} AS created_at, {A} AS created_date
FROM (SELECT t.id AS ref, t.user_id, 'overdue_faculty' AS type, CAST(1 AS BIGINT) AS recipients, 'Sent to your faculty' AS title,
             'Loan ' || i.item_name || ' x ' || t.qty || ' is ' || COALESCE(CAST({A} - t.borrow_date AS VARCHAR), '-')
               || ' days overdue; the letter to your faculty is recorded as sent' AS message,
             '{{"ref":"' || t.id || '","goto":"/history"}}' AS meta, CAST(NULL AS VARCHAR) AS audience
      FROM _asked t JOIN inventory i ON i.id = t.inventory_id
      WHERE t.user_id IN (SELECT id FROM users)
        AND NOT EXISTS (SELECT 1 FROM _stored s WHERE s.type = 'overdue_faculty' AND s.ref = t.id
                        AND (s.user_id = t.user_id OR s.created_date = {A}))
      UNION ALL
      SELECT t.id, NULL, 'overdue_staff', n.untold, 'Marked as sent to the faculty',
             'Loan ' || t.id || ' (' || i.item_name || ' x ' || t.qty || ') was marked as sent to the faculty',
             '{{"ref":"' || t.id || '","user_id":"' || t.user_id || '"}}', 'staff'
      FROM _asked t JOIN inventory i ON i.id = t.inventory_id,
           LATERAL (SELECT (SELECT COUNT(*) FROM _roster) - COUNT(DISTINCT r.staff_id) AS untold
                    FROM _stored s JOIN _roster r ON s.user_id = r.staff_id
                      OR s.audience = 'staff' AND COALESCE(r.joined, s.created_at) <= s.created_at
                    WHERE s.type = 'overdue_staff' AND s.ref = t.id) n
      WHERE n.untold > 0) o""", {"_asked": """
  SELECT * FROM transactions WHERE return_date IS NULL AND id IN (SELECT tx_id FROM escalation_requests)"""}))
def q_escalation_notices(spark, sf_dir):
    return SN.escalation_notices(lending(spark, sf_dir), fx.escalation_requests(spark, sf_dir), AS_OF)


@register("manual_notice_rows", oracle(f"""
SELECT t.user_id, 'overdue_student' AS type, 'Overdue: please return the equipment' AS title,
       'Your loan of ' || i.item_name || ' is ' || ({A} - t.borrow_date) || ' days overdue; please return it' AS message,
       '{{"ref":"' || t.id || '","days_overdue":' || ({A} - t.borrow_date) || ',"item":"' || i.item_name || '","qty":' || t.qty
         || '}}' AS meta, {RUN_TS_SQL} AS created_at, {A} AS created_date
FROM _outcome o JOIN transactions t ON t.id = o.tx_id JOIN inventory i ON i.id = t.inventory_id
WHERE o.status = 'inserted'""", {"_outcome": MANUAL_SQL}))
def q_manual_notice_rows(spark, sf_dir):
    return SN.manual_notice_rows(lending(spark, sf_dir), AS_OF, fx.manual_notice_requests(spark, sf_dir))


@register("loans_after_settlement", plain("""
SELECT t.* REPLACE (COALESCE(s.ts, t.return_date) AS return_date), s.ts IS NOT NULL AS changed
FROM transactions t LEFT JOIN (SELECT tx_id, ts FROM _settled WHERE outcome = 'return_completed') s ON s.tx_id = t.id""",
                                            SETTLE_CTES, recursive=True))
def q_loans_after_settlement(spark, sf_dir):
    l = lending(spark, sf_dir)
    return SN.loans_after_settlement(l, J.settle_returns(l, fx.return_events(spark, sf_dir)))


@register("returns_of_settlement", plain("""
SELECT CAST(NULL AS VARCHAR) AS id, tx_id AS transaction_id, CAST(returned_qty AS INTEGER) AS return_qty, ts AS returned_at, note
FROM _settled WHERE accepted""", SETTLE_CTES, recursive=True))
def q_returns_of_settlement(spark, sf_dir):
    return SN.returns_of(J.settle_returns(lending(spark, sf_dir), fx.return_events(spark, sf_dir)))


@register("loans_of_admission", plain(f"""
SELECT a.req_id AS id, a.user_id, a.inventory_id, a.qty, a.borrow_date, CAST(NULL AS TIMESTAMP) AS return_date, a.ts AS created_at,
       CAST(NULL AS TIMESTAMP) AS escalated_at, CAST(NULL AS DATE) AS promised_return_date
FROM _areq a JOIN _awalk w ON w.req_id = a.req_id AND w.rn > 0 WHERE a.pre IS NULL AND w.reason IS NULL""",
                                     ADMIT_CTES, recursive=True))
def q_loans_of_admission(spark, sf_dir):
    return SN.loans_of(J.admit_loans(lending(spark, sf_dir), fx.loan_requests(spark, sf_dir)))
