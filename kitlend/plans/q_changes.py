"""Intake, change sets, deletes, backfills and seed rows."""

from __future__ import annotations

from kitlend.operators import changes as C
from kitlend.operators.notify import run_timestamp
from kitlend.plans.catalog import register
from kitlend.plans.q_balances import oracle
from kitlend.plans.q_notify import RUN_TS_SQL
from kitlend.sources import fixtures as fx
from kitlend.sources.fixtures import AS_OF, lending

REG_CTES = {
    "_reg": """
  SELECT r.*, lower(r.email) AS ek,
         CASE WHEN r.kind = 'student' THEN r.student_id ELSE r.citizen_id END AS ik,
         CASE WHEN r.email IS NULL OR r.email = '' OR r.full_name IS NULL THEN 'missing'
              WHEN r.kind IS NULL OR r.kind NOT IN ('student', 'external') THEN 'kind'
              WHEN r.kind = 'student' AND NOT ends_with(r.email, '@mail.example.edu') THEN 'email_domain'
              WHEN r.kind = 'student' AND NOT regexp_matches(COALESCE(r.student_id, ''), '^[0-9]{12}$')
                THEN 'student_id_format'
              WHEN r.kind = 'external' AND NOT regexp_matches(COALESCE(r.citizen_id, ''), '^[0-9]{13}$')
                THEN 'citizen_id_format' END AS rule
  FROM registrations r""",
    "_reg2": """
  SELECT *, COALESCE(rule, CASE WHEN ek IN (SELECT lower(email) FROM users)
                                  OR ik IN (SELECT student_id FROM users WHERE student_id IS NOT NULL
                                            UNION SELECT citizen_id FROM users WHERE citizen_id IS NOT NULL
                                            UNION SELECT qr_code_value FROM users WHERE qr_code_value IS NOT NULL)
                                THEN 'taken' END) AS pre
  FROM _reg""",
    "_rc": """
  SELECT req_id, ek, ik, row_number() OVER (ORDER BY ts, req_id) AS rn FROM _reg2 WHERE pre IS NULL""",
    "_rw": """
  SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS req_id, CAST([] AS VARCHAR[]) AS es,
         CAST([] AS VARCHAR[]) AS ids, CAST(NULL AS BOOLEAN) AS ok
  UNION ALL
  SELECT c.rn, c.req_id,
         CASE WHEN NOT list_contains(w.es, c.ek) AND NOT list_contains(w.ids, c.ik)
              THEN list_append(w.es, c.ek) ELSE w.es END,
         CASE WHEN NOT list_contains(w.es, c.ek) AND NOT list_contains(w.ids, c.ik)
              THEN list_append(w.ids, c.ik) ELSE w.ids END,
         NOT list_contains(w.es, c.ek) AND NOT list_contains(w.ids, c.ik)
  FROM _rw w JOIN _rc c ON c.rn = w.rn + 1""",
}


@register("register_members", oracle("""
SELECT x.req_id, x.kind, x.email, x.reason IS NULL AS accepted, x.reason,
       CASE WHEN x.reason IS NULL THEN ro.id END AS role_id,
       CASE WHEN x.reason IS NULL THEN x.ik END AS qr_code_value,
       CASE WHEN x.reason IS NULL AND x.kind = 'student' THEN sha256(x.student_id) END AS student_id_hash
FROM (SELECT r.*, COALESCE(r.pre, CASE WHEN NOT w.ok THEN 'taken_in_batch' END) AS reason
      FROM _reg2 r LEFT JOIN _rw w ON w.req_id = r.req_id AND w.rn > 0) x
LEFT JOIN roles ro ON ro.name = x.kind""", REG_CTES, recursive=True))
def q_register_members(spark, sf_dir):
    return C.register_members(lending(spark, sf_dir), fx.registrations(spark, sf_dir))


CHANGE_CTES = {
    "_ic": """
  SELECT c.*, trim(COALESCE(c.name, '')) AS nm, lower(trim(COALESCE(c.name, ''))) AS lnm
  FROM inventory_changes c""",
    "_ic2": """
  SELECT c.*,
         CASE WHEN c.nm = '' OR c.stock IS NULL OR c.stock < 0 THEN 'invalid'
              WHEN c.id IS NOT NULL AND a.id IS NULL THEN 'not_found'
              WHEN c.id IS NOT NULL AND c.stock < a.outstanding_in_use THEN 'below_in_use'
              WHEN EXISTS (SELECT 1 FROM inventory i WHERE lower(i.item_name) = c.lnm
                           AND (c.id IS NULL OR i.id <> c.id)) THEN 'name_taken' END AS r
  FROM _ic c LEFT JOIN _item_units a ON a.id = c.id""",
    "_fid": "SELECT id, MIN(req_id) AS f FROM _ic2 WHERE r IS NULL AND id IS NOT NULL GROUP BY id",
    "_fnm": """
  SELECT c.lnm, MIN(c.req_id) AS f FROM _ic2 c LEFT JOIN _fid fi ON fi.id = c.id
  WHERE c.r IS NULL AND (c.id IS NULL OR c.req_id = fi.f) GROUP BY c.lnm""",
    "_chk": """
  SELECT c.req_id, c.id, c.nm AS name, c.stock, c.active, c.reason IS NULL AS accepted, c.reason
  FROM (SELECT c.*, CASE WHEN c.r IS NOT NULL THEN c.r
                         WHEN c.id IS NOT NULL AND c.req_id <> fi.f THEN 'duplicate_change'
                         WHEN c.req_id <> fn.f THEN 'name_taken_in_batch' END AS reason
        FROM _ic2 c LEFT JOIN _fid fi ON fi.id = c.id LEFT JOIN _fnm fn ON fn.lnm = c.lnm) c""",
}


@register("check_inventory_changes", oracle("SELECT * FROM _chk", CHANGE_CTES))
def q_check_inventory_changes(spark, sf_dir):
    return C.check_inventory_changes(lending(spark, sf_dir), fx.inventory_changes(spark, sf_dir))


@register("apply_inventory_changes", oracle("""
SELECT i.id, CASE WHEN e.id IS NOT NULL THEN e.name ELSE i.item_name END AS item_name,
       CASE WHEN e.id IS NOT NULL THEN e.stock ELSE i.stock END AS stock,
       CASE WHEN e.id IS NOT NULL THEN e.active ELSE i.active END AS active,
       i.deleted_at, e.id IS NOT NULL AS changed
FROM inventory i LEFT JOIN (SELECT * FROM _chk WHERE accepted AND id IS NOT NULL) e ON e.id = i.id
UNION ALL
SELECT CAST(NULL AS BIGINT), name, stock, TRUE, CAST(NULL AS TIMESTAMP), TRUE
FROM _chk WHERE accepted AND id IS NULL""", CHANGE_CTES))
def q_apply_inventory_changes(spark, sf_dir):
    l = lending(spark, sf_dir)
    return C.apply_inventory_changes(l, C.check_inventory_changes(l, fx.inventory_changes(spark, sf_dir)))


ROLE_SQL = """
SELECT req_id, user_id, role, outcome,
       CASE WHEN outcome = 'role_updated' THEN new_role ELSE old_role END AS role_id,
       CASE WHEN outcome = 'role_updated' THEN rn ELSE old_type END AS member_type
FROM (SELECT c.req_id, c.user_id, c.role, lower(trim(c.role)) AS rn, r.id AS new_role,
             u.role_id AS old_role, u.member_type AS old_type,
             CASE WHEN r.id IS NULL THEN 'role_not_found' WHEN u.id IS NULL THEN 'not_found'
                  WHEN c.req_id <> f.f THEN 'duplicate_change' ELSE 'role_updated' END AS outcome
      FROM role_changes c LEFT JOIN roles r ON r.name = lower(trim(c.role))
      LEFT JOIN users u ON u.id = c.user_id
      LEFT JOIN (SELECT user_id, MIN(req_id) AS f FROM role_changes WHERE lower(trim(role)) IN (SELECT name FROM roles)
                 GROUP BY user_id) f ON f.user_id = c.user_id) x"""


@register("apply_role_changes", oracle(ROLE_SQL))
def q_apply_role_changes(spark, sf_dir):
    return C.apply_role_changes(lending(spark, sf_dir), fx.role_changes(spark, sf_dir))


DELETE_SQL = """
SELECT user_id, outcome,
       CASE WHEN outcome = 'deleted' THEN nn ELSE 0 END AS notifications_removed,
       CASE WHEN outcome = 'deleted' THEN hn ELSE 0 END AS holds_removed
FROM (SELECT d.user_id,
             CASE WHEN u.id IS NULL THEN 'not_found'
                  WHEN d.user_id IN (SELECT user_id FROM transactions) THEN 'refused_loans'
                  WHEN d.user_id IN (SELECT user_id FROM fitness_visits) THEN 'refused_visits'
                  ELSE 'deleted' END AS outcome,
             (SELECT COUNT(*) FROM notifications n WHERE n.user_id = d.user_id) AS nn,
             (SELECT COUNT(*) FROM user_holds h WHERE h.user_id = d.user_id) AS hn
      FROM (SELECT DISTINCT user_id FROM delete_user_requests) d LEFT JOIN users u ON u.id = d.user_id) x"""


@register("delete_users", oracle(DELETE_SQL))
def q_delete_users(spark, sf_dir):
    return C.delete_users(lending(spark, sf_dir), fx.delete_user_requests(spark, sf_dir))


ITEM_DELETE_SQL = f"""
SELECT id, outcome,
       CASE WHEN outcome = 'archived' THEN FALSE ELSE active END AS active,
       CASE WHEN outcome = 'archived' THEN COALESCE(deleted_at, {RUN_TS_SQL}) ELSE deleted_at END AS deleted_at
FROM (SELECT r.id, i.active, i.deleted_at,
             CASE WHEN i.id IS NULL THEN 'not_found'
                  WHEN r.id IN (SELECT inventory_id FROM transactions) THEN 'archived'
                  ELSE 'deleted' END AS outcome
      FROM (SELECT DISTINCT id FROM item_delete_requests) r LEFT JOIN inventory i ON i.id = r.id) x"""


@register("delete_or_archive_items", oracle(ITEM_DELETE_SQL))
def q_delete_or_archive_items(spark, sf_dir):
    return C.delete_or_archive_items(lending(spark, sf_dir), fx.item_delete_requests(spark, sf_dir),
                                     run_timestamp(AS_OF))


@register("backfill_created_date", oracle("""
SELECT id, COALESCE(created_date, CAST(created_at AS DATE)) AS created_date,
       created_date IS NULL AS backfilled
FROM notifications"""))
def q_backfill_created_date(spark, sf_dir):
    return C.backfill_created_date(lending(spark, sf_dir))


@register("backfill_student_hash", oracle("""
SELECT id,
       CASE WHEN member_type = 'student' AND student_id IS NOT NULL AND student_id_hash IS NULL
            THEN sha256(student_id) ELSE student_id_hash END AS student_id_hash,
       (member_type = 'student' AND student_id IS NOT NULL AND student_id_hash IS NULL) AS backfilled
FROM users"""))
def q_backfill_student_hash(spark, sf_dir):
    return C.backfill_student_hash(lending(spark, sf_dir))


@register("seed_missing", oracle("""
SELECT 'roles' AS target, name AS key, CAST(NULL AS VARCHAR) AS role
FROM (VALUES ('student'), ('external'), ('staff'), ('admin')) s(name)
WHERE name NOT IN (SELECT name FROM roles)
UNION ALL
SELECT 'users', email, role
FROM (VALUES ('staff', 'staff@example.com'), ('admin', 'admin@example.com')) s(role, email)
WHERE email NOT IN (SELECT email FROM users)"""))
def q_seed_missing(spark, sf_dir):
    return C.seed_missing(lending(spark, sf_dir))
