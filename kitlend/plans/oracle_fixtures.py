"""DuckDB spelling of the fixture mapping, as a CTE prefix for oracle queries.

Written independently of ``kitlend.sources.fixtures`` (SQL text, not derived
from the DataFrame code) so that the oracle checks the Spark mapping too.
"""

AS_OF_SQL = "DATE '2001-08-05'"

_CTES = {
    "_cust": """
  SELECT *, CASE WHEN c_mktsegment = 'MACHINERY'
                   THEN CASE WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'staff' END
                 WHEN c_mktsegment = 'FURNITURE' THEN 'external'
                 ELSE 'student' END AS mt
  FROM customer""",
    "users": """
  SELECT c_custkey AS id,
         CAST(CASE mt WHEN 'student' THEN 1 WHEN 'external' THEN 2 WHEN 'staff' THEN 3 ELSE 4 END
              AS INTEGER) AS role_id,
         mt AS member_type,
         'M' || CAST(c_custkey AS VARCHAR) || '@mail.example.edu' AS email,
         CASE WHEN mt = 'student' THEN lpad(CAST(c_custkey AS VARCHAR), 12, '0') END AS student_id,
         CASE WHEN mt = 'external' THEN lpad(CAST(c_custkey AS VARCHAR), 13, '9') END AS citizen_id,
         c_name AS full_name,
         CASE WHEN mt = 'student' THEN c_mktsegment END AS faculty,
         CAST(NULL AS VARCHAR) AS phone,
         CASE WHEN mt = 'student' THEN lpad(CAST(c_custkey AS VARCHAR), 12, '0')
              WHEN mt = 'external' THEN lpad(CAST(c_custkey AS VARCHAR), 13, '9') END AS qr_code_value,
         CAST(DATE '2000-01-01' + CAST(c_custkey % 365 AS INTEGER) AS TIMESTAMP) AS created_at,
         CASE WHEN mt = 'student' AND c_custkey % 3 <> 0
              THEN sha256(lpad(CAST(c_custkey AS VARCHAR), 12, '0')) END AS student_id_hash
  FROM _cust""",
    "roles": """
  SELECT CAST(id AS INTEGER) AS id, name
  FROM (VALUES (1, 'student'), (2, 'external'), (3, 'staff'), (4, 'admin')) r(id, name)""",
    "inventory": """
  SELECT p_partkey AS id,
         p_name || ' ' || p_brand || ' ' || CAST(p_partkey AS VARCHAR) AS item_name,
         CAST(p_size * 10 AS INTEGER) AS stock,
         p_type <> 'PROMO' AS active,
         CASE WHEN p_type = 'PROMO' AND p_size > 40 THEN TIMESTAMP '2001-01-01 00:00:00' END AS deleted_at
  FROM part""",
    "_lines": """
  SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_returnflag, l.l_linestatus,
         l.l_shipdate, o.o_custkey, o.o_orderdate,
         CAST(l.l_quantity AS INTEGER) AS qty,
         CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) || '-'
           || CAST(l.l_partkey AS VARCHAR) || '-' || CAST(l.l_suppkey AS VARCHAR) || '-'
           || CAST(CAST(l.l_quantity AS INTEGER) AS VARCHAR) AS line_id
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "_loans": """
  SELECT *, l_linestatus = 'O' AS is_open, CAST(o_orderdate AS DATE) AS borrow_date
  FROM _lines WHERE l_returnflag <> 'R'""",
    "transactions": """
  SELECT line_id AS id, o_custkey AS user_id, l_partkey AS inventory_id, qty, borrow_date,
         CASE WHEN NOT is_open THEN l_shipdate END AS return_date,
         CASE WHEN l_linenumber <> 7 THEN o_orderdate + to_hours(l_linenumber) END AS created_at,
         CASE WHEN is_open AND l_returnflag = 'N' AND l_suppkey % 4 = 0 THEN l_shipdate END AS escalated_at,
         CASE WHEN is_open AND l_returnflag = 'A' AND l_linenumber <= 5
              THEN CAST(l_shipdate AS DATE) END AS promised_return_date
  FROM _loans""",
    "transaction_returns": """
  SELECT x.line_id || '-' || CAST(v.n AS VARCHAR) AS id,
         x.line_id AS transaction_id,
         CAST(CASE WHEN NOT x.is_open THEN x.qty
                   WHEN v.n = 1 THEN floor(x.qty / 2)
                   ELSE x.qty - floor(x.qty / 2) END AS INTEGER) AS return_qty,
         CASE WHEN NOT x.is_open THEN x.l_shipdate
              ELSE CAST(x.borrow_date + v.n AS TIMESTAMP) END AS returned_at,
         CASE WHEN x.is_open THEN CASE WHEN v.n = 1 THEN 'part' ELSE 'rest' END END AS note
  FROM (SELECT *, CASE WHEN NOT is_open THEN 1
                       WHEN l_suppkey % 3 = 0 AND qty >= 2
                         THEN CASE WHEN l_suppkey % 5 = 1 THEN 2 ELSE 1 END
                       ELSE 0 END AS nr
        FROM _loans) x
  JOIN (VALUES (1), (2)) v(n) ON v.n <= x.nr""",
    "user_holds": """
  SELECT c_custkey AS id, c_custkey AS user_id, 'overdue' AS reason,
         TIMESTAMP '2001-07-01 00:00:00' AS created_at,
         CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2001-07-15 00:00:00' END AS cleared_at
  FROM customer WHERE c_acctbal < 0 OR c_custkey % 7 = 0""",
    "fitness_visits": """
  SELECT e.event_id AS id, e.user_id, CAST(e.ts AS DATE) AS visit_date,
         CAST(CASE WHEN u.member_type = 'student' THEN 5 ELSE 30 END AS INTEGER) AS amount,
         CASE WHEN e.event_id % 2 = 0 THEN 'qr' ELSE 'cash' END AS pay_method,
         e.ts AS created_at
  FROM events e JOIN users u ON e.user_id = u.id
  WHERE e.event_type = 'purchase' AND u.member_type IN ('student', 'external')""",
    "notifications": """
  SELECT 'e' || CAST(e.event_id AS VARCHAR) AS id, e.user_id, m.ntype AS type,
         e.event_type AS title, CAST(NULL AS VARCHAR) AS message,
         CASE WHEN m.ntype <> 'fitness_visit'
              THEN '{"ref":"' || json_extract_string(e.props, '$.k') || '"}' END AS meta,
         e.ts AS created_at,
         CASE WHEN e.event_id % 3 = 0 THEN e.ts END AS read_at,
         CASE WHEN e.event_id % 11 <> 0 THEN CAST(e.ts AS DATE) END AS created_date, CAST(NULL AS VARCHAR) AS audience
  FROM events e
  JOIN (VALUES ('click', 'borrow_created'), ('view', 'return_partial'),
               ('signup', 'overdue_staff_2_6'), ('error', 'overdue_staff'),
               ('purchase', 'fitness_visit')) m(etype, ntype) ON e.event_type = m.etype
  UNION ALL
  SELECT k.tag || line_id, CASE WHEN k.aud IS NULL THEN o_custkey END, k.ntype, 'overdue', CAST(NULL AS VARCHAR),
         '{"ref":"' || line_id || '"}',
         CAST(borrow_date + k.day AS TIMESTAMP), CAST(NULL AS TIMESTAMP), borrow_date + k.day, k.aud
  FROM _loans JOIN (VALUES (1, 'os-', 'overdue_student', 2, NULL), (2, 'sl-', 'overdue_staff_2_6', 3, NULL),
                           (3, 'sa-', 'overdue_staff', 7, 'staff')) k(line, tag, ntype, day, aud) ON k.line = l_linenumber
  WHERE is_open""",
    "notification_reads": """
  SELECT 'sa-' || line_id AS notification_id, o_custkey AS user_id, CAST(borrow_date + 8 AS TIMESTAMP) AS read_at
  FROM _loans WHERE is_open AND l_linenumber = 3 AND l_suppkey % 2 = 0""",
    "loan_requests": """
  SELECT line_id AS req_id, o_orderdate AS ts, o_custkey AS user_id, l_partkey AS inventory_id,
         qty, CAST(o_orderdate AS DATE) AS borrow_date
  FROM _lines WHERE l_returnflag = 'R'""",
    "return_events": """
  SELECT x.line_id || CASE WHEN v.n = 1 THEN '-a' ELSE '-b' END AS event_id,
         CASE WHEN v.n = 1 THEN x.l_shipdate ELSE x.l_shipdate + INTERVAL 1 DAY END AS ts,
         x.line_id AS tx_id,
         CAST(CASE WHEN v.n = 1 THEN nullif(x.l_partkey % 5, 0) * 4 END AS INTEGER) AS return_qty,
         CAST(NULL AS VARCHAR) AS note
  FROM (SELECT *, CASE WHEN l_suppkey % 6 = 0 THEN 2 ELSE 1 END AS nr
        FROM _lines) x
  JOIN (VALUES (1), (2)) v(n) ON v.n <= x.nr""",
    "scan_codes": """
  SELECT id AS scan_id,
         CASE id % 5
           WHEN 0 THEN coalesce(qr_code_value, CAST(id AS VARCHAR))
           WHEN 1 THEN CASE WHEN id % 2 = 0 THEN chr(160) || dashed || ' ' ELSE dashed END
           WHEN 2 THEN 'https://lend.example.org/return?member=' || coalesce(qr_code_value, CAST(id AS VARCHAR))
           WHEN 3 THEN sha256(CAST(id AS VARCHAR))
           ELSE 'X' || CAST(id AS VARCHAR) || 'Z' END AS raw
  FROM (SELECT *,
               concat_ws('-', substr(coalesce(qr_code_value, CAST(id AS VARCHAR)), 1, 4),
                              substr(coalesce(qr_code_value, CAST(id AS VARCHAR)), 5, 4),
                              substr(coalesce(qr_code_value, CAST(id AS VARCHAR)), 9)) AS dashed
        FROM users) s""",
    "registrations": """
  SELECT c_custkey AS req_id,
         TIMESTAMP '2001-08-01 00:00:00' + to_minutes(CAST(c_custkey % 97 AS INTEGER)) AS ts,
         CASE WHEN c_custkey % 29 <> 0 THEN CASE WHEN c_custkey % 3 <> 0 THEN 'student' ELSE 'external' END END AS kind,
         CASE WHEN c_custkey % 10 = 7 THEN 'm' || CAST(c_custkey - 7 AS VARCHAR) || '@mail.example.edu'
              ELSE 'N' || CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS VARCHAR)
                   || CASE WHEN c_custkey % 4 = 1 THEN '@MAIL.EXAMPLE.EDU' ELSE '@mail.example.edu' END
         END AS email,
         CASE WHEN c_custkey % 3 <> 0 THEN
           CASE WHEN c_custkey % 13 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 11, '0')
                ELSE lpad(CAST(CAST(floor(c_custkey / 3) * 5 AS BIGINT) AS VARCHAR), 12, '0') END
         END AS student_id,
         CASE WHEN c_custkey % 3 = 0
              THEN lpad(CAST(CAST(floor(c_custkey / 6) AS BIGINT) AS VARCHAR), 13, '9') END AS citizen_id,
         c_name AS full_name,
         CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS faculty,
         CAST(NULL AS VARCHAR) AS phone
  FROM customer""",
    "visit_requests": """
  SELECT event_id AS req_id,
         CASE WHEN event_id % 17 = 0 THEN user_id + 1000000000 ELSE user_id END AS user_id,
         CASE WHEN event_id % 7 = 0 THEN 'staff' WHEN user_id % 2 = 0 THEN 'student'
              ELSE 'external' END AS member_type,
         CAST(ts AS DATE) AS visit_date,
         CASE event_id % 4 WHEN 0 THEN 'qr' WHEN 1 THEN 'cash' WHEN 3 THEN 'card' END AS pay_method
  FROM events WHERE event_type = 'purchase'""",
    "promise_changes": """
  SELECT line_id || '-p' || CAST(v.n AS VARCHAR) AS req_id, line_id AS tx_id,
         CASE v.w WHEN 0 THEN ''
              WHEN 1 THEN strftime(CAST(o_orderdate AS DATE) + 9 + v.n, '%Y-%m-%d')
              ELSE '5/8/2001' END AS date
  FROM _lines, LATERAL (SELECT 1 AS n, l_linenumber % 3 AS w
                        UNION ALL SELECT 2, 2 WHERE l_suppkey % 7 = 2
                        UNION ALL SELECT 3, 1 WHERE l_suppkey % 7 = 2) v""",
    "inventory_changes": """
  SELECT p_partkey AS req_id,
         CASE WHEN p_partkey % 4 = 0 THEN CAST(NULL AS BIGINT)
              WHEN p_partkey % 9 = 1 THEN p_partkey - 1 ELSE p_partkey END AS id,
         CASE WHEN p_partkey % 4 = 0 THEN p_name
              WHEN p_partkey % 5 = 0 THEN upper(p_name || ' ' || p_brand || ' ' || CAST(p_partkey + 1 AS VARCHAR))
              ELSE p_name || ' ' || p_brand || ' ' || CAST(p_partkey AS VARCHAR) END AS name,
         CAST(p_size * 10 - (p_partkey % 7) * 25 AS INTEGER) AS stock,
         p_partkey % 2 = 0 AS active
  FROM part""",
    "role_changes": """
  SELECT k.req_id, k.user_id, ['student', 'external', 'Staff', 'admin', 'owner'][k.r % 5 + 1] AS role
  FROM (SELECT c_custkey AS req_id, c_custkey AS user_id, c_custkey AS r FROM customer
        UNION ALL SELECT c_custkey + 1000000000, c_custkey, c_custkey + 1 FROM customer WHERE c_custkey % 3 = 0) k""",
    "mark_read_requests": """
  SELECT id, user_id FROM notifications WHERE type IN ('borrow_created', 'return_partial')
  UNION ALL
  SELECT id, user_id + 1 FROM notifications WHERE type = 'fitness_visit'
  UNION ALL
  SELECT id, 1 + ('0x' || substr(md5(id), 1, 7))::BIGINT % 1500 FROM notifications WHERE audience IS NOT NULL""",
    "manual_notice_requests": """
  SELECT x.line_id || '-n' || CAST(v.n AS VARCHAR) AS req_id, x.line_id AS tx_id
  FROM (SELECT *, CASE WHEN l_suppkey % 9 = 1 THEN 2 ELSE 1 END AS nr
        FROM _lines) x
  JOIN (VALUES (1), (2)) v(n) ON v.n <= x.nr""",
    "escalation_requests": """
  SELECT line_id AS tx_id FROM _lines""",
    "manual_hold_releases": """
  SELECT c_custkey AS user_id, 'manual' AS note, 1 AS priority,
         'hold-clear-' || CAST(c_custkey AS VARCHAR) AS ref
  FROM customer WHERE c_acctbal < -500""",
    "delete_user_requests": """
  SELECT c_custkey AS user_id FROM customer
  UNION ALL SELECT c_custkey + 1000000000 FROM customer WHERE c_custkey % 26 = 0""",
    "item_toggles": """
  SELECT p_partkey AS id FROM part WHERE p_partkey % 3 > 0
  UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 3 = 2
  UNION ALL SELECT p_partkey + 1000000000 FROM part WHERE p_partkey % 12 = 0""",
    "staff_requests": """
  SELECT c_custkey AS req_id,
         CASE WHEN c_custkey % 17 <> 0 THEN
           CASE WHEN c_custkey % 11 = 0 THEN 'M' || CAST(c_custkey AS VARCHAR) || '@mail.example.edu'
                ELSE ' s' || CAST(c_custkey // 2 AS VARCHAR) || '@mail.example.edu ' END END AS email,
         c_name || ' ' AS full_name,
         ['staff', 'Admin', 'owner', 'staff', 'ADMIN', 'external', ''][c_custkey % 7 + 1] AS role
  FROM customer""",
    "item_delete_requests": """
  SELECT p_partkey AS id FROM part
  UNION ALL SELECT p_partkey + 1000000000 FROM part WHERE p_partkey % 12 = 0""",
}


def with_fixtures(body: str, ctes: dict[str, str] | None = None, recursive: bool = False) -> str:
    """Prefix an oracle query body with every fixture CTE (DuckDB drops unused
    ones), then the query's own CTEs in order."""
    allc = {**_CTES, **(ctes or {})}
    text = ",\n".join(f"{name} AS ({sql}\n)" for name, sql in allc.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{text}\n{body}"
