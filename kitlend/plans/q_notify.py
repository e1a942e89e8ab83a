"""Notification run, de-duplication, outbox, feeds, badges, letters and keyed updates."""

from __future__ import annotations

import datetime as dt

from kitlend.operators import notify as N
from kitlend.operators import updates as U
from kitlend.plans.catalog import register
from kitlend.plans.oracle_fixtures import AS_OF_SQL as A
from kitlend.plans.daily import notices_as_rows
from kitlend.plans.q_history import oracle as _oracle
from kitlend.plans.q_history import tier_views
from kitlend.sources import fixtures as fx
from kitlend.sources.fixtures import AS_OF, Lending, lending

RUN_TS_SQL = "TIMESTAMP '2001-08-05 01:00:00'"

_CAND = """
  SELECT 'member_2_6' AS kind, o.tx_id AS ref, 'overdue_student' AS type, o.user_id AS recipient_id,
         u.email AS recipient_email, 'Overdue equipment reminder' AS title,
         'Loan ' || o.item_name || ' x ' || CAST(o.qty AS VARCHAR) || ' is '
           || CAST(o.days_overdue AS VARCHAR) || ' days overdue; please return it soon' AS message,
         o.user_id, o.item_name, o.qty, o.days_overdue
  FROM _late{n} o JOIN users u ON u.id = o.user_id
  UNION ALL
  SELECT 'staff_2_6', o.tx_id, 'overdue_staff_2_6', CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR),
         'Loans 2-6 days overdue',
         'A member has ' || o.item_name || ' x ' || CAST(o.qty AS VARCHAR) || ' out for '
           || CAST(o.days_overdue AS VARCHAR) || ' days',
         o.user_id, o.item_name, o.qty, o.days_overdue
  FROM _late{n} o
  UNION ALL
  SELECT 'staff_7_plus', o.tx_id, 'overdue_staff', CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR),
         'Loans over 7 days overdue',
         'Member ' || COALESCE(u.full_name, CAST(o.user_id AS VARCHAR)) || ' has ' || o.item_name
           || ' x ' || CAST(o.qty AS VARCHAR) || ' out for ' || CAST(o.days_overdue AS VARCHAR)
           || ' days. Letter for the faculty: /reports/overdue/print?tx='
           || replace(url_encode(o.tx_id), '+', '%20'),
         o.user_id, o.item_name, o.qty, o.days_overdue
  FROM _very_late{n} o LEFT JOIN users u ON u.id = o.user_id"""

# What a run inserts, told pair by pair: a staff member is told of a loan by a row
# of their own, or by an audience row since they joined.
_NEW = """
  SELECT c.kind, c.ref, c.type, r.recipient_id, r.recipients, c.title, c.message,
         CASE WHEN c.kind = 'staff_7_plus' THEN 'staff' END AS audience,
         '{{"ref":"' || c.ref || '","tx_id":"' || c.ref || '",' ||
         CASE WHEN c.kind = 'member_2_6' THEN '"goto":"/history#tx=' || c.ref
              ELSE '"user_id":' || CAST(c.user_id AS VARCHAR) || ',"item":"' || c.item_name || '","qty":' || CAST(c.qty AS VARCHAR)
                || ',"days_overdue":' || CAST(c.days_overdue AS VARCHAR)
                || CASE WHEN c.kind = 'staff_7_plus'
                        THEN ',"print_url":"/reports/overdue/print?tx=' || replace(url_encode(c.ref), '+', '%20') || '"' ELSE '' END
                || ',"history_url":"/staff/history?member=' || CAST(c.user_id AS VARCHAR) END || '"}}' AS meta, {ts} AS created_at, {day} AS created_date
  FROM _cand{n} c, LATERAL (
    SELECT c.recipient_id AS recipient_id, CAST(1 AS BIGINT) AS recipients
    WHERE c.kind = 'member_2_6' AND c.ref NOT IN (SELECT ref FROM _stored{n} WHERE type = 'overdue_student')
    UNION ALL
    SELECT f.first_untold, 1 FROM _first_untold{n} f
    WHERE c.kind = 'staff_2_6' AND f.ref = c.ref AND f.first_untold IS NOT NULL
      AND c.ref NOT IN (SELECT ref FROM _stored{n} WHERE type = 'overdue_staff_2_6' AND created_date = {day})
    UNION ALL
    SELECT NULL, f.untold FROM _untold7{n} f WHERE c.kind = 'staff_7_plus' AND f.ref = c.ref AND f.untold > 0) r"""


def notify_ctes(day: str, ts: str, n: str = "", more: str = "") -> dict[str, str]:
    """CTEs of a run on a day; ``more`` adds stored rows to those of the table."""
    return {
        "_cand" + n: _CAND.format(n=n),
        "_roster" + n: """
  SELECT u.id AS staff_id, u.email AS staff_email, u.created_at AS joined, row_number() OVER (ORDER BY u.id) AS staff_rank
  FROM users u JOIN roles r ON r.id = u.role_id WHERE r.name IN ('staff', 'admin')""",
        "_stored" + n: f"""
  SELECT * FROM (SELECT user_id, type, json_extract_string(meta, '$.ref') AS ref, created_date, created_at, audience
                 FROM notifications {more}) z WHERE ref IS NOT NULL""",
        "_first_untold" + n: f"""
  SELECT c.ref, MIN(r.staff_id) AS first_untold FROM (SELECT DISTINCT ref FROM _cand{n} WHERE kind = 'staff_2_6') c, _roster r
  WHERE NOT EXISTS (SELECT 1 FROM _stored{n} s WHERE s.type = 'overdue_staff_2_6' AND s.ref = c.ref AND s.user_id = r.staff_id)
  GROUP BY c.ref""",
        "_untold7" + n: f"""
  SELECT c.ref, COUNT(*) AS untold FROM (SELECT DISTINCT ref FROM _cand{n} WHERE kind = 'staff_7_plus') c, _roster r
  WHERE NOT EXISTS (SELECT 1 FROM _stored{n} s WHERE s.type = 'overdue_staff' AND s.ref = c.ref AND s.user_id = r.staff_id)
    AND NOT EXISTS (SELECT 1 FROM _stored{n} s WHERE s.type = 'overdue_staff' AND s.ref = c.ref AND s.audience = 'staff'
                    AND COALESCE(r.joined, s.created_at) <= s.created_at)
  GROUP BY c.ref""",
        "_new" + n: _NEW.format(n=n, day=day, ts=ts),
    }


NOTIFY_CTES = notify_ctes(A, RUN_TS_SQL)


def oracle(body: str, extra=None) -> str:
    return _oracle(body, {**NOTIFY_CTES, **(extra or {})})


@register("overdue_fanout", oracle("SELECT * FROM _cand"))
def q_overdue_fanout(spark, sf_dir):
    return N.overdue_candidates(lending(spark, sf_dir), AS_OF)


@register("notification_dedupe", oracle("SELECT * FROM _new"))
def q_notification_dedupe(spark, sf_dir):
    return N.notification_dedupe(lending(spark, sf_dir), AS_OF)


NEXT_DAY = AS_OF + dt.timedelta(days=1)
NEXT_CTES = {k + "_2": v.replace("_aged", "_aged_2") for k, v in tier_views(f"DATE '{NEXT_DAY}'").items()} | notify_ctes(
    f"DATE '{NEXT_DAY}'", f"TIMESTAMP '{N.run_timestamp(NEXT_DAY)}'", "_2",
    "UNION ALL SELECT recipient_id, type, ref, created_date, created_at, audience FROM _new")


@register("overdue_second_run", oracle("SELECT * FROM _new_2", NEXT_CTES))
def q_overdue_second_run(spark, sf_dir):
    """The run of the next day, over the table that the first run has added to."""
    l = lending(spark, sf_dir)
    rows = notices_as_rows(N.notification_dedupe(l, AS_OF)).checkpoint(eager=True)
    tables = {n: (lambda n=n: getattr(l, n)) for n in l.NAMES if n != "notifications"}
    after = Lending(**tables, notifications=l.notifications.unionByName(rows), open_transactions=lambda: l.open_transactions)
    return N.notification_dedupe(after, NEXT_DAY)


@register("staff_addresses", oracle(f"""
SELECT 'staff-{AS_OF}' AS audience_id, staff_id, staff_email AS to_address, {A} AS run_date FROM _roster WHERE staff_email <> ''"""))
def q_staff_addresses(spark, sf_dir):
    return N.staff_addresses(lending(spark, sf_dir), AS_OF)


_SUBJ = """CASE kind WHEN 'member_2_6' THEN 'Overdue equipment reminder'
                WHEN 'staff_2_6' THEN '[Alert] 2-6 days overdue'
                ELSE '[Alert] over 7 days overdue' END"""


@register("mail_outbox", oracle(f"""
SELECT kind, ref, recipient_email AS to_address, 'member' AS audience, CAST(NULL AS VARCHAR) AS audience_id,
       CAST(1 AS BIGINT) AS recipients,
       {_SUBJ} AS subject, message AS body, {A} AS run_date
FROM _cand WHERE kind = 'member_2_6' AND recipient_email <> ''
UNION ALL
SELECT kind, ref, CAST(NULL AS VARCHAR), 'staff', 'staff-2001-08-05',
       (SELECT COUNT(*) FROM _roster WHERE staff_email <> ''), {_SUBJ}, message, {A}
FROM _cand WHERE kind <> 'member_2_6'
UNION ALL
SELECT kind, ref, 'staff@example.com', 'alert', CAST(NULL AS VARCHAR), CAST(1 AS BIGINT), {_SUBJ}, message, {A}
FROM _cand WHERE kind <> 'member_2_6'"""))
def q_mail_outbox(spark, sf_dir):
    return N.mail_outbox(lending(spark, sf_dir), AS_OF)


# Every notice that somebody sees: their own, and for staff those to all since they joined.
_SEEN = """
  SELECT user_id, id, type, title, message, meta, created_at, read_at FROM notifications WHERE user_id IS NOT NULL
  UNION ALL
  SELECT r.staff_id, m.id, m.type, m.title, m.message, m.meta, m.created_at, w.read_at
  FROM (SELECT * FROM notifications WHERE audience = 'staff') m JOIN _roster r ON COALESCE(r.joined, m.created_at) <= m.created_at
  LEFT JOIN notification_reads w ON w.notification_id = m.id AND w.user_id = r.staff_id"""
SEEN_CTES = {"_seen": _SEEN}

_FEED = """
SELECT user_id, CAST(pos AS INTEGER) AS pos, id, type, title, message, meta, created_at, read_at
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS FIRST, id) AS pos
      FROM _seen {where}) f
WHERE pos <= {n}"""


@register("notification_feed", oracle(_FEED.format(where="", n=20), SEEN_CTES))
def q_notification_feed(spark, sf_dir):
    return N.notification_feed(lending(spark, sf_dir), 20)


@register("notification_feed_staff", oracle(_FEED.format(
    where="WHERE type IN ('overdue_staff', 'overdue_staff_2_6') "
          "AND user_id IN (SELECT staff_id FROM _roster)", n=50), SEEN_CTES))
def q_notification_feed_staff(spark, sf_dir):
    return N.notification_feed(lending(spark, sf_dir), 50, staff_only=True)


@register("unread_badges", oracle("""
SELECT user_id, unread,
       CASE WHEN unread > 99 THEN '99+' WHEN unread > 0 THEN CAST(unread AS VARCHAR) END AS badge
FROM (SELECT user_id, COUNT(*) FILTER (WHERE read_at IS NULL) AS unread FROM _seen GROUP BY user_id) b""", SEEN_CTES))
def q_unread_badges(spark, sf_dir):
    return N.unread_badges(lending(spark, sf_dir))


@register("read_audience", oracle(f"""
SELECT * FROM notification_reads
UNION ALL
SELECT DISTINCT m.id, r.staff_id, {RUN_TS_SQL} FROM mark_read_requests q JOIN notifications m ON m.id = q.id AND m.audience = 'staff'
JOIN _roster r ON r.staff_id = q.user_id AND COALESCE(r.joined, m.created_at) <= m.created_at
WHERE NOT EXISTS (SELECT 1 FROM notification_reads w WHERE w.notification_id = m.id AND w.user_id = r.staff_id)"""))
def q_read_audience(spark, sf_dir):
    return N.read_audience(lending(spark, sf_dir), fx.mark_read_requests(spark, sf_dir), N.run_timestamp(AS_OF))


@register("mark_read", oracle(f"""
SELECT n.* EXCLUDE (read_at),
       CASE WHEN r.id IS NOT NULL AND n.read_at IS NULL THEN {RUN_TS_SQL} ELSE n.read_at END AS read_at,
       (r.id IS NOT NULL AND n.read_at IS NULL) AS changed
FROM notifications n
LEFT JOIN (SELECT DISTINCT id, user_id FROM mark_read_requests) r
  ON r.id = n.id AND r.user_id = n.user_id"""))
def q_mark_read(spark, sf_dir):
    l = lending(spark, sf_dir)
    return N.mark_read(l, fx.mark_read_requests(spark, sf_dir), N.run_timestamp(AS_OF))


@register("faculty_letters", oracle("""
SELECT o.tx_id, COALESCE(u.faculty, '(unspecified)') AS faculty,
       COALESCE(u.full_name, '-') AS full_name, COALESCE(u.email, '-') AS email,
       o.item_name, o.qty,
       CAST(day(t.borrow_date) AS VARCHAR) || '/' || CAST(month(t.borrow_date) AS VARCHAR) || '/'
         || CAST(year(t.borrow_date) + 543 AS VARCHAR) AS borrow_date_th,
       o.days_overdue, t.escalated_at IS NOT NULL AS escalated
FROM _very_late o JOIN transactions t ON t.id = o.tx_id LEFT JOIN users u ON u.id = o.user_id"""))
def q_faculty_letters(spark, sf_dir):
    return N.faculty_letters(lending(spark, sf_dir), AS_OF)


PROMISE_SQL = r"""
SELECT req_id, tx_id, date, outcome,
       CASE outcome WHEN 'set' THEN d WHEN 'cleared' THEN NULL ELSE promised_return_date END AS promised_return_date
FROM (SELECT *, CASE WHEN why IS NOT NULL THEN why
                     WHEN row_number() OVER (PARTITION BY tx_id, why IS NULL ORDER BY req_id) > 1 THEN 'conflict'
                     WHEN txt = '' THEN 'cleared' ELSE 'set' END AS outcome
      FROM (SELECT *, CASE WHEN id IS NULL THEN 'not_found' WHEN txt <> '' AND d IS NULL THEN 'invalid_date'
                           WHEN return_date IS NOT NULL THEN 'closed' END AS why
            FROM (SELECT c.*, t.id, t.return_date, t.promised_return_date, trim(COALESCE(c.date, '')) AS txt,
                         CASE WHEN regexp_matches(trim(COALESCE(c.date, '')), '^\d{4}-\d{2}-\d{2}$')
                              THEN TRY_CAST(trim(c.date) AS DATE) END AS d
                  FROM promise_changes c LEFT JOIN transactions t ON t.id = c.tx_id) a) b) e"""


@register("set_promise", oracle(PROMISE_SQL))
def q_set_promise(spark, sf_dir):
    return U.set_promise(lending(spark, sf_dir), fx.promise_changes(spark, sf_dir))


@register("mark_escalated", oracle(f"""
SELECT r.tx_id,
       CASE WHEN t.id IS NULL THEN 'not_found' WHEN t.return_date IS NOT NULL THEN 'already_returned'
            WHEN t.escalated_at IS NOT NULL THEN 'already_marked' ELSE 'marked' END AS outcome,
       CASE WHEN t.id IS NOT NULL AND t.return_date IS NULL AND t.escalated_at IS NULL
            THEN {RUN_TS_SQL} ELSE t.escalated_at END AS escalated_at
FROM (SELECT DISTINCT tx_id FROM escalation_requests) r LEFT JOIN transactions t ON t.id = r.tx_id"""))
def q_mark_escalated(spark, sf_dir):
    return U.mark_escalated(lending(spark, sf_dir), fx.escalation_requests(spark, sf_dir),
                            N.run_timestamp(AS_OF))


MANUAL_SQL = f"""
SELECT r.req_id, r.tx_id,
       CASE WHEN t.id IS NULL THEN 'not_found'
            WHEN t.return_date IS NOT NULL THEN 'already_returned'
            WHEN COALESCE({A} - t.borrow_date, 0) < 2 THEN 'not_overdue_enough'
            WHEN r.tx_id IN (SELECT ref FROM _stored WHERE type = 'overdue_student')
                 OR r.req_id <> f.first_req THEN 'already'
            ELSE 'inserted' END AS status
FROM manual_notice_requests r
JOIN (SELECT tx_id, MIN(req_id) AS first_req FROM manual_notice_requests GROUP BY tx_id) f
  ON f.tx_id = r.tx_id
LEFT JOIN (SELECT t.* FROM transactions t WHERE t.inventory_id IN (SELECT id FROM inventory)) t
  ON t.id = r.tx_id"""


@register("manual_notice", oracle(MANUAL_SQL))
def q_manual_notice(spark, sf_dir):
    return U.manual_notice(lending(spark, sf_dir), AS_OF, fx.manual_notice_requests(spark, sf_dir))


ROTATION_FROM, ROTATION_TO = dt.date(2001, 7, 1), AS_OF


@register("staff_rotation_schedule", oracle(f"""
SELECT t.id AS ref, t.user_id, CAST(t.borrow_date + d.n AS DATE) AS day,
       CAST(d.n AS INTEGER) AS days_overdue, r.staff_id AS recipient_id
FROM transactions t JOIN (VALUES (2), (3), (4), (5), (6)) d(n) ON TRUE
JOIN _roster r ON r.staff_rank = d.n - 1
WHERE t.return_date IS NULL AND t.borrow_date IS NOT NULL
  AND t.borrow_date + d.n BETWEEN DATE '{ROTATION_FROM}' AND DATE '{ROTATION_TO}'"""))
def q_staff_rotation_schedule(spark, sf_dir):
    return N.staff_rotation_schedule(lending(spark, sf_dir), ROTATION_FROM, ROTATION_TO)


FEED_SINCE = dt.datetime(2024, 1, 25, 12, 0, 0)


@register("notification_feed_since", oracle(f"""
SELECT user_id, CAST(pos AS INTEGER) AS pos, id, type, title, message, meta, created_at, read_at
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS FIRST, id) AS pos
      FROM _seen WHERE created_at >= TIMESTAMP '{FEED_SINCE}' - INTERVAL 5 SECOND) f
WHERE pos <= 100""", SEEN_CTES))
def q_notification_feed_since(spark, sf_dir):
    return N.notification_feed(lending(spark, sf_dir), 500, since=FEED_SINCE)

