"""Small exact tables, one per rule of FIXTURES.md section 4."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from helpers import D, TS, item, loan, make_lending, note, ret, rows, user
from kitlend import schema as S
from kitlend.operators import balances as B
from kitlend.operators import changes as C
from kitlend.operators import history as H
from kitlend.operators import jobs as J
from kitlend.operators import notify as N
from kitlend.operators import overdue as O
from kitlend.operators.members import resolve_members

AS_OF = D(2001, 8, 5)


def days_ago(n):
    return AS_OF - dt.timedelta(days=n)


def test_loan_age_tiers(spark):
    loans = [loan(f"t{n}", 1, 1, 1, days_ago(n)) for n in (1, 2, 6, 7)]
    loans += [loan("tnull", 1, 1, 1, None), loan("tfut", 1, 1, 1, days_ago(-1))]
    l = make_lending(spark, users=[user(1)], inventory=[item(1)], transactions=loans)
    assert rows(O.overdue_2_6_days(l, AS_OF), "tx_id", "days_overdue") == [("t2", 2), ("t6", 6)]
    assert rows(O.overdue_7_plus(l, AS_OF), "tx_id") == [("t7",)]


def test_outstanding_subtracts_part_returns(spark):
    loans = [loan("none", 1, 1, 5, days_ago(3)), loan("two", 1, 1, 5, days_ago(3)),
             loan("all_open", 1, 1, 5, days_ago(3)), loan("closed", 1, 1, 5, days_ago(3), TS(2001, 8, 4))]
    rets = [ret("r1", "two", 2), ret("r2", "all_open", 5), ret("r3", "closed", 5)]
    l = make_lending(spark, users=[user(1)], inventory=[item(1, stock=30)], transactions=loans,
                     transaction_returns=rets)
    assert rows(B.tx_outstanding(l), "tx_id", "outstanding_qty") == [("none", 5), ("two", 3)]
    # overdue reports full qty and ignores part returns: the fully returned open loan counts
    st = B.item_status(l, AS_OF).collect()[0]
    assert (st["in_use"], st["overdue_2_6"], st["available"]) == (8, 15, 22)
    audit = rows(__import__("kitlend.operators.audit", fromlist=["x"]).audit_balances(l), "rule", "tx_id")
    assert audit == [("open_nothing_left", "all_open")]


def test_availability_is_clamped_and_totals_sum_clamped(spark):
    loans = [loan("a", 1, 1, 12, days_ago(1)), loan("b", 1, 2, 1, days_ago(1))]
    l = make_lending(spark, users=[user(1)], inventory=[item(1, stock=10), item(2, stock=5)],
                     transactions=loans)
    av = {r["id"]: r["available_for_new_borrow"] for r in B.inventory_available(l).collect()}
    assert av == {1: 0, 2: 4}
    k = B.inventory_kpis(l).collect()[0]
    assert (k["total_stock"], k["total_out"], k["total_available"]) == (15, 13, 4)
    assert rows(B.stock_level(l), "id", "stock_level") == [(1, "out"), (2, "ok")]


def test_status_precedence_and_promise_rules(spark):
    loans = [
        loan("ret_esc", 1, 1, 1, days_ago(9), TS(2001, 8, 1), escalated=TS(2001, 7, 30)),
        loan("esc_prom", 1, 1, 1, days_ago(9), escalated=TS(2001, 7, 30), promised=days_ago(1)),
        loan("prom_today", 1, 1, 1, days_ago(3), promised=AS_OF),
        loan("prom_yday", 1, 1, 1, days_ago(3), promised=days_ago(1)),
        loan("prom_tmrw", 1, 1, 1, days_ago(3), promised=days_ago(-1)),
        loan("d7", 1, 1, 1, days_ago(7)), loan("d2", 1, 1, 1, days_ago(2)), loan("d1", 1, 1, 1, days_ago(1)),
    ]
    l = make_lending(spark, users=[user(1)], inventory=[item(1)], transactions=loans)
    st = dict(rows(O.loan_status(l, AS_OF), "tx_id", "status"))
    assert st == {"ret_esc": "returned", "esc_prom": "escalated", "prom_today": "promised",
                  "prom_yday": "promised", "prom_tmrw": "promised", "d7": "overdue_7_plus",
                  "d2": "overdue_2_plus", "d1": "open"}
    ps = {r[0]: (r[1], r[2]) for r in rows(O.promise_state(l, AS_OF), "tx_id", "missed_by_date",
                                              "missed_by_instant")}
    assert ps["prom_today"] == (False, True)
    assert ps["prom_yday"] == (True, True)
    assert ps["prom_tmrw"] == (False, False)


def _requests(spark, reqs):
    return spark.createDataFrame(
        [(r, TS(2001, 8, 1, 0, i), u, it, q, D(2001, 8, 1)) for i, (r, u, it, q) in enumerate(reqs)],
        S.LOAN_REQUESTS)


def test_admission_refused_request_uses_nothing(spark):
    l = make_lending(spark, users=[user(1)], inventory=[item(1, stock=7)])
    out = J.admit_loans(l, _requests(spark, [("a", 1, 1, 5), ("b", 1, 1, 3), ("c", 1, 1, 4), ("d", 1, 1, 1)]))
    assert rows(out, "req_id", "accepted", "reason") == [
        ("a", True, None), ("b", False, "stock"), ("c", False, "stock"), ("d", True, None)]
    out = J.admit_loans(l, _requests(spark, [("a", 1, 1, 5), ("b", 999, 1, 1), ("c", 1, 1, 2)]))
    assert rows(out, "req_id", "reason") == [("a", None), ("b", "user"), ("c", None)]


def test_admission_hold_rules(spark):
    holds = [(1, 2, "overdue", TS(2001, 7, 1), None), (2, 3, "overdue", TS(2001, 7, 1), None)]
    l = make_lending(spark, users=[user(1), user(2), user(3)], inventory=[item(1, stock=1)],
                     transactions=[loan("open", 2, 1, 1, days_ago(9))], user_holds=holds)
    req = _requests(spark, [("h_open", 2, 1, 1), ("h_free", 3, 1, 5), ("bad", 1, 1, 0), ("noitem", 1, 9, 1)])
    out = J.admit_loans(l, req)
    assert rows(out, "req_id", "reason") == [("bad", "invalid"), ("h_free", "stock"),
                                             ("h_open", "hold"), ("noitem", "item")]
    rel = rows(J.borrow_hold_releases(l, req), "user_id")
    assert rel == [(3,)]  # released although the stock check then fails


def _events(spark, evs):
    return spark.createDataFrame(
        [(e, TS(2001, 8, 2, 0, i), t, q, None) for i, (e, t, q) in enumerate(evs)], S.RETURN_EVENTS)


def test_return_settlement(spark):
    loans = [loan("L5", 1, 1, 5, days_ago(3)), loan("Z", 1, 1, 4, days_ago(3)),
             loan("N", 1, 1, 4, days_ago(3))]
    l = make_lending(spark, users=[user(1)], inventory=[item(1)], transactions=loans)
    ev = _events(spark, [("e1", "L5", 3), ("e2", "L5", 3), ("e3", "L5", None), ("e4", "L5", 1),
                         ("z", "Z", 0), ("n", "N", -1), ("x", "nope", 1)])
    out = {r[0]: r[1:] for r in rows(J.settle_returns(l, ev), "event_id", "reason", "returned_qty",
                                      "outcome")}
    assert out["e1"] == (None, 3, "return_partial")
    assert out["e2"] == ("over", None, None)
    assert out["e3"] == (None, 2, "return_completed")
    assert out["e4"] == ("closed", None, None)
    assert out["z"] == (None, 4, "return_completed")
    assert out["n"] == (None, 4, "return_completed")
    assert out["x"] == ("not_found", None, None)


def test_return_releases_hold_when_nothing_left(spark):
    loans = [loan("A", 1, 1, 2, days_ago(3)), loan("B", 2, 1, 2, days_ago(3)), loan("C", 2, 1, 1, days_ago(3))]
    holds = [(1, 1, "overdue", TS(2001, 7, 1), None), (2, 2, "overdue", TS(2001, 7, 1), None)]
    l = make_lending(spark, users=[user(1), user(2)], inventory=[item(1)], transactions=loans,
                     user_holds=holds)
    settled = J.settle_returns(l, _events(spark, [("a", "A", None), ("b", "B", None)]))
    rel = J.return_hold_releases(l, settled)
    assert rows(rel, "user_id", "note") == [(1, "auto-clear: returned tx A")]
    h = {r[0]: r[1:] for r in rows(J.clear_holds(l, rel, TS(2001, 8, 5, 1)), "user_id", "cleared_now", "reason")}
    assert h[1] == (True, "overdue | cleared: auto-clear: returned tx A")
    assert h[2] == (False, "overdue")


STAFF = [user(10, "staff", 3), user(11, "staff", 3), user(12, "admin", 4)]


def _stored_from(out, day):
    return [(f"{r['kind']}-{r['recipient_id']}-{day}", r["recipient_id"], r["type"], None, None,
             r["meta"], TS(day.year, day.month, day.day, 1), None, day, r["audience"])
            for r in out.collect()]


def test_staff_rotation_and_member_once(spark):
    borrowed = D(2001, 8, 1)
    base = dict(users=[user(1)] + STAFF, inventory=[item(1)],
                transactions=[loan("L", 1, 1, 1, borrowed)])
    stored = []
    got = []
    for d in range(2, 7):
        as_of = borrowed + dt.timedelta(days=d)
        l = make_lending(spark, notifications=stored, **base)
        out = N.notification_dedupe(l, as_of)
        got.append(sorted((r["kind"], r["recipient_id"]) for r in out.collect()))
        stored = stored + _stored_from(out, as_of)
    assert got == [[("member_2_6", 1), ("staff_2_6", 10)], [("staff_2_6", 11)], [("staff_2_6", 12)], [], []]
    # a second run on the same day adds nothing, but mail goes out again
    as_of = borrowed + dt.timedelta(days=4)
    l = make_lending(spark, notifications=stored, **base)
    assert N.notification_dedupe(l, as_of).count() == 0
    assert N.mail_outbox(l, as_of).count() == 3  # member + staff list + alert address


def test_seven_plus_reaches_staff_not_yet_told(spark):
    borrowed = D(2001, 7, 20)
    told_a = [note("x", 10, "overdue_staff", ref="L")]
    l = make_lending(spark, users=[user(1)] + STAFF, inventory=[item(1)],
                     transactions=[loan("L", 1, 1, 1, borrowed)], notifications=told_a)
    out = N.notification_dedupe(l, AS_OF).collect()
    assert [(r["kind"], r["recipients"]) for r in out] == [("staff_7_plus", 2)]
    all_told = [note(f"x{s}", s, "overdue_staff", ref="L") for s in (10, 11, 12)]
    l = make_lending(spark, users=[user(1)] + STAFF, inventory=[item(1)],
                     transactions=[loan("L", 1, 1, 1, borrowed)], notifications=all_told)
    assert N.notification_dedupe(l, AS_OF).count() == 0


def test_notifications_without_ref_never_collide(spark):
    n = [note("a", 1, "overdue_staff", ref=None), note("b", 1, "overdue_staff", ref=None)]
    l = make_lending(spark, users=[user(1)], notifications=n)
    from kitlend.operators.audit import audit_unique
    assert audit_unique(l).where(F.col("rule").startswith("notifications")).count() == 0


CODES = [
    ("000000001234", "000000001234"),
    ("9999999991234", "9999999991234"),
    ("0000-0000-1234", "000000001234"),
    ("   000000001234 ﻿", "000000001234"),
    ("https://x.org/return?member=000000001234", "000000001234"),
    ("https://x.org/members/000000001234", "000000001234"),
    ("https%3A%2F%2Fx.org%2Freturn%3Fmember%3D000000001234", "000000001234"),
    ("https://x.org/return?member=a+b%20c", "abc"),
    ("%zz", "%zz"),
    ("a+b", "a+b"),
    ("c56a4180-65aa-42ec-a945-5fd21dec0538", "c56a4180-65aa-42ec-a945-5fd21dec0538"),
    ("C56A4180-65AA-42EC-A945-5FD21DEC0538", "C56A4180-65AA-42EC-A945-5FD21DEC0538"),
    ("-", ""),
    ("   ", ""),
    ("A1234567890123", "A1234567890123"),
    ("id: 000000001234.", "000000001234"),
]


def test_code_normalising_and_resolution(spark):
    scans = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(CODES)], S.SCAN_CODES)
    users = [user(1234, student_id="000000001234", qr="000000001234"),
             user(7, "external", 2, citizen_id="9999999991234", qr="9999999991234"),
             user(8, "staff", 3)]
    l = make_lending(spark, users=users)
    out = {r[0]: r[1:] for r in rows(resolve_members(scans, l.users), "scan_id", "code", "user_id")}
    for i, (_, want) in enumerate(CODES):
        assert out[i][0] == want, CODES[i]
    assert out[0][1] == 1234 and out[1][1] == 7 and out[2][1] == 1234
    assert out[12][1] is None and out[13][1] is None  # empty codes match nothing


def test_registration_batch_first_wins_on_two_keys(spark):
    regs = spark.createDataFrame([
        (1, TS(2001, 8, 1, 0, 1), "student", "e1@mail.example.edu", "111111111111", None, "A", None, None),
        (2, TS(2001, 8, 1, 0, 2), "student", "E1@mail.example.edu", "222222222222", None, "B", None, None),
        (3, TS(2001, 8, 1, 0, 3), "student", "e3@mail.example.edu", "222222222222", None, "C", None, None),
        (4, TS(2001, 8, 1, 0, 4), "student", "e4@mail.example.edu", "44444444444", None, "D", None, None),
        (5, TS(2001, 8, 1, 0, 5), "student", "e5@other.org", "555555555555", None, "E", None, None),
        (6, TS(2001, 8, 1, 0, 6), "external", "u1@x.edu", None, "6666666666666", "F", None, None),
    ], "req_id long, ts timestamp_ntz, kind string, email string, student_id string, citizen_id string, "
       "full_name string, faculty string, phone string")
    l = make_lending(spark, users=[user(1)])
    out = rows(C.register_members(l, regs), "req_id", "reason")
    assert out == [(1, None), (2, "taken_in_batch"), (3, None), (4, "student_id_format"),
                   (5, "email_domain"), (6, "taken")]


def test_null_order_in_history(spark):
    loans = [loan("a", 1, 1, 1, None), loan("b", 1, 1, 1, days_ago(2), created=None),
             loan("c", 1, 1, 1, days_ago(2), created=TS(2001, 8, 3, 5)), loan("d", 1, 1, 1, days_ago(9))]
    l = make_lending(spark, users=[user(1)], inventory=[item(1)], transactions=loans)
    assert [r["id"] for r in H.history_loans(l, AS_OF).collect()] == ["a", "c", "b", "d"]


def test_inventory_changes_and_archive(spark):
    inv = [item(1, "Ball", stock=10), item(2, "Net", stock=10), item(3, "Bat", stock=5)]
    l = make_lending(spark, users=[user(1)], inventory=inv,
                     transactions=[loan("t", 1, 1, 6, days_ago(1))])
    ch = spark.createDataFrame([(1, None, "ball", 5, True), (2, 2, "BALL", 10, True), (3, 1, "Ball", 4, True),
                                (4, 3, "Bat", 5, False), (5, 3, "Bat", 6, True)],
                               "req_id long, id long, name string, stock int, active boolean")
    assert rows(C.check_inventory_changes(l, ch), "req_id", "reason") == [
        (1, "name_taken"), (2, "name_taken"), (3, "below_in_use"), (4, None), (5, "duplicate_change")]
    dels = spark.createDataFrame([(1,), (2,), (99,)], "id long")
    out = rows(C.delete_or_archive_items(l, dels, TS(2001, 8, 5, 1)), "id", "outcome", "active")
    assert out == [(1, "archived", False), (2, "deleted", True), (99, "not_found", None)]


def test_rotation_schedule_matches_day_by_day_runs(spark):
    borrowed = D(2001, 8, 1)
    l = make_lending(spark, users=[user(1)] + STAFF, inventory=[item(1)],
                     transactions=[loan("L", 1, 1, 1, borrowed)])
    sched = rows(N.staff_rotation_schedule(l, D(2001, 8, 1), D(2001, 8, 10)), "day", "recipient_id")
    assert sched == [(D(2001, 8, 3), 10), (D(2001, 8, 4), 11), (D(2001, 8, 5), 12)]


def test_second_partial_return_notice_is_dropped(spark):
    l = make_lending(spark, users=[user(1)], inventory=[item(1)], transactions=[loan("L", 1, 1, 5, days_ago(3))],
                     notifications=[note("old", 1, "return_partial", ref="ret-OTHER")])
    settled = J.settle_returns(l, _events(spark, [("a", "L", 1), ("b", "L", 1), ("c", "L", None)]))
    got = rows(J.return_notices(l, settled), "event_id", "type", "inserted", "mailed")
    assert got == [("a", "return_partial", True, True), ("b", "return_partial", False, True),
                   ("c", "return_completed", True, True)]


def test_hold_release_notices(spark):
    holds = [(i, i, "overdue", TS(2001, 7, 1), None) for i in (1, 2, 3, 4)]
    l = make_lending(spark, users=[user(i) for i in (1, 2, 3, 4)], inventory=[item(1)], user_holds=holds,
                     notifications=[note("n", 4, "hold_cleared", ref="hold-clear-4")])
    rel = spark.createDataFrame(
        [(1, "manual", 1, "hold-clear-1"), (2, J.NOTE_BORROW, 2, None), (3, "auto-clear: returned tx A", 3, "clear-A"),
         (4, "manual", 1, "hold-clear-4")], "user_id long, note string, priority int, ref string")
    got = rows(J.hold_release_notices(l, rel), "user_id", "ref")
    assert got == [(1, "hold-clear-1"), (3, "clear-A")]  # borrow clears silently; 4 was already told


def test_registration_without_a_kind_is_refused(spark):
    l = make_lending(spark)
    regs = spark.createDataFrame([(1, TS(2001, 8, 1), None, "a@mail.example.edu", None, "1234567890123", "A", None, None)],
                                 "req_id long, ts timestamp_ntz, kind string, email string, student_id string, "
                                 "citizen_id string, full_name string, faculty string, phone string")
    r = C.register_members(l, regs).first()
    assert (r["accepted"], r["reason"], r["role_id"], r["qr_code_value"]) == (False, "kind", None, None)


def test_a_refused_item_change_frees_its_name(spark):
    l = make_lending(spark, inventory=[item(1), item(2)])
    ch = spark.createDataFrame([(1, 1, "x", 5, True), (2, 1, "y", 5, True), (3, 2, "y", 5, True), (4, None, "Y ", 5, True)],
                               "req_id long, id long, name string, stock int, active boolean")
    got = rows(C.check_inventory_changes(l, ch), "req_id", "reason")
    assert got == [(1, None), (2, "duplicate_change"), (3, None), (4, "name_taken_in_batch")]


def test_first_valid_role_change_wins(spark):
    l = make_lending(spark, users=[user(1)])
    ch = spark.createDataFrame([(1, 1, "owner"), (2, 1, "staff"), (3, 1, "admin"), (4, 9, "staff")],
                               "req_id long, user_id long, role string")
    got = rows(C.apply_role_changes(l, ch), "req_id", "outcome", "role_id")
    assert got == [(1, "role_not_found", 1), (2, "role_updated", 3), (3, "duplicate_change", 1), (4, "not_found", None)]


def test_first_valid_promise_change_wins(spark):
    from kitlend.operators import updates as U
    l = make_lending(spark, transactions=[loan("a", 1, 1, 1, days_ago(3), promised=days_ago(1))], inventory=[item(1)])
    ch = spark.createDataFrame([("1", "a", "5/8/2001"), ("2", "a", "2001-08-09"), ("3", "a", "2001-08-10"), ("4", "b", "")],
                               "req_id string, tx_id string, date string")
    got = rows(U.set_promise(l, ch), "req_id", "outcome", "promised_return_date")
    assert got == [("1", "invalid_date", days_ago(1)), ("2", "set", D(2001, 8, 9)), ("3", "conflict", days_ago(1)),
                   ("4", "not_found", None)]


def test_a_long_registration_chain_is_decided_by_parity(spark):
    """e1-i1, e1-i2, e2-i2, ...: each shares one key with the row before it."""
    n = 10_000
    regs = spark.createDataFrame(
        [(k, TS(2001, 8, 1) + dt.timedelta(seconds=k), "external", f"e{k // 2}@x", None, f"{(k + 1) // 2:013d}", "N", None, None)
         for k in range(n)],
        "req_id long, ts timestamp_ntz, kind string, email string, student_id string, citizen_id string, "
        "full_name string, faculty string, phone string").repartition(8)
    calls = []
    real = C._chains
    C._chains = lambda m: calls.append(1) or real(m)
    try:
        got = {r["req_id"]: r["accepted"] for r in C.register_members(make_lending(spark), regs).collect()}
    finally:
        C._chains = real
    assert got == {k: k % 2 == 0 for k in range(n)} and len(calls) == 1


def test_registration_rounds_equal_first_come_first_served(spark):
    import random
    rnd = random.Random(6)
    rows_ = [(k, TS(2001, 8, 1) + dt.timedelta(seconds=rnd.randint(0, 50)), "external", f"e{rnd.randint(0, 60)}@x", None,
              f"{rnd.randint(0, 60):013d}", "N", None, None) for k in range(200)]
    regs = spark.createDataFrame(rows_, "req_id long, ts timestamp_ntz, kind string, email string, student_id string, "
                                 "citizen_id string, full_name string, faculty string, phone string")
    es, ids, want = set(), set(), {}
    for r in sorted(rows_, key=lambda r: (r[1], r[0])):
        want[r[0]] = r[3] not in es and r[5] not in ids
        if want[r[0]]:
            es.add(r[3])
            ids.add(r[5])
    assert {r["req_id"]: r["accepted"] for r in C.register_members(make_lending(spark), regs).collect()} == want


def test_deleted_members_go_with_their_notices_and_holds(spark):
    from kitlend.operators import snapshots as SN
    l = make_lending(spark, users=[user(1), user(2)], inventory=[item(1)], transactions=[loan("t", 1, 1, 1, days_ago(1))],
                     notifications=[note("a", 1, "x"), note("b", 2, "x"), note("c", None, "overdue_staff", "t", audience="staff")],
                     user_holds=[(1, 1, "r", TS(2001, 1, 1), None), (2, 2, "r", TS(2001, 1, 1), None)])
    after = SN.after_user_deletes(l, spark.createDataFrame([(1,), (2,), (3,)], "user_id long"))
    assert {n: rows(df, "id") for n, df in after.items()} == {"users": [(1,)], "notifications": [("a",), ("c",)],
                                                              "user_holds": [(1,)]}


def test_escalation_and_seven_day_notice_share_the_once_rule(spark):
    from kitlend.operators import snapshots as SN
    l = make_lending(spark, users=[user(1), user(5, "staff", 3, created=TS(2001, 1, 1))], inventory=[item(1)],
                     transactions=[loan("new", 1, 1, 1, days_ago(9)), loan("told", 1, 1, 1, days_ago(9)),
                                   loan("back", 1, 1, 1, days_ago(9), returned=TS(2001, 8, 1))],
                     notifications=[note("a", None, "overdue_staff", "told", audience="staff")])
    req = spark.createDataFrame([("new",), ("told",), ("back",), ("new",)], "tx_id string")
    got = rows(SN.escalation_notices(l, req, AS_OF), "ref", "type", "recipients")
    assert got == [("new", "overdue_faculty", 1), ("new", "overdue_staff", 1), ("told", "overdue_faculty", 1)]


def test_loans_are_not_dealt_by_the_instant_of_their_notice(spark):
    """Most loans have no 7+ day row and one run gives all its rows one instant: neither
    may gather in one task."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        l = make_lending(spark, users=[user(1, "staff", 3), user(2, "staff", 3, created=TS(2001, 8, 2))],
                         notifications=[note("n", None, N.STAFF_7_PLUS, "a", audience="staff")])
        s7 = spark.createDataFrame([("a",), ("b",)], "ref string")
        out = N.untold_staff(l, s7)
        assert "hashpartitioning(_at7" not in out._jdf.queryExecution().executedPlan().toString()
        assert rows(out, "ref", "recipients") == [("a", 1), ("b", 2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_history_moves_loans_once_a_key(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        l = make_lending(spark, transactions=[loan("a", 1, 1, 1, D(2001, 7, 1))])
        p = H.history_loans(l, AS_OF)._jdf.queryExecution().executedPlan().toString()
        assert sum("Exchange hashpartitioning(user_id" in line for line in p.splitlines()) <= 2  # the loans, the holds
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_settlement_is_stored_as_columns(spark):
    l = make_lending(spark, transactions=[loan("A", 1, 1, 5, D(2001, 7, 1))])
    settled = J.settle_returns(l, _events(spark, [("a", "A", 2), ("x", "Z", 1)]))
    p = settled._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in p and "ExistingRDD" not in p
    assert rows(settled, "event_id", "reason", "returned_qty") == [("a", None, 2), ("x", "not_found", None)]


def test_settlement_moves_events_once_and_takes_any_number_of_unknown_loans(spark):
    """The plan of the result reads what was decided; one unknown loan and no loan at all may hold many events."""
    l = make_lending(spark, transactions=[loan("A", 1, 1, 700, D(2001, 7, 1)), loan("B", 1, 1, 3, D(2001, 7, 1))])
    evs = [("b1", "B", 2), ("b2", "B", 2), ("b3", "B", None), ("b4", "B", 1)]
    few = J.settle_returns(l, _events(spark, evs))
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()
    want = [("b1", None, 2, 1), ("b2", "over", None, 1), ("b3", None, 1, 0), ("b4", "closed", None, 0)]
    assert rows(few, "event_id", "reason", "returned_qty", "remaining_after") == want
    many = [(f"{t}{i}", t, 1) for t in ("A", "X", None) for i in range(600)]
    timed = [(e, TS(2001, 8, 2) + dt.timedelta(minutes=i), t, q, None) for i, (e, t, q) in enumerate(evs + many)]
    out = {r[0]: r[1:] for r in rows(J.settle_returns(l, spark.createDataFrame(timed, S.RETURN_EVENTS)), "event_id", "reason", "returned_qty",
                                      "remaining_after", "user_id", "accepted", "outcome")}
    assert len(out) == 1804 and [(e, *out[e][:3]) for e, *_ in evs] == want
    assert all(out[f"A{i}"] == (None, 1, 699 - i, 1, True, "return_partial") for i in range(600))
    assert {out[f"{t}{i}"] for t in ("X", None) for i in range(600)} == {("not_found", None, None, None, False, None)}


def test_return_notices_meet_told_loans_without_their_refs(spark):
    l = make_lending(spark, users=[user(1)], transactions=[loan(t, 1, 1, 5, D(2001, 7, 1)) for t in "AB"],
                     notifications=[note("n", 1, "return_partial", "ret-A"), note("m", 1, "return_partial", "B"),
                                    note("o", 1, "return_partial", "ret-")])
    out = J.return_notices(l, J.settle_returns(l, _events(spark, [("a", "A", 1), ("b", "B", 1), ("c", "B", 1)])))
    assert rows(out, "event_id", "ref", "inserted") == [("a", "ret-A", False), ("b", "ret-B", True), ("c", "ret-B", False)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # the refs, which follow from the loan, are never moved
        p = out.select("*")._jdf.queryExecution().executedPlan().toString()
        assert p.count("concat(ret-") == 1 and "concat(ret-" not in p.split("Exchange", 1)[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_history_adds_what_follows_from_other_columns_after_the_sort(spark):
    l = make_lending(spark, users=[user(1)], transactions=[loan("a", 1, 1, 4, D(2001, 7, 1)), loan("b", 9, 1, 1, D(2001, 7, 2))],
                     transaction_returns=[ret("r", "a", 1)])
    h = H.history_loans(l, AS_OF)
    p = h._jdf.queryExecution().executedPlan().toString()
    assert "display_code" not in p.split("rangepartitioning", 1)[1] and "days_overdue" not in p.split("rangepartitioning", 1)[1]
    assert [tuple(r) for r in h.select("id", "returned_qty", "remaining_qty", "days_overdue", "display_code").collect()][:1] == [
        ("b", 0, 1, 34, None)]
