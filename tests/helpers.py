"""Small exact tables for rule tests: build a Lending from literal rows."""

from __future__ import annotations

import datetime as dt

from kitlend import schema as S
from kitlend.sources.fixtures import Lending

D = dt.date
TS = dt.datetime


def make_lending(spark, **rows) -> Lending:
    def df(name):
        return spark.createDataFrame(rows.get(name, []), S.TABLES[name])
    roles = rows.get("roles", [(1, "student"), (2, "external"), (3, "staff"), (4, "admin")])
    return Lending(
        roles=spark.createDataFrame(roles, S.ROLES), users=df("users"), inventory=df("inventory"),
        transactions=df("transactions"), transaction_returns=df("transaction_returns"),
        fitness_visits=df("fitness_visits"), notifications=df("notifications"),
        user_holds=df("user_holds"))


def user(uid, member_type="student", role_id=1, email=None, student_id=None, citizen_id=None,
         name=None, faculty=None, qr=None, created=None, sid_hash=None):
    return (uid, role_id, member_type, email or f"u{uid}@x.edu", student_id, citizen_id,
            name or f"User {uid}", faculty, None, qr, created, sid_hash)


def item(iid, name=None, stock=10, active=True, deleted_at=None):
    return (iid, name or f"item {iid}", stock, active, deleted_at)


def loan(tid, uid, iid, qty, borrow=None, returned=None, created=None, escalated=None, promised=None):
    return (tid, uid, iid, qty, borrow, returned, created, escalated, promised)


def ret(rid, tid, q, at=TS(2001, 1, 1)):
    return (rid, tid, q, at, None)


def note(nid, uid, ntype, ref=None, created=TS(2001, 8, 1), read=None, day="auto", audience=None):
    meta = None if ref is None else '{"ref":"%s"}' % ref
    cday = created.date() if day == "auto" else day
    return (nid, uid, ntype, None, None, meta, created, read, cday, audience)


def rows(df, *cols, order=None):
    out = [tuple(r[c] for c in cols) for r in df.collect()]
    return sorted(out, key=repr) if order is None else out
