"""Kept structures: folded feeds and badges, the name index, bucketed tables."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from helpers import D, TS, item, loan, make_lending, note, ret, user
from kitlend import schema as S
from kitlend.operators import audit as AU
from kitlend.operators import balances as B
from kitlend.operators import feed_state as K
from kitlend.operators import key_index as I
from kitlend.operators import name_index as X
from kitlend.operators import notify as N
from kitlend.plans import catalog
from kitlend.sources import bucketed
from kitlend.sources import fixtures as fx
from kitlend.sources.bucketed import read_bucketed, write_bucketed

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def after(l, **tables):
    return fx.Lending(**{n: getattr(l, n) for n in fx.Lending.NAMES if n not in tables}, **tables)


def test_ten_batches_equal_full_recomputation(spark, tmp_path):
    """Notices, readings of both kinds and a deleted member over ten batches, each run
    twice; compared with the whole tables after every third one."""
    rnd = random.Random(5)
    path = f"file:{tmp_path}"
    people = [user(i, "staff", 3, created=TS(2001, 1, 1) + dt.timedelta(days=9 * i)) for i in range(1, 6)]
    people += [user(i, created=TS(2001, 1, 1)) for i in range(6, 12)]
    rows, reads, told = {}, {}, {}
    for k in range(1, 11):
        new, fresh, heard, gone = [], [], [], []
        for j in range(60):
            at = TS(2001, 1, 1) + dt.timedelta(days=rnd.randint(0, 60))
            everybody = rnd.random() < 0.3
            new.append(note(f"n{k}-{j}", None if everybody else rnd.choice([1, 2, 7, 8, 9, 11]), "t", f"r{j}",
                            None if rnd.random() < 0.05 else at, day=None, audience="staff" if everybody else None))
        if k == 6:
            gone = [8]
        rows = {i: r for i, r in rows.items() if r[1] not in gone}
        for i, r in rows.items():
            if r[1] is not None and r[7] is None and rnd.random() < 0.3:
                fresh.append((i, r[1], TS(2001, 4, k)))
        for i, u, at in fresh:
            rows[i] = (*rows[i][:7], at, *rows[i][8:])
        rows |= {r[0]: r for r in new if r[1] != 8 or k < 6}
        new = [rows[r[0]] for r in new if r[0] in rows]
        for i, r in told.items():
            for p in people[:5]:
                if (i, p[0]) not in reads and r[6] is not None and r[6] >= p[10] and rnd.random() < 0.2:
                    heard.append((i, p[0], TS(2001, 4, k)))
        reads |= {(i, u): (i, u, at) for i, u, at in heard}
        told |= {r[0]: r for r in new if r[1] is None}
        args = (spark.createDataFrame(new, S.NOTIFICATIONS), spark.createDataFrame(fresh, "id string, user_id long, read_at timestamp_ntz"),
                spark.createDataFrame(heard, "notification_id string, user_id long, read_at timestamp_ntz"),
                spark.createDataFrame([(g,) for g in gone], "user_id long"))
        assert K.fold_batch(spark, path, k, *args) and K.fold_batch(spark, path, k, *args)
        if k in (4, 7):
            kept = K.kept(spark, path)
            assert kept.compact() == k == kept.base() == kept.compact()
            assert not K.fold_batch(spark, path, k, *args)
        if k % 3 == 1:
            l = after(make_lending(spark, users=people, notifications=list(rows.values())),
                      notification_reads=spark.createDataFrame(list(reads.values()), "notification_id string, user_id long, read_at timestamp_ntz"))
            state = K.kept(spark, path).now()
            assert same(N.unread_badges(l), K.badges(state, l))
            for n in (5, 100):
                assert same(N.notification_feed(l, n), K.feed(state, l, n))
    assert max(r["unread"] for r in K.badges(state, l).collect()) > 50 and reads
    assert not (tmp_path / "batches" / "newest" / "batch=4").exists() and (tmp_path / "batches" / "newest" / "batch=7").exists()


def test_a_state_reads_no_notifications(spark, tmp_path):
    """Neither badge nor feed scans more than the state and the roster's tables."""
    path = f"file:{tmp_path}"
    l = fx.lending(spark, SF)
    K.fold_batch(spark, path, 1, l.notifications)
    only = fx.Lending(**{n: getattr(l, n) if n in ("roles", "users") else (lambda: 1 / 0) for n in fx.Lending.NAMES if n != "notification_reads"},
                      notification_reads=lambda: 1 / 0)
    state = K.kept(spark, path).now()
    assert K.badges(state, only).count() > 0 and K.feed(state, only).count() > 0


def test_name_search_equals_contains(spark, tmp_path):
    names = ["Red Widget", "blue  widget", "100% cotton_mat", "Ball", "ab", "a", "", "  ", None, "ÉCLAIR ball", "ลูกบอล", "widgetwidget",
             "x_y", "x%y", "ﬁt"]
    items = spark.createDataFrame(list(enumerate(names)), "id long, item_name string")
    path = f"file:{tmp_path}"
    X.build_name_index(items, path)
    terms = ["widget", " WIDGET ", "_", "%", "%y", "x_y", "ball", "a", "ab", "", "  ", "zzz", "éclair", "ลูก", "wid", "idgetw", "d w", "ﬁ"]
    for term in terms:
        want = sorted(r["id"] for r in items.where(F.lower("item_name").contains(term.strip().lower())).collect())
        assert sorted(r["id"] for r in X.search_names(items, path, term).collect()) == want, term
    asked = spark.createDataFrame([(t,) for t in [*terms, None, "widget"]], "term string")
    got = sorted((r["term"], r["id"]) for r in X.search_terms(items, path, asked).collect())
    assert got == sorted((t, i) for t in terms for i, n in enumerate(names) if n is not None and t.strip() and t.strip().lower() in n.lower())


def test_long_terms_have_few_candidates(spark, tmp_path):
    """Terms of six characters or more go by runs of six, of which few names have each,
    and the names of one file are dealt out before they are cut."""
    items = spark.range(2000).select("id", F.concat(F.lit("ring "), (F.col("id") + 100_000).cast("string")).alias("item_name"))
    path = f"file:{tmp_path}"
    X.build_name_index(items, path)
    assert X.runs_of("100123") == ["100123"] and X.hit_postings(spark, path, "100123").count() == 1
    terms = items.select(F.expr("right(item_name, 7)").alias("term"))
    assert sorted(r["id"] for r in X.search_terms(items, path, terms).collect()) == list(range(2000))
    one = X._postings(items.coalesce(1))
    assert "Exchange hashpartitioning(id" in plan(one)


def test_a_search_reads_only_hit_postings(spark, tmp_path):
    path = f"file:{tmp_path}"
    X.build_name_index(fx.lending(spark, SF).inventory, path)
    p = plan(X.hit_postings(spark, path, "red widget"))
    assert "PartitionFilters: [bucket" in p.replace("#", " ").replace("isnotnull", "") or "PartitionFilters: [" in p and " IN " in p
    assert "PushedFilters: [In(run" in p
    read = X.hit_postings(spark, path, "red widget").select(F.input_file_name()).distinct().count()
    assert read <= len(X.runs_of("red widget")) < X.BUCKETS


def test_bucketed_balances_plan_no_exchange(spark, tmp_path):
    l = fx.lending(spark, SF)
    write_bucketed(l, "kept_test", f"file:{tmp_path}", 4)
    b = read_bucketed(spark, "kept_test", l)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept, plainly = plan(B.with_returned(B.open_loans(b), b.transaction_returns)), plan(B.with_returned(B.open_loans(l), l.transaction_returns))
        assert "Exchange" not in kept and "SortMergeJoin" in kept and "Bucketed: true" in kept
        assert "Exchange" in plainly
        assert "loan_state" in kept and "PartitionFilters: [isnotnull(loan_state" in kept
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert same(B.tx_outstanding(l), B.tx_outstanding(b))
    assert same(B.inventory_available(l), B.inventory_available(b))
    assert same(l.transactions, b.transactions)
    for name in ("transactions", "transaction_returns"):
        spark.sql(f"DROP TABLE kept_test_{name}")


def test_buckets_grow_with_the_tables(spark, monkeypatch):
    """A bucket holds about as many rows as asked for, not an eighth of the table."""
    catalog.load_all()
    from kitlend.plans import q_kept
    l, made = fx.lending(spark, SF), []

    def write(l, prefix, path, buckets):
        write_bucketed(l, prefix, path, buckets)
        made.append((prefix, buckets))
    monkeypatch.setattr(q_kept, "write_bucketed", write)
    monkeypatch.setattr(bucketed, "BUCKET_ROWS", 200, raising=False)
    assert same(B.tx_outstanding(l), q_kept.q_tx_outstanding_bucketed(spark, SF))
    (prefix, buckets), = made
    rows = max(l.transactions.count(), l.transaction_returns.count())
    assert buckets == -(-rows // 200) > 8
    held = spark.table(f"{prefix}_transactions").groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert held <= 300
    for name in ("transactions", "transaction_returns"):
        spark.sql(f"DROP TABLE {prefix}_{name}")


def test_key_index_equals_full_audits_after_every_batch(spark, tmp_path):
    """Rows that come, go and change, parents too; the violations kept up by the keys of
    each batch are those of the whole tables."""
    path = f"file:{tmp_path}"
    people = {i: user(i, email=f"m{i % 4}@x", role_id=i % 5) for i in range(1, 7)}
    items = {i: item(i, name=f"thing {i % 2}") for i in range(1, 4)}
    loans = {f"t{i}": loan(f"t{i}", i % 8 + 1, i % 5 + 1, 1, D(2001, 8, 1)) for i in range(12)}
    returns = [ret(f"r{i}", f"t{i % 15}", 1) for i in range(9)]
    notes = [note(f"n{i}", 1 + i % 3, "overdue_student", f"t{i % 2}") for i in range(5)]
    make = lambda: make_lending(spark, users=list(people.values()), inventory=list(items.values()), transactions=list(loans.values()),
                                transaction_returns=returns, notifications=notes)
    row = lambda name, rows: spark.createDataFrame(rows, S.TABLES[name])
    assert I.fold_changes(spark, path, 1, I.full_tables(make()))
    text = lambda df: sorted(map(str, df.collect()))
    unique, orphans = (set(text(v)) for v in I.violations(spark, path))
    for k in range(2, 6):
        added, removed = {}, {}
        if k == 2:  # a member goes, one who was missing comes
            removed["users"], added["users"] = row("users", [people.pop(2)]), row("users", [user(8)])
            people[8] = user(8)
        if k == 3:  # a loan names another item; an email changes
            removed["transactions"] = row("transactions", [loans["t1"]])
            loans["t1"] = loan("t1", 99, 1, 1, D(2001, 8, 1))
            added["transactions"] = row("transactions", [loans["t1"]])
            removed["users"] = row("users", [people[5]])
            people[5] = user(5, email="own@x")
            added["users"] = row("users", [people[5]])
        if k == 4:  # the same row again and again
            returns += [ret("r0", "gone", 1)] * 3
            added["transaction_returns"] = row("transaction_returns", [ret("r0", "gone", 1)] * 3)
        if k == 5:
            returns = [r for r in returns if r[1] != "gone"]
            removed["transaction_returns"] = row("transaction_returns", [ret("r0", "gone", 1)] * 3)
        assert I.fold_changes(spark, path, k, added, removed)
        named = {(r["space"], r["key"]) for r in spark.read.parquet(I.index(spark, path).batch_path("entries", k)).collect()}
        l = make()
        whole = AU.audit_unique(l).collect(), AU.audit_foreign_keys(l).collect()
        u, o = I.changed_violations(spark, path, k)
        parent = {f"{t}.{fk}": p for t, keys in AU.foreign_keys().items() for fk, p in keys}
        assert text(u) == sorted(str(r) for r in whole[0] if (r["rule"], r["key"]) in named)
        assert text(o) == sorted(str(r) for r in whole[1] if (parent[r["rule"]], r["missing_key"]) in named)
        for v, w in zip(I.violations(spark, path), whole, strict=True):
            assert text(v) == sorted(map(str, w))
        if k == 3:
            I.index(spark, path).compact()
            assert not I.fold_changes(spark, path, k, added, removed)
    assert unique and orphans


def test_key_index_deals_its_entries_once_a_step(spark, tmp_path):
    """One exchange sums and orders a batch or a base, and one finds the violations of each kind."""
    path = f"file:{tmp_path}"
    people = [user(1), user(1), user(2, role_id=9)]
    I.fold_changes(spark, path, 1, I.full_tables(make_lending(spark, users=people, transactions=[loan("t1", 3, 1, 1, D(2001, 8, 1))])))
    kept = plan(I.index(spark, path).now()["entries"])
    assert kept.count("Exchange") == 1 and "rangepartitioning" not in kept
    unique, orphans = I.violations(spark, path)
    assert plan(unique).count("Exchange") == 1 and plan(orphans).count("Exchange") == 1
    assert {r["key"] for r in unique.collect() if r["rule"] == "users.id"} == {"1"}
    assert sorted((r["rule"], r["row_id"]) for r in orphans.collect()) == [
        ("transactions.inventory_id", "t1"), ("transactions.user_id", "t1"), ("users.role_id", "2")]


def test_key_index_deals_what_meets_alone(spark, tmp_path):
    """A compaction deals out the kinds of entries of several batches; orphans are sought among the keys with children."""
    path = f"file:{tmp_path}"
    l = make_lending(spark, users=[user(1), user(2, role_id=9)], transactions=[loan("t1", 3, 1, 1, D(2001, 8, 1))] * 2)
    I.fold_changes(spark, path, 1, I.full_tables(l))
    I.fold_changes(spark, path, 2, {"users": l.users}, {"users": l.users})  # nothing is left of it
    I.fold_changes(spark, path, 3, {"users": spark.createDataFrame([user(3)], S.TABLES["users"])},
                   {"users": l.users.where("id = 2")})
    kept = I.index(spark, path)
    made = kept.compacted()["entries"]
    dealt = plan(made).split("Exchange", 1)[1]
    assert "users.id" in dealt.split("FileScan", 1)[0] and plan(made).count("Exchange") == 1
    assert same(made, kept.now()["entries"])
    assert kept.compact() == 3
    assert "In(space, [inventory.id,roles.id,transactions.id,users.id])" in plan(I.violations(spark, path)[1])
    for v, w in zip(I.violations(spark, path), (AU.audit_unique, AU.audit_foreign_keys), strict=True):
        now = make_lending(spark, users=[user(1), user(3)], transactions=[loan("t1", 3, 1, 1, D(2001, 8, 1))] * 2)
        assert same(v, w(now))


def test_foreign_keys_meet_their_parents_in_one_join(spark):
    p = plan(AU.audit_foreign_keys(fx.lending(spark, SF)))
    assert p.count("LeftOuter") == 1
    assert "LeftAnti" not in p and "NestedLoop" not in p and "CartesianProduct" not in p


def test_batches_read_their_own_notices(spark, tmp_path, monkeypatch):
    """The notices are shaped once and not again for each batch and piece."""
    from kitlend.plans import catalog
    catalog.load_all()
    from kitlend.plans import q_kept as Q
    made = []
    l = fx.lending(spark, SF)
    notes = l.notifications
    monkeypatch.setattr(K, "fold_batch", lambda s, p, k, new, *rest: made.append(new))
    monkeypatch.setattr(K, "kept", lambda s, p: type("Nothing", (), {"compact": lambda self: 0, "now": lambda self: {}})())
    Q.folded(spark, l, f"file:{tmp_path}")
    assert len(made) == Q.BATCHES + 1 and sum(n.count() for n in made) == notes.count()
    for n in made:
        assert "lineitem" not in plan(n) and "PartitionFilters: [isnotnull(_batch" in plan(n)
