"""The fold against a brute-force sequential fold, with one hot key spread over
many range partitions and runs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import pytest

from kitlend.operators.fold import ADMISSION, CLOSED, RANGE_ROWS, SETTLEMENT, _pieces, ordered_fold, range_partitions


def admit_one(s, row):
    qty, known = row
    return (s, "stock") if qty > s else (s - qty, None) if known else (s, "user")


def settle_one(s, row):
    if s <= 0:
        return s, "closed" if s == CLOSED else "fully_returned"
    take = row[0] if row[0] is not None and row[0] > 0 else s
    return (s, "over") if take > s else (s - take or CLOSED, None)


def brute(rows, start, one):
    s, out = start, {}
    for rid, *vals in rows:
        before = s
        s, code = one(s, tuple(vals))
        out[rid] = (before, s, code)
    return out


def test_admission_fold_hot_key_matches_brute_force(spark):
    rnd = random.Random(7)
    hot = [(i, rnd.randint(1, 9), rnd.random() > 0.1) for i in range(400)]
    cold = [(1000 + i, rnd.randint(1, 9), True) for i in range(60)]
    data = [(i, 1, q, k, 120) for i, q, k in hot] + [(i, 2 + i % 5, q, k, 20) for i, q, k in cold]
    df = spark.createDataFrame(data, "rid long, item long, qty int, user_known boolean, cap long")
    got = {r["rid"]: (r["state_before"], r["state_after"], r["code"])
           for r in ordered_fold(df, "item", ["rid"], "cap", ADMISSION, partitions=9, run_rows=16).collect()}
    want = brute([(i, q, k) for i, q, k in hot], 120, admit_one)
    for it in range(2, 7):
        want.update(brute([(i, q, k) for i, q, k in cold if 2 + i % 5 == it], 20, admit_one))
    assert got == want


def test_settlement_fold_hot_loan_matches_brute_force(spark):
    rnd = random.Random(11)
    evs = [(i, rnd.choice([1, 1, 2, 2, 3, 5, 40] + [None] * (i // 280))) for i in range(300)]
    df = spark.createDataFrame([(i, "L", q, 300) for i, q in evs],
                               "rid long, tx string, return_qty int, cap long")
    got = {r["rid"]: (r["state_before"], r["state_after"], r["code"])
           for r in ordered_fold(df, "tx", ["rid"], "cap", SETTLEMENT, partitions=6, run_rows=16).collect()}
    want = brute(evs, 300, settle_one)
    assert got == want
    assert {c for _, _, c in want.values()} >= {None, "over"}


def test_global_rank_matches_sorted_order(spark):
    from kitlend.operators.ranking import global_rank
    rnd = random.Random(3)
    ids = rnd.sample(range(100_000), 500)
    df = spark.createDataFrame([(i,) for i in ids], "k long")
    got = {r["k"]: r["rank"] for r in global_rank(df, "k").collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(ids))}


def test_fold_result_does_not_depend_on_partitioning(spark):
    from kitlend.sources import fixtures as fx
    from kitlend.operators import jobs as J
    l = fx.lending(spark, "/root/testdata/sf0.001")
    ev = fx.return_events(spark, "/root/testdata/sf0.001")
    lk = l.transactions.select(F.col("id").alias("tx_id"), F.col("qty").cast("long").alias("cap"))
    df = ev.join(lk, "tx_id").select("tx_id", "ts", "event_id", "return_qty", "cap")
    one = {r["event_id"]: (r["state_after"], r["code"]) for r in
           ordered_fold(df, "tx_id", ["ts", "event_id"], "cap", SETTLEMENT, partitions=1, run_rows=3).collect()}
    many = {r["event_id"]: (r["state_after"], r["code"]) for r in
            ordered_fold(df, "tx_id", ["ts", "event_id"], "cap", SETTLEMENT, partitions=7).collect()}
    assert one == many and len(one) > 1000
    req = fx.loan_requests(spark, "/root/testdata/sf0.001")
    a = sorted(tuple(r) for r in J.admit_loans(l, req).collect())
    assert len(a) > 1000


def test_admission_fold_property(spark):
    from hypothesis import given, settings, strategies as st

    reqs = st.lists(st.tuples(st.integers(0, 2), st.integers(1, 12), st.booleans()), min_size=1, max_size=120)

    @settings(max_examples=6, deadline=None)
    @given(reqs, st.integers(1, 8), st.integers(0, 40))
    def check(rows, parts, cap):
        data = [(i, k, q, known, cap) for i, (k, q, known) in enumerate(rows)]
        df = spark.createDataFrame(data, "rid long, item long, qty int, user_known boolean, cap long")
        got = {r["rid"]: (r["state_before"], r["state_after"], r["code"])
               for r in ordered_fold(df, "item", ["rid"], "cap", ADMISSION, partitions=parts, run_rows=7).collect()}
        want = {}
        for item in {k for k, _, _ in rows}:
            want.update(brute([(i, q, kn) for i, (k, q, kn) in enumerate(rows) if k == item], cap,
                              admit_one))
        assert got == want

    check()


def test_settlement_fold_property(spark):
    from hypothesis import given, settings, strategies as st

    evs = st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(-2, 9))),
                   min_size=1, max_size=80)

    @settings(max_examples=5, deadline=None)
    @given(evs, st.integers(1, 6), st.integers(-1, 25))
    def check(rows, parts, start):
        data = [(i, f"L{k}", q, start) for i, (k, q) in enumerate(rows)]
        df = spark.createDataFrame(data, "rid long, tx string, return_qty int, cap long")
        got = {r["rid"]: (r["state_before"], r["state_after"], r["code"])
               for r in ordered_fold(df, "tx", ["rid"], "cap", SETTLEMENT, partitions=parts, run_rows=7).collect()}
        want = {}
        for key in {k for k, _ in rows}:
            want.update(brute([(i, q) for i, (k, q) in enumerate(rows) if k == key], start, settle_one))
        assert got == want

    check()


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_key_with_a_third_of_the_rows(spark, parts):
    rnd = random.Random(parts)
    data = [(i, 0 if i % 3 == 0 else 1 + rnd.randint(0, 200), rnd.randint(1, 9), rnd.random() > 0.1, 300)
            for i in range(3000)]
    df = spark.createDataFrame(data, "rid long, item long, qty int, user_known boolean, cap long")
    got = {r["rid"]: (r["state_before"], r["state_after"], r["code"])
           for r in ordered_fold(df, "item", ["rid"], "cap", ADMISSION, partitions=parts, run_rows=64).collect()}
    want = {}
    for item in {d[1] for d in data}:
        want.update(brute([(i, q, kn) for i, k, q, kn, _ in data if k == item], 300, admit_one))
    assert got == want


def test_large_stock_and_a_million_rows_of_one_key(spark):
    """Start 10^9, 10^6 requests of one item: small, middling and nearly as large
    as what is left, so that levels fall at many places."""
    n, cap = 1_000_000, 10**9
    h = F.pmod(F.xxhash64("rid"), F.lit(1000))
    qty = (F.when(h < 900, h).when(h < 990, h * 1000).when(h < 998, h * 100_000)
           .otherwise(F.lit(cap) - F.col("rid") * 1000).cast("int"))
    df = (spark.range(n).withColumnRenamed("id", "rid").withColumn("item", F.lit(1)).withColumn("qty", F.greatest(qty, F.lit(1)))
          .withColumn("user_known", h != 7).withColumn("cap", F.lit(cap).cast("long"))).checkpoint()
    out = ordered_fold(df, "item", ["rid"], "cap", ADMISSION, partitions=16)
    got = out.select("rid", "qty", "user_known", "state_before", "state_after", "code").toArrow().sort_by("rid")
    state = cap
    columns = [got.column(c).to_pylist() for c in ("qty", "user_known", "state_before", "state_after", "code")]
    for q, known, before, after, code in zip(*columns, strict=True):
        want = admit_one(state, (q, known))
        assert (before, (after, code)) == (state, want)
        state = after
    assert got.num_rows == n and state < cap // 1000


@pytest.mark.parametrize("seed", range(4))
def test_pieces_of_a_run_cover_what_they_say(spark, seed):
    """Between its breakpoints a run subtracts the piece's sum; the pieces are
    one a level, whatever the stock."""
    rnd = random.Random(seed)
    needs = [rnd.choice([1, 2, 3, 5, 17, 40, 1000, None, 0 if seed % 2 else 4]) for _ in range(12)]
    df = spark.createDataFrame([([x for x in needs if x is not None], 5000)], "needs array<long>, start long")
    pieces = df.select(_pieces(F.col("needs"), F.col("start")).alias("p")).first()["p"]
    assert len(pieces) == 13
    for s in range(1, 5001, 3):
        p, after = pieces[s.bit_length() - 1], s
        for x in needs:
            if x is not None and after > 0 and x <= after:
                after = after - x if x else 0
        if p["lo"] <= s < p["hi"]:
            assert after == s - p["t"]
        else:
            assert after.bit_length() < s.bit_length()


def test_range_partitions_grow_with_counted_rows():
    assert [range_partitions(n) for n in (0, RANGE_ROWS, RANGE_ROWS + 1, 1000 * RANGE_ROWS, 10**7 * RANGE_ROWS)] == [
        1, 1, 2, 1000, 10**7]


@pytest.mark.parametrize("descending", [False, True])
def test_running_sum_matches_sorted_order(spark, descending):
    from kitlend.operators.ranking import running_sum
    rnd = random.Random(13)
    data = [(rnd.randint(0, 60), rnd.randint(0, 9)) for _ in range(400)]
    got = running_sum(spark.createDataFrame(data, "k long, v long"), "k", "v", "s", descending=descending).collect()
    upto = (lambda a, b: a >= b) if descending else (lambda a, b: a <= b)
    assert {(r["k"], r["s"]) for r in got} == {(k, sum(v for j, v in data if upto(j, k))) for k, _ in data}
    assert len(got) == len(data)
