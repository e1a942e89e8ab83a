"""Change jobs written back to stored tables: only touched partitions change, and a
batch has its effect once."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from helpers import D, TS, item, loan, make_lending, note, user
from kitlend.sources import writeback as W
from kitlend.sources.tables import read_table, write_lending


def files(out, name):
    root = out.removeprefix("file:")
    return {f for f in glob.glob(f"{root}/{name}/**/*.parquet", recursive=True)}


@pytest.fixture()
def stored(spark, tmp_path):
    l = make_lending(
        spark, users=[user(1), user(2), user(3)], inventory=[item(1), item(2), item(3)],
        transactions=[loan("a", 1, 1, 2, D(2001, 6, 3)), loan("b", 1, 1, 2, D(2001, 7, 3)), loan("c", 2, 1, 2, D(2001, 7, 9)),
                      loan("d", 2, 2, 2, D(2001, 5, 9), TS(2001, 6, 1)), loan("n", 2, 2, 2, None)],
        notifications=[note("x", 3, "t"), note("y", 1, "t", created=TS(2001, 8, 2)), note("z", 3, "t", created=TS(2001, 8, 2))])
    out = f"file:{tmp_path}"
    write_lending(l, out)
    return out


def test_a_promise_rewrites_its_partition_once(spark, stored):
    before = files(stored, "transactions")
    loans = read_table(spark, stored, "transactions")
    new = loans.where("id = 'a'").withColumn("promised_return_date", F.lit(D(2001, 9, 1))).withColumn("deleted", F.lit(False))
    assert W.write_back(spark, stored, "transactions", new, "day-1")
    after = files(stored, "transactions")
    assert {os.path.dirname(f) for f in before - after} == {os.path.dirname(f) for f in after - before}
    assert all("loan_state=open/borrow_month=2001-06" in f for f in before ^ after)
    assert not W.write_back(spark, stored, "transactions", new, "day-1")  # the same batch again
    assert files(stored, "transactions") == after
    got = {r["id"]: r["promised_return_date"] for r in read_table(spark, stored, "transactions").collect()}
    assert got == {"a": D(2001, 9, 1), "b": None, "c": None, "d": None, "n": None}


def test_closing_moves_loans_and_removes_empty_partitions(spark, stored):
    settled = spark.createDataFrame(
        [("e1", "a", TS(2001, 8, 1), True, "return_completed", 0), ("e2", "b", TS(2001, 8, 1), True, "return_completed", 0),
         ("e3", "n", TS(2001, 8, 1), True, "return_completed", 0)],
        "event_id string, tx_id string, ts timestamp_ntz, accepted boolean, outcome string, remaining_after long")
    assert W.apply_closures(spark, stored, settled, "batch-7")
    loans = {r["id"]: r["return_date"] for r in read_table(spark, stored, "transactions").collect()}
    assert {k for k, v in loans.items() if v is not None} == {"a", "b", "d", "n"} and len(loans) == 5
    now = files(stored, "transactions")
    assert not any("loan_state=open/borrow_month=2001-06" in f or "loan_state=open/borrow_month=__HIVE" in f for f in now)
    assert any("loan_state=open/borrow_month=2001-07" in f for f in now)


def test_a_run_that_broke_off_is_finished(spark, stored, monkeypatch):
    loans = read_table(spark, stored, "transactions")
    rows = loans.where("id IN ('a', 'b')").withColumn("deleted", F.col("id") == "b").withColumn("qty", F.lit(9))
    with monkeypatch.context() as m:  # after freezing
        m.setattr(W, "_apply", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            W.write_back(spark, stored, "transactions", rows, "b1")
    W._apply(spark, stored, "transactions", f"{stored}/_changes/transactions/b1")  # and before the mark
    later = rows.withColumn("qty", F.lit(100))  # what the batch would compute now: not used
    assert W.write_back(spark, stored, "transactions", later, "b1")
    assert {r["id"]: r["qty"] for r in read_table(spark, stored, "transactions").collect()} == {"a": 9, "c": 2, "d": 2, "n": 2}


def test_members_and_items_go_or_stay(spark, stored):
    ask = spark.createDataFrame([("r1", "3"), ("r2", "1")], "req_id string, user_id string")
    assert W.apply_user_deletes(spark, stored, ask, "u1") and not W.apply_user_deletes(spark, stored, ask, "u1")
    assert {r["id"] for r in read_table(spark, stored, "users").collect()} == {"1", "2"}
    assert {r["id"] for r in read_table(spark, stored, "notifications").collect()} == {"y"}
    items = spark.createDataFrame([("r1", "1"), ("r2", "2"), ("r3", "3")], "req_id string, id string")
    assert W.apply_item_deletes(spark, stored, items, TS(2001, 8, 3), "i1")
    left = {r["id"]: (r["active"], r["deleted_at"]) for r in read_table(spark, stored, "inventory").collect()}
    assert "3" not in left and set(left) <= {"1", "2"}
