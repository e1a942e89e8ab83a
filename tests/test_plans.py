"""Plan checks: the physical plans keep the properties the design relies on."""

from __future__ import annotations

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_member_resolution_is_an_equi_join(spark):
    import __spark_entry__ as E
    p = plan(E.queries()["resolve_members"](spark, SF))
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p


def test_returns_summed_once_per_loan(spark):
    import __spark_entry__ as E
    df = E.queries()["tx_outstanding"](spark, SF)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("sum(return_qty") == 1


def test_filters_and_columns_reach_the_scan(spark):
    import tempfile
    from kitlend.operators import balances as B
    from kitlend.sources import fixtures as fx
    from kitlend.sources.tables import read_lending, write_lending
    out = tempfile.mkdtemp(prefix="kitlend-plan-")
    write_lending(fx.lending(spark, SF), out)
    s = read_lending(spark, out)
    p = plan(B.lendable_items(s))
    assert "PushedFilters: [IsNotNull(active), IsNotNull(stock), EqualTo(active,true), GreaterThan(stock,0)]" in p
    assert "ReadSchema: struct<id:string,item_name:string,stock:int,active:boolean>" in p
    p = plan(B.tx_outstanding(s))
    assert "PartitionFilters: [isnotnull(loan_state" in p


def test_queries_scan_the_files_they_need(spark):
    import __spark_entry__ as E
    for name in ("item_status", "outstanding_all", "notification_feed", "unread_badges", "history_loans"):
        p = plan(E.queries()[name](spark, SF))
        assert "FileScan parquet" in p, name
        if name not in ("notification_feed", "unread_badges"):  # these read the ranked staff roster too
            assert "ExistingRDD" not in p, name
    p = plan(E.queries()["unread_badges"](spark, SF))
    assert "l_extendedprice" not in p
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    p = plan(E.queries()["open_loans"](spark, SF))
    spark.conf.set("spark.sql.maxMetadataStringLength", old)
    assert "EqualTo(l_linestatus,O)" in p and "Not(EqualTo(l_returnflag,R))" in p


def test_member_joins_shuffle_both_sides(spark):
    """AQE splits a hot member only where both sides of the join are exchanged."""
    from kitlend.sources import fixtures as fx
    l = fx.lending(spark, SF)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        u = l.users.select(F.col("id").alias("uid"), "email")
        p = plan(l.transactions.join(u, F.col("user_id") == F.col("uid"), "left"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Exchange hashpartitioning(user_id" in p and "Exchange hashpartitioning(uid" in p


def test_feed_rank_filter_limits_before_shuffle(spark):
    import __spark_entry__ as E
    df = E.queries()["notification_feed"](spark, SF)
    df.collect()
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_join_anywhere(spark):
    import __spark_entry__ as E
    for name in ("notification_dedupe", "mail_outbox", "admin_dashboard", "overdue_fanout"):
        p = plan(E.queries()[name](spark, SF))
        assert "CartesianProduct" not in p and "NestedLoopJoin" not in p, name
