"""Contracts that hold at any size: chunks follow their order, adapters follow their
source, intermediate tables go."""

import datetime as dt
import os
import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from linewise.operators import lineage as L
from linewise.operators import reaching as E
from linewise.plans.materialize import application_folder, cut, owned, release
from linewise.sources import adapters as A


def assert_monotone(df, order, chunk):
    """The chunk never decreases along the order."""
    w = Window.orderBy(*order)
    bad = df.withColumn("_c", chunk).withColumn("_p", F.lag("_c").over(w)).where(F.col("_p") > F.col("_c"))
    assert bad.count() == 0


def lineitems(spark, rows):
    cols = ("l_suppkey bigint, l_shipdate date, l_orderkey bigint, l_partkey bigint, l_linenumber int, "
            "l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
            "l_linestatus string")
    return spark.createDataFrame([(1, d, o, 7, n, 1.0, 1.0, 0.0, 0.0, f, "O") for d, o, n, f in rows], cols)


def test_lineitem_order_past_two_to_the_24(spark):
    day = dt.date(1995, 1, 1)
    rows = [(day, 2**24 + 5, 1, "R"), (day + dt.timedelta(1), 3, 2, "N"),
            (day + dt.timedelta(1), 2**25 + 1, 3, "R"), (day + dt.timedelta(2), 2**24 + 1, 4, "N")]
    folder = tempfile.mkdtemp(prefix="linewise-test-", dir="/tmp")
    df = lineitems(spark, rows)
    assert_monotone(df, A.LINEITEM_ORDER, A.lineitem_chunk())
    df.write.parquet(f"{folder}/lineitem.parquet")
    edges = L.build(A.lineitem_trace(spark, folder), has_calls=False).edges
    assert {(r.src, r.dst) for r in edges.collect()} == {(1, 2), (3, 4)}


def orders(spark, n, key0=1):
    d = dt.date(1996, 1, 1)
    return spark.createDataFrame(
        [(5, key0 + i, "FPO"[i % 3], d + dt.timedelta(i % 300), "1-URGENT") for i in range(n)],
        "o_custkey bigint, o_orderkey bigint, o_orderstatus string, o_orderdate date, o_orderpriority string")


def test_orders_chunk_splits_a_hot_customer_year(spark):
    df = A.ranked_orders(orders(spark, 900, 2**24 - 300))
    assert_monotone(df, A.ORDERS_ORDER, A.orders_chunk())
    assert df.select(A.orders_chunk().alias("c")).distinct().count() > 300


def test_adapter_follows_a_rewritten_source(spark):
    folder = tempfile.mkdtemp(prefix="linewise-test-", dir="/tmp")
    orders(spark, 2).write.parquet(f"{folder}/orders.parquet")
    one = A.orders_facts(spark, folder).where("kind <> 'test'").count()
    orders(spark, 5).write.mode("overwrite").parquet(f"{folder}/orders.parquet")
    assert (one, A.orders_facts(spark, folder).where("kind <> 'test'").count()) == (2, 5)


def _local(path):
    return path.replace("file:", "").replace("//", "/")


def test_intermediate_tables_have_an_owner(spark):
    facts = A.orders_facts(spark, "/root/testdata/sf0.001")
    with owned(spark) as folder:
        assert E.reaching_branches(facts).count() > 0
        assert os.listdir(_local(folder))
    assert not os.path.exists(_local(folder))
    base = application_folder(spark)
    cut(spark.range(3))
    assert os.path.exists(_local(base))
    release(spark)
    assert not os.path.exists(_local(base))
    assert cut(spark.range(3)).count() == 3  # a new folder is made when needed


def test_one_pass_queries_read_the_source(spark):
    """The events adapter writes nothing for a reader that needs one pass, and prunes."""
    folder = tempfile.mkdtemp(prefix="linewise-test-", dir="/tmp")
    spark.createDataFrame([(1, 7, "signup", '{"k": 3}', dt.datetime(2024, 1, 1), 0.5)],
                          "event_id bigint, user_id bigint, event_type string, props string, ts timestamp, value double"
                          ).write.parquet(f"{folder}/events.parquet")
    trace = A.events_trace(spark, folder)
    assert trace.inputFiles() and all("/events.parquet/" in f for f in trace.inputFiles())
    assert [(r.run_id, r.event_id, r.kind) for r in trace.collect()] == [(7, 2, "enter")]
    plan = spark._jvm.PythonSQLUtils.explainString(
        trace.select("run_id", "event_id")._jdf.queryExecution(), "formatted")
    assert "struct<event_id:bigint,user_id:bigint,event_type:string,props:string>" in plan
    assert A.stored_events_trace(spark, folder).collect() == trace.collect()
