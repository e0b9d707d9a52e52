"""Batch/stream parity of live lineage (G1, G2), growing graphs, and the live run status."""

import os
import random
import tempfile

import pytest
from helpers import trace_df
from linewise.operators import lineage as L
from linewise.operators.growing import GrowingGraph
from linewise.sources.schema import TRACE
from linewise.streaming import live as G
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_property_folds import random_log


def _folder():
    return tempfile.mkdtemp(prefix="linewise-test-", dir="/tmp")


def _logs(spark, seed, runs, n=40, first_run=0):
    rng = random.Random(seed)
    rows = [r for run in range(first_run, first_run + runs) for r in random_log(rng, run, n)]
    for r in rows:
        r.setdefault("uses", None)
    return trace_df(spark, rows).withColumn("ts", F.timestamp_seconds(F.col("event_id")))


def _set(edges):
    return {(r.run_id, r.src, r.dst) for r in edges.select("run_id", "src", "dst").collect()}


def _batch(trace, **options):
    return _set(L.build(trace.drop("ts"), **options).edges)


def _chain(spark, n):
    """One run: statement i reads what statement i - 1 wrote (one line and address each)."""
    rows = []
    for i in range(n):
        var = lambda j: Row(name=f"x{j}", id=j, type="int", columns=None)
        rows.append((1, 2 * i, "exec", i, f"s{i}", [var(i - 1)] if i else [], [], None, None, None))
        rows.append((1, 2 * i + 1, "update", i, None, [], [var(i)], None, None, None))
    return spark.createDataFrame(rows, TRACE).withColumn("ts", F.timestamp_seconds(F.col("event_id") + 1_000_000))


def test_appended_parts_equal_one_build(spark):
    trace = _logs(spark, 17, 5).drop("ts")
    options = {"refinement": "most_specific", "ignore_unknown": True}
    graph = GrowingGraph(spark, _folder(), chunk_bits=2, compact_every=2, **options)
    top = trace.agg(F.max("event_id")).first()[0]
    cuts = [-1, top // 3, top // 3, top // 2, top]  # one part is empty
    for lo, hi in zip(cuts, cuts[1:]):
        graph.append(trace.where((F.col("event_id") > lo) & (F.col("event_id") <= hi)))
    assert graph.edges.count() == graph.edges.distinct().count()
    assert _set(graph.edges) == _batch(trace, **options)
    assert graph.late.count() == 0


def test_a_part_is_folded_once_and_a_broken_one_anew(spark):
    trace = _logs(spark, 3, 3).drop("ts")
    graph = GrowingGraph(spark, _folder())
    half = trace.agg(F.max("event_id")).first()[0] // 2
    first, second = trace.where(F.col("event_id") <= half), trace.where(F.col("event_id") > half)
    graph.append(first, 0)
    graph.append(first, 0)  # replayed: complete, nothing happens
    graph.append(second, 1)
    where, fs = graph._fs(f"{graph._at('part', 1)}/calls")
    fs.delete(where, True)  # as if the append had broken off before its last table
    assert _set(graph.edges) < _batch(trace)
    graph.append(second, 1)
    assert _set(graph.edges) == _batch(trace)


def test_late_events_are_counted_not_folded(spark):
    trace = _chain(spark, 6).drop("ts")
    graph = GrowingGraph(spark, _folder())
    graph.append(trace.where("event_id > 5"))
    graph.append(trace.where("event_id <= 5"))
    assert graph.late.count() == 6
    assert _set(graph.edges) == _batch(trace.where("event_id > 5"))


def test_live_lineage_equals_batch(spark):
    trace = _logs(spark, 11, 4)
    assert _set(G.run_lineage(spark, trace)) == _batch(trace)
    assert _set(G.run_lineage(spark, trace, ordered=True, delay="5 seconds")) == _batch(trace)


def test_state_is_carried_over_many_batches(spark):
    """A chain whose every edge crosses statements, one file per micro-batch."""
    trace = _chain(spark, 12)
    assert _set(G.run_lineage(spark, trace, batches=100)) == {(1, i, i + 1) for i in range(1, 12)}


def test_null_line_numbers(spark):
    rows = [{"run_id": 1, "event_id": 1, "kind": "exec", "lineno": None, "uses": [], "defs": []},
            {"run_id": 1, "event_id": 2, "kind": "update", "lineno": None, "uses": [], "defs": [("x", 1)]},
            {"run_id": 1, "event_id": 3, "kind": "exec", "lineno": 2, "uses": [("x", 1)], "defs": []}]
    trace = trace_df(spark, rows).withColumn("ts", F.timestamp_seconds(F.col("event_id")))
    assert _batch(trace) == {(1, 1, 2)}
    assert _set(G.run_lineage(spark, trace, ordered=True, batches=2)) == {(1, 1, 2)}


def _streamed(spark, parts, schema, delay):
    """The parts as files, one per micro-batch, through the ordered live graph."""
    base = _folder()
    for i, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(f"{base}/landed")
        for f in [f for f in os.listdir(f"{base}/landed") if f.endswith(".parquet")]:
            full = f"{base}/landed/{f}"
            if os.path.getmtime(full) > 2000:  # not yet placed
                os.utime(full, (1000 + i, 1000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/landed")
    G.finish(spark, lambda: G.live_graph(stream, base, ordered=True, delay=delay))
    return base


def test_disordered_batches_are_released_in_order(spark, monkeypatch):
    """The second half of every run arrives first; the delay covers the disorder."""
    monkeypatch.setattr(G, "RELEASE_BITS", 3)
    trace = _logs(spark, 5, 4)
    mid = trace.agg(F.max("event_id")).first()[0] // 2
    end = G.with_flush(trace, "1000 seconds")
    parts = [trace.where(F.col("event_id") > mid), trace.where(F.col("event_id") <= mid), end.where("kind = 'flush'")]
    base = _streamed(spark, parts, end.schema, "1000 seconds")
    assert _set(G.edges_of(spark, base)) == _batch(trace)


def test_events_behind_the_watermark_go_aside(spark):
    trace = _chain(spark, 10)
    parts = [trace.where("event_id >= 8"), trace.where("event_id < 8"),
             G.with_flush(trace, "1 second").where("kind = 'flush'")]
    base = _streamed(spark, parts, G.with_flush(trace).schema, "1 second")
    assert sorted(r.event_id for r in G.behind(spark, base).collect()) == list(range(8))
    with pytest.raises(RuntimeError, match="8 events"):
        G.edges_of(spark, base)
    assert _set(GrowingGraph(spark, f"{base}/graph").edges) == _batch(trace.where("event_id >= 8"))


def test_the_release_runs_in_spark_alone_and_a_batch_starts_over(spark):
    """No Python per key (it took minutes for a few thousand keys): the plan of a release has
    tables only. The last of events with one id counts; events without time go aside."""
    folder = _folder()
    trace = _chain(spark, 6)
    end = G.with_flush(trace, "2 seconds")
    no_time = trace.where("event_id = 3").withColumn("event_id", F.lit(99).cast("bigint")).withColumn(
        "ts", F.lit(None).cast("timestamp"))
    again = trace.where("event_id = 11").withColumn("lineno", F.lit(70).cast("bigint"))
    parts = [trace.where("event_id between 4 and 11").unionByName(no_time), trace.where("event_id < 2").unionByName(again),
             end.where("kind = 'flush'")]
    line = G.Release(spark, folder, "2 seconds")
    got = [[(r.event_id, r.lineno) for r in line.append(p.select(end.columns) if "ts" in p.columns else p, i)
            .orderBy("event_id").collect()] for i, p in enumerate(parts) for _ in range(2)]
    assert got[0] == got[1] == [(i, i // 2) for i in range(4, 9)]
    assert got[2] == got[3] == []
    assert got[4] == got[5] == [(9, 4), (10, 5), (11, 70)]
    assert sorted(r.event_id for r in G.behind(spark, folder).collect()) == [0, 1, 99]
    plan = spark._jvm.PythonSQLUtils.explainString(
        line.append(parts[0], 0)._jdf.queryExecution(), "simple")
    assert "Python" not in plan and "Pandas" not in plan


def test_restart_from_the_checkpoint(spark):
    """Two runs of one query over a growing folder: the second continues from the state."""
    folder = _folder()
    trace = _chain(spark, 12)
    for lo, hi in ((0, 13), (13, 24)):
        part = trace.where((F.col("event_id") >= lo) & (F.col("event_id") < hi))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(trace.schema).parquet(f"{folder}/in")
        G.finish(spark, lambda: G.live_graph(stream, folder))
    assert _set(G.edges_of(spark, folder)) == {(1, i, i + 1) for i in range(1, 12)}


def test_live_run_status(spark):
    rows = [{"run_id": 1, "event_id": 1, "kind": "exec", "lineno": 1, "uses": [], "defs": []},
            {"run_id": 1, "event_id": 2, "kind": "exception", "msg": "boom"},
            {"run_id": 2, "event_id": 1, "kind": "exec", "lineno": 1, "uses": [], "defs": []}]
    trace = trace_df(spark, rows).withColumn("ts", F.timestamp_seconds(F.col("event_id")))
    assert [(r.run_id, r.msg) for r in G.run_status(spark, trace).collect()] == [(1, "boom")]
