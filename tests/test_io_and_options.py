"""A1/A2 round trip, E13 mutating calls, F-invariants on a small graph."""

import tempfile

from pyspark.sql import functions as F

from helpers import program, trace_df
from linewise.operators import lineage as L
from linewise.operators import reaching as E
from linewise.operators import slicing as S
from linewise.sources import io
from linewise.sources.schema import FACTS


def test_trace_and_graph_round_trip(spark):
    tr = trace_df(spark, program([([], [("x", 1)]), ([("x", 1)], [("y", 2)]), ([("y", 2)], [])]))
    d = tempfile.mkdtemp(prefix="linewise-io-", dir="/tmp")
    io.write_trace(tr, f"{d}/trace")
    back = io.read_trace(spark, f"{d}/trace")
    assert sorted(back.collect()) == sorted(tr.collect())
    g = L.build(back, ignore_unknown=True)
    io.write_graph(g.nodes, g.edges, f"{d}/graph")
    nodes, edges = io.read_graph(spark, f"{d}/graph")
    assert nodes.count() == 3
    assert {(r.src, r.dst) for r in edges.collect()} == {(1, 2), (2, 3)}


def test_mutating_calls(spark):
    rows = [(1, 0, 1, 1, "assign", None, None, [], [], [], False, [], ["lst"]),
            (1, 0, 2, 2, "call", None, None, [], [], [], False, ["lst"], []),
            (1, 0, 3, 3, "expr", None, None, [], [], [], False, ["lst"], [])]
    facts = spark.createDataFrame(rows, FACTS)
    plain = {(r.src, r.dst) for r in E.reaching_edges(facts).collect()}
    mut = {(r.src, r.dst) for r in E.reaching_edges(facts, mutating_calls=True).collect()}
    assert plain == {(1, 2), (1, 3)}
    assert mut == {(1, 2), (2, 3)}


def test_slice_invariants(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 1, 3), (1, 3, 4), (1, 5, 4), (1, 4, 2)],
                                  "run_id long, src long, dst long")   # has a cycle 2-3-4-2
    seeds = spark.createDataFrame([(1, 1), (1, 4)], "run_id long, seed long")
    fwd = {(r.seed, r.node_id) for r in S.slices(edges, seeds, "forward").collect()}
    assert fwd == {(1, 1), (1, 2), (1, 3), (1, 4), (4, 4), (4, 2), (4, 3)}
    back = {(r.seed, r.node_id) for r in S.slices(S.reverse(edges), seeds, "forward").collect()}
    assert back == {(r.seed, r.node_id) for r in S.slices(edges, seeds, "backward").collect()}
    sub = {(r.seed, r.src, r.dst) for r in S.induced(edges, S.slices(edges, seeds, "forward")).collect()}
    assert (4, 4, 2) in sub and (4, 1, 2) not in sub
    top = S.impact(S.slices(edges, seeds, "forward"), k=1).collect()
    assert [(r.seed, r.impact) for r in top] == [(1, 3)]


def test_readme_usage(spark):
    from linewise.sources.io import read_trace, write_graph, write_trace
    d = tempfile.mkdtemp(prefix="linewise-readme-", dir="/tmp")
    write_trace(trace_df(spark, program([([], [("x", 1)]), ([("x", 1)], [("y", 2)]), ([("y", 2)], [])])),
                f"{d}/trace")
    trace = read_trace(spark, f"{d}/trace")
    g = L.build(trace, refinement="most_specific")
    write_graph(g.nodes, g.edges, f"{d}/graph")
    seeds = g.edges.groupBy("run_id").agg(F.max("dst").alias("seed"))
    got = {r.node_id for r in S.slices(g.edges.filter("src <> 0"), seeds, "backward").collect()}
    assert got == {1, 2, 3}


def _reach(edges, seed, forward):
    nxt = {}
    for a, b in edges:
        nxt.setdefault(a if forward else b, []).append(b if forward else a)
    seen, todo = {seed}, [seed]
    while todo:
        for n in nxt.get(todo.pop(), ()):
            if n not in seen:
                seen.add(n)
                todo.append(n)
    return seen


def test_slices_of_random_graphs_equal_a_search(spark):
    import random

    rnd = random.Random(11)
    rows, want = [], {"forward": set(), "backward": set()}
    seeds = []
    for run in range(12):
        n = 40
        edges = {(i, i + 1) for i in range(n) if rnd.random() < 0.8}          # long runs
        edges |= {(rnd.randrange(n), rnd.randrange(n)) for _ in range(run)}    # cycles and joins
        edges |= {(100, 101), (101, 102), (102, 100)}                          # a cycle apart
        rows += [(run, a, b) for a, b in edges]
        for seed in (0, 20, 39, 101, rnd.randrange(n)):
            seeds.append((run, seed))
            for d in want:
                want[d] |= {(run, seed, x) for x in _reach(edges, seed, d == "forward")}
    e = spark.createDataFrame(rows, "run_id bigint, src bigint, dst bigint")
    s = spark.createDataFrame(seeds, "run_id bigint, seed bigint")
    for d in want:
        got = [tuple(r) for r in S.slices(e, s, d).collect()]
        assert len(got) == len(set(got)) and set(got) == want[d]


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    from linewise.operators import slicing

    cuts = []
    real = slicing.cut
    monkeypatch.setattr(slicing, "cut", lambda df, label="step": cuts.append(label) or real(df, label))
    n = 10_000
    monkeypatch.setattr(slicing, "_ascending", lambda edges: False)  # contracted, not swept
    e = spark.range(n).selectExpr("1L AS run_id", "id AS src", "id + 1 AS dst")
    s = spark.createDataFrame([(1, 0), (1, 5_000)], "run_id bigint, seed bigint")
    assert S.slices(e, s, "forward").count() == n + 1 + n - 5_000 + 1
    assert cuts.count("chain_pointers") <= 16 and len(cuts) <= 30
