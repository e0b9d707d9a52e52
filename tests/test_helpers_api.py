"""Small API helpers: routing (A3), flattening (A4), line lookups (C14), node selection (F1)."""

from pyspark.sql import functions as F

from helpers import program, trace_df
from linewise.operators import events as A
from linewise.operators import lineage as L
from linewise.operators import slicing as S


def test_of_kind_and_event_fields(spark):
    rows = program([([], [("x", 1)]), ([("x", 1)], [])]) + [
        {"run_id": 1, "event_id": 100, "kind": "enter", "lineno": 2,
         "call": {"qualname": "f", "co_name": "f", "module": "m", "defined_by_user": True}}]
    tr = trace_df(spark, rows)
    assert A.of_kind(tr, "update").count() == 1
    flat = A.event_fields(A.of_kind(tr, "enter"))
    assert "call" not in flat.columns and flat.select("qualname", "module").first() == ("f", "m")


def test_line_lookups_and_node_ids(spark):
    tr = trace_df(spark, program([([], [("x", 1)]), ([("x", 1)], [("y", 2)]), ([("y", 2)], [])]))
    g = L.build(tr, ignore_unknown=True)
    assert [r.run_id for r in L.edge_exists(g, 1, 2).collect()] == [1]
    assert L.edge_exists(g, 1, 3).count() == 0
    assert [r.node_id for r in L.node_by_line(g, 3).collect()] == [3]
    assert {r.node_id for r in S.node_ids(g.nodes, F.col("lineno") >= 2).collect()} == {2, 3}


def test_unbalanced_modes(spark):
    import pytest

    from linewise.operators import scope as B
    rows = [{"run_id": 1, "event_id": 1, "kind": "exit", "lineno": 1, "call": {"co_name": "f"}},
            {"run_id": 1, "event_id": 2, "kind": "exec", "lineno": 1, "uses": [], "defs": []},
            {"run_id": 2, "event_id": 1, "kind": "enter", "lineno": 1, "call": {"co_name": "f"}},
            {"run_id": 2, "event_id": 2, "kind": "exec", "lineno": 1, "uses": [], "defs": []},
            {"run_id": 2, "event_id": 3, "kind": "exit", "lineno": 1, "call": {"co_name": "f"}}]
    tr = trace_df(spark, rows)
    clamp = {(r.run_id, r.event_id): r.depth for r in B.with_call_depth(tr).collect()}
    assert clamp[(1, 2)] == 0 and clamp[(2, 2)] == 1
    kept = {r.run_id for r in B.with_call_depth(tr, on_unbalanced="quarantine").collect()}
    assert kept == {2}
    with pytest.raises(ValueError):
        B.with_call_depth(tr, on_unbalanced="error")
