"""Golden edges of the six programs (FIXTURES §2), every refinement, ignore_unknown."""

import pytest

from helpers import program, trace_df
from linewise.operators import lineage as L

P, C, D, S1, S2, Y, F, E, S3 = 1, 2, 3, 4, 5, 6, 7, 8, 9
I10, I20, I12, I23, M, M0, I100, X = 10, 20, 12, 23, 30, 31, 100, 40

PANDAS = [
    ([], [("pd", P)]),
    ([("pd", P), ("pd.DataFrame", C)], [("df", D)]),
    ([("df", D)], [("df", D), ("df.c1", S1)]),
    ([("df", D)], [("df", D), ("df.c2", S2)]),
]
MATRIX = [
    ([], [("m", M)]),
    ([("m", M), ("m[0]", M0)], [("m", M), ("m[0]", M0), ("m[0][1]", I100)]),
    ([("m", M), ("m[0]", M0)], [("m", M), ("m[0]", M0), ("m[0][2]", I20)]),
]
PROGRAMS = {
    1: PANDAS + [([("df", D), ("df.c1", S1)], [("y", Y)])],
    2: [([], [("d", D)]),
        ([("d", D)], [("d", D), ("d[1]", I10)]),
        ([("d", D)], [("d", D), ("d[0]", I20)]),
        ([("d", D), ("d[1]", I10)], [("x", I12)]),
        ([("d", D), ("d[0]", I20)], [("y", I23)])],
    3: MATRIX + [([("m", M), ("m[0]", M0)], [("x", X)]),
                 ([("m", M), ("m[0]", M0), ("m[0][1]", I100)], [("y", I100)])],
    4: MATRIX + [([("m", M), ("m[0]", M0)], [("x", M0)]),
                 ([("m", M), ("m[0]", M0), ("m[0][1]", I100)], [("y", I100)])],
    5: PANDAS + [([("df", D), ("df.copy", F)], [("df", E)]),
                 ([("df", E), ("df.c1", S3)], [("y", Y)])],
    6: PANDAS + [([("df", D), ("df.copy", F)], [("df", E)]),
                 ([("df", E)], [("df", E), ("df.c1", S3)]),
                 ([("df", E), ("df.c1", S3)], [("y", Y)])],
}
# Expected edges per (program, strategy).
EXPECTED = {
    (1, "include_all"): "1-2 2-3 3-4 3-5 4-5",
    (1, "ignore_base"): "1-2 2-3 2-4 2-5 3-5",
    (1, "most_specific"): "1-2 2-3 2-4 2-5 3-5",
    (2, "include_all"): "1-2 2-3 2-4 3-4 3-5",
    (2, "ignore_base"): "1-2 1-3 1-4 2-4 1-5 3-5",
    (2, "most_specific"): "1-2 1-3 1-4 2-4 1-5 3-5",
    (3, "include_all"): "1-2 2-3 3-4 2-5 3-5",
    (3, "ignore_base"): "1-2 1-3 1-4 1-5 2-3 2-5 3-4 3-5",
    (3, "most_specific"): "1-2 1-3 1-4 1-5 2-5",
    (4, "include_all"): "1-2 2-3 3-4 2-5 3-5 4-5",
    (5, "include_all"): "1-2 2-3 3-4 4-5 5-6",
    (5, "ignore_base"): "1-2 2-3 2-4 2-5 5-6",
    (5, "most_specific"): "1-2 2-3 2-4 2-5 5-6",
    (6, "include_all"): "1-2 2-3 3-4 4-5 5-6 6-7",
    (6, "ignore_base"): "1-2 2-3 2-4 2-5 5-6 5-7 6-7",
    (6, "most_specific"): "1-2 2-3 2-4 2-5 5-6 5-7 6-7",
}


def _edges(spec):
    return {tuple(int(x) for x in e.split("-")) for e in spec.split()}


@pytest.fixture(scope="module")
def all_programs(spark):
    rows = []
    for pid, stmts in PROGRAMS.items():
        rows += program(stmts, run_id=pid)
    return trace_df(spark, rows)


@pytest.mark.parametrize("strategy", L.REFINEMENTS)
def test_golden_edges(all_programs, strategy):
    got = {}
    for r in L.build(all_programs, strategy, ignore_unknown=True, chunk_bits=2).edges.collect():
        got.setdefault(r.run_id, set()).add((r.src, r.dst))
    for (pid, strat), spec in EXPECTED.items():
        if strat == strategy:
            assert got.get(pid, set()) == _edges(spec), (pid, strategy)


def test_basic_counts(spark):
    tr = trace_df(spark, program([([], [("x", 1)]), ([], [("y", 2)]), ([("x", 1), ("y", 2)], [])]))
    g = L.build(tr, ignore_unknown=True)
    assert g.nodes.count() == 3
    assert {(r.src, r.dst) for r in g.edges.collect()} == {(1, 3), (2, 3)}


def test_unknown_reads_come_from_node_zero(spark):
    tr = trace_df(spark, program([([("a", 7)], [("b", 8)]), ([("b", 8), ("c", 9)], [])]))
    edges = {(r.src, r.dst) for r in L.build(tr).edges.collect()}
    assert edges == {(0, 1), (1, 2), (0, 2)}
    stats = L.graph_stats(L.build(tr)).collect()[0]
    assert (stats.n_nodes, stats.n_edges) == (3, 3)
