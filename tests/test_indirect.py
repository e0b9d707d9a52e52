"""Reads through functions: components against a search, recursion, deep calls."""

import random

from linewise.operators.scope import condensed, indirect_uses
from linewise.sources.schema import TRACE


def _reach(out, f):
    seen, todo = {f}, [f]
    while todo:
        for n in out[todo.pop()]:
            if n not in seen:
                seen.add(n)
                todo.append(n)
    return seen


def test_components_and_levels():
    rng = random.Random(3)
    for trial in range(60):
        n = rng.randint(1, 14)
        out = {f: [rng.randrange(n) for _ in range(rng.randint(0, 3))] for f in range(n)}
        found = condensed(out)
        level = {f: lv for group, lv in found for f in group}
        assert sorted(f for group, _ in found for f in group) == list(range(n))
        for group, lv in found:
            for f in range(n):
                mutual = f in _reach(out, group[0]) and group[0] in _reach(out, f)
                assert (f in group) == mutual
            below = [level[x] for f in group for x in out[f] if x not in group]
            assert lv == 1 + max(below, default=-1)
    assert len(condensed({i: [i + 1] if i < 50_000 else [] for i in range(50_001)})) == 50_001


def _trace(spark, reads):
    rows = [(r, e, "exec", 1, "s", [(f"v{i}", i, "t", None) for i in ids], [], None, None, None) for r, e, ids in reads]
    return spark.createDataFrame(rows, TRACE)


def test_closure_with_recursion(spark):
    # 1 -> 2 -> 3 -> 2 (a cycle), 3 reads 30, 1 reads 10; 4 reads itself only and 40; 5 calls 4
    refs = [(1, 1, 2), (1, 1, 10), (1, 2, 3), (1, 3, 2), (1, 3, 30), (1, 4, 4), (1, 4, 40), (1, 5, 4), (2, 1, 99)]
    table = spark.createDataFrame([(r, f, f"v{i}", i) for r, f, i in refs], "run_id long, func_id long, name string, id long")
    trace = _trace(spark, [(1, 1, [1]), (1, 2, [3, 7]), (1, 3, [5]), (1, 4, [8]), (2, 1, [1, 2])])
    got = {(r.run_id, r.event_id, r.id) for r in indirect_uses(trace, table).collect()}
    out = {}
    for r, f, i in refs:
        out.setdefault((r, f), set()).add(i)
    want = set()
    for run, event, ids in [(1, 1, [1]), (1, 2, [3, 7]), (1, 3, [5]), (1, 4, [8]), (2, 1, [1, 2])]:
        graph = {f: [i for i in v if (run, i) in out] for (r, f), v in out.items() if r == run}
        want |= {(run, event, i) for i in ids}
        want |= {(run, event, i) for f in ids if f in graph for g in _reach(graph, f) for i in out[run, g]}
    assert got == want
