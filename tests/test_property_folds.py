"""Window/scan forms equal sequential folds on random logs: unbalanced calls, NULL
addresses, repeated lines, aliased addresses, loop markers; tiny chunks so that every
carry crosses chunk boundaries."""

import random

import pytest
from pyspark.sql import functions as F

from fold import fold_bound_loops, fold_depth, fold_lineage
from helpers import trace_df
from linewise.operators import lineage as L
from linewise.operators import scope as B

PATHS = ["a", "a.b", "a.b.c", "d", "d[0]", "d[0][1]", "e"]


def random_log(rng, run_id, n):
    rows, eid = [], rng.randint(0, 5)
    for _ in range(n):
        eid += rng.randint(1, 3)          # gaps, never contiguous
        r = rng.random()
        lineno = None if rng.random() < 0.05 else rng.randint(0, 5)
        if r < 0.45:
            uses = [(p, rng.choice([None, 1, 2, 3, 4, 5])) for p in rng.sample(PATHS, rng.randint(0, 3))]
            rows.append({"run_id": run_id, "event_id": eid, "kind": "exec", "lineno": lineno,
                         "uses": uses, "defs": []})
            if rng.random() < 0.6:
                eid += 1
                target = rng.choice(PATHS)
                from fold import prefixes
                defs = [(p, rng.choice([None, 1, 2, 3, 4, 5])) for p in prefixes(target)]
                rows.append({"run_id": run_id, "event_id": eid, "kind": "update", "lineno": lineno,
                             "uses": [], "defs": defs})
        elif r < 0.6:
            rows.append({"run_id": run_id, "event_id": eid, "kind": "enter", "lineno": lineno,
                         "call": {"qualname": "f", "co_name": "f", "defined_by_user": rng.random() < 0.5}})
        elif r < 0.75:
            rows.append({"run_id": run_id, "event_id": eid, "kind": "exit", "lineno": lineno,
                         "call": {"co_name": "f"}})
        else:
            kind = rng.choice(["loop_init", "loop_iter", "loop_iter", "loop_clear"])
            rows.append({"run_id": run_id, "event_id": eid, "kind": kind, "loop_name": rng.choice(["L1", "L2"])})
    return rows


@pytest.fixture(scope="module")
def logs(spark):
    rng = random.Random(7)
    rows = []
    for run in range(12):
        rows += random_log(rng, run, rng.randint(10, 70))
    return rows, trace_df(spark, rows)


def _by_run(rows):
    out = {}
    for r in rows:
        out.setdefault(r["run_id"], []).append(r)
    return {k: sorted(v, key=lambda e: e["event_id"]) for k, v in out.items()}


@pytest.mark.parametrize("strategy,ignore", [("include_all", False), ("ignore_base", False),
                                             ("most_specific", True), ("include_all", True)])
def test_lineage_equals_fold(logs, strategy, ignore):
    rows, df = logs
    want = set()
    for run, evs in _by_run(rows).items():
        lin = [e for e in evs if e["kind"] in ("exec", "update", "enter", "exit")]
        _, edges = fold_lineage(lin, strategy, ignore)
        want |= {(run, s, d) for s, d in edges}
    got = {(r.run_id, r.src, r.dst) for r in L.build(df, strategy, ignore, chunk_bits=2).edges.collect()}
    assert got == want
    assert all(s < d for _, s, d in got)


def test_depth_equals_fold(logs):
    rows, df = logs
    want = {}
    for run, evs in _by_run(rows).items():
        for e, d in zip(evs, fold_depth(evs)):
            want[(run, e["event_id"])] = d
    for bits in (1, 3, 20):
        got = {(r.run_id, r.event_id): r.depth for r in B.with_call_depth(df, chunk_bits=bits).collect()}
        assert got == want, bits


@pytest.mark.parametrize("n", [0, 1, 2, None])
def test_bound_loops_equals_fold(logs, n):
    rows, df = logs
    want = set()
    for run, evs in _by_run(rows).items():
        want |= {(run, e) for e in fold_bound_loops(evs, n)}
    got = {(r.run_id, r.event_id) for r in B.bound_loops(df, n, chunk_bits=2).collect()}
    assert got == want


def test_call_spans_pair_like_a_stack(logs):
    rows, df = logs
    want = set()
    for run, evs in _by_run(rows).items():
        stack = []
        for e in evs:
            if e["kind"] == "enter":
                stack.append(e["event_id"])
            elif e["kind"] == "exit" and stack:
                want.add((run, stack.pop(), e["event_id"]))
        want |= {(run, s, None) for s in stack}
    got = {(r.run_id, r.enter_id, r.exit_id) for r in B.call_spans(df, chunk_bits=2).collect()}
    assert got == want
