"""Branch-aware reaching writers (E4/E5) equal a scope fold with sound merges on random
nested programs; straight-line reaching writers and undefined reads on a small case."""

import random

from pyspark.sql import functions as F

from linewise.operators import reaching as E
from linewise.sources.schema import FACTS

from pairs import reaching_branches_by_pairs


def random_block(rng, depth, counter):
    out = []
    for _ in range(rng.randint(0, 4)):
        r = rng.random()
        if r < 0.25 and depth < 3:
            counter[1] += 1
            out.append(("if", counter[1], random_block(rng, depth + 1, counter), random_block(rng, depth + 1, counter)))
        else:
            out.append(("write" if rng.random() < 0.5 else "read", rng.choice("abc")))
    return out


def flatten(block, path, rows, unit, seq):
    for s in block:
        if s[0] == "if":
            flatten(s[2], path + [(s[1], "T")], rows, unit, seq)
            flatten(s[3], path + [(s[1], "F")], rows, unit, seq)
        else:
            seq[0] += 1
            s_id = seq[0]
            rows.append((unit, 0, s_id, s_id, "assign" if s[0] == "write" else "expr",
                         path[-1][0] if path else None, path[-1][1] if path else None,
                         [{"ctl_id": c, "arm": a} for c, a in path],
                         [], [], False, [s[1]] if s[0] == "read" else [], [s[1]] if s[0] == "write" else []))


def fold(block, unit, state, edges, seq):
    for s in block:
        if s[0] == "if":
            t = fold(s[2], unit, {k: set(v) for k, v in state.items()}, edges, seq)
            f = fold(s[3], unit, {k: set(v) for k, v in state.items()}, edges, seq)
            state = {k: t.get(k, set()) | f.get(k, set()) for k in set(t) | set(f)}
        else:
            seq[0] += 1
            if s[0] == "read":
                edges |= {(unit, w, seq[0], s[1]) for w in state.get(s[1], ())}
            else:
                state[s[1]] = {seq[0]}
    return state


def test_reaching_branches_equals_fold(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for unit in range(150):
        prog = random_block(rng, 0, [0, 0])
        flatten(prog, [], rows, unit, [0])
        fold(prog, unit, {}, want, [0])
    facts = spark.createDataFrame(rows, FACTS)
    got = {(r.unit_id, r.src, r.dst, r.key) for r in E.reaching_branches(facts).collect()}
    assert got == want
    pairs = {(r.unit_id, r.src, r.dst, r.key) for r in reaching_branches_by_pairs(facts).collect()}
    assert pairs == want


def test_straight_line_and_undefined(spark):
    rows = [(1, 0, 1, 10, "expr", None, None, [], [], [], False, ["x"], []),
            (1, 0, 2, 20, "assign", None, None, [], [], [], False, [], ["x"]),
            (1, 0, 3, 30, "assign", None, None, [], [], [], True, ["x"], ["x"]),
            (1, 0, 4, 40, "expr", None, None, [], [], [], False, ["x", "y"], []),
            (1, 0, 5, 50, "expr", None, None, [], [], [], False, ["y"], [])]
    facts = spark.createDataFrame(rows, FACTS)
    edges = {(r.src, r.dst, r.key) for r in E.reaching_edges(facts).collect()}
    assert edges == {(20, 30, "x"), (30, 40, "x")}
    und = {(r.key, r.source_seq, r.n_reads) for r in E.undefined_reads(facts).collect()}
    assert und == {("x", 1, 1), ("y", 4, 2)}


def test_large_seq_keeps_every_edge(spark):
    """Positions are exact: the same program near 0 and near 2**54 has the same edges."""
    def program(unit, base):
        t, f = [{"ctl_id": 9, "arm": "T"}], [{"ctl_id": 9, "arm": "F"}]
        rows = [(1, [], "w"), (2, t, "w"), (3, f, "r"), (4, [], "r")]
        return [(unit, 0, base + s, s, "assign", None, None, bp, [], [], False,
                 ["x"] if k == "r" else [], ["x"] if k == "w" else []) for s, bp, k in rows]
    facts = spark.createDataFrame(program(1, 0) + program(2, 1 << 54) + program(3, (1 << 62) + 1), FACTS)
    got = {(r.unit_id, r.src, r.dst) for r in E.reaching_branches(facts).collect()}
    assert got == {(u, a, b) for u in (1, 2, 3) for a, b in ((1, 3), (1, 4), (2, 4))}


def test_units_are_dealt_once(spark):
    """one exchange by unit; before, each nesting level had scans, joins and tables of its own."""
    rows, prog = [], random_block(random.Random(3), 0, [0, 0])
    flatten(prog + [("if", 99, [("if", 98, prog, prog)], prog)], [], rows, 1, [0])
    plan = E.reaching_branches(spark.createDataFrame(rows, FACTS))._jdf.queryExecution().sparkPlan().toString()
    full = E.reaching_branches(spark.createDataFrame(rows, FACTS))._jdf.queryExecution().executedPlan().toString()
    assert full.count("Exchange ") == 1 and "Join" not in plan


def test_large_units_in_chunks_equal_small_ones(spark, monkeypatch):
    """units too large for a task give the same edges, mixed with small ones or alone."""
    rng, rows, want = random.Random(5), [], set()
    for unit in range(40):
        prog = random_block(rng, 0, [0, 0])
        flatten(prog, [], rows, unit, [0])
        fold(prog, unit, {}, want, [0])
    facts = spark.createDataFrame(rows, FACTS)
    for limit in (20, 0):
        monkeypatch.setattr(E, "UNIT_ROWS", limit)
        assert {(r.unit_id, r.src, r.dst, r.key) for r in E.reaching_branches(facts).collect()} == want


def test_null_tests_and_statements_give_nothing(spark):
    """What stands in a block with a NULL test does not leave it; NULL statements are no ends."""
    def row(seq, stmt, path, kind):
        bp = [{"ctl_id": c, "arm": a} for c, a in path]
        return (1, 0, seq, stmt, "expr", None, None, bp, [], [], False,
                ["x"] if kind == "r" else [], ["x"] if kind == "w" else [])
    rows = [row(1, 1, [], "w"), row(2, 2, [(None, "T")], "r"), row(3, 3, [(None, "T")], "w"),
            row(4, 4, [(None, "T")], "r"), row(5, 5, [(None, "F")], "w"), row(6, 6, [], "r"), row(7, None, [], "r")]
    got = {(r.src, r.dst) for r in E.reaching_branches(spark.createDataFrame(rows, FACTS)).collect()}
    assert got == {(3, 4), (1, 6)}
