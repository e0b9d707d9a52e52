"""Slices by bitmaps against a search: ranges, many seeds, both directions, cycles, top impact."""

import random

import pytest
from linewise.operators import slicing as S


def _reach(edges, seed, direction):
    seen, todo = {seed}, [seed]
    while todo:
        n = todo.pop()
        for a, b in edges:
            to = b if direction == "forward" and a == n else a if direction == "backward" and b == n else None
            if to is not None and to not in seen:
                seen.add(to)
                todo.append(to)
    return seen


def _graph(rng, n, m, acyclic=True):
    out = set()
    while len(out) < m:
        a, b = rng.randrange(n), rng.randrange(n)
        if a != b:
            out.add((min(a, b), max(a, b)) if acyclic else (a, b))
    return sorted(out)


def _tables(spark, graphs, seeds):
    e = spark.createDataFrame([(r, a, b) for r, g in graphs.items() for a, b in g], "run_id long, src long, dst long")
    s = spark.createDataFrame([(r, x) for r, xs in seeds.items() for x in xs], "run_id long, seed long")
    return e, s


@pytest.mark.parametrize("bits,words,acyclic", [(14, 64, True), (3, 1, True), (14, 64, False)])
def test_slices_equal_a_search(spark, monkeypatch, bits, words, acyclic):
    monkeypatch.setattr(S, "BLOCK_BITS", bits)
    monkeypatch.setattr(S, "GROUP_WORDS", words)
    rng = random.Random(bits)
    n = 70 if bits > 3 else 30
    graphs = {1: _graph(rng, n, n + 20, acyclic), 2: _graph(rng, 12, 15, acyclic), 3: [(0, 1), (5, 20)]}
    seeds = {1: range(n), 2: [0, 3, 11, 11], 3: [0, 20, 40]}  # 40 has no edge
    e, s = _tables(spark, graphs, seeds)
    for direction in ("forward", "backward") if bits > 3 and acyclic else ("forward",):
        got = [tuple(r) for r in S.slices(e, s, direction).select("run_id", "seed", "node_id").collect()]
        want = {(r, x, n) for r, xs in seeds.items() for x in set(xs) for n in _reach(graphs[r], x, direction)}
        assert len(got) == len(want) and set(got) == want
        sizes = {(r.run_id, r.seed): r.impact for r in S.slice_sizes(e, s, direction).collect()}
        assert sizes == {(r, x): sum(1 for w in want if w[:2] == (r, x)) - 1 for r, xs in seeds.items() for x in set(xs)}


@pytest.mark.parametrize("acyclic", [True, False])
def test_top_impact_is_exact(spark, monkeypatch, acyclic):
    monkeypatch.setattr(S, "BLOCK_BITS", 4)
    rng = random.Random(7)
    graphs = {r: _graph(rng, 40, 45, acyclic) for r in (1, 2)}
    e, s = _tables(spark, graphs, {r: range(40) for r in (1, 2)})
    size = {(r, x): len(_reach(graphs[r], x, "forward")) - 1 for r in graphs for x in range(40)}
    for k in (7,) if acyclic else (500,):
        got = [tuple(r) for r in S.top_impact(e, s, k).select("impact", "run_id", "seed").collect()]
        assert got == [(n, r, x) for (r, x), n in sorted(size.items(), key=lambda i: (-i[1], i[0]))][:k]


def test_seeds_that_cannot_win_are_not_counted(spark, monkeypatch):
    """A star and late nodes: only those with room for more than the star's rays stay."""
    edges = [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(31, 40)]
    e, s = _tables(spark, {1: edges}, {1: range(41)})
    counted = []
    real = S.slice_sizes
    monkeypatch.setattr(S, "slice_sizes", lambda e, s, d: counted.append(s.count()) or real(e, s, d))
    assert [tuple(r) for r in S.top_impact(e, s, 1).select("seed", "impact").collect()] == [(0, 29)]
    assert counted == [12]  # node ids 0 to 11 have at least 29 ids after them


def test_empty_tables(spark):
    e, s = _tables(spark, {1: [(0, 1)]}, {1: [0]})
    assert S.slices(e.limit(0), s, "forward").count() == 1
    assert S.slices(e, s.limit(0), "forward").count() == 0
    assert S.top_impact(e, s.limit(0), 3).count() == 0
