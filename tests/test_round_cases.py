"""Line breaks after a path, with items, and an unknown node's label in bounded parts."""

from helpers import trace_df
from linewise.functions import paths as P
from linewise.operators import lineage as L
from linewise.operators import reaching as E
from linewise.sources.schema import FACTS
from pyspark.sql import functions as F


def test_a_line_break_ends_no_path(spark):
    names = ["a.b", "a.b\n", "a.b ", "a.b\u0085", "a.b\r\n", "a[\n].b", "d['\n']"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, p string")
    got = {r.i: r.s for r in df.select("i", P.path_segments("p").alias("s")).collect()}
    assert got == {0: ["a", ".b"], 1: None, 2: None, 3: None, 4: None, 5: ["a", "[\n]", ".b"], 6: ["d", "['\n']"]}


def test_with_items_store_their_name(spark):
    row = lambda seq, kind, targets, refs: (1, 0, seq, seq, kind, None, None, [], targets, refs, False, None, None)
    facts = E.with_accesses(spark.createDataFrame(
        [row(1, "with", ["f"], ["open"]), row(2, "expr", [], ["f"]), row(3, "with", [], ["lock"])], FACTS))
    assert [(r.loads, r.stores) for r in facts.orderBy("seq").collect()] == [(["open"], ["f"]), (["f"], []), (["lock"], [])]
    assert [(r.src, r.dst, r.key) for r in E.reaching_branches(facts).collect()] == [(1, 2, "f")]


def test_the_unknown_label_lists_every_read_in_parts(spark, monkeypatch):
    monkeypatch.setattr(L, "LABEL_BITS", 2)
    rows = [{"run_id": run, "event_id": e, "kind": "exec", "lineno": e, "uses": [(f"v{e % 3}", e % 3), ("w", 9)], "defs": []}
            for run in (1, 2) for e in range(1, 4 + run)]
    label = L.unknown_label(L.build(trace_df(spark, rows)))
    parts = [(r.run_id, r.part, r.n_reads, r.text) for r in label.orderBy("run_id", "part").collect()]
    assert all(n <= 4 for _, _, n, _ in parts) and [p[:2] for p in parts] == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]
    for run in (1, 2):
        want = "".join(f"v{e % 3},w," for e in range(1, 4 + run))
        assert "".join(t for r, _, _, t in parts if r == run) == want
    assert label.agg(F.sum("n_reads")).first()[0] == 18
