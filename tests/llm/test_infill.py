import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linewise.llm import infill
from linewise.llm.infill import Array, Bitmap, BoundarySet, Runs, boundaries, container, fill_in_middle, restored


def expected(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("kind,values", [
    (Runs, range(65_536)), (Runs, [*range(5), *range(100, 9000)]), (Array, range(0, 8000, 2)), (Array, [65_535]),
    (Bitmap, [v for v in range(65_536) if v % 7 not in (1, 3, 4)]), (Bitmap, range(0, 65_536, 3))])
def test_each_container_selects(kind, values):
    values = list(values)
    mask = np.zeros(values[-1] + 1, bool)
    mask[values] = True
    c = container(mask)
    assert type(c) is kind
    for k in {0, 1, 63, 64, len(values) // 2, len(values) - 1} & set(range(len(values))):
        assert c.select(k) == values[k]


def test_sets_over_several_containers():
    rng = np.random.default_rng(3)
    for share in (0.001, 0.2, 0.999):
        mask = rng.random(400_000) < share
        mask[70_000:200_000] = False  # an empty container between others
        where = np.flatnonzero(mask)
        s = BoundarySet(mask[i:i + 65_536] for i in range(0, len(mask), 65_536))
        assert len(s) == len(where) and len(s.containers) < 7
        assert all(s.select(k) == where[k] for k in rng.integers(0, len(where), 300))
        with pytest.raises(IndexError):
            s.select(len(where))


@given(st.text(max_size=60), st.integers(0, 4))
@settings(max_examples=200, deadline=None)
def test_cuts_fall_between_code_points(text, pad):
    text = "é" * (32_766 * pad // 2) + text  # some sets reach into a second container
    data, cuts = text.encode(), boundaries(text.encode())
    assert len(cuts) == len(text) + 1
    for k in {0, 1, len(text) // 2, len(text)} & set(range(len(cuts))):
        assert data[:cuts.select(k)].decode() == text[:k]


def test_word_units():
    for text in ("", "  ", "one", "  two words \n", "a b  c\td", "x " * 70_000 + " é"):
        data, cuts = text.encode(), boundaries(text.encode(), "word")
        starts = [0, *[m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)][1:]] if text else []
        assert [cuts.select(k) for k in range(len(cuts))] == [*starts, len(data)]


def test_query_equals_brute_force(spark, docs, rows, odd, empty):
    for table in (docs, odd):
        out = fill_in_middle(table)
        got = sorted((tuple(r) for r in out.collect()), key=repr)
        assert got == sorted((expected(r.doc_id, r.text) for r in table.collect()), key=repr)
        back = [tuple(r) for r in out.select("doc_id", restored().alias("text")).collect()]
        assert sorted(back, key=repr) == sorted(((r.doc_id, r.text or "") for r in table.collect()), key=repr)
    assert fill_in_middle(empty).collect() == []


def test_markers_and_look_alikes(spark):
    texts = ["a<P>b", "<S>", "x<M>", "<", "<P", "P><S", "a<<P>", "><P><", "<S" * 40, "M>" * 40, "<[PSM]>" * 9]
    df = spark.createDataFrame([(i, t) for i in range(40) for t in texts], "doc_id bigint, text string")
    out = fill_in_middle(df).withColumn("back", restored()).collect()
    assert len(out) == 440 and {r.form for r in out} == {"plain", "psm", "spm"}
    want = sorted(t for i in range(40) for t in texts)
    assert sorted(r.back for r in out) == want
    assert all(r.form == "plain" for r in out if re.search("<[PSM]>", r.back))


def test_batches_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(infill, "BATCH_BYTES", 1000)
    df = spark.createDataFrame([(i, "word " * (i % 300)) for i in range(600)], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in fill_in_middle(df).select("doc_id", "n", "output").collect())
    assert got == sorted((e[0], e[1], e[5]) for e in (expected(i, "word " * (i % 300)) for i in range(600)))
