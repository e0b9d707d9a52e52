import math
import random

import pytest
from pyspark.sql import functions as F

from linewise.llm.mixing import mix, targets

SCHEMA = "doc_id bigint, text string, source string"


def shares(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by the rounds of the definition."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()) * share, set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        above = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not above:
            return out | {s: level * w[s] for s in open_}
        out |= {s: float(most * sizes[s]) for s in above}
        left -= sum(out[s] for s in above)
        open_ -= above
    return out


def check(df, **options):
    rows = mix(df, **options).collect()
    sizes = {}
    for r in df.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    want = shares(sizes)
    by_uid, taken, total = {}, dict.fromkeys(sizes, 0), sum(sizes.values())
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], abs=1e-6)
        assert 0 <= r.taken <= r.size and r.epoch in (0, 1)
        by_uid[r.uid] = by_uid.get(r.uid, 0) + r.taken
        taken[r.source] += r.taken
    assert len(by_uid) == df.count()
    n = len(sizes)
    assert all(abs(taken[s] - want[s]) <= max(1, n) for s in sizes), (taken, want)
    assert abs(sum(taken.values()) - 1.5 * total) <= n
    order = sorted((r for r in rows if r.taken), key=lambda r: r.position)
    at = 0
    for r in order:  # gapless, and by finish time
        assert r.position == at
        at += r.taken
    assert [r.finish for r in order] == sorted(r.finish for r in order)
    return rows


def test_targets_by_rounds(spark):
    rng = random.Random(5)
    for trial in range(6):
        sizes = {f"s{i}": rng.choice([0, 1, 7, 50, 1000, 40_000]) for i in range(rng.randint(1, 30))}
        sizes |= {None: rng.randint(0, 500), "é": 9, "z\U0001f600": 4, "z￮": 3}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r.source: r.target for r in targets(df).collect()}
        want = shares(sizes)
        assert got.keys() == want.keys()
        assert all(got[s] == pytest.approx(want[s], abs=1e-6) for s in want)


def test_hot_source_long_documents_and_repeats(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.choice([0, 1, 20, 300]), rng.choice(["hot", "hot", "b", "c", None])) for i in range(500)]
    rows += [(1000, "long " * 40_000, "c"), (1001, "only " * 900, "one"), (1002, "", "none")]
    check(spark.createDataFrame(rows, SCHEMA))


def test_order_of_the_rows_changes_nothing(spark, docs):
    def view(df):
        return sorted(((r.doc_id, r.epoch, r.taken, r.position) for r in mix(df).collect()), key=repr)
    first = view(docs)
    assert first == view(docs.repartition(7, F.rand(3))) == view(docs.orderBy(F.desc("text")))
    assert first != sorted(((r.doc_id, r.epoch, r.taken, r.position) for r in mix(docs, seed="other").collect()), key=repr)


def test_documents(docs):
    check(docs)


def test_odd_rows(spark, odd, empty):
    check(odd)
    assert mix(empty).collect() == []
    same = spark.createDataFrame([(7, "one two three", "s")] * 50 + [(None, None, None)] * 5, SCHEMA)
    got = check(same)
    assert sorted(r.taken for r in got if r.source == "s") == sorted([3] * 75)
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], SCHEMA)
    assert {(r.doc_id, r.target, r.taken) for r in mix(blank).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}


def test_own_sizes_and_weights(spark):
    df = spark.createDataFrame([(i, "x" * 10, "ab"[i % 2]) for i in range(100)], SCHEMA)
    got = mix(df, size=F.length("text"), weights=(1, 4), share=1.0, most=5)
    taken = {r[0]: r[1] for r in got.groupBy("source").agg(F.sum("taken")).collect()}
    assert taken == {"a": 200, "b": 800} and got.agg(F.max("epoch")).first()[0] == 1
    assert math.isclose(got.where("source = 'b'").first().target, 800)
