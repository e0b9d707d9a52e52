"""Ordered scans with and without hot keys give the same (``linewise.plans.scan``)."""

import random

import pytest
from pyspark.sql import functions as F

from linewise.plans import scan as S


def _scans(df):
    w, n = F.col("w"), F.col("n")
    chunk = S.chunk_of("at", 2)
    yield S.last_before(df, ["k"], ["at"], w, n, "out", chunk)
    yield S.first_after(df, ["k"], ["at"], w, n, "out", chunk)
    yield S.running_sum(df, ["k"], ["at"], n, "out", chunk)
    yield S.running_sums(df, ["k"], ["at"], {"out": n, "two": n * 2}, chunk, inclusive=False)
    yield S.clamped_level(df, ["k"], ["at"], n, "out", chunk)
    yield S.clamped_level_and_count(df, ["k"], ["at"], n, lambda x: x == 0, "out", "count", chunk)
    yield S.count_and_last(df, ["k"], ["at"], ~w, w, n, "out", "last", chunk)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(k, i, rng.random() < 0.3, rng.choice([-1, 0, 1])) for k, size in ((None, 9), (1, 40), (2, 3), (3, 25))
            for i in range(size)]
    return spark.createDataFrame(data, "k int, at bigint, w boolean, n int").repartition(3)


def test_hot_keys_and_others_agree(spark, rows, monkeypatch):
    """All keys cold, some hot, all hot; without hot keys the plan has one exchange and no join."""
    found = []
    for hot in (100, 20, 0):
        monkeypatch.setattr(S, "HOT_ROWS", hot)
        plans = list(_scans(rows))
        found.append([sorted(map(repr, p.collect())) for p in plans])
        if hot == 100:
            text = [p._jdf.queryExecution().optimizedPlan().toString() for p in plans]
            assert not any("Join" in x or "Aggregate" in x for x in text)
            assert all(x.count("RepartitionByExpression") == 1 for x in text)
    assert found[0] == found[1] == found[2]
