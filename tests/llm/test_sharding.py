from collections import Counter

from pyspark.sql import functions as F

from linewise.llm.sharding import Shard, assign, shard_of, tree


def placed(spark, shards, n=4000):
    return {r.id: r.s for r in spark.range(n).select("id", shard_of(F.col("id"), shards).alias("s")).collect()}


def test_growth_takes_rows_only_into_the_new_shard(spark):
    for n in (8, 9, 12):
        a, b = placed(spark, tree(n)), placed(spark, tree(n + 1))
        assert all(b[i] in (a[i], n) for i in a)
        assert Counter(b.values())[n] > 0


def test_weights_are_followed_and_movement_is_confined(spark):
    base = [Shard(s, s // 2, s // 4) for s in range(8)]
    heavier = [*base[:7], Shard(7, 3, 1, 3.0)]
    a, b = placed(spark, base), placed(spark, heavier)
    share = Counter(b.values())
    assert 1.3 < sum(share[s] for s in range(4, 8)) / sum(share[s] for s in range(4)) < 1.7
    assert 2.4 < share[7] / share[6] < 3.6
    assert all(b[i] >= 4 for i in a if a[i] != b[i])  # only into the region whose weight grew


def test_zero_weight_is_empty(spark):
    assert 3 not in placed(spark, [*tree(8)[:3], Shard(3, 1, 0, 0.0), *tree(8)[4:]]).values()


def test_odd_rows(odd, empty):
    got = assign(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {r.size for r in got if r.doc_id in (1, 2)} == {1}
    assert assign(empty).collect() == []
