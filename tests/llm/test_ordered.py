import random

from pyspark.sql import functions as F

from linewise.llm.ordered import before, join_spread, ordered


def test_running_sums_over_ranges(spark):
    rng = random.Random(8)
    rows = [(rng.choice("aaaab"), rng.randint(0, 50), i, rng.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, x int, i int, v int")
    order = [F.col("k"), F.col("x"), F.col("i")]
    got = before(ordered(df.repartition(5), order, "t"), ["k"], order, F.col("v"), "s")
    want, run = {}, {}
    for k, x, i, v in sorted(rows):
        want[i] = run.get(k, 0)
        run[k] = want[i] + v
    assert {r.i: r.s for r in got.collect()} == want
    whole = before(ordered(df, order, "t"), [], order, F.lit(1), "s").collect()
    assert [r.s for r in sorted(whole, key=lambda r: (r.k, r.x, r.i))] == list(range(400))


def test_join_spread_equals_a_plain_join(spark):
    rows = [(i % 7 if i % 3 else 99, i) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, i int")
    stats = df.groupBy("k").agg(F.count("*").alias("n")).withColumn("w", F.col("k") % 2 == 1).withColumn("p", -F.col("k"))
    for least in (1, 100, 10_000):
        got = join_spread(df, ["k"], stats, "n", F.col("w"), ("p",), least)
        assert got.columns == ["k", "i", "p"]
        assert sorted(map(tuple, got.collect())) == sorted((k, i, -k) for k, i in rows if k % 2)
    assert join_spread(df.limit(0), ["k"], stats.limit(0), "n", F.col("w")).count() == 0
