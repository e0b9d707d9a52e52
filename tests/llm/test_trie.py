import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from linewise.llm import trie
from linewise.llm.trie import PRIME, element, inverse, prefix_trie, then

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in own.items()}
    members, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        turns = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    leaves, saved, children = {}, {}, {}
    for node, m in members.items():
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
        gain = (len(m) - 1) * len(node[-1][1].split()) if node else 0
        leaf = len(ends.get(node, [])) == len(m)
        for d in range(len(node) + 1):
            saved[node[:d]] = saved.get(node[:d], 0) + gain
            leaves[node[:d]] = leaves.get(node[:d], 0) + leaf
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), children.get(node, 0), leaves[node],
         saved[node], hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
        for node, m in members.items())


def got(df, **options):
    out = prefix_trie(df, **options).drop("ref").collect()
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in out)


def make(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def test_monoid():
    rng = random.Random(2)
    f, g, h = ([element(rng.getrandbits(64), rng.getrandbits(64), PRIME) for _ in range(3)])
    assert then(then(f, g, PRIME), h, PRIME) == then(f, then(g, h, PRIME), PRIME)
    assert then(f, inverse(f, PRIME), PRIME) == then(inverse(f, PRIME), f, PRIME) == (1, 0)
    assert then(f, g, PRIME) != then(g, f, PRIME)


def random_rows(rng, n_convs, n_texts):
    rows = []
    for c in rng.sample(range(-60, 400), n_convs):
        for t in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([t, t, None]) if t == 0 else t, rng.choice(["user", "bot", None]),
                         rng.choice([None, "", *[f"word {i} of some" for i in range(n_texts)]])))
    return rows


@pytest.mark.parametrize("n_texts", [1, 3])
def test_random_conversations(spark, n_texts):
    rows = random_rows(random.Random(n_texts), 120, n_texts)
    assert got(make(spark, rows)) == brute(rows)


def test_giant_conversation_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_BITS", 4)
    monkeypatch.setattr(trie, "BLOCK_BITS", 3)
    giant = [(40, t, "user", f"turn {t}") for t in range(300)]
    rows = giant + [(c, t, r, x) for c in range(41, 60) for _, t, r, x in giant[:c * 3]]
    rows += [(c, 0, "user", "one") for c in range(100, 160)]
    want, spark_parts = brute(rows), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 11)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(make(spark, rows)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", spark_parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_turnless_absent_bases_and_repeated_rows(spark):
    rows = [(c, 0, "user", "hello there") for c in range(21, 40)]  # their base 20 is absent
    rows += [(c, 1, None, None) for c in range(60, 75)] + [(60, 1, None, None)] * 3 + [(None, 1, "user", "lost")] * 4
    rows += [(80, None, "user", "first"), (80, -5, "user", "second"), (-40, 0, "a", "x"), (-47, 0, "b", "y")]
    assert got(make(spark, rows)) == brute(rows)
    assert prefix_trie(make(spark, [(None, 1, "user", "lost")])).collect() == []
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_equal_turn_numbers_have_one_order(spark):
    rows = [(c, 3, "user", f"text {i}") for c in (0, 20, 40) for i in range(9)]
    a, b = got(make(spark, rows)), got(make(spark, rows[::-1], 5))
    assert a == b


def test_extra_columns_are_ignored(spark):
    rows = random_rows(random.Random(9), 40, 2)
    df = make(spark, rows).withColumns({c: F.lit(-1) for c in (
        "depth", "a", "b", "pos", "ref", "words", "h", "part", "n", "uid", "tie", "last")})
    assert got(df) == brute(rows)


def test_collisions_are_found_and_drawn_anew(spark):
    rows = random_rows(random.Random(4), 80, 3)
    assert got(make(spark, rows), primes=(5, 7, PRIME)) == brute(rows)
    with pytest.raises(RuntimeError):
        prefix_trie(make(spark, rows), primes=(5, 7))


def test_conversations(spark):
    from llm_cases import SF

    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert got(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
