import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from linewise.llm.components import components
from linewise.llm.simhash import (_flips, _forest, block_masks, blocks_for, coordinates, distance_table,
                                  fingerprint_of, keep_one, links, near_duplicates, pivots)


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    """doc_id -> smallest doc_id reachable over links of at most 4 bits."""
    fps = sorted(set(prints.values()))
    up = {f: f for f in fps}

    def find(f):
        while up[f] != f:
            f = up[f]
        return f
    for i, f in enumerate(fps):
        for g in fps[i + 1:]:
            if bin(f ^ g).count("1") <= 4:
                up[find(g)] = find(f)
    least = {}
    for d, f in prints.items():
        least[find(f)] = min(least.get(find(f), d), d)
    return {d: least[find(f)] for d, f in prints.items()}


def test_fingerprints(rows):
    for _, text in [*rows[:60], (0, ""), (0, None), (0, "one"), (0, "a b c d"), (0, "A b\tc\x0bd E"), (0, " \n")]:
        assert fingerprint_of(text) == brute_print(text)


def test_query_equals_brute_force(spark, docs, rows):
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in near_duplicates(docs).collect()}
    prints = {d: brute_print(t) for d, t in rows}
    groups = brute_groups(prints)
    assert got == {d: (prints[d], groups[d]) for d in prints}


def clustered(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n // 20):
        c = rnd.getrandbits(64)
        for _ in range(20):
            f = c
            for _ in range(rnd.randint(0, 6)):
                f ^= 1 << rnd.randrange(64)
            out.append(f)
    return sorted(set(out))


@pytest.mark.parametrize("options", [{}, {"n_blocks": 8}, {"bucket_rows": 5}, {"bucket_rows": 5, "n_blocks": 7},
                                     {"n_pivots": 1}])
def test_links_keep_components(spark, options):
    fps = clustered(400, 3)
    if options.get("bucket_rows"):  # one dense cloud makes buckets too large to hold
        rnd = random.Random(9)
        fps = sorted({*fps, *(sum(1 << b for b in rnd.sample(range(64), 2)) for _ in range(60))})
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    found = links(df, **options)
    for r in found.collect():
        assert bin((r.x ^ r.y) % 2**64).count("1") <= (8 if options.get("bucket_rows") else 4)
    roots = {r.node: r.root for r in components(found).collect()}
    groups = brute_groups({f: f % 2**64 for f in signed})
    by_root, by_group = {}, {}
    for f in signed:
        by_root.setdefault(roots.get(f, f), set()).add(f)
        by_group.setdefault(groups[f], set()).add(f)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_group.values()))


def test_pivots_never_discard_a_link():
    rng, refs = np.random.default_rng(4), pivots()
    a = rng.integers(0, 2**63, 500).astype(np.uint64)
    b = a.copy()
    for i in range(500):
        for bit in rng.choice(64, i % 5, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    assert (np.abs(distance_table(a, refs) - distance_table(b, refs)).max(axis=1) <= 4).all()


@pytest.mark.parametrize("n", [1, 8, 24, 32, 64])
def test_code_holds_all_distances(n):
    rng, refs = np.random.default_rng(n), pivots(n)
    fps = np.concatenate([rng.integers(0, 2**64, 300, np.uint64), np.array([0, 2**64 - 1, 1, 2**63], np.uint64)])
    table = distance_table(fps, refs)
    codes = coordinates(table)
    # the code as a fingerprint has the same distances, and one code belongs to one row of distances
    assert (distance_table(codes, refs) == table).all()
    assert len({*codes.tolist()}) == len({tuple(r) for r in table.tolist()})


def test_codes_differ_by_the_maximum_over_unions():
    rng, refs = np.random.default_rng(6), pivots(8)
    a, b = rng.integers(0, 2**64, (2, 50), np.uint64)
    unions = np.array([sum(int(refs[1 + i]) for i in range(8) if u >> i & 1) for u in range(256)], np.uint64)
    most = np.abs(distance_table(a, unions) - distance_table(b, unions)).max(axis=1)
    codes = [coordinates(distance_table(x, refs)) for x in (a, b)]
    assert (np.bitwise_count(codes[0] ^ codes[1]) == most).all()


@pytest.mark.parametrize("half", [1, 2, 4])
def test_linked_pairs_of_a_bucket_share_a_point(half):
    rnd, refs = random.Random(half), pivots()
    mask, n = (1 << 32) - 1 if half < 4 else (1 << 56) - 1, 0
    flips = _flips(mask, half, 32)
    assert len(flips) == len({*flips}) and max(bin(f).count("1") for f in flips) <= half
    while n < 40:
        x = rnd.getrandbits(64)
        y = x
        for _ in range(rnd.randint(0, half)):
            y ^= 3 << 2 * rnd.randrange(16)
        for _ in range(rnd.randint(0, 2 * half)):
            y ^= 1 << rnd.randrange(64)
        c, d = (int(v) for v in coordinates(distance_table(np.array([x, y], np.uint64), refs)))
        if (c ^ d) & mask or bin(x ^ y).count("1") > 2 * half:
            continue
        n += 1
        assert {x ^ f for f in flips} & {y ^ f for f in flips}


def test_blocks_cover_all_bits():
    for k in range(6, 13):
        assert max(block_masks(k, k - 4)).bit_length() == 64
    assert blocks_for(10) == 6 and blocks_for(10**10) > blocks_for(10**6)


def test_forest_of_a_chain():
    fps = np.array([(1 << 4 * i) - 1 for i in range(12)], np.uint64)
    assert sum(len(x) for x, _ in _forest(fps, coordinates(distance_table(fps, pivots())), 4)) == 11


def test_odd_rows(odd):
    got = near_duplicates(odd).collect()
    assert len(got) == odd.count()
    zero = {r.component_id for r in got if r.fp == 0}
    assert zero == {1}  # null, empty and blank texts are one group; its null ids don't name it
    assert {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [
        (False, 0), (True, -8), (True, 1), (True, 4), (True, 5), (True, 7)]


def test_empty(empty):
    assert near_duplicates(empty).collect() == [] and keep_one(empty).collect() == []


def test_components_of_a_long_chain(spark):
    n = 300
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, ids[1:])), "x bigint, y bigint")
    got = components(df)
    assert got.count() == n and got.select("root").distinct().count() == 1
    assert components(df.where(F.lit(False))).collect() == []
