"""Near-duplicate groups by SimHash fingerprints, with pivot distance tables.

1. Fingerprints: 64 majority bits over the XXH64 hashes of a text's word shingles. Equal
   fingerprints are one class from here on (a class keeps its smallest doc_id), so exact
   copies cost nothing more.
2. Pivot distance table, written once: each fingerprint's Hamming distances to 33 reference
   fingerprints, zero and 32 with one block of bits set each. A distance to such a reference
   and the distance to zero tell the block's weight, so the table keeps, in one 64-bit code,
   each block's weight as a run of ones (``coordinates``); all distances follow from it. The
   distance to any union of references changes by the blocks' weight differences with either
   sign, so the largest coordinate difference over all 2^32 unions is the sum of the absolute
   weight differences: the number of bits in which two codes differ.
3. Candidates without all pairs: the references are cut into ``k`` groups. Two fingerprints
   within ``distance`` bits have the same coordinates in at least ``k - distance`` groups, so
   every linked pair shares a bucket (a choice of that many groups and their coordinates).
   ``k`` grows with the number of classes, which keeps buckets small; every ``k`` gives the
   same links. Pairs of a bucket whose maximum coordinate difference is over ``distance`` are
   discarded (triangle inequality), survivors are verified on their bits.
4. A small bucket yields its verified pairs; a larger one only a spanning forest of its
   links. A bucket of more than ``bucket_rows`` classes is not held by any task: each of
   its fingerprints is dealt to the points within half the distance that keep the bucket's
   coordinates. Two fingerprints that share such a point are linked, and two linked ones of
   the bucket share one, so a star per point holds all links at a cost linear in the bucket.
5. Connected components over the links (see ``components``).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.llm.common import cut, documents, ship_package
from linewise.llm.components import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
PIVOTS = 32
BUCKET_ROWS = 16384
MEAN_ROWS = 128
SMALL = 32


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text; 0 for a text without words."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1:].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(
            starts[at:at + (1 << 16)], ends[at:at + (1 << 16)])), np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little") \
            .reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th (a hash of the text, which with doc_id names the row) and fp (the
    fingerprint as a signed bigint) of every row."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fps = np.array([fingerprint_of(t, shingle) for t in part.column(2).to_pylist()],
                               np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(fps.view(np.int64))],
                    names=["doc_id", "th", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text_hash(text).alias("th"),
                       text.alias("text")).mapInArrow(run, "doc_id bigint, th bigint, fp bigint")


def _text_hash(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _edges(n: int) -> list[int]:
    """Where ``n`` nearly equal blocks of 64 bits begin, and 64."""
    return [64 * i // n for i in range(n + 1)]


def _mask(a: int, b: int) -> int:
    return ((1 << b) - 1) ^ ((1 << a) - 1)


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: zero, then ``n`` with one block of bits set each."""
    edges = _edges(n)
    return np.array([0, *[_mask(a, b) for a, b in zip(edges, edges[1:])]], np.uint64)


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of every fingerprint to every reference, one row each."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def coordinates(table: np.ndarray) -> np.ndarray:
    """A row of distances to ``pivots(n)`` as one code: each block's weight as a run of ones
    from the block's low end. Two codes differ in as many bits as the largest difference of
    the distances to any union of references."""
    edges = np.array(_edges(table.shape[1] - 1))
    wide = table.astype(np.int16)
    weights = (wide[:, :1] + np.diff(edges) - wide[:, 1:]) // 2
    ones = np.array([(1 << i) - 1 for i in range(65)], np.uint64)
    return np.bitwise_or.reduce(ones[weights] << edges[:-1].astype(np.uint64), axis=1)


def pivot_table(classes: DataFrame, n_pivots: int = PIVOTS) -> DataFrame:
    """fp and code (its distances to the references) of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots(n_pivots)
        for batch in batches:
            fps = batch.column(0).to_numpy()
            codes = coordinates(distance_table(fps.view(np.uint64), refs))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))],
                                             names=["fp", "code"])

    return classes.select("fp").mapInArrow(run, "fp bigint, code bigint")


def block_masks(k: int, keep: int, n_pivots: int = PIVOTS) -> list[int]:
    """Bit masks of all choices of ``keep`` out of ``k`` nearly equal groups of references."""
    edges = _edges(n_pivots)
    cuts = [edges[n_pivots * i // k] for i in range(k + 1)]
    return [sum(c) for c in combinations([_mask(a, b) for a, b in zip(cuts, cuts[1:])], keep)]


def blocks_for(n: int, distance: int = DISTANCE, n_pivots: int = PIVOTS) -> int:
    """The least number of groups whose keys tell enough for ``n`` classes: some MEAN_ROWS
    classes a bucket if fingerprints were random."""
    edges = _edges(n_pivots)
    told = sum(width - sum(math.comb(width, w) * math.log2(math.comb(width, w)) for w in range(width + 1))
               / 2 ** width for width in (b - a for a, b in zip(edges, edges[1:])))
    k = distance + 2
    while k < 2 * distance + 4 and told * (k - distance) / k < math.log2(max(n, 2) / MEAN_ROWS):
        k += 1
    return k


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _near(fps: np.ndarray, codes: np.ndarray, fp, code, distance: int) -> np.ndarray:
    """Which of the pairs are linked: pivot discard, then the bits of the survivors."""
    near = np.bitwise_count(codes ^ code) <= distance
    at = np.nonzero(near)
    near[at] = np.bitwise_count((fps ^ fp)[at]) <= distance
    return near


def _small_pairs(keys: np.ndarray, fps: np.ndarray, codes: np.ndarray, distance: int):
    """Linked pairs of rows with equal keys; rows lie sorted by key, groups are small."""
    lag, out = 1, []
    at = np.arange(len(fps))
    while True:
        at = at[at + lag < len(fps)]
        at = at[keys[at] == keys[at + lag]]
        if not len(at):
            return out
        good = at[_near(fps[at], codes[at], fps[at + lag], codes[at + lag], distance)]
        out.append((fps[good], fps[good + lag]))
        lag += 1


def _forest(fps: np.ndarray, codes: np.ndarray, distance: int):
    """Links that connect what is connected within one bucket: a spanning forest."""
    paired = [_near(fps[None, :], codes[None, :], fps[at:at + 64, None], codes[at:at + 64, None],
                    distance).sum(axis=1) > 1 for at in range(0, len(fps), 64)]
    left, out = np.flatnonzero(np.concatenate(paired)), []
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            f = frontier.pop()
            near = _near(fps[left], codes[left], fps[f], codes[f], distance)
            hit = left[near]
            if len(hit):
                out.append((np.full(len(hit), fps[f]), fps[hit]))
                frontier += hit.tolist()
                left = left[~near]
    return out


def _bucket_links(rows: DataFrame, distance: int, bucket_rows: int) -> DataFrame:
    """Links within buckets. ``rows`` (choice, key, fp, code) is distributed by bucket and sorted.
    Result: x, y; a bucket that is too large gives one row with its choice and key instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None  # rows of the bucket that is still open
        closed = None  # bucket found too large

        def emit(links, over=()):
            x = [p for p, _ in links]
            y = [p for _, p in links]
            n = sum(map(len, x))
            longs = lambda parts: np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
            none = [None] * n
            return pa.RecordBatch.from_arrays([
                pa.array([*longs(x).tolist(), *[None] * len(over)], pa.int64()),
                pa.array([*longs(y).tolist(), *[None] * len(over)], pa.int64()),
                pa.array([*none, *[c for c, _ in over]], pa.int32()),
                pa.array([*none, *[k for _, k in over]], pa.int64())],
                names=["x", "y", "choice", "key"])

        def work(c, k, f, codes):
            change = np.flatnonzero((c[1:] != c[:-1]) | (k[1:] != k[:-1])) + 1
            edges = np.concatenate([[0], change, [len(f)]])
            group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            size = np.diff(edges)
            small = (size <= SMALL)[group] & (size > 1)[group]
            links = _small_pairs(group[small], f[small], codes[small], distance)
            for g in np.flatnonzero((size > SMALL) & (size <= bucket_rows)):
                own = slice(edges[g], edges[g + 1])
                links += _forest(f[own], codes[own], distance)
            return links, [(int(c[edges[g]]), int(k[edges[g]])) for g in np.flatnonzero(size > bucket_rows)]

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(4)]
            if closed is not None:  # drop what follows of a bucket already handed over
                go_on = (cols[0] != closed[0]) | (cols[1] != closed[1])
                cols = [c[go_on] for c in cols]
                if not len(cols[0]):
                    continue
                closed = None
            if rest is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(rest, cols)]
            c, k, f, codes = cols
            same = (c == c[-1]) & (k == k[-1])
            first = int(np.argmax(same))
            if len(f) - first > bucket_rows:
                closed, rest, done = (c[-1], k[-1]), None, len(f)
            else:
                rest, done = [x[first:].copy() for x in cols], first
            if done:
                yield emit(*work(c[:done], k[:done], f[:done].view(np.uint64), codes[:done].view(np.uint64)))
        if rest is not None and len(rest[0]):
            yield emit(*work(rest[0], rest[1], rest[2].view(np.uint64), rest[3].view(np.uint64)))

    return rows.mapInArrow(run, "x bigint, y bigint, choice int, key bigint")


def _flips(mask: int, half: int, n_pivots: int) -> list[int]:
    """Changes of at most ``half`` bits that keep the coordinates under ``mask``: of the bits
    outside any, of a block inside two at a time (two fingerprints of equal weight there
    differ by such twos). An odd half may have to part such a two, so then all bits are free."""
    edges = _edges(n_pivots)
    blocks = [(a, b) for a, b in zip(edges, edges[1:]) if half % 2 == 0 and mask >> a & 1]
    held = sum(_mask(a, b) for a, b in blocks)
    free = [1 << i for i in range(64) if not held >> i & 1]
    twos = [(1 << i) | (1 << j) for a, b in blocks for i, j in combinations(range(a, b), 2)]
    out = set()
    for t in range(half // 2 + 1):
        for two in combinations(twos, t):
            moved = functools.reduce(int.__xor__, two, 0)
            for r in range(half - 2 * t + 1):
                out |= {moved ^ sum(more) for more in combinations(free, r)}
    return sorted(out)


def _midpoints(rows: DataFrame, masks: list[int], distance: int, n_pivots: int) -> DataFrame:
    """(choice, point, fp): points within half the distance that keep the bucket's coordinates."""
    half = distance // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = {}
        for batch in batches:
            choice, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c in np.unique(choice).tolist():
                if c not in flips:
                    flips[c] = np.array(_flips(masks[c], half, n_pivots), np.uint64).view(np.int64)
                own = fps[choice == c]
                for at in range(0, len(own), 64):
                    part = own[at:at + 64]
                    points = (part[:, None] ^ flips[c][None, :]).reshape(-1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(points), c, np.int32)), pa.array(points),
                         pa.array(np.repeat(part, len(flips[c])))], names=["choice", "point", "fp"])

    return rows.select("choice", "fp").mapInArrow(run, "choice int, point bigint, fp bigint")


def links(classes: DataFrame, distance: int = DISTANCE, n_pivots: int = PIVOTS,
          bucket_rows: int = BUCKET_ROWS, n_blocks: int | None = None) -> DataFrame:
    """Links (x, y) between distinct fingerprints ``classes.fp`` whose components are those
    of all pairs within ``distance`` bits. ``distance`` must be even."""
    if distance % 2:
        raise ValueError("an even distance is needed for the points halfway")
    table = cut(pivot_table(classes, n_pivots), "simhash-pivots")
    k = n_blocks or blocks_for(table.count(), distance, n_pivots)
    masks = block_masks(k, k - distance, n_pivots)
    keyed = table.select("fp", "code", F.explode(F.array([
        F.struct(F.lit(i).alias("choice"), F.col("code").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for i, m in enumerate(masks)])).alias("b")).select("b.choice", "b.key", "fp", "code")
    dealt = keyed.repartition("choice", "key").sortWithinPartitions("choice", "key")
    found = cut(_bucket_links(dealt, distance, bucket_rows), "simhash-links")
    out = found.where("x IS NOT NULL").select("x", "y")
    large = found.where("choice IS NOT NULL").select("choice", "key")
    if large.isEmpty():
        return out
    points = cut(_midpoints(keyed.join(large, ["choice", "key"], "left_semi"), masks, distance, n_pivots),
                 "simhash-points")
    heads = points.groupBy("choice", "point").agg(F.min("fp").alias("x"), F.max("fp").alias("_m")) \
        .where("x <> _m").drop("_m")
    stars = points.join(heads, ["choice", "point"]).select("x", F.col("fp").alias("y")).where("x <> y")
    return out.unionByName(stars.distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE,
                    n_pivots: int = PIVOTS, bucket_rows: int = BUCKET_ROWS,
                    n_blocks: int | None = None) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of the connected group), th and root (a
    fingerprint that names the group) per row.

    Null and empty texts and texts of white space have fingerprint 0 and are linked like any
    others. Repeated rows give repeated rows; a null doc_id is never a component's id while
    the group has another. An empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, shingle), "simhash-fps")
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    roots = cut(components(links(classes, distance, n_pivots, bucket_rows, n_blocks)), "simhash-roots")
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = cut(rooted.join(ids, "root").select("fp", "component_id", "root"), "simhash-ids")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id", "th", "root")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs``, all columns, per near-duplicate group: the one with the smallest
    doc_id (of repeated ids the one with the least text hash)."""
    groups = near_duplicates(docs, **options)
    keep = (groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("_lw_kept")).select("_lw_kept"))
    key = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"),
                   _text_hash(F.col("text").cast("string")).alias("th"))
    out = docs.withColumn("_lw_row", key)
    return (out.join(cut(keep, "simhash-kept"), F.col("_lw_row").eqNullSafe(F.col("_lw_kept")), "left_semi")
            .dropDuplicates(["_lw_row"]).drop("_lw_row"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
