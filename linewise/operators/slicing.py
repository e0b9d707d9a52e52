"""F: node selection, forward / backward slices, induced subgraphs, impact.

A slice is computed for many seeds at once. The seeds of a run are numbered, and a node
carries a bitmap of the seeds that reach it, in 64-bit words merged by ``bit_or``: one row
per (node, word of 64 seeds) instead of one per (node, seed).

* **Acyclic graphs** (every edge from a smaller to a larger node id, as in lineage) are
  swept over ranges of node ids. A task takes one range of 2**``BLOCK_BITS`` ids of one run
  and closes its bitmaps over the edges inside the range in one pass in id order; what
  leaves the range goes, merged, to the ranges that come later. Each range is closed once,
  so the rounds are as many as a run has ranges, however deep the graph is, and one if no
  edge crosses ranges.
* **Other graphs** step a frontier over the *contracted* graph. Runs of nodes with one way
  in and one way out (a loop doing ``x = x + 1`` a billion times is such a run) are
  contracted first by pointer jumping: one pointer per node, doubled each round. A round
  sends the new bits of a node over its edges and drops those that the target has already,
  in one aggregation; it ends when no bit is new.

Each round starts from written tables, so plans don't grow. ``WITH RECURSIVE`` is not used:
Spark accepts only ``UNION ALL`` there, which enumerates paths. The driver only learns
whether something is left.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewise.functions.paths import canonical_ref
from linewise.plans.materialize import cut
from linewise.plans.scan import chunk_of, running_sum
from linewise.session import ship_package

COMPACT_EVERY = 8
#: A range has so many node ids; its inner edges are held by one task. Lower it for
#: statements that read thousands of locations each.
BLOCK_BITS = 14
#: Words of 64 seeds that are closed together; more seeds make more tasks.
GROUP_WORDS = 64
_BITS = "run_id bigint, node_id bigint, word bigint, bits bigint"
_FULL = (1 << 64) - 1


def node_ids(nodes: DataFrame, cond: Column) -> DataFrame:
    """ids of the nodes matching a predicate."""
    return nodes.filter(cond).select("run_id", "node_id")


def reverse(edges: DataFrame) -> DataFrame:
    """the reverse graph."""
    return edges.select("run_id", F.col("dst").alias("src"), F.col("src").alias("dst"), *[
        c for c in edges.columns if c not in ("run_id", "src", "dst")])


def _chains(step: DataFrame) -> DataFrame | None:
    """``(run_id, node_id, tail, hops, end_id)`` for every node inside a run of nodes with
    one way in and one way out: the run's last such node, the hops to it, and the node
    after it. Nodes on a cycle of such nodes have no tail and are left out."""
    ins = step.groupBy("run_id", F.col("next_id").alias("node_id")).agg(F.count("*").alias("n_in"))
    outs = step.groupBy("run_id", "node_id").agg(F.count("*").alias("n_out"), F.min("next_id").alias("next_id"))
    inner = cut(outs.join(ins, ["run_id", "node_id"]).filter("n_in = 1 AND n_out = 1")
                .select("run_id", "node_id", "next_id"), "chain_nodes")
    followed = inner.select("run_id", F.col("node_id").alias("next_id"), F.lit(True).alias("more"))
    # tail: itself where the next node is outside, else still open
    state = cut(inner.join(followed, ["run_id", "next_id"], "left").select(
        "run_id", "node_id", F.when(F.col("more"), F.col("next_id")).otherwise(F.col("node_id")).alias("tail"),
        F.when(F.col("more"), 1).otherwise(0).cast("bigint").alias("hops"),
        F.coalesce("more", F.lit(False)).alias("open")), "chain_pointers")
    n = state.count()
    jumps = 1
    while jumps <= n and not state.filter("open").isEmpty():
        to = state.select("run_id", F.col("node_id").alias("tail"), F.col("tail").alias("t2"),
                          F.col("hops").alias("h2"), F.col("open").alias("o2"))
        state = cut(state.join(to, ["run_id", "tail"]).select(
            "run_id", "node_id", F.col("t2").alias("tail"), (F.col("hops") + F.col("h2")).alias("hops"),
            F.col("o2").alias("open")), "chain_pointers")
        jumps *= 2
    if not n:
        return None
    ends = inner.select("run_id", F.col("node_id").alias("tail"), F.col("next_id").alias("end_id"))
    return cut(state.filter("NOT open").join(ends, ["run_id", "tail"]), "chains")


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    """Distinct steps (run_id, node_id, next_id) of a slice."""
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction: {direction}")
    a, b = ("dst", "src") if direction == "backward" else ("src", "dst")
    return cut(edges.select("run_id", F.col(a).alias("node_id"), F.col(b).alias("next_id")).distinct(), "slice_edges")


def _numbered(seeds: DataFrame) -> DataFrame:
    """Distinct seeds (run_id, seed) with their number in the run (from 0)."""
    seeds = seeds.select("run_id", F.col("seed").cast("bigint").alias("seed")).distinct()
    out = running_sum(seeds, ["run_id"], ["seed"], F.lit(1), "idx", chunk_of("seed"), inclusive=False)
    return cut(out, "slice_seeds")


def _first_bits(numbered: DataFrame, node: str = "seed") -> DataFrame:
    one = F.expr("shiftleft(1L, CAST(idx % 64 AS int))")
    return _merged(numbered.select("run_id", F.col(node).alias("node_id"), F.shiftright("idx", 6).alias("word"),
                                   one.alias("bits")))


def _merged(bits: DataFrame) -> DataFrame:
    return bits.groupBy("run_id", "node_id", "word").agg(F.expr("bit_or(bits)").alias("bits"))


def _members(bits: DataFrame, numbered: DataFrame) -> DataFrame:
    """Bitmaps as rows: run_id, seed, node_id."""
    own = F.expr("filter(sequence(0, 63), i -> (shiftrightunsigned(bits, i) & 1) = 1)")
    rows = bits.select("run_id", "node_id", "word", F.explode(own).alias("i"))
    return (rows.select("run_id", "node_id", (F.col("word") * 64 + F.col("i")).alias("idx"))
            .join(numbered, ["run_id", "idx"]).select("run_id", "seed", "node_id"))


def _closed(counted: bool, group_words: int) -> Callable:
    """Close the bitmaps of one range of node ids (a group of words) over its inner edges.
    Rows: an edge (node_id, next_id; word null) or bits (node_id, word, bits). Gives the bits
    of all nodes, and with ``counted`` the nodes that each seed of the group reaches (word
    -1: node_id is the seed's number, bits the count)."""
    def run(table: pa.Table) -> pa.Table:
        run_id, first = table["run_id"][0], 64 * table["part"][0].as_py() * group_words
        have: dict[int, int] = {}
        told = table.filter(pc.is_valid(table["word"]))
        for node, word, bits in zip(*(told[c].to_pylist() for c in ("node_id", "word", "bits"))):
            have[node] = have.get(node, 0) | (bits & _FULL) << (64 * word - first)
        edges = table.filter(pc.is_null(table["word"]))
        edges = edges.take(pc.sort_indices(edges, [("node_id", "descending")]))
        for node, to in zip(edges["node_id"].to_pylist(), edges["next_id"].to_pylist()):
            if node in have:
                have[to] = have.get(to, 0) | have[node]
        wide = max((b.bit_length() + 63) // 64 for b in have.values())
        raw = b"".join(b.to_bytes(8 * wide, "little") for b in have.values())
        words = np.frombuffer(raw, "<i8").reshape(-1, wide)
        at, k = np.nonzero(words)
        cols = [np.array(list(have), np.int64)[at], k + first // 64, words[at, k]]
        if counted:
            total = np.zeros(64 * wide, np.int64)
            for lo in range(0, len(words), 4096):  # 4,096 nodes' bits unpacked at a time
                part = np.ascontiguousarray(words[lo:lo + 4096]).view(np.uint8)
                total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            seen = np.flatnonzero(total)
            cols = [np.concatenate(c) for c in zip(cols, [seen + first, np.full(len(seen), -1), total[seen]])]
        return pa.table([pa.array([run_id.as_py()] * len(cols[0]), pa.int64()), *[pa.array(c, pa.int64()) for c in cols]],
                        names=["run_id", "node_id", "word", "bits"])
    return run


def _sweep(step: DataFrame, start: DataFrame, counted: bool = False) -> DataFrame:
    """Bits of all nodes that the bits of ``start`` reach, for steps that all go from a larger
    to a smaller id (or, with ids negated, the other way)."""
    ship_package(step.sparkSession)
    block = lambda c: F.shiftright(c, BLOCK_BITS)
    inside = block("node_id") == block("next_id")
    inner = step.where(inside).select("run_id", "node_id", "next_id", block("node_id").alias("block"))
    cross = step.where(~inside)

    def close(bits: DataFrame) -> DataFrame:
        keyed = bits.select("run_id", block("node_id").alias("block"), F.floor(F.col("word") / GROUP_WORDS).alias("part"),
                            "node_id", F.lit(None).cast("bigint").alias("next_id"), "word", "bits")
        edges = inner.join(keyed.select("run_id", "block", "part").distinct(), ["run_id", "block"]).select(
            "run_id", "block", "part", "node_id", "next_id", F.lit(None).cast("bigint").alias("word"),
            F.lit(None).cast("bigint").alias("bits"))
        return keyed.unionByName(edges).groupBy("run_id", "block", "part").applyInArrow(_closed(counted, GROUP_WORDS), _BITS)

    if cross.isEmpty():
        return close(start)
    pending, done = cut(start, "slice_pending"), []
    while True:
        top = pending.groupBy("run_id").agg(F.max(block("node_id")).alias("top"))  # one row per run
        told = pending.join(top, "run_id", "left")
        now = cut(close(told.where(block("node_id") == F.col("top")).select(*pending.columns)), "slice_closed")
        done.append(now)
        left = now.where("word >= 0").join(cross, ["run_id", "node_id"]).select(
            "run_id", F.col("next_id").alias("node_id"), "word", "bits")
        rest = told.where(block("node_id") < F.col("top")).select(*pending.columns)
        pending = cut(_merged(rest.unionByName(left)), "slice_pending")
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, done)
        if len(done) > COMPACT_EVERY:
            done = [cut(reduce(DataFrame.unionByName, done), "slice_done")]


def _ascending(edges: DataFrame) -> bool:
    return edges.where("src >= dst").isEmpty()


def _swept(edges: DataFrame, numbered: DataFrame, direction: str, counted: bool = False) -> DataFrame:
    step, start = _steps(edges, direction), _first_bits(numbered)
    if direction == "backward":
        return _sweep(step, start, counted)
    turn = lambda df: df.withColumns({c: -F.col(c) for c in ("node_id", "next_id") if c in df.columns})
    out = _sweep(turn(step), turn(start), counted)
    return out.withColumn("node_id", F.when(F.col("word") < 0, F.col("node_id")).otherwise(-F.col("node_id")))


def slices(edges: DataFrame, seeds: DataFrame, direction: str = "backward") -> DataFrame:
    """``(run_id, seed, node_id)`` for every node reachable from each seed
    (the seed included). ``seeds`` has ``run_id`` and ``seed`` columns; run ids and node ids
    are not null. A seed without edges reaches itself."""
    numbered = _numbered(seeds)
    if _ascending(edges):
        return _members(_swept(edges, numbered, direction), numbered)
    step = _steps(edges, direction)
    chains = _chains(step)
    seeds = numbered.withColumn("node_id", F.col("seed"))
    if chains is None:
        return _members(_frontier(step, _first_bits(numbered)), numbered)
    inside = chains.select("run_id", F.col("node_id").alias("next_id"), F.col("end_id").alias("to_id"), "tail")
    outer = step.join(chains.select("run_id", "node_id"), ["run_id", "node_id"], "left_anti") \
        .join(inside, ["run_id", "next_id"], "left")
    outer = cut(outer.select("run_id", "node_id", F.coalesce("to_id", "next_id").alias("next_id"), "tail"),
                "slice_contracted")
    placed = cut(seeds.join(chains, ["run_id", "node_id"], "left"), "slice_placed")
    start = placed.select("run_id", "idx", F.coalesce("end_id", "node_id").alias("start"))
    bits = cut(_frontier(outer.select("run_id", "node_id", "next_id").distinct(), _first_bits(start, "start")), "slice_met")
    # runs entered from a visited node are visited whole, a seed's own run from the seed on
    whole = _merged(bits.join(outer.filter("tail IS NOT NULL").select("run_id", "node_id", "tail").distinct(),
                              ["run_id", "node_id"]).select("run_id", F.col("tail").alias("node_id"), "word", "bits"))
    whole = whole.withColumnRenamed("node_id", "tail").join(
        chains.select("run_id", "tail", "node_id"), ["run_id", "tail"]).select("run_id", "node_id", "word", "bits")
    own = (placed.filter("tail IS NOT NULL").select("run_id", "idx", "tail", F.col("hops").alias("from"))
           .join(chains.select("run_id", "tail", F.col("node_id").alias("on"), "hops"), ["run_id", "tail"])
           .filter("hops <= from"))
    return _members(_merged(bits.unionByName(whole).unionByName(_first_bits(own, "on"))), numbered)


def _frontier(step: DataFrame, start: DataFrame) -> DataFrame:
    """Bits of all nodes that the bits of ``start`` reach, over any graph."""
    fresh = cut(start, "slice_frontier")
    parts = [fresh]
    while True:
        reached = fresh.join(step, ["run_id", "node_id"]).select(
            "run_id", F.col("next_id").alias("node_id"), "word", "bits", F.lit(0).cast("bigint").alias("old"))
        known = reduce(DataFrame.unionByName, parts).select(
            "run_id", "node_id", "word", F.lit(0).cast("bigint").alias("bits"), F.col("bits").alias("old"))
        fresh = reached.unionByName(known).groupBy("run_id", "node_id", "word").agg(
            F.expr("bit_or(bits) & ~bit_or(old)").alias("bits")).where("bits <> 0")
        fresh = cut(fresh, "slice_frontier")
        if fresh.isEmpty():
            return _merged(reduce(DataFrame.unionByName, parts))
        parts.append(fresh)
        if len(parts) > COMPACT_EVERY:
            parts = [cut(_merged(reduce(DataFrame.unionByName, parts)), "slice_visited")]


def induced(edges: DataFrame, slice_nodes: DataFrame) -> DataFrame:
    """edges with both ends in the slice of a seed, original direction."""
    s = slice_nodes.select("run_id", "seed", F.col("node_id").alias("src"))
    d = slice_nodes.select("run_id", "seed", F.col("node_id").alias("dst"))
    return (edges.select("run_id", "src", "dst").join(s, ["run_id", "src"])
                 .join(d, ["run_id", "seed", "dst"], "left_semi")
                 .select("run_id", "seed", "src", "dst"))


def seeds_by_text(nodes: DataFrame, text: str) -> DataFrame:
    """the nodes whose statement text equals ``text`` after normalising, as seeds."""
    return (nodes.filter(canonical_ref(F.col("line")) == canonical_ref(F.lit(text)))
                 .select("run_id", F.col("node_id").alias("seed")))


def slices_by_text(nodes: DataFrame, edges: DataFrame, text: str, direction: str = "backward") -> DataFrame:
    """the slices of :func:`seeds_by_text`."""
    return slices(edges, seeds_by_text(nodes, text), direction)


def slice_sizes(edges: DataFrame, seeds: DataFrame, direction: str = "forward") -> DataFrame:
    """F8: run_id, seed and impact, the nodes in the seed's slice but for itself. On acyclic
    graphs the nodes are counted where their bitmaps are closed, no slice is written out."""
    numbered = _numbered(seeds)
    if _ascending(edges):
        counts = _swept(edges, numbered, direction, counted=True).where("word = -1").groupBy(
            "run_id", F.col("node_id").alias("idx")).agg(F.sum("bits").alias("n"))
        return numbered.join(counts, ["run_id", "idx"]).select("run_id", "seed", (F.col("n") - 1).alias("impact"))
    return impact(slices(edges, seeds, direction))


def top_impact(edges: DataFrame, seeds: DataFrame, k: int, direction: str = "forward") -> DataFrame:
    """F8: the ``k`` seeds with the largest slices (then by run_id, seed), exact.

    A slice has at least the seed's direct neighbours, and on an acyclic graph at most the
    node ids between the seed and the run's last one that is reached by an edge. Seeds whose
    upper bound is below the k-th lower bound cannot be among the first k, whatever their
    slices are; only the others are counted."""
    seeds = cut(seeds.select("run_id", "seed").distinct(), "impact_seeds")
    step = _steps(edges, direction)
    if not _ascending(edges):
        return slice_sizes(edges, seeds, direction).orderBy(F.desc("impact"), "run_id", "seed").limit(k)
    least = step.groupBy("run_id", F.col("node_id").alias("seed")).agg(F.count("*").alias("least"))
    far = F.max("next_id") if direction == "forward" else F.min("next_id")
    ends = step.groupBy("run_id").agg(far.alias("far"))
    bound = cut(seeds.join(least, ["run_id", "seed"], "left").join(ends, "run_id", "left").select(
        "run_id", "seed", F.coalesce("least", F.lit(0)).alias("least"),
        F.coalesce(F.abs(F.col("far") - F.col("seed")), F.lit(0)).alias("most")), "impact_bounds")
    kth = bound.orderBy(F.desc("least")).limit(k).agg(F.count("*"), F.min("least")).first()
    able = bound.where(F.col("most") >= kth[1]) if kth[0] == k else bound
    return slice_sizes(edges, able, direction).orderBy(F.desc("impact"), "run_id", "seed").limit(k)


def impact(slice_nodes: DataFrame, k: int | None = None) -> DataFrame:
    """F8 of given slices: slice size per seed (seed excluded); top-k when ``k`` given."""
    out = slice_nodes.groupBy("run_id", "seed").agg(
        F.sum((F.col("node_id") != F.col("seed")).cast("bigint")).alias("impact"))
    return out if k is None else out.orderBy(F.col("impact").desc(), "run_id", "seed").limit(k)
