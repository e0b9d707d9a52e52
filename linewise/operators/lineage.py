"""C: the last-writer lineage graph.

For each top-level statement execution (a node), an edge comes from the statement that
last wrote each location it reads. Resolution takes two hops, both as-of lookups done as
chunked ordered scans (never a range self-join):

1. location -> ``lineno`` of the latest (refined) write strictly before the read;
2. ``lineno`` -> the latest node of that line strictly before the read.

A read with no earlier write comes from node 0 ("unknown") unless ``ignore_unknown``.
Node ids count top-level statements per run from 1; edges are distinct and ``src < dst``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewise.functions.paths import path_base, path_prefixes
from linewise.operators.scope import call_delta, top_level, with_call_depth
from linewise.plans.materialize import cut
from linewise.plans.scan import (DEFAULT_CHUNK_BITS, chunk_of, clamped_level_and_count, last_before,
                                 running_sum)

REFINEMENTS = ("include_all", "ignore_base", "most_specific")


def _dedupe_vars(vs: Column) -> Column:
    """A variable's identity is (name, id); type and columns ride along."""
    return F.array_distinct(F.transform(vs, lambda v: F.struct(v["name"].alias("name"), v["id"].alias("id"))))


def refine(defs: Column, strategy: str = "include_all") -> Column:
    """Syntactic write refinement inside the array (no shuffle).

    ignore_base: drop a name that is the base (leading identifier) of another written
    path of the same event. most_specific: drop a name that is a proper prefix of another.
    """
    if strategy == "include_all":
        return defs
    if strategy == "ignore_base":
        return F.filter(defs, lambda d: ~F.exists(
            defs, lambda o: (o["name"] != path_base(o["name"])) & (path_base(o["name"]) == d["name"])))
    if strategy == "most_specific":
        return F.filter(defs, lambda d: ~F.exists(
            defs, lambda o: F.array_contains(path_prefixes(o["name"], exclude_full=True), d["name"])))
    raise ValueError(f"unknown refinement: {strategy}")


class Lineage:
    """The pieces of one graph build. Each stage is computed (and written) on first use,
    so queries that need only nodes never resolve reads.

    trace   top-level exec / update rows
    nodes   run_id, node_id, event_id, lineno, line, uses
    writes  run_id, event_id, lineno, name, id (refined)
    reads   run_id, dst, event_id, name, id, w_lineno, w_found, src (NULL = unknown)
    edges   run_id, src, dst (distinct)
    """

    def __init__(self, trace: DataFrame, refinement: str = "include_all", ignore_unknown: bool = False,
                 chunk_bits: int = DEFAULT_CHUNK_BITS, on_unbalanced: str = "clamp",
                 has_calls: bool | None = None):
        self._src, self.refinement, self.ignore_unknown = trace, refinement, ignore_unknown
        self.chunk_bits, self.on_unbalanced, self.has_calls = chunk_bits, on_unbalanced, has_calls
        self.chunk = chunk_of("event_id", chunk_bits)

    @cached_property
    def trace(self) -> DataFrame:
        """Top-level exec / update rows with ``node_id`` on the execs.

        Depth and node numbering run as one chunked pass (node ids count the execs whose
        depth is 0); a trace declared call-free skips the depth part."""
        t = self._src.filter(F.col("kind").isin("exec", "update", "enter", "exit")) \
                     .select("run_id", "event_id", "kind", "lineno", "line", "uses", "defs")
        has_calls = self.has_calls
        if has_calls is None:
            has_calls = bool(t.filter(F.col("kind").isin("enter", "exit")).take(1))
        is_exec = F.col("kind") == "exec"
        if has_calls and self.on_unbalanced == "clamp":
            t = clamped_level_and_count(t, ["run_id"], ["event_id"], call_delta(),
                                        lambda depth: (depth == 0) & is_exec, "depth", "node_id", self.chunk)
        else:
            if has_calls:
                t = with_call_depth(t, on_unbalanced=self.on_unbalanced, chunk_bits=self.chunk_bits)
            else:   # no calls at all: every event is top level
                t = t.withColumn("depth", F.lit(0).cast("bigint"))
            t = running_sum(t, ["run_id"], ["event_id"], ((F.col("depth") == 0) & is_exec).cast("int"),
                            "node_id", self.chunk)
        return cut(top_level(t).select("run_id", "event_id", "kind", "lineno", "line", "uses", "defs",
                                       F.when(is_exec, F.col("node_id")).alias("node_id")),
                   "top_level")

    @cached_property
    def nodes(self) -> DataFrame:
        return self.trace.filter(F.col("kind") == "exec").select(
            "run_id", "node_id", "event_id", "lineno", "line", "uses")

    @cached_property
    def writes(self) -> DataFrame:
        return (self.trace.filter(F.col("kind") == "update")
                    .select("run_id", "event_id", "lineno",
                            F.explode(_dedupe_vars(refine(F.col("defs"), self.refinement))).alias("v"))
                    .select("run_id", "event_id", "lineno", "v.name", "v.id"))

    def _write_rows(self) -> DataFrame:
        """The writes that a read may come from."""
        return self.writes.select("run_id", "id", "event_id", "name", "lineno")

    def _node_rows(self) -> DataFrame:
        """The nodes that a line may lead to."""
        return self.nodes.select("run_id", "lineno", "event_id", "node_id")

    @cached_property
    def _hop1(self) -> DataFrame:
        # A5/A6 + C2: hop 1, location -> lineno of the last write strictly before the read
        reads = self.nodes.select("run_id", "event_id", F.col("node_id").alias("dst"),
                                  F.explode(_dedupe_vars("uses")).alias("v")) \
                          .select("run_id", "event_id", "dst", "v.name", "v.id")
        acc = (reads.select("run_id", "id", "event_id", "dst", "name",
                            F.lit(None).cast("bigint").alias("lineno"), F.lit(False).alias("_w"))
                    .unionByName(self._write_rows().select("run_id", "id", "event_id",
                                                           F.lit(None).cast("bigint").alias("dst"), "name",
                                                           "lineno", F.lit(True).alias("_w"))))
        # the found flag rides along: a write with a NULL lineno is still a write
        hop1 = last_before(acc, ["run_id", "id"], ["event_id", F.col("_w").cast("int")],
                           F.col("_w"), F.struct(F.col("lineno").alias("l")), "_hit", self.chunk)
        return cut(hop1.filter(~F.col("_w")).select(
            "run_id", "event_id", "dst", "name", "id", F.col("_hit.l").alias("w_lineno"),
            F.col("_hit").isNotNull().alias("w_found")), "reads")

    @cached_property
    def _resolved(self) -> DataFrame:
        # Hop 2, lineno -> latest node of that line strictly before the read. The
        # reading node itself has the same event id, so sources sort after targets on ties.
        known = self._hop1.filter(F.col("w_found"))
        probe = (known.select("run_id", F.col("w_lineno").alias("lineno"), "event_id", "dst", "name", "id",
                              F.lit(None).cast("bigint").alias("node_id"), F.lit(False).alias("_n"))
                      .unionByName(self._node_rows().select("run_id", "lineno", "event_id",
                                                            F.lit(None).cast("bigint").alias("dst"),
                                                            F.lit(None).cast("string").alias("name"),
                                                            F.lit(None).cast("bigint").alias("id"),
                                                            "node_id", F.lit(True).alias("_n"))))
        hop2 = last_before(probe, ["run_id", "lineno"], ["event_id", F.col("_n").cast("int")],
                           F.col("_n"), F.col("node_id"), "src", self.chunk)
        return hop2.filter(~F.col("_n")).select(
            "run_id", "dst", "event_id", "name", "id", F.col("lineno").alias("w_lineno"),
            F.lit(True).alias("w_found"), "src")

    @cached_property
    def reads(self) -> DataFrame:
        unknown = self._hop1.filter(~F.col("w_found")).select(
            "run_id", "dst", "event_id", "name", "id", "w_lineno", "w_found",
            F.lit(None).cast("bigint").alias("src"))
        return self._resolved.unionByName(unknown)

    @cached_property
    def edges(self) -> DataFrame:
        # Unknown reads come from node 0 unless ignored; edges are distinct
        rows = self._resolved.filter(F.col("src").isNotNull()) if self.ignore_unknown else self.reads
        return (rows.select("run_id", F.coalesce("src", F.lit(0)).cast("bigint").alias("src"),
                            F.col("dst").cast("bigint").alias("dst"))
                    .distinct())


def build(trace: DataFrame, refinement: str = "include_all", ignore_unknown: bool = False,
          chunk_bits: int = DEFAULT_CHUNK_BITS, on_unbalanced: str = "clamp",
          has_calls: bool | None = None) -> Lineage:
    """``has_calls=False`` declares a trace without enter/exit events (every statement is
    top level) and skips the depth scan; ``None`` probes for one such row."""
    return Lineage(trace, refinement, ignore_unknown, chunk_bits, on_unbalanced, has_calls)


def lineage(trace: DataFrame, refinement: str = "include_all", ignore_unknown: bool = False,
            chunk_bits: int = DEFAULT_CHUNK_BITS) -> DataFrame:
    """Edges (run_id, src, dst) of the last-writer graph."""
    return build(trace, refinement, ignore_unknown, chunk_bits).edges


def unknown_summary(g: Lineage) -> DataFrame:
    """Per run, the names read with no earlier writer.

    The reference appends one name per unknown read to node 0's label, which grows with
    the trace; here each distinct name appears once, in first-read order, so the
    aggregate is bounded by the program text, not by the number of executions.
    """
    firsts = (g.reads.filter(~F.col("w_found"))
                     .groupBy("run_id", "name")
                     .agg(F.min("event_id").alias("first_event_id"), F.count(F.lit(1)).alias("n_reads")))
    return (firsts.groupBy("run_id")
                  .agg(F.sort_array(F.collect_list(F.struct("first_event_id", "name"))).alias("_l"),
                       F.sum("n_reads").cast("bigint").alias("n_unknown_reads"))
                  .select("run_id",
                          F.concat(F.lit("UNKNOWNS: "),
                                   F.array_join(F.transform("_l", lambda x: F.concat(x["name"], F.lit(","))), ""))
                           .alias("src_label"),
                          "n_unknown_reads"))


LABEL_BITS = 12   # reads in one part of an unknown node's label: 2**12


def unknown_label(g: Lineage, chunk_bits: int = DEFAULT_CHUNK_BITS) -> DataFrame:
    """The label of each run's unknown node with one entry per unknown read, in event order
    (reads of one event by name and id), as rows run_id, part, n_reads and text: the parts of
    a run, put together in their order, are the label. A part holds at most 2**LABEL_BITS
    reads, so no group holds a run."""
    unknown = g.reads.filter(~F.col("w_found")).select("run_id", "event_id", "name", "id")
    at = running_sum(unknown, ["run_id"], ["event_id", "name", "id"], F.lit(1), "at", chunk_of("event_id", chunk_bits),
                     inclusive=False)
    rows = at.groupBy("run_id", F.shiftright("at", LABEL_BITS).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("at", "name"))).alias("_l"))
    return rows.select("run_id", "part", F.size("_l").cast("bigint").alias("n_reads"), F.array_join(
        F.transform("_l", lambda x: F.concat(F.coalesce(x["name"], F.lit("")), F.lit(","))), "").alias("text"))


def _last_updates(g: Lineage, chunk_bits: int) -> DataFrame:
    """run_id, node_id and the writes of the last update attributed to each node (an update
    goes to the latest node of its line at or before it)."""
    chunk = chunk_of("event_id", chunk_bits)
    ups = g.trace.filter(F.col("kind") == "update").select(
        "run_id", "event_id", "lineno", "defs")
    probe = (ups.select("run_id", "lineno", "event_id", F.col("defs"),
                        F.lit(None).cast("bigint").alias("node_id"), F.lit(False).alias("_n"))
                .unionByName(g.nodes.select("run_id", "lineno", "event_id",
                                            F.lit(None).cast(ups.schema["defs"].dataType).alias("defs"),
                                            "node_id", F.lit(True).alias("_n"))))
    att = last_before(probe, ["run_id", "lineno"], ["event_id", F.col("_n").cast("int")],
                      F.col("_n"), F.col("node_id"), "owner", chunk)
    att = att.filter(~F.col("_n") & F.col("owner").isNotNull())
    return att.groupBy("run_id", F.col("owner").alias("node_id")).agg(
        F.max_by(_dedupe_vars(F.col("defs")), F.col("event_id")).alias("complete_defs"))


def node_defs(g: Lineage, trace: DataFrame, refinement: str, chunk_bits: int = DEFAULT_CHUNK_BITS) -> DataFrame:
    """For each node, the names of the refined and of the complete writes of its last
    update, joined (``node_def_vars`` has them with their addresses)."""
    last = _last_updates(g, chunk_bits)
    return last.select("run_id", "node_id",
                       F.array_join(F.sort_array(F.transform(refine(F.col("complete_defs"), refinement),
                                                             lambda d: d["name"])), ",").alias("defs"),
                       F.array_join(F.sort_array(F.transform("complete_defs", lambda d: d["name"])), ",")
                        .alias("complete_defs"))


def node_def_vars(g: Lineage, refinement: str, chunk_bits: int = DEFAULT_CHUNK_BITS) -> DataFrame:
    """One row per distinct (name, id) that the last update of a node writes, and
    whether the refinement keeps it."""
    last = _last_updates(g, chunk_bits).withColumn("kept", F.transform(
        refine(F.col("complete_defs"), refinement), lambda d: F.struct(d["name"].alias("name"), d["id"].alias("id"))))
    rows = last.select("run_id", "node_id", "kept", F.explode("complete_defs").alias("d"))
    return rows.select("run_id", "node_id", F.col("d.name").alias("name"), F.col("d.id").alias("id"),
                       F.array_contains("kept", F.struct(F.col("d.name").alias("name"), F.col("d.id").alias("id")))
                       .alias("refined")).distinct()


def node_calls(g: Lineage, trace: DataFrame, chunk_bits: int = DEFAULT_CHUNK_BITS) -> DataFrame:
    """Every enter (at any depth) goes to the latest node of its line before it;
    one row per attributed call (the relational form of the node's ``calls`` list)."""
    chunk = chunk_of("event_id", chunk_bits)
    enters = trace.filter(F.col("kind") == "enter").select(
        "run_id", "event_id", "lineno", F.col("call.qualname").alias("qualname"))
    probe = (enters.withColumn("node_id", F.lit(None).cast("bigint")).withColumn("_n", F.lit(False))
                   .unionByName(g.nodes.select("run_id", "event_id", "lineno",
                                               F.lit(None).cast("string").alias("qualname"),
                                               "node_id", F.lit(True).alias("_n"))))
    att = last_before(probe, ["run_id", "lineno"], ["event_id", F.col("_n").cast("int")],
                      F.col("_n"), F.col("node_id"), "owner", chunk)
    return att.filter(~F.col("_n") & F.col("owner").isNotNull()).select(
        "run_id", F.col("owner").alias("node_id"), F.col("event_id").alias("call_event_id"), "qualname")


def graph_stats(g: Lineage) -> DataFrame:
    """Nodes (node 0 counted when some edge uses it) and edges per run."""
    n_nodes = g.nodes.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    n_edges = g.edges.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.max((F.col("src") == 0).cast("int")).alias("_has0"))
    return (n_nodes.join(n_edges, "run_id", "full")
                   .select("run_id",
                           (F.coalesce("n_nodes", F.lit(0)) + F.coalesce("_has0", F.lit(0))).cast("bigint").alias("n_nodes"),
                           F.coalesce("n_edges", F.lit(0)).cast("bigint").alias("n_edges")))


def node_degree(g: Lineage) -> DataFrame:
    """in/out degree of every node (node 0 included when used)."""
    ends = (g.edges.select("run_id", F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o"))
                   .unionByName(g.edges.select("run_id", F.col("dst").alias("node_id"),
                                               F.lit(1).alias("i"), F.lit(0).alias("o")))
                   .unionByName(g.nodes.select("run_id", "node_id", F.lit(0).alias("i"), F.lit(0).alias("o"))))
    return ends.groupBy("run_id", "node_id").agg(F.sum("i").cast("bigint").alias("in_degree"),
                                                 F.sum("o").cast("bigint").alias("out_degree"))


def edges_between_lines(g: Lineage) -> DataFrame:
    """C14: edges per (source line, target line) pair; ``edge_exists`` filters one pair."""
    n = g.nodes.select("run_id", "node_id", "lineno")
    src = n.select("run_id", F.col("node_id").alias("src"), F.col("lineno").alias("src_lineno"))
    dst = n.select("run_id", F.col("node_id").alias("dst"), F.col("lineno").alias("dst_lineno"))
    e = g.edges.filter(F.col("src") != 0).join(src, ["run_id", "src"]).join(dst, ["run_id", "dst"])
    return e.groupBy("run_id", "src_lineno", "dst_lineno").agg(F.count(F.lit(1)).alias("n_edges"))


def edge_exists(g: Lineage, l1: int, l2: int) -> DataFrame:
    """C14: runs that have an edge from a node of line l1 to a node of line l2."""
    return (edges_between_lines(g).filter((F.col("src_lineno") == l1) & (F.col("dst_lineno") == l2))
                                  .select("run_id").distinct())


def node_by_line(g: Lineage, lineno: int) -> DataFrame:
    """C14: nodes of one line."""
    return g.nodes.filter(F.col("lineno") == lineno).select("run_id", "node_id", "event_id")
