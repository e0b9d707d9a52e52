"""B: call depth, top-level filtering, call spans, origin / name filters, loop bounds,
call arguments and profiles. Every per-run ordered step is a chunked scan
(``linewise.plans.scan``), so one giant run is still spread over many tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewise.plans.materialize import cut
from linewise.plans.scan import (DEFAULT_CHUNK_BITS, chunk_of, clamped_level, first_after,
                                 last_before, running_sum, running_sums)
from linewise.session import ship_package

def call_delta() -> Column:
    return F.when(F.col("kind") == "enter", 1).when(F.col("kind") == "exit", -1).otherwise(0)


def with_call_depth(trace: DataFrame, on_unbalanced: str = "clamp", out: str = "depth",
                    chunk_bits: int = DEFAULT_CHUNK_BITS) -> DataFrame:
    """B1: calls entered minus calls left, *before* each event.

    ``clamp`` (default): an exit with nothing open counts for nothing. ``quarantine``:
    runs that ever go below zero are dropped. ``error``: fail on such a run.
    """
    chunk = chunk_of("event_id", chunk_bits)
    if on_unbalanced == "clamp":
        return clamped_level(trace, ["run_id"], ["event_id"], call_delta(), out, chunk)
    raw = running_sum(trace, ["run_id"], ["event_id"], call_delta(), out, chunk, inclusive=False)
    bad = raw.filter(F.col(out) + F.when(F.col("kind") == "exit", -1).otherwise(0) < 0) \
             .select("run_id").distinct()
    if on_unbalanced == "quarantine":
        return raw.join(bad, "run_id", "left_anti")
    if on_unbalanced == "error":
        n = bad.count()
        if n:
            raise ValueError(f"{n} run(s) leave more calls than they enter")
        return raw
    raise ValueError(f"unknown on_unbalanced: {on_unbalanced}")


def top_level(trace_with_depth: DataFrame, depth: str = "depth") -> DataFrame:
    """B2: statements and writes that happen outside any call."""
    return trace_with_depth.filter((F.col(depth) == 0) & F.col("kind").isin("exec", "update"))


def _spans(trace: DataFrame, chunk_bits: int) -> DataFrame:
    """Call spans with the whole ``call`` of the enter event."""
    calls = with_call_depth(trace.filter(F.col("kind").isin("enter", "exit"))
                                 .select("run_id", "event_id", "kind", "lineno", "call"),
                            chunk_bits=chunk_bits)
    calls = calls.withColumn(
        "level", F.when(F.col("kind") == "enter", F.col("depth") + 1).otherwise(F.col("depth")))
    calls = calls.filter(F.col("level") > 0)
    nxt = first_after(calls, ["run_id", "level"], ["event_id"], F.lit(True),
                      F.struct("event_id", "kind"), "_next", chunk_of("event_id", chunk_bits))
    return (nxt.filter(F.col("kind") == "enter")
               .select("run_id", F.col("event_id").alias("enter_id"),
                       F.when(F.col("_next.kind") == "exit", F.col("_next.event_id")).alias("exit_id"),
                       F.col("level").cast("bigint").alias("level"), "lineno", "call"))


def call_spans(trace: DataFrame, chunk_bits: int = DEFAULT_CHUNK_BITS) -> DataFrame:
    """Pair each enter with its exit. The level of an enter is the depth after it;
    an exit that closes something has level = depth before it. The matching exit is the
    next enter/exit row of the same level; if that next row is another enter (or none),
    the call never returned (``exit_id`` NULL)."""
    return _spans(trace, chunk_bits).select(
        "run_id", "enter_id", "exit_id", "level", "lineno", F.col("call.qualname").alias("qualname"))


def _marked(trace: DataFrame, spans: DataFrame) -> DataFrame:
    """``trace`` with ``_d``: 1 at the enter, -1 at the exit of a span, else 0."""
    ends = F.array(F.struct(F.col("enter_id").alias("event_id"), F.lit(1).alias("d")),
                   F.struct(F.col("exit_id").alias("event_id"), F.lit(-1).alias("d")))
    marks = cut(spans.select("run_id", F.explode(ends).alias("e")).select(
        "run_id", "e.event_id", F.col("e.d").alias("_d")).filter("event_id IS NOT NULL"), "span_marks")
    return trace.join(marks, ["run_id", "event_id"], "left").withColumn("_d", F.coalesce("_d", F.lit(0)))


def by_origin(trace: DataFrame, defined: bool | None = None, called: bool | None = None) -> DataFrame:
    """Keep call events by origin flags (other kinds pass)."""
    cond = F.lit(True)
    if defined is not None:
        cond = cond & (F.col("call.defined_by_user") == F.lit(defined))
    if called is not None:
        cond = cond & (F.col("call.called_by_user") == F.lit(called))
    return trace.filter(~F.col("kind").isin("enter", "exit") | F.coalesce(cond, F.lit(False)))


def collapse_external(trace: DataFrame, chunk_bits: int = DEFAULT_CHUNK_BITS) -> DataFrame:
    """Keep a call into code not defined by the user, drop everything beneath it.

    An event is kept unless some external call span (B3) strictly contains it; the
    external enter and its exit are the kept boundary rows. Implemented as a running
    count of open external spans (+1 at the enter, -1 at the exit), not a range join."""
    ext = _spans(trace, chunk_bits).filter(~F.coalesce(F.col("call.defined_by_user"), F.lit(False)))
    inside = running_sum(_marked(trace, ext), ["run_id"], ["event_id"], F.col("_d"), "_inside",
                         chunk_of("event_id", chunk_bits), inclusive=False)
    # the exclusive count of an external exit row includes its own span
    keep = (F.col("_inside") == 0) | ((F.col("_inside") == 1) & (F.col("_d") == -1))
    return inside.filter(keep).drop("_d", "_inside")


def drop_named(trace: DataFrame, names: DataFrame | list[str], field: str = "call.co_name",
               chunk_bits: int = DEFAULT_CHUNK_BITS) -> DataFrame:
    """Drop calls whose name is in ``names`` together with everything they run.

    ``names`` is a small fixed list (comprehension frames, instrumentation stubs) or a
    DataFrame with a ``name`` column; the DataFrame is joined, never broadcast blindly."""
    spans = _spans(trace, chunk_bits).withColumn("name", F.col(field))
    if isinstance(names, list):
        spans = spans.filter(F.col("name").isin(names))
    else:
        spans = spans.join(names.select("name").distinct(), "name", "left_semi")
    inside = running_sum(_marked(trace, spans), ["run_id"], ["event_id"], F.col("_d"), "_in",
                         chunk_of("event_id", chunk_bits), inclusive=True)
    # a dropped call's enter counts itself; its exit row is back at the outer level, so the
    # exit is dropped by its mark
    return inside.filter((F.col("_in") == 0) & (F.col("_d") != -1)).drop("_d", "_in")


def bound_loops(trace: DataFrame, n: int | None, chunk_bits: int = DEFAULT_CHUNK_BITS) -> DataFrame:
    """Keep the first ``n`` iterations of every loop instance (nested loops too).

    Markers: ``loop_init`` (a loop instance starts), ``loop_iter`` (an iteration starts),
    ``loop_clear`` (the loop is left). Once a loop passes its bound, recording stops
    until that loop is cleared; a second init without a clear resets the count but does
    not re-enable recording (kept on purpose). Markers are dropped from the output.
    """
    markers = ("loop_init", "loop_iter", "loop_clear")
    if n is None:
        return trace.filter(~F.col("kind").isin(*markers))
    chunk = chunk_of("event_id", chunk_bits)
    m = cut(trace.filter(F.col("kind").isin(*markers)).select("run_id", "event_id", "kind", "loop_name"),
            "loop_markers")
    keys = ["run_id", "loop_name"]
    is_init, is_iter, is_clear = (F.col("kind") == "loop_init", F.col("kind") == "loop_iter",
                                  F.col("kind") == "loop_clear")
    # cseg: count segments (a new one at each init or clear); kseg: "ignored" segments,
    # only a clear opens a new one (both in one pass); cnt: iterations so far in a cseg
    m = running_sums(m, keys, ["event_id"], {"_cseg": (is_init | is_clear).cast("int"),
                                              "_kseg": is_clear.cast("int")}, chunk)
    m = cut(running_sum(m, keys + ["_cseg"], ["event_id"], is_iter.cast("int"), "_cnt", chunk),
            "loop_segments")
    over = (F.col("_cnt") >= n) & ~is_clear
    # off: loop is over its bound at or before this marker within the kseg (sticky)
    m = running_sum(m, keys + ["_kseg"], ["event_id"], over.cast("int"), "_over", chunk)
    m = m.withColumn("_off", (F.col("_over") > 0).cast("int"))
    m = last_before(m, keys, ["event_id"], F.lit(True), F.col("_off"), "_prev_off", chunk)
    m = cut(m.withColumn("_delta", F.col("_off") - F.coalesce("_prev_off", F.lit(0)))
             .filter(F.col("_delta") != 0), "loop_switches")
    rows = trace.join(m.select("run_id", "event_id", "_delta"), ["run_id", "event_id"], "left") \
                .withColumn("_delta", F.coalesce("_delta", F.lit(0)))
    # number of loops currently off, including a change made by this very marker
    rows = running_sum(rows, ["run_id"], ["event_id"], F.col("_delta"), "_nf", chunk, inclusive=True)
    return rows.filter((F.col("_nf") == 0) & ~F.col("kind").isin(*markers)).drop("_delta", "_nf")


def call_args(trace: DataFrame) -> DataFrame:
    """One row per argument of each entered call."""
    return (trace.filter(F.col("kind") == "enter")
                 .select("run_id", "event_id", F.col("call.qualname").alias("qualname"),
                         F.posexplode("call.args").alias("pos", "arg"))
                 .select("run_id", "event_id", "qualname", F.col("pos").cast("bigint").alias("pos"),
                         F.col("arg.name").alias("arg_name"), F.col("arg.id").alias("arg_id"),
                         F.col("arg.type").alias("arg_type")))


def call_profile(trace: DataFrame) -> DataFrame:
    """Calls per qualified name and module (map-side partial aggregation)."""
    return (trace.filter(F.col("kind") == "enter")
                 .groupBy(F.col("call.qualname").alias("qualname"), F.col("call.module").alias("module"))
                 .agg(F.count(F.lit(1)).alias("n_calls"),
                      F.countDistinct("run_id").alias("n_runs"),
                      F.sum(F.col("call.defined_by_user").cast("int")).cast("bigint").alias("n_user_defined")))


def link_calls(trace: DataFrame, chunk_bits: int = DEFAULT_CHUNK_BITS) -> DataFrame:
    """Link each enter to the latest statement before it that names the called
    function's address among its reads (``uses.id = call.func_id``)."""
    chunk = chunk_of("event_id", chunk_bits)
    reads = (trace.filter(F.col("kind") == "exec")
                  .select("run_id", "event_id", F.explode(F.array_distinct(F.transform("uses", lambda u: u["id"]))).alias("loc")))
    enters = trace.filter(F.col("kind") == "enter").select("run_id", "event_id", F.col("call.func_id").alias("loc"))
    both = (reads.withColumn("_src", F.lit(True)).unionByName(enters.withColumn("_src", F.lit(False))))
    linked = last_before(both, ["run_id", "loc"], ["event_id", F.col("_src").cast("int")], F.col("_src"),
                         F.col("event_id"), "caller_event_id", chunk)
    return linked.filter(~F.col("_src")).select("run_id", F.col("event_id").alias("enter_id"),
                                                F.col("loc").alias("func_id"), "caller_event_id")


def function_refs(trace: DataFrame, chunk_bits: int = DEFAULT_CHUNK_BITS, global_only: bool = False) -> DataFrame:
    """What each function reads: every ``exec`` inside a call is attributed to its
    innermost open call (the latest enter whose level equals the statement's depth, an
    as-of scan keyed by (run, level)); one row per (run, function address, name, id).

    With ``global_only`` the function's own locations are left out: those passed to it as
    arguments and those that updates inside its calls write."""
    chunk = chunk_of("event_id", chunk_bits)
    t = with_call_depth(trace.filter(F.col("kind").isin("exec", "update", "enter", "exit"))
                             .select("run_id", "event_id", "kind", "uses", "defs", "call"), chunk_bits=chunk_bits)
    touched = F.when(F.col("kind") == "exec", F.col("uses")).otherwise(F.col("defs"))
    enters = t.filter(F.col("kind") == "enter").select(
        "run_id", "event_id", "kind", (F.col("depth") + 1).alias("level"), F.col("call.func_id").alias("func_id"),
        F.lit(None).cast(t.schema["uses"].dataType).alias("vars"), F.lit(True).alias("_src"))
    inner = t.filter(F.col("kind").isin("exec", "update") & (F.col("depth") > 0)).select(
        "run_id", "event_id", "kind", F.col("depth").alias("level"), F.lit(None).cast("bigint").alias("func_id"),
        touched.alias("vars"), F.lit(False).alias("_src"))
    owned = last_before(enters.unionByName(inner), ["run_id", "level"], ["event_id", F.col("_src").cast("int")],
                        F.col("_src"), F.col("func_id"), "owner", chunk)
    seen = (owned.filter(~F.col("_src") & F.col("owner").isNotNull())
                 .select("run_id", F.col("owner").alias("func_id"), "kind", F.explode("vars").alias("u"))
                 .select("run_id", "func_id", "kind", F.col("u.name").alias("name"), F.col("u.id").alias("id"))
                 .distinct())
    if not global_only:
        return seen.filter("kind = 'exec'").drop("kind")
    seen = cut(seen, "function_touches")
    args = trace.filter(F.col("kind") == "enter").select(
        "run_id", F.col("call.func_id").alias("func_id"), F.explode("call.args").alias("a")).select(
        "run_id", "func_id", F.col("a.id").alias("id"))
    own = seen.filter("kind = 'update'").select("run_id", "func_id", "id").unionByName(args).distinct()
    return seen.filter("kind = 'exec'").drop("kind").join(own, ["run_id", "func_id", "id"], "left_anti") \
        .select("run_id", "func_id", "name", "id")


def components(edges: DataFrame) -> DataFrame:
    """Strongly connected components of each run's graph of functions (run_id, src, dst):
    run_id, func_id, comp (its least function) and level (0: reaches no other component, else
    one more than the highest level it reaches). One group holds the functions of one run
    that name one another: bounded by the program, not by the trace."""
    def run(table: pa.Table) -> pa.Table:
        out: dict[int, list[int]] = {}
        for a, b in zip(table["src"].to_pylist(), table["dst"].to_pylist()):
            out.setdefault(a, []).append(b)
            out.setdefault(b, [])
        rows = [(table["run_id"][0].as_py(), f, min(group), level)
                for group, level in condensed(out) for f in group]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows)], names=["run_id", "func_id", "comp", "level"])

    ship_package(edges.sparkSession)
    return edges.select("run_id", "src", "dst").groupBy("run_id").applyInArrow(
        run, "run_id bigint, func_id bigint, comp bigint, level bigint")


def condensed(out: dict[int, list[int]]) -> list[tuple[list[int], int]]:
    """Components of a graph with their levels, those that are reached before those that
    reach them (a depth-first search with a stack of its own, however deep the calls)."""
    index, low, on, stack, found, level = {}, {}, set(), [], [], {}
    for root in out:
        work = [(root, iter(out[root]))] if root not in index else []
        while work:
            node, rest = work[-1]
            if node not in index:
                index[node] = low[node] = len(index)
                stack.append(node)
                on.add(node)
            ahead = next((n for n in rest if n not in index), None)
            if ahead is not None:
                work.append((ahead, iter(out[ahead])))
                continue
            work.pop()
            low[node] = min([low[node], *(low[n] for n in out[node] if n in on)])
            if low[node] == index[node]:
                group = []
                while not group or group[-1] != node:
                    group.append(stack.pop())
                on.difference_update(group)
                own = set(group)
                level |= dict.fromkeys(group, max((1 + level[n] for f in group for n in out[f] if n not in own), default=0))
                found.append((group, level[node]))
    return found


def closure_refs(refs: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the functions of a component and all functions that they reach read (run_id,
    comp, name, id), and the :func:`components`.

    Sets are merged along the condensed graph from its lowest level up: a component's set is
    its own and the finished sets of the components it names. There are as many rounds as
    the program's calls are deep, and no pair of functions is listed."""
    comp = cut(components(edges), "components")
    of = lambda f: comp.select("run_id", F.col("func_id").alias(f), F.col("comp").alias(f"{f}_comp"), "level")
    step = cut(edges.join(of("src"), ["run_id", "src"]).join(of("dst").drop("level"), ["run_id", "dst"])
               .where("src_comp <> dst_comp").select("run_id", F.col("src_comp").alias("comp"), "level",
                                                     F.col("dst_comp").alias("to")).distinct(), "component_steps")
    own = cut(refs.join(comp.select("run_id", "func_id", "comp", "level"), ["run_id", "func_id"])
              .select("run_id", "comp", "level", "name", "id").distinct(), "component_refs")
    done = own.where("level = 0").drop("level")
    for level in range(1, (step.agg(F.max("level")).first()[0] or 0) + 1):
        gained = (step.where(F.col("level") == level).select("run_id", "comp", "to")
                  .join(done.withColumnRenamed("comp", "to"), ["run_id", "to"]).select("run_id", "comp", "name", "id"))
        here = cut(gained.unionByName(own.where(F.col("level") == level).drop("level")).distinct(), "component_closed")
        done = done.unionByName(here)
    return done, comp


def indirect_uses(trace: DataFrame, fn_refs: DataFrame | None = None,
                  chunk_bits: int = DEFAULT_CHUNK_BITS, global_only: bool = False) -> DataFrame:
    """A statement that reads a function's address also reads what that function
    reads, and what the functions it names read (closure over the function graph, by its
    strongly connected components; recursion is one component). Returns the statement's
    direct and indirect reads, distinct."""
    refs = cut(fn_refs if fn_refs is not None else function_refs(trace, chunk_bits, global_only),
               "function_refs")
    fns = refs.select("run_id", "func_id").distinct()
    # every function names itself here, so that those without calls are components too
    fgraph = cut(refs.join(fns.select("run_id", F.col("func_id").alias("id")), ["run_id", "id"], "left_semi")
                 .select("run_id", F.col("func_id").alias("src"), F.col("id").alias("dst"))
                 .unionByName(fns.select("run_id", F.col("func_id").alias("src"), F.col("func_id").alias("dst")))
                 .distinct(), "function_graph")
    closed, comp = closure_refs(refs, fgraph)
    direct = (trace.filter(F.col("kind") == "exec")
                   .select("run_id", "event_id", F.explode("uses").alias("u"))
                   .select("run_id", "event_id", F.col("u.name").alias("name"), F.col("u.id").alias("id")))
    named = direct.join(comp.select("run_id", F.col("func_id").alias("id"), "comp"), ["run_id", "id"]) \
                  .select("run_id", "event_id", "comp").distinct()
    indirect = named.join(closed, ["run_id", "comp"]).select("run_id", "event_id", "name", "id")
    return direct.unionByName(indirect).distinct()
