"""Build trace DataFrames from small Python event lists."""

from __future__ import annotations

from linewise.sources.schema import TRACE


def var(name, lid, vtype=None, columns=None):
    return (name, lid, vtype, columns)


def trace_df(spark, rows):
    """rows: dicts with run_id, event_id, kind and optional lineno, line, uses, defs
    ((name, id) pairs), call (dict), loop_name, msg."""
    out = []
    for r in rows:
        call = r.get("call")
        if call is not None:
            call = (call.get("is_method"), call.get("co_name"), call.get("qualname"), call.get("module"),
                    [var(*a) for a in call.get("args", [])] or None, call.get("func_id"),
                    call.get("called_by_user", True), call.get("defined_by_user", True))
        out.append((r.get("run_id", 1), r["event_id"], r["kind"], r.get("lineno"), r.get("line"),
                    [var(n, i) for n, i in r["uses"]] if r.get("uses") is not None else None,
                    [var(n, i) for n, i in r["defs"]] if r.get("defs") is not None else None,
                    call, r.get("loop_name"), r.get("msg")))
    return spark.createDataFrame(out, TRACE)


def program(stmts, run_id=1):
    """stmts: list of (uses, defs); statement n executes at lineno n (exec at 2n, update at 2n+1)."""
    rows = []
    for n, (uses, defs) in enumerate(stmts, start=1):
        rows.append({"run_id": run_id, "event_id": 2 * n, "kind": "exec", "lineno": n, "uses": uses, "defs": []})
        if defs:
            rows.append({"run_id": run_id, "event_id": 2 * n + 1, "kind": "update", "lineno": n,
                         "uses": [], "defs": defs})
    return rows
