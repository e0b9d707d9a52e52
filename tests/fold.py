"""Sequential folds written from the documented semantics; the oracles of the
property tests (one pass over a Python list, the way a single-process tool does it)."""

from __future__ import annotations

import re

SEG = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|\.[A-Za-z_][A-Za-z0-9_]*|\[(?:[^\[\]]|\[[^\[\]]*\])*\]")


def prefixes(path: str, exclude_full: bool = False) -> list[str]:
    segs = SEG.findall(path)
    out = ["".join(segs[:i]) for i in range(1, len(segs) + 1)]
    return out[:-1] if exclude_full else out


def base(path: str) -> str:
    m = re.match(r"[A-Za-z_][A-Za-z0-9_]*", path)
    return m.group(0) if m else ""


def refine(defs, strategy):
    if strategy == "include_all":
        return list(defs)
    if strategy == "ignore_base":
        bases = {base(n) for n, _ in defs if base(n) != n}
        return [(n, i) for n, i in defs if n not in bases]
    nested = {p for n, _ in defs for p in prefixes(n, exclude_full=True)}
    return [(n, i) for n, i in defs if n not in nested]


def fold_lineage(events, strategy="include_all", ignore_unknown=False):
    """events: dicts with kind, lineno, uses, defs ((name, id) lists), in event order."""
    counter, depth = 1, 0
    line_node, loc_line, edges, nodes = {}, {}, set(), []
    for e in events:
        k = e["kind"]
        if k == "exec":
            if depth > 0:
                continue
            node = counter
            counter += 1
            nodes.append(node)
            for name, lid in dict.fromkeys(e["uses"]):
                if lid in loc_line and loc_line[lid] in line_node:
                    edges.add((line_node[loc_line[lid]], node))
                elif not ignore_unknown:
                    edges.add((0, node))
            line_node[e["lineno"]] = node
        elif k == "update":
            if depth > 0:
                continue
            for _, lid in refine(list(dict.fromkeys(e["defs"])), strategy):
                loc_line[lid] = e["lineno"]
        elif k == "enter":
            depth += 1
        elif k == "exit":
            depth = max(0, depth - 1)
    return nodes, edges


def fold_depth(events):
    depth, out = 0, []
    for e in events:
        out.append(depth)
        if e["kind"] == "enter":
            depth += 1
        elif e["kind"] == "exit":
            depth = max(0, depth - 1)
    return out


def fold_bound_loops(events, n):
    counters, ignored, kept = {}, set(), []
    for e in events:
        k, name = e["kind"], e.get("loop_name")
        if k == "loop_init":
            counters[name] = 0
            if n is not None and counters[name] >= n:
                ignored.add(name)
        elif k == "loop_iter":
            counters[name] = counters.get(name, 0) + 1
            if n is not None and counters[name] >= n:
                ignored.add(name)
        elif k == "loop_clear":
            counters[name] = 0
            ignored.discard(name)
        elif not ignored:
            kept.append(e["event_id"])
    return kept
