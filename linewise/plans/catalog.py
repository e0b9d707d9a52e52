"""The registered queries: one Spark plan per operator of the survey inventory, each with
its DuckDB oracle. Every query reads the driver tables (through the adapters), so its
work grows with them; no row caps, id subsets or prefixes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.functions import paths as P
from linewise.operators import events as A
from linewise.operators import lineage as L
from linewise.operators import reaching as E
from linewise.operators import scope as B
from linewise.operators import slicing as S
from linewise.operators.growing import GrowingGraph
from linewise.plans import oracle as O
from linewise.plans.materialize import cut, new_folder
from linewise.plans.scan import chunk_of, last_before
from linewise.sources import io as IO
from linewise.sources.adapters import (events_trace, lineitem_facts, lineitem_trace, order_names, orders_facts,
                                       stored_events_trace, stored_lineitem_facts)
from linewise.streaming import live as G

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _graph(spark, sf, refinement="include_all", ignore_unknown=False) -> L.Lineage:
    # the events adapter emits enter/exit rows (signup / error events)
    return L.build(stored_events_trace(spark, sf), refinement, ignore_unknown, has_calls=True)


# ---- C: lineage graph ------------------------------------------------------------------

@register("lineage_edges", O.lineage_sql("include_all"))
def lineage_edges(spark, sf):
    return _graph(spark, sf).edges


@register("lineage_edges_known", O.lineage_sql("include_all", known=True))
def lineage_edges_known(spark, sf):
    return _graph(spark, sf, ignore_unknown=True).edges


@register("lineage_ignore_base", O.lineage_sql("ignore_base"))
def lineage_ignore_base(spark, sf):
    return _graph(spark, sf, "ignore_base").edges


@register("lineage_most_specific", O.lineage_sql("most_specific"))
def lineage_most_specific(spark, sf):
    return _graph(spark, sf, "most_specific").edges


@register("lineage_parts", O.LINEITEM)
def lineage_parts(spark, sf):
    return L.build(lineitem_trace(spark, sf), has_calls=False).edges


@register("unknown_summary", f"""WITH {O.graph_ctes()},
firsts AS (SELECT run_id, name, MIN(event_id) AS fe, COUNT(*) AS n FROM hop2 WHERE w_lineno IS NULL GROUP BY ALL)
SELECT run_id, 'UNKNOWNS: ' || string_agg(name || ',', '' ORDER BY fe, name) AS src_label,
       CAST(SUM(n) AS BIGINT) AS n_unknown_reads
FROM firsts GROUP BY run_id""")
def unknown_summary(spark, sf):
    return L.unknown_summary(_graph(spark, sf))


@register("unknown_label", f"""WITH {O.graph_ctes()},
u AS (SELECT run_id, name, row_number() OVER (PARTITION BY run_id ORDER BY event_id, name, id) - 1 AS i
      FROM hop2 WHERE w_lineno IS NULL)
SELECT run_id, CAST(i // 4096 AS BIGINT) AS part, COUNT(*) AS n_reads, string_agg(name || ',', '' ORDER BY i) AS text
FROM u GROUP BY ALL""")
def unknown_label(spark, sf):
    """C6 with one entry per unknown read, in bounded parts."""
    return L.unknown_label(_graph(spark, sf))


@register("node_defs", f"""WITH {O.graph_ctes('most_specific')},
att AS (
  SELECT t.run_id, t.event_id, arg_max(n.node_id, n.event_id) AS node_id
  FROM top t JOIN nodes n ON n.run_id = t.run_id AND n.lineno = t.lineno AND n.event_id < t.event_id
  WHERE t.kind = 'update' GROUP BY ALL),
lastup AS (SELECT run_id, node_id, MAX(event_id) AS event_id FROM att GROUP BY ALL),
d AS (SELECT l.run_id, l.node_id, f.name, f.run_id AS r2, f.event_id AS e2
      FROM lastup l JOIN defs_flat f ON f.run_id = l.run_id AND f.event_id = l.event_id)
SELECT d.run_id, d.node_id,
       string_agg(CASE WHEN NOT EXISTS (SELECT 1 FROM defs_flat o WHERE o.run_id = d.r2 AND o.event_id = d.e2
                        AND (starts_with(o.name, d.name || '.') OR starts_with(o.name, d.name || '[')))
                       THEN d.name END, ',' ORDER BY d.name) AS defs,
       string_agg(d.name, ',' ORDER BY d.name) AS complete_defs
FROM d GROUP BY d.run_id, d.node_id""")
def node_defs(spark, sf):
    tr = stored_events_trace(spark, sf)
    return L.node_defs(L.build(tr, "most_specific"), tr, "most_specific")


@register("node_calls", f"""WITH {O.graph_ctes()}
SELECT t.run_id, arg_max(n.node_id, n.event_id) AS node_id, t.event_id AS call_event_id,
       concat('f', t.k % 7) AS qualname
FROM trace t JOIN nodes n ON n.run_id = t.run_id AND n.lineno = t.lineno AND n.event_id < t.event_id
WHERE t.kind = 'enter' GROUP BY t.run_id, t.event_id, t.k""")
def node_calls(spark, sf):
    tr = stored_events_trace(spark, sf)
    return L.node_calls(L.build(tr), tr)


@register("graph_stats", f"""WITH {O.graph_ctes()},
nn AS (SELECT run_id, COUNT(*) AS n FROM nodes GROUP BY run_id),
ne AS (SELECT run_id, COUNT(*) AS m, MAX(CASE WHEN src = 0 THEN 1 ELSE 0 END) AS z FROM edges_all GROUP BY run_id)
SELECT COALESCE(nn.run_id, ne.run_id) AS run_id,
       CAST(COALESCE(n, 0) + COALESCE(z, 0) AS BIGINT) AS n_nodes, CAST(COALESCE(m, 0) AS BIGINT) AS n_edges
FROM nn FULL JOIN ne ON nn.run_id = ne.run_id""")
def graph_stats(spark, sf):
    return L.graph_stats(_graph(spark, sf))


@register("node_degree", f"""WITH {O.graph_ctes()},
ends AS (SELECT run_id, src AS node_id, 0 AS i, 1 AS o FROM edges_all
         UNION ALL SELECT run_id, dst, 1, 0 FROM edges_all
         UNION ALL SELECT run_id, node_id, 0, 0 FROM nodes)
SELECT run_id, node_id, CAST(SUM(i) AS BIGINT) AS in_degree, CAST(SUM(o) AS BIGINT) AS out_degree
FROM ends GROUP BY run_id, node_id""")
def node_degree(spark, sf):
    return L.node_degree(_graph(spark, sf))


@register("edge_between_lines", f"""WITH {O.graph_ctes()}
SELECT e.run_id, s.lineno AS src_lineno, d.lineno AS dst_lineno, COUNT(*) AS n_edges
FROM edges_all e JOIN nodes s ON s.run_id = e.run_id AND s.node_id = e.src
                 JOIN nodes d ON d.run_id = e.run_id AND d.node_id = e.dst
GROUP BY ALL""")
def edge_between_lines(spark, sf):
    return L.edges_between_lines(_graph(spark, sf))


# ---- B: scope, calls, loops ------------------------------------------------------------

@register("call_depth_quarantine", f"""WITH {O.EV},
s AS (SELECT run_id, event_id, kind, SUM(CASE kind WHEN 'enter' THEN 1 WHEN 'exit' THEN -1 ELSE 0 END)
             OVER (PARTITION BY run_id ORDER BY event_id) AS after FROM trace),
ok AS (SELECT run_id FROM s GROUP BY run_id HAVING MIN(after) >= 0)
SELECT run_id, event_id, kind, CAST(after - CASE kind WHEN 'enter' THEN 1 WHEN 'exit' THEN -1 ELSE 0 END AS BIGINT) AS depth
FROM s WHERE run_id IN (SELECT run_id FROM ok)""")
def call_depth_quarantine(spark, sf):
    """B1: runs that leave more calls than they enter are left out."""
    return B.with_call_depth(events_trace(spark, sf).select("run_id", "event_id", "kind"), "quarantine")


@register("call_depth", f"WITH {O.EV}\nSELECT run_id, event_id, kind, depth FROM depth")
def call_depth(spark, sf):
    return B.with_call_depth(stored_events_trace(spark, sf)).select("run_id", "event_id", "kind", "depth")


@register("top_level", f"""WITH {O.EV}
SELECT run_id, event_id, kind, lineno FROM depth WHERE depth = 0 AND kind IN ('exec', 'update')""")
def top_level(spark, sf):
    return B.top_level(B.with_call_depth(stored_events_trace(spark, sf))).select("run_id", "event_id", "kind", "lineno")


SPANS = f"""WITH {O.EV},
lv AS (SELECT *, CASE WHEN kind = 'enter' THEN depth + 1 ELSE depth END AS level
       FROM depth WHERE kind IN ('enter', 'exit')),
nx AS (SELECT *, LEAD(event_id) OVER (PARTITION BY run_id, level ORDER BY event_id) AS next_id,
              LEAD(kind) OVER (PARTITION BY run_id, level ORDER BY event_id) AS next_kind
       FROM lv WHERE level > 0),
spans AS (SELECT run_id, event_id AS enter_id, CASE WHEN next_kind = 'exit' THEN next_id END AS exit_id,
                 CAST(level AS BIGINT) AS level, lineno, concat('f', k % 7) AS qualname, k % 2 = 0 AS defined_by_user
          FROM nx WHERE kind = 'enter')"""


@register("call_spans", SPANS + "\nSELECT run_id, enter_id, exit_id, level, lineno, qualname FROM spans")
def call_spans(spark, sf):
    return B.call_spans(stored_events_trace(spark, sf))


@register("by_origin", f"""WITH {O.EV}
SELECT run_id, event_id, kind FROM trace WHERE kind NOT IN ('enter', 'exit') OR k % 2 = 0""")
def by_origin(spark, sf):
    return B.by_origin(events_trace(spark, sf), defined=True).select("run_id", "event_id", "kind")


@register("collapse_external", SPANS + """
SELECT t.run_id, t.event_id, t.kind FROM trace t
WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE NOT s.defined_by_user AND s.run_id = t.run_id
                  AND t.event_id > s.enter_id AND (s.exit_id IS NULL OR t.event_id < s.exit_id))""")
def collapse_external(spark, sf):
    return B.collapse_external(stored_events_trace(spark, sf)).select("run_id", "event_id", "kind")


# Fixed parameter of the drop_named query: call names treated as instrumentation frames.
DROP_NAMES = ["f0", "f3"]


@register("drop_named", SPANS + """
SELECT t.run_id, t.event_id, t.kind FROM trace t
WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.qualname IN ('f0', 'f3') AND s.run_id = t.run_id
                  AND t.event_id >= s.enter_id AND (s.exit_id IS NULL OR t.event_id <= s.exit_id))""")
def drop_named(spark, sf):
    return B.drop_named(stored_events_trace(spark, sf), DROP_NAMES).select("run_id", "event_id", "kind")


LOOP_BOUND = 2


@register("bound_loops", f"""WITH {O.EV},
m AS (SELECT run_id, event_id, kind, loop_name,
             SUM(CASE WHEN kind IN ('loop_init', 'loop_clear') THEN 1 ELSE 0 END)
               OVER (PARTITION BY run_id, loop_name ORDER BY event_id) AS cseg,
             SUM(CASE WHEN kind = 'loop_clear' THEN 1 ELSE 0 END)
               OVER (PARTITION BY run_id, loop_name ORDER BY event_id) AS kseg
      FROM trace WHERE kind LIKE 'loop_%'),
m2 AS (SELECT *, SUM(CASE WHEN kind = 'loop_iter' THEN 1 ELSE 0 END)
                   OVER (PARTITION BY run_id, loop_name, cseg ORDER BY event_id) AS cnt FROM m),
m3 AS (SELECT *, MAX(CASE WHEN cnt >= {LOOP_BOUND} AND kind <> 'loop_clear' THEN 1 ELSE 0 END)
                   OVER (PARTITION BY run_id, loop_name, kseg ORDER BY event_id) AS off FROM m2),
m4 AS (SELECT run_id, event_id,
              off - COALESCE(LAG(off) OVER (PARTITION BY run_id, loop_name ORDER BY event_id), 0) AS delta FROM m3),
t AS (SELECT tr.run_id, tr.event_id, tr.kind,
             SUM(COALESCE(m4.delta, 0)) OVER (PARTITION BY tr.run_id ORDER BY tr.event_id) AS nf
      FROM trace tr LEFT JOIN m4 ON m4.run_id = tr.run_id AND m4.event_id = tr.event_id)
SELECT run_id, event_id, kind FROM t WHERE nf = 0 AND kind NOT LIKE 'loop_%'""")
def bound_loops(spark, sf):
    return B.bound_loops(stored_events_trace(spark, sf), LOOP_BOUND).select("run_id", "event_id", "kind")


@register("call_profile", f"""WITH {O.EV}
SELECT concat('f', k % 7) AS qualname, concat('m', k % 3) AS module, COUNT(*) AS n_calls,
       COUNT(DISTINCT run_id) AS n_runs, CAST(SUM(CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_user_defined
FROM trace WHERE kind = 'enter' GROUP BY ALL""")
def call_profile(spark, sf):
    return B.call_profile(events_trace(spark, sf))


@register("call_args", f"""WITH {O.EV}
SELECT run_id, event_id, concat('f', k % 7) AS qualname, CAST(0 AS BIGINT) AS pos, concat('v', k % 4) AS arg_name,
       CAST(k % 4 AS BIGINT) AS arg_id, CASE WHEN k % 4 = 0 THEN 'DataFrame' ELSE 'list' END AS arg_type
FROM trace WHERE kind = 'enter'
UNION ALL
SELECT run_id, event_id, concat('f', k % 7), CAST(1 AS BIGINT), concat('v', k % 4, '[', k % 3, ']'),
       CAST(100 + k % 12 AS BIGINT), 'list'
FROM trace WHERE kind = 'enter'""")
def call_args(spark, sf):
    return B.call_args(events_trace(spark, sf))


@register("link_calls", f"""WITH {O.EV}
SELECT t.run_id, t.event_id AS enter_id, CAST(t.k % 4 AS BIGINT) AS func_id,
       (SELECT MAX(u.event_id) FROM uses_flat u WHERE u.run_id = t.run_id AND u.id = t.k % 4
          AND u.event_id < t.event_id) AS caller_event_id
FROM trace t WHERE t.kind = 'enter'""")
def link_calls(spark, sf):
    return B.link_calls(stored_events_trace(spark, sf))


def _indirect_sql(own: str = "SELECT NULL AS run_id, NULL AS func_id, NULL AS id WHERE FALSE") -> str:
    return f"""WITH RECURSIVE {O.EV},
ex AS (SELECT * FROM depth WHERE kind IN ('exec', 'update') AND depth > 0),
owned AS (SELECT x.run_id, x.event_id, x.kind, arg_max(n.k % 4, n.event_id) AS fn
          FROM ex x JOIN depth n ON n.run_id = x.run_id AND n.kind = 'enter' AND n.depth + 1 = x.depth
                                 AND n.event_id < x.event_id
          GROUP BY x.run_id, x.event_id, x.kind),
own AS ({own}),
refs AS (SELECT DISTINCT o.run_id, o.fn AS func_id, u.name, u.id FROM owned o
         JOIN uses_flat u ON u.run_id = o.run_id AND u.event_id = o.event_id
         WHERE NOT EXISTS (SELECT 1 FROM own w WHERE w.run_id = o.run_id AND w.func_id = o.fn AND w.id = u.id)),
fns AS (SELECT DISTINCT run_id, func_id FROM refs),
fgraph AS (SELECT DISTINCT r.run_id, r.func_id AS src, r.id AS dst FROM refs r
           JOIN fns f ON f.run_id = r.run_id AND f.func_id = r.id),
reach(run_id, fn, g) AS (
  SELECT run_id, func_id, func_id FROM fns
  UNION
  SELECT c.run_id, c.fn, e.dst FROM reach c JOIN fgraph e ON e.run_id = c.run_id AND e.src = c.g),
direct AS (SELECT run_id, event_id, name, id FROM uses_flat),
ind AS (SELECT d.run_id, d.event_id, r.name, r.id FROM direct d
        JOIN reach c ON c.run_id = d.run_id AND c.fn = d.id
        JOIN refs r ON r.run_id = c.run_id AND r.func_id = c.g)
SELECT run_id, event_id, name, id FROM direct UNION SELECT run_id, event_id, name, id FROM ind"""


@register("indirect_uses", _indirect_sql())
def indirect_uses(spark, sf):
    return B.indirect_uses(stored_events_trace(spark, sf))


@register("indirect_global_uses", _indirect_sql(
    """SELECT run_id, k % 4 AS func_id, unnest([k % 4, 100 + k % 12]) AS id FROM trace WHERE kind = 'enter'
       UNION SELECT o.run_id, o.fn, d.id FROM owned o JOIN defs_flat d ON d.run_id = o.run_id AND d.event_id = o.event_id"""))
def indirect_global_uses(spark, sf):
    """B11 for global reads: arguments and locations a function writes are its own."""
    return B.indirect_uses(stored_events_trace(spark, sf), global_only=True)


# ---- A: event model --------------------------------------------------------------------

@register("accesses", f"""WITH {O.EV}
SELECT DISTINCT run_id, event_id, 'read' AS access, name, id FROM uses_flat
UNION ALL
SELECT DISTINCT run_id, event_id, 'write', name, id FROM defs_flat""")
def accesses(spark, sf):
    return A.accesses(events_trace(spark, sf))


@register("accesses_repeated", ORACLE["accesses"])
def accesses_repeated(spark, sf):
    """Values that a statement names twice are accessed once."""
    twice = events_trace(spark, sf).withColumns({c: F.concat(c, c) for c in ("uses", "defs")})
    return A.accesses(twice)


@register("column_usage", f"""WITH {O.EV},
c AS (SELECT run_id, name, concat('c', k % 3) AS column_name FROM uses_flat WHERE type = 'DataFrame' AND pos = 0
        AND k % 4 = 0
      UNION ALL
      SELECT run_id, name, concat('c', k % 3 + 1) FROM uses_flat WHERE type = 'DataFrame' AND pos = 0 AND k % 4 = 0)
SELECT name, column_name, COUNT(*) AS n_reads, COUNT(DISTINCT run_id) AS n_runs FROM c GROUP BY ALL""")
def column_usage(spark, sf):
    return A.column_usage(events_trace(spark, sf))


@register("event_text", f"""WITH {O.EV},
ud AS (SELECT run_id, event_id, concat('[', string_agg(concat(name, ': ', type, ' @ ', id), ', ' ORDER BY pos), ']') AS d
       FROM defs_flat GROUP BY ALL)
SELECT t.run_id, t.event_id, t.kind,
       CASE t.kind WHEN 'exec' THEN concat('exec line: ', t.line, ' (line=', t.lineno, ')')
                   WHEN 'update' THEN concat('mem-update(', ud.d, ')')
                   WHEN 'enter' THEN concat('enter call: ', t.line, ' (line=', t.lineno, ')')
                   WHEN 'exit' THEN concat('exit call: ', t.line, ' (line=', t.lineno, ')')
                   WHEN 'exception' THEN 'abnormal exit (exception)'
                   ELSE concat(t.kind, '(', COALESCE(t.loop_name, ''), ')') END AS text
FROM trace t LEFT JOIN ud ON ud.run_id = t.run_id AND ud.event_id = t.event_id""")
def event_text(spark, sf):
    return A.render(events_trace(spark, sf))


@register("run_status", f"""WITH {O.EV}
SELECT run_id, COUNT(*) AS n_events, MAX(CASE WHEN kind = 'exception' THEN 1 ELSE 0 END) = 1 AS abnormal,
       CAST(SUM(CASE WHEN kind = 'exception' THEN 1 ELSE 0 END) AS BIGINT) AS n_exceptions,
       arg_max(msg, CASE WHEN kind = 'exception' THEN event_id END) AS last_msg
FROM trace GROUP BY run_id""")
def run_status(spark, sf):
    return A.run_status(events_trace(spark, sf))


@register("event_numbers", f"""WITH {O.EV}
SELECT run_id, event_id, CAST(ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY event_id) AS BIGINT) AS seq FROM trace""")
def event_numbers(spark, sf):
    return A.number_events(events_trace(spark, sf).select("run_id", "event_id"))


# ---- D: path functions -----------------------------------------------------------------

NAMES = f"""WITH {O.EV},
names AS (SELECT DISTINCT name FROM uses_flat UNION SELECT DISTINCT name FROM defs_flat),
segs AS (SELECT name, regexp_extract_all(name, '[A-Za-z_][A-Za-z0-9_]*|\\.[A-Za-z_][A-Za-z0-9_]*|\\[[^\\]]*\\]') AS s
         FROM names)"""


def _names(spark, sf) -> DataFrame:
    tr = stored_events_trace(spark, sf)
    return A.accesses(tr).select("name").distinct()


@register("path_prefixes", NAMES + """
SELECT name,
       array_to_string(list_transform(range(1, len(s) + 1), lambda i: array_to_string(s[1:i], '')), '|') AS prefixes,
       array_to_string(list_transform(range(1, len(s)), lambda i: array_to_string(s[1:i], '')), '|') AS proper_prefixes
FROM segs""")
def path_prefixes(spark, sf):
    return _names(spark, sf).select(
        "name", F.array_join(P.path_prefixes("name"), "|").alias("prefixes"),
        F.array_join(P.path_prefixes("name", exclude_full=True), "|").alias("proper_prefixes"))


@register("path_base", NAMES + "\nSELECT name, regexp_extract(name, '^[A-Za-z_][A-Za-z0-9_]*') AS base FROM names")
def path_base(spark, sf):
    return _names(spark, sf).select("name", P.path_base("name").alias("base"))


@register("path_depth", NAMES + """
SELECT name, CAST(len(s) AS INTEGER) AS depth,
       CASE WHEN len(s) > 1 THEN array_to_string(s[1:len(s) - 1], '') END AS parent
FROM segs""")
def path_depth(spark, sf):
    return _names(spark, sf).select("name", P.path_depth("name").alias("depth"), P.path_parent("name").alias("parent"))


@register("order_paths", f"""WITH {O.ORDER_NAMES}
SELECT array_to_string(s, '') AS name, s[1] AS base, len(s)::INTEGER AS depth,
       array_to_string(list_transform(range(1, len(s) + 1), lambda i: array_to_string(s[1:i], '')), '|') AS prefixes,
       CASE WHEN len(s) > 1 THEN array_to_string(s[1:len(s) - 1], '') END AS parent FROM seg""")
def order_paths(spark, sf):
    """D1-D4 on references with nested and quoted brackets, calls and other alphabets, as many
    as there are orders."""
    names = order_names(spark, sf).select("name", P.path_segments("name").alias("segs"))
    return names.select(
        "name", P.path_base("name", "segs").alias("base"), P.path_depth("name", "segs").alias("depth"),
        F.array_join(P.path_prefixes("name", segments="segs"), "|").alias("prefixes"),
        P.path_parent("name", "segs").alias("parent"))


# statements of the events adapter seen as assignments: a purchase writes n2 from base
STMTS = f"""WITH {O.EV},
st AS (SELECT run_id, event_id, k,
              concat('v', k % 4, '[', k % 3, '].f', (k // 12) % 2) AS target,
              concat('v', (k + 1) % 4) AS rhs, k % 5 = 0 AS aug
       FROM trace WHERE kind = 'exec' AND event_type = 'purchase')"""


def _executed(spark, sf) -> DataFrame:
    """Exec events with the most specific path that the update after them writes (NULL: no
    update). An update belongs to the latest exec of its run and line before it; ids may
    have gaps."""
    tr = stored_events_trace(spark, sf)
    rows = tr.filter(F.col("kind").isin("exec", "update")).select(
        "run_id", "event_id", "kind", "lineno", "uses", F.try_element_at("defs", F.lit(-1))["name"].alias("target"))
    owned_by = last_before(rows, ["run_id", "lineno"], ["event_id"], F.col("kind") == "exec", F.col("event_id"),
                           "of", chunk_of("event_id"))
    up = owned_by.filter((F.col("kind") == "update") & F.col("of").isNotNull()).groupBy(
        "run_id", F.col("of").alias("event_id")).agg(F.max_by("target", F.col("event_id")).alias("target"))
    return rows.filter("kind = 'exec'").drop("target", "kind").join(up, ["run_id", "event_id"], "left")


def _statements(spark, sf) -> DataFrame:
    """Assignments of the events trace: a statement that is followed by an update reads its
    uses and writes the most specific path (the last def)."""
    return _executed(spark, sf).filter("target IS NOT NULL").select(
        "run_id", "event_id", F.array("target").alias("targets"),
        F.transform("uses", lambda u: u["name"]).alias("rhs_refs"), (F.col("lineno") % 5 == 0).alias("is_augmented"))


@register("statement_reads", STMTS + """,
r AS (SELECT run_id, event_id, concat('v', (k + 1) % 4) AS x FROM st
      UNION SELECT run_id, event_id, concat('v', k % 4) FROM st
      UNION SELECT run_id, event_id, concat('v', k % 4, '[', k % 3, ']') FROM st
      UNION SELECT run_id, event_id, target FROM st WHERE aug)
SELECT run_id, event_id, string_agg(x, ',' ORDER BY x) AS reads FROM r GROUP BY ALL""")
def statement_reads(spark, sf):
    s = _statements(spark, sf)
    return s.select("run_id", "event_id",
                    F.array_join(F.sort_array(P.statement_reads("targets", "rhs_refs", "is_augmented")), ",").alias("reads"))


@register("statement_writes", STMTS + """,
w AS (SELECT run_id, event_id, concat('v', k % 4) AS x FROM st
      UNION SELECT run_id, event_id, concat('v', k % 4, '[', k % 3, ']') FROM st
      UNION SELECT run_id, event_id, target FROM st)
SELECT run_id, event_id, string_agg(x, ',' ORDER BY x) AS writes FROM w GROUP BY ALL""")
def statement_writes(spark, sf):
    s = _statements(spark, sf)
    return s.select("run_id", "event_id", F.array_join(P.statement_writes("targets"), ",").alias("writes"))


# ---- E: reaching writers ---------------------------------------------------------------

def _reaching_sql(extra: str = "FALSE") -> str:
    return f"""WITH {O.FACTS},
w AS (SELECT * FROM facts WHERE is_write OR {extra})
SELECT DISTINCT r.unit_id, arg_max(w.stmt_id, w.seq) AS src, r.stmt_id AS dst, r.key
FROM facts r JOIN w ON w.unit_id = r.unit_id AND w.scope_id = r.scope_id AND w.key = r.key AND w.seq < r.seq
WHERE r.is_read GROUP BY r.unit_id, r.stmt_id, r.key"""


@register("reaching_writers", _reaching_sql())
def reaching_writers(spark, sf):
    return E.reaching_edges(orders_facts(spark, sf))


@register("reaching_mutating", _reaching_sql("is_call"))
def reaching_mutating(spark, sf):
    """A bare call counts as writing what it names."""
    return E.reaching_edges(orders_facts(spark, sf), mutating_calls=True)


@register("undefined_reads", f"""WITH {O.FACTS}
SELECT r.unit_id, r.scope_id, r.key, MIN(r.seq) AS source_seq, COUNT(*) AS n_reads
FROM facts r WHERE r.is_read AND NOT EXISTS (
  SELECT 1 FROM facts w WHERE w.unit_id = r.unit_id AND w.scope_id = r.scope_id AND w.key = r.key
    AND w.is_write AND w.seq < r.seq)
GROUP BY ALL""")
def undefined_reads(spark, sf):
    return E.undefined_reads(orders_facts(spark, sf))


@register("reaching_branches", f"""WITH {O.FACTS},
w AS (SELECT * FROM facts WHERE is_write),
r AS (SELECT * FROM facts WHERE is_read),
blk AS (SELECT unit_id, scope_id, ctl_id, MAX(seq) + 0.5 AS end_seq FROM facts WHERE ctl_id IS NOT NULL GROUP BY ALL),
pseudo AS (SELECT w.unit_id, w.scope_id, w.ctl_id, w.key, b.end_seq FROM w
           JOIN blk b ON b.unit_id = w.unit_id AND b.scope_id = w.scope_id AND b.ctl_id = w.ctl_id
           WHERE w.ctl_id IS NOT NULL AND NOT w.in_loop GROUP BY ALL HAVING COUNT(DISTINCT w.arm) = 2)
SELECT DISTINCT r.unit_id, w.stmt_id AS src, r.stmt_id AS dst, r.key
FROM r JOIN w ON w.unit_id = r.unit_id AND w.scope_id = r.scope_id AND w.key = r.key AND w.seq < r.seq
WHERE NOT (w.ctl_id IS NOT NULL AND r.ctl_id IS NOT NULL AND w.ctl_id = r.ctl_id AND w.arm <> r.arm)
  AND NOT EXISTS (
    SELECT 1 FROM w k WHERE k.unit_id = r.unit_id AND k.scope_id = r.scope_id AND k.key = r.key
      AND k.seq > w.seq AND k.seq < r.seq
      AND (k.ctl_id IS NULL OR (k.ctl_id = r.ctl_id AND k.arm = r.arm) OR (k.ctl_id = w.ctl_id AND k.arm = w.arm)))
  AND NOT EXISTS (
    SELECT 1 FROM pseudo p WHERE p.unit_id = r.unit_id AND p.scope_id = r.scope_id AND p.key = r.key
      AND p.end_seq > w.seq AND p.end_seq < r.seq AND (w.ctl_id IS NULL OR w.ctl_id <> p.ctl_id))""")
def reaching_branches(spark, sf):
    return E.reaching_branches(orders_facts(spark, sf))


@register("reaching_nested", O.nested_sql())
def reaching_nested(spark, sf):
    """E4/E5/E14 with blocks three deep, with items (E15) and imports with and without alias."""
    return E.reaching_branches(lineitem_facts(spark, sf))


@register("nested_accesses", f"""WITH {O.NESTED}
SELECT unit_id, seq AS stmt_id, key, false AS is_write FROM reads UNION ALL SELECT unit_id, seq, key, true FROM writes""")
def nested_accesses(spark, sf):
    """What imports without alias, with items and reads of two keys touch."""
    return E.accesses(stored_lineitem_facts(spark, sf)).select("unit_id", "stmt_id", "key", F.col("_w").alias("is_write"))


@register("control_edges", f"""WITH {O.FACTS}
SELECT unit_id, ctl_id, arm, stmt_id FROM facts WHERE ctl_id IS NOT NULL""")
def control_edges(spark, sf):
    return E.control_edges(orders_facts(spark, sf))


@register("loop_edges", f"""WITH {O.FACTS}
SELECT t.unit_id, t.stmt_id AS ctl_id, arg_max(b.stmt_id, b.seq) AS src, t.key
FROM facts t JOIN facts b ON b.unit_id = t.unit_id AND b.scope_id = t.scope_id AND b.ctl_id = t.stmt_id AND b.key = t.key
WHERE t.is_test AND t.in_loop AND b.is_write GROUP BY t.unit_id, t.stmt_id, t.key""")
def loop_edges(spark, sf):
    return E.loop_edges(orders_facts(spark, sf))


PATH_FACTS = f"""WITH {O.EV},
pf AS (SELECT run_id AS unit_id, event_id AS seq, name AS path FROM uses_flat),
pw AS (SELECT run_id AS unit_id, event_id AS seq, concat('v', k % 4) AS key FROM trace WHERE kind = 'exec' AND event_type = 'purchase'
       UNION SELECT run_id, event_id, concat('v', k % 4, '[', k % 3, ']') FROM trace WHERE kind = 'exec' AND event_type = 'purchase'
       UNION SELECT run_id, event_id, concat('v', k % 4, '[', k % 3, '].f', (k // 12) % 2) FROM trace
             WHERE kind = 'exec' AND event_type = 'purchase'),
pr AS (SELECT unit_id, seq, path,
              regexp_extract_all(path, '[A-Za-z_][A-Za-z0-9_]*|\\.[A-Za-z_][A-Za-z0-9_]*|\\[[^\\]]*\\]') AS s FROM pf),
pi AS (SELECT unit_id, seq, path, s, unnest(range(1, len(s) + 1)) AS i FROM pr),
pp AS (SELECT unit_id, seq, path, array_to_string(s[1:i], '') AS key, CAST(len(s) - i AS INTEGER) AS depth FROM pi),
hit AS (SELECT pp.unit_id, pp.seq, pp.path, pp.key, pp.depth, arg_max(pw.seq, pw.seq) AS src
        FROM pp JOIN pw ON pw.unit_id = pp.unit_id AND pw.key = pp.key AND pw.seq < pp.seq GROUP BY ALL)"""


def _path_facts(spark, sf) -> DataFrame:
    """Statement facts over the events trace: each exec reads its variables' paths, a
    purchase statement stores the most specific path it updates."""
    return _executed(spark, sf).select(
        F.col("run_id").alias("unit_id"), F.lit(0).cast("bigint").alias("scope_id"),
        F.col("event_id").alias("seq"), F.col("event_id").alias("stmt_id"),
        F.when(F.col("target").isNotNull(), "assign").otherwise("expr").alias("kind"),
        F.transform("uses", lambda u: u["name"]).alias("loads"),
        F.when(F.col("target").isNotNull(), F.array("target")).otherwise(F.array().cast("array<string>")).alias("stores"))


@register("reaching_specific", PATH_FACTS + """
SELECT unit_id, arg_min(src, depth) AS src, seq AS dst, path, arg_min(key, depth) AS via
FROM hit GROUP BY unit_id, seq, path""")
def reaching_specific(spark, sf):
    return E.reaching_specific(_path_facts(spark, sf), over_approximate=True)


# ---- F: slicing ------------------------------------------------------------------------

SLICE_SEEDS = "SELECT run_id, MAX(dst) AS seed FROM edges_known GROUP BY run_id"


def _known_graph(spark, sf):
    g = _graph(spark, sf, ignore_unknown=True)
    return g, cut(g.edges, "known_edges")  # seeds, order test and steps read it again


@register("backward_slice", f"""WITH RECURSIVE {O.graph_ctes()},
seeds AS ({SLICE_SEEDS}),
sl(run_id, seed, node_id) AS (
  SELECT run_id, seed, seed FROM seeds
  UNION
  SELECT s.run_id, s.seed, e.src FROM sl s JOIN edges_known e ON e.run_id = s.run_id AND e.dst = s.node_id)
SELECT run_id, seed, node_id FROM sl""")
def backward_slice(spark, sf):
    g, e = _known_graph(spark, sf)
    seeds = e.groupBy("run_id").agg(F.max("dst").alias("seed"))
    return S.slices(e, seeds, "backward")


@register("forward_slice", f"""WITH RECURSIVE {O.graph_ctes()},
seeds AS (SELECT run_id, MIN(src) AS seed FROM edges_known GROUP BY run_id),
sl(run_id, seed, node_id) AS (
  SELECT run_id, seed, seed FROM seeds
  UNION
  SELECT s.run_id, s.seed, e.dst FROM sl s JOIN edges_known e ON e.run_id = s.run_id AND e.src = s.node_id)
SELECT run_id, seed, node_id FROM sl""")
def forward_slice(spark, sf):
    g, e = _known_graph(spark, sf)
    seeds = e.groupBy("run_id").agg(F.min("src").alias("seed"))
    return S.slices(e, seeds, "forward")


@register("induced_subgraph", f"""WITH RECURSIVE {O.graph_ctes()},
seeds AS ({SLICE_SEEDS}),
sl(run_id, seed, node_id) AS (
  SELECT run_id, seed, seed FROM seeds
  UNION
  SELECT s.run_id, s.seed, e.src FROM sl s JOIN edges_known e ON e.run_id = s.run_id AND e.dst = s.node_id)
SELECT a.run_id, a.seed, e.src, e.dst FROM edges_known e
JOIN sl a ON a.run_id = e.run_id AND a.node_id = e.src
JOIN sl b ON b.run_id = e.run_id AND b.seed = a.seed AND b.node_id = e.dst""")
def induced_subgraph(spark, sf):
    g, e = _known_graph(spark, sf)
    seeds = e.groupBy("run_id").agg(F.max("dst").alias("seed"))
    return S.induced(e, S.slices(e, seeds, "backward"))


# Fixed parameter of the text-seeded slice: a statement text, normalised before matching.
SLICE_TEXT = " purchase (3) "


@register("slices_by_text", f"""WITH RECURSIVE {O.graph_ctes()},
seeds AS (SELECT run_id, node_id AS seed FROM nodes WHERE replace(line, ' ', '') = 'purchase(3)'),
sl(run_id, seed, node_id) AS (
  SELECT run_id, seed, seed FROM seeds
  UNION
  SELECT s.run_id, s.seed, e.src FROM sl s JOIN edges_known e ON e.run_id = s.run_id AND e.dst = s.node_id)
SELECT run_id, seed, node_id FROM sl""")
def slices_by_text(spark, sf):
    g, e = _known_graph(spark, sf)
    return S.slices_by_text(g.nodes, e, SLICE_TEXT, "backward")


IMPACT_K = 20


@register("impact", f"""WITH RECURSIVE {O.graph_ctes()},
seeds AS (SELECT run_id, node_id AS seed FROM nodes WHERE replace(line, ' ', '') = 'purchase(3)'),
sl(run_id, seed, node_id) AS (
  SELECT run_id, seed, seed FROM seeds
  UNION
  SELECT s.run_id, s.seed, e.dst FROM sl s JOIN edges_known e ON e.run_id = s.run_id AND e.src = s.node_id)
SELECT run_id, seed, CAST(COUNT(*) - 1 AS BIGINT) AS impact FROM sl GROUP BY run_id, seed
ORDER BY impact DESC, run_id, seed LIMIT {IMPACT_K}""")
def impact(spark, sf):
    g, e = _known_graph(spark, sf)
    return S.top_impact(e, S.seeds_by_text(g.nodes, SLICE_TEXT), IMPACT_K)


# ---- G: streaming ----------------------------------------------------------------------

@register("live_lineage", O.lineage_sql("include_all"))
def live_lineage(spark, sf):
    return G.run_lineage(spark, stored_events_trace(spark, sf, with_time=True))


@register("live_lineage_ordered", O.lineage_sql("include_all"))
def live_lineage_ordered(spark, sf):
    return G.run_lineage(spark, stored_events_trace(spark, sf, with_time=True), ordered=True, delay="1 hour")


@register("live_lineage_parts", O.LINEITEM)
def live_lineage_parts(spark, sf):
    """G1 on the trace of few giant runs."""
    return G.run_lineage(spark, lineitem_trace(spark, sf))


@register("live_run_status", f"""WITH {O.EV}
SELECT run_id, event_id, msg FROM trace WHERE kind = 'exception'""")
def live_run_status(spark, sf):
    return G.run_status(spark, stored_events_trace(spark, sf, with_time=True))


@register("growing_lineage", O.lineage_sql("include_all"))
def growing_lineage(spark, sf):
    """A2 and C1-C5 on a growing trace: the events in three appended parts, by event id."""
    trace = stored_events_trace(spark, sf)
    thirds = trace.selectExpr("percentile_approx(event_id, array(0.33, 0.67)) AS q").first().q
    graph = GrowingGraph(spark, new_folder(spark, "growing"))
    for part in ((F.col("event_id") <= thirds[0]), F.col("event_id").between(thirds[0] + 1, thirds[1]),
                 F.col("event_id") > thirds[1]):
        graph.append(trace.where(part))
    return graph.edges


# ---- operators over stored traces and graphs -------------------------------------------

@register("lineage_stored_trace", O.lineage_sql("include_all"))
def lineage_stored_trace(spark, sf):
    """A1/A2: a trace and a graph written and read again give the same edges."""
    folder = new_folder(spark, "stored")
    IO.write_trace(events_trace(spark, sf), f"{folder}/trace")
    g = L.build(IO.read_trace(spark, f"{folder}/trace"), has_calls=True)
    IO.write_graph(g.nodes, g.edges, f"{folder}/graph")
    return IO.read_graph(spark, f"{folder}/graph")[1]


@register("call_events", f"""WITH {O.EV}
SELECT run_id, event_id, concat('f', k % 7) AS co_name, concat('f', k % 7) AS qualname, concat('m', k % 3) AS module,
       k % 5 = 0 AS is_method, CAST(k % 4 AS BIGINT) AS func_id, k % 2 = 0 AS defined_by_user
FROM trace WHERE kind = 'enter'""")
def call_events(spark, sf):
    """A3/A4: the enter events with their call details as columns."""
    return A.event_fields(A.of_kind(events_trace(spark, sf), "enter")).select(
        "run_id", "event_id", "co_name", "qualname", "module", "is_method", "func_id", "defined_by_user")


@register("node_uses", f"""WITH {O.graph_ctes()}
SELECT DISTINCT n.run_id, n.node_id, u.name, u.id FROM nodes n
JOIN uses_flat u ON u.run_id = n.run_id AND u.event_id = n.event_id""")
def node_uses(spark, sf):
    """C11: what each node reads."""
    nodes = _graph(spark, sf).nodes
    return nodes.select("run_id", "node_id", F.explode("uses").alias("u")).select(
        "run_id", "node_id", F.col("u.name").alias("name"), F.col("u.id").alias("id")).distinct()


@register("node_def_vars", f"""WITH {O.graph_ctes('most_specific')},
att AS (
  SELECT t.run_id, t.event_id, arg_max(n.node_id, n.event_id) AS node_id
  FROM top t JOIN nodes n ON n.run_id = t.run_id AND n.lineno = t.lineno AND n.event_id < t.event_id
  WHERE t.kind = 'update' GROUP BY ALL),
lastup AS (SELECT run_id, node_id, MAX(event_id) AS event_id FROM att GROUP BY ALL)
SELECT l.run_id, l.node_id, f.name, f.id,
       NOT EXISTS (SELECT 1 FROM defs_flat o WHERE o.run_id = f.run_id AND o.event_id = f.event_id
                   AND (starts_with(o.name, f.name || '.') OR starts_with(o.name, f.name || '['))) AS refined
FROM lastup l JOIN defs_flat f ON f.run_id = l.run_id AND f.event_id = l.event_id""")
def node_def_vars(spark, sf):
    """C10 with addresses."""
    tr = stored_events_trace(spark, sf)
    return L.node_def_vars(L.build(tr, "most_specific"), "most_specific")


@register("column_reads", f"""WITH {O.EV}
SELECT DISTINCT run_id, event_id, CAST(k % 10 AS BIGINT) AS lineno, 'v0' AS name,
       concat('c', unnest([k_col % 3, k_col % 3 + 1])) AS column_name
FROM (SELECT run_id, event_id, k, k AS k_col, event_type FROM trace WHERE kind = 'exec'
        AND ((event_type IN ('click', 'view') AND k % 4 = 0)))""")
def column_reads(spark, sf):
    """A10 per statement: the columns of tabular values that each statement reads."""
    return A.column_reads(events_trace(spark, sf))


@register("prefix_reads", f"""WITH {O.EV}
SELECT a.run_id, a.event_id, a.name AS prefix, b.name FROM uses_flat a
JOIN uses_flat b ON b.run_id = a.run_id AND b.event_id = a.event_id
WHERE a.name = b.name OR starts_with(b.name, a.name || '.') OR starts_with(b.name, a.name || '[')""")
def prefix_reads(spark, sf):
    """Pairs of references of one statement of which one is a prefix of the other."""
    names = A.of_kind(events_trace(spark, sf), "exec").select(
        "run_id", "event_id", F.transform("uses", lambda u: u["name"]).alias("names"))
    return (names.select("run_id", "event_id", "names", F.explode("names").alias("prefix"))
            .select("run_id", "event_id", "prefix", F.explode("names").alias("name"))
            .filter(P.is_prefix_of("prefix", "name")))


@register("statement_accesses", f"""WITH {O.FACTS}
SELECT unit_id, scope_id, stmt_id, key, is_read AS reads, is_write AS writes FROM facts""")
def statement_accesses(spark, sf):
    """What assignments, augmented ones, imports, calls and tests read and write."""
    f = orders_facts(spark, sf)
    return f.select("unit_id", "scope_id", "stmt_id", F.explode(F.array_union("loads", "stores")).alias("key"),
                    "loads", "stores").select(
        "unit_id", "scope_id", "stmt_id", "key", F.array_contains("loads", F.col("key")).alias("reads"),
        F.array_contains("stores", F.col("key")).alias("writes"))


@register("reverse_slice", f"""WITH RECURSIVE {O.graph_ctes()},
sl(run_id, seed, node_id) AS (
  SELECT run_id, node_id, node_id FROM nodes WHERE lineno = 7
  UNION
  SELECT s.run_id, s.seed, e.dst FROM sl s JOIN edges_known e ON e.run_id = s.run_id AND e.src = s.node_id)
SELECT run_id, seed, node_id FROM sl""")
def reverse_slice(spark, sf):
    """nodes chosen by a predicate; a backward slice of the reverse graph."""
    g, e = _known_graph(spark, sf)
    seeds = S.node_ids(g.nodes, F.col("lineno") == 7).select("run_id", F.col("node_id").alias("seed"))
    return S.slices(S.reverse(e), seeds, "backward")
