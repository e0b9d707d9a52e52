"""Oracle SQL (DuckDB dialect) for every catalog query.

Written independently of the Spark side and, where possible, with a different
formulation: as-of lookups are ``arg_max`` over a ``<`` join, slices are
``WITH RECURSIVE ... UNION``, refinement uses string predicates instead of prefix
arrays, and the adapters are flat ``UNION ALL`` tables instead of nested structs.
Every computed column is aliased to the Spark name; counters are BIGINT.
"""

from __future__ import annotations

# ---- events -> trace adapter ------------------------------------------------------

EV = """
ev AS (
  SELECT user_id AS run_id, event_id, event_type,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
tr0 AS (
  SELECT run_id, 2 * event_id AS event_id, event_type, k,
         CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'exec'
              WHEN event_type = 'signup' AND k < 25 THEN 'enter'
              WHEN event_type = 'error' AND k < 75 THEN 'exit'
              WHEN event_type = 'error' AND k < 90 THEN 'exception' END AS kind
  FROM ev
  UNION ALL
  SELECT run_id, 2 * event_id + 1, event_type, k,
         CASE WHEN event_type = 'purchase' THEN 'update'
              WHEN event_type = 'signup' AND k >= 75 THEN 'loop_init'
              WHEN event_type = 'view' AND k % 4 = 0 THEN 'loop_iter'
              WHEN event_type = 'error' AND k >= 90 THEN 'loop_clear' END
  FROM ev),
trace AS (
  SELECT run_id, CAST(event_id AS BIGINT) AS event_id, event_type, k, kind,
         CAST(CASE WHEN kind <> 'exception' THEN k % 10 END AS BIGINT) AS lineno,
         CASE WHEN kind IN ('exec', 'enter', 'exit') THEN concat(event_type, '(', k % 10, ')') END AS line,
         CASE WHEN kind LIKE 'loop_%' THEN concat('loop', k % 2) END AS loop_name,
         CASE WHEN kind = 'exception' THEN concat('error k=', k) END AS msg
  FROM tr0 WHERE kind IS NOT NULL),
uses_flat AS (
  SELECT run_id, event_id, 0 AS pos, concat('v', k % 4) AS name, CAST(k % 4 AS BIGINT) AS id,
         CASE WHEN k % 4 = 0 THEN 'DataFrame' ELSE 'list' END AS type, k
  FROM trace WHERE kind = 'exec' AND event_type IN ('click', 'view')
  UNION ALL
  SELECT run_id, event_id, 1, concat('v', k % 4, '[', k % 3, ']'), CAST(100 + k % 12 AS BIGINT), 'list', k
  FROM trace WHERE kind = 'exec' AND event_type IN ('click', 'view')
  UNION ALL
  SELECT run_id, event_id, 2, concat('v', k % 4, '[', k % 3, '].f', (k // 12) % 2),
         CAST(200 + (k % 12) * 2 + (k // 12) % 2 AS BIGINT), 'int', k
  FROM trace WHERE kind = 'exec' AND event_type = 'click'
  UNION ALL
  SELECT run_id, event_id, 0, concat('v', (k + 1) % 4), CAST((k + 1) % 4 AS BIGINT),
         CASE WHEN (k + 1) % 4 = 0 THEN 'DataFrame' ELSE 'list' END, k
  FROM trace WHERE kind = 'exec' AND event_type = 'purchase'),
defs_flat AS (
  SELECT run_id, event_id, lineno, 0 AS pos, concat('v', k % 4) AS name, CAST(k % 4 AS BIGINT) AS id,
         CASE WHEN k % 4 = 0 THEN 'DataFrame' ELSE 'list' END AS type
  FROM trace WHERE kind = 'update'
  UNION ALL
  SELECT run_id, event_id, lineno, 1, concat('v', k % 4, '[', k % 3, ']'), CAST(100 + k % 12 AS BIGINT), 'list'
  FROM trace WHERE kind = 'update'
  UNION ALL
  SELECT run_id, event_id, lineno, 2, concat('v', k % 4, '[', k % 3, '].f', (k // 12) % 2),
         CAST(200 + (k % 12) * 2 + (k // 12) % 2 AS BIGINT), 'int'
  FROM trace WHERE kind = 'update'),
dl AS (
  SELECT *, CASE kind WHEN 'enter' THEN 1 WHEN 'exit' THEN -1 ELSE 0 END AS delta FROM trace),
de AS (
  SELECT *, COALESCE(SUM(delta) OVER (PARTITION BY run_id ORDER BY event_id
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e
  FROM dl),
depth AS (
  SELECT *, CAST(e - LEAST(0, MIN(e) OVER (PARTITION BY run_id ORDER BY event_id
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS BIGINT) AS depth
  FROM de)"""

REFINE = {
    "include_all": "TRUE",
    "ignore_base": """NOT EXISTS (
        SELECT 1 FROM defs_flat o WHERE o.run_id = d.run_id AND o.event_id = d.event_id
          AND o.name <> regexp_extract(o.name, '^[A-Za-z_][A-Za-z0-9_]*')
          AND regexp_extract(o.name, '^[A-Za-z_][A-Za-z0-9_]*') = d.name)""",
    "most_specific": """NOT EXISTS (
        SELECT 1 FROM defs_flat o WHERE o.run_id = d.run_id AND o.event_id = d.event_id
          AND (starts_with(o.name, d.name || '.') OR starts_with(o.name, d.name || '[')))""",
}


def graph_ctes(refinement: str = "include_all") -> str:
    """Nodes, reads and the two-hop resolution over the events trace."""
    return EV + f""",
top AS (SELECT * FROM depth WHERE depth = 0 AND kind IN ('exec', 'update')),
nodes AS (
  SELECT run_id, event_id, lineno, line, event_type, k,
         CAST(ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY event_id) AS BIGINT) AS node_id
  FROM top WHERE kind = 'exec'),
reads AS (
  SELECT DISTINCT u.run_id, u.event_id, n.node_id, u.name, u.id
  FROM uses_flat u JOIN nodes n ON n.run_id = u.run_id AND n.event_id = u.event_id),
writes AS (
  SELECT d.run_id, d.event_id, d.lineno, d.name, d.id
  FROM defs_flat d JOIN top t ON t.run_id = d.run_id AND t.event_id = d.event_id
  WHERE {REFINE[refinement]}),
hop1 AS (
  SELECT r.run_id, r.event_id, r.node_id, r.name, r.id, arg_max(w.lineno, w.event_id) AS w_lineno
  FROM reads r LEFT JOIN writes w
    ON w.run_id = r.run_id AND w.id IS NOT DISTINCT FROM r.id AND w.event_id < r.event_id
  GROUP BY r.run_id, r.event_id, r.node_id, r.name, r.id),
hop2 AS (
  SELECT h.run_id, h.event_id, h.node_id AS dst, h.name, h.id, h.w_lineno, arg_max(n.node_id, n.event_id) AS src
  FROM hop1 h LEFT JOIN nodes n
    ON n.run_id = h.run_id AND n.lineno = h.w_lineno AND n.event_id < h.event_id
  GROUP BY h.run_id, h.event_id, h.node_id, h.name, h.id, h.w_lineno),
edges_all AS (
  SELECT DISTINCT run_id, CAST(COALESCE(src, 0) AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM hop2),
edges_known AS (
  SELECT DISTINCT run_id, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM hop2
  WHERE w_lineno IS NOT NULL)"""


def lineage_sql(refinement: str = "include_all", known: bool = False) -> str:
    return f"WITH {graph_ctes(refinement)}\nSELECT run_id, src, dst FROM {'edges_known' if known else 'edges_all'}"


LINEITEM = """
WITH li AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_partkey,
           l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS pos
  FROM lineitem),
reads AS (
  SELECT CAST(l_suppkey AS BIGINT) AS run_id, 2 * pos AS event_id, pos AS node_id, l_partkey % 50 AS id
  FROM li WHERE l_returnflag <> 'R'),
writes AS (
  SELECT CAST(l_suppkey AS BIGINT) AS run_id, 2 * pos + 1 AS event_id, l_linenumber AS lineno, l_partkey % 50 AS id
  FROM li WHERE l_returnflag = 'R'),
nodes AS (
  SELECT CAST(l_suppkey AS BIGINT) AS run_id, 2 * pos AS event_id, pos AS node_id, l_linenumber AS lineno FROM li),
hop1 AS (
  SELECT r.run_id, r.event_id, r.node_id, r.id, arg_max(w.lineno, w.event_id) AS w_lineno
  FROM reads r LEFT JOIN writes w ON w.run_id = r.run_id AND w.id = r.id AND w.event_id < r.event_id
  GROUP BY ALL),
hop2 AS (
  SELECT h.run_id, h.node_id AS dst, arg_max(n.node_id, n.event_id) AS src
  FROM hop1 h LEFT JOIN nodes n ON n.run_id = h.run_id AND n.lineno = h.w_lineno AND n.event_id < h.event_id
  GROUP BY h.run_id, h.event_id, h.node_id, h.id, h.w_lineno)
SELECT DISTINCT run_id, CAST(COALESCE(src, 0) AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM hop2"""

# ---- orders -> facts adapter ------------------------------------------------------

FACTS = """
o AS (
  SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate, o_orderpriority,
         CAST(year(o_orderdate) AS BIGINT) AS yr FROM orders),
st AS (
  SELECT *, CASE WHEN o_orderstatus = 'O' THEN 0 WHEN o_orderstatus = 'P' AND yr % 2 = 1 THEN 3 ELSE 2 END AS rnk FROM o
  UNION ALL
  SELECT DISTINCT o_custkey, -yr, 'T', NULL, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][yr % 5 + 1],
         yr, 1 FROM o WHERE o_orderstatus IN ('F', 'P')),
facts AS (
  SELECT CAST(o_custkey AS BIGINT) AS unit_id,
         CAST(CASE WHEN o_orderstatus <> 'T' AND o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS scope_id,
         CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY yr, rnk, o_orderdate, o_orderkey) AS BIGINT) AS seq,
         CAST(o_orderkey AS BIGINT) AS stmt_id, o_orderpriority AS key,
         o_orderstatus <> 'T' AND (o_orderkey % 3 = 0 OR (o_orderkey % 3 = 2 AND o_orderkey % 5 = 0)) AS is_write,
         o_orderstatus = 'T' OR o_orderkey % 6 = 0 OR o_orderkey % 3 = 1
           OR (o_orderkey % 3 = 2 AND o_orderkey % 5 <> 0) AS is_read,
         o_orderstatus <> 'T' AND o_orderkey % 3 = 2 AND o_orderkey % 5 = 1 AS is_call,
         o_orderstatus = 'T' AS is_test,
         CASE WHEN o_orderstatus IN ('F', 'P') THEN -yr END AS ctl_id,
         CASE WHEN o_orderstatus = 'F' OR (o_orderstatus = 'P' AND yr % 2 = 0) THEN 'T'
              WHEN o_orderstatus = 'P' THEN 'F' END AS arm,
         yr % 2 = 0 AS in_loop
  FROM st)"""


# ---- lineitem -> nested facts, orders -> names --------------------------------------

NESTED = """
li AS (
  SELECT *, CAST(l_suppkey * 10 + year(l_shipdate) - 1992 AS BIGINT) AS unit_id, month(l_shipdate) AS m,
         CASE l_linenumber WHEN 7 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS depth FROM lineitem),
st AS (
  SELECT *, CASE WHEN m > 6 THEN 1 ELSE 0 END AS half, (m + 2) // 3 AS q,
         CAST(ROW_NUMBER() OVER (PARTITION BY unit_id ORDER BY depth > 0, depth > 0 AND m > 6, depth > 1,
              CASE WHEN depth > 1 THEN (m + 2) // 3 ELSE 0 END, depth > 2, depth > 2 AND m % 3 <> 1, l_shipdate, l_orderkey,
              l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS BIGINT) AS seq
  FROM li),
p AS (
  SELECT *, ['1' || CASE WHEN half = 0 THEN 'T' ELSE 'F' END, (10 + half) || CASE WHEN q % 2 = 1 THEN 'T' ELSE 'F' END,
             (100 + q) || CASE WHEN m % 3 = 1 THEN 'T' ELSE 'F' END][1:depth] AS b FROM st),
facts AS (
  SELECT unit_id, seq, l_returnflag AS flag, l_linenumber AS n, 'k' || l_partkey % 3 AS key, 'k' || (l_partkey + 1) % 3 AS other,
         b, '/' || array_to_string(list_transform(b, lambda x: x || '/'), '') AS path FROM p),
w AS (SELECT unit_id, seq, CASE WHEN flag = 'N' AND n = 3 THEN key || '.sub' ELSE key END AS name, path, b FROM facts WHERE flag <> 'A'),
writes AS (SELECT unit_id, seq, name AS key, path, b FROM w),
reads AS (SELECT unit_id, seq, unnest([key, other]) AS key, path, b FROM facts WHERE flag = 'A')"""


def nested_sql() -> str:
    """Writers that reach by NOT EXISTS over paths as texts: a write kills where its own path
    is a prefix of the earlier writer's or of the reader's; a block whose arms both write
    kills, at its end, writers from before it. Blocks are worked out from the inside out."""
    def level(d: int) -> str:
        inner = f"UNION ALL SELECT unit_id, key, ctx FROM both{d + 1}" if d < 3 else ""
        return f"""
arm{d} AS (SELECT DISTINCT unit_id, key, ctx FROM (SELECT unit_id, key, path AS ctx FROM writes {inner})
          WHERE len(string_split(ctx, '/')) - 2 = {d}),
both{d} AS (SELECT unit_id, key, ctx, ctl, first, last FROM (
  SELECT unit_id, key, regexp_extract(ctx, '^(.*/)[^/]+/$', 1) AS ctx, regexp_extract(ctx, '([0-9]+)[TF]/$', 1) AS ctl,
         count(DISTINCT ctx) AS arms FROM arm{d} GROUP BY ALL HAVING count(DISTINCT ctx) = 2)
  JOIN (SELECT unit_id, min(seq) AS first, max(seq) AS last, list_aggregate(list_transform(b[1:{d - 1}], lambda x: x || '/'), 'string_agg', '') AS outer_path,
               b[{d}][1:-2] AS c FROM facts WHERE len(b) >= {d} GROUP BY ALL) e USING (unit_id)
  WHERE ctl = c AND ctx = '/' || coalesce(outer_path, ''))"""
    return f"""WITH {NESTED},{level(3)},{level(2)},{level(1)},
blocks AS (SELECT unit_id, key, ctx, first, last FROM both1 UNION ALL SELECT unit_id, key, ctx, first, last FROM both2
           UNION ALL SELECT unit_id, key, ctx, first, last FROM both3)
SELECT DISTINCT r.unit_id, w.seq AS src, r.seq AS dst, r.key
FROM reads r JOIN writes w ON w.unit_id = r.unit_id AND w.key = r.key AND w.seq < r.seq
WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(w.b) AS x) a, (SELECT unnest(r.b) AS y) c
                  WHERE a.x[1:-2] = c.y[1:-2] AND a.x <> c.y)
  AND NOT EXISTS (SELECT 1 FROM writes k WHERE k.unit_id = r.unit_id AND k.key = r.key AND k.seq > w.seq AND k.seq < r.seq
                  AND (starts_with(w.path, k.path) OR starts_with(r.path, k.path)))
  AND NOT EXISTS (SELECT 1 FROM blocks k WHERE k.unit_id = r.unit_id AND k.key = r.key AND k.first > w.seq AND k.last < r.seq
                  AND (starts_with(w.path, k.ctx) OR starts_with(r.path, k.ctx)))"""


ORDER_NAMES = """
seg AS (
  SELECT DISTINCT [(['c', 'größe', '数'][o_orderkey % 3 + 1]) || o_custkey, '["' || o_orderpriority || '"]',
    '[i[' || o_orderkey % 7 || ']]', '.f' || o_orderkey % 11, '(a, ''](''  , [' || o_orderkey || '])',
    '.é_' || o_orderstatus][1:o_orderkey % 5 + 2] AS s FROM orders)"""
