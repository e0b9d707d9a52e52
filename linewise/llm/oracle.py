"""DuckDB SQL of the queries that SQL can express, written from their definitions."""

from __future__ import annotations

from linewise.llm.quality import RULES, STOP_WORDS, SYMBOLS

_SPACE = r"[\x20\x09-\x0D]"


def _text(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def quality_sql() -> str:
    by = {"mean_word_length": "word_chars / greatest(n_words, 1)",
          "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
          "stop_word_ratio": "n_stop_words / greatest(n_words, 1)",
          "duplicate_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
          "longest_word": "longest_word"}
    rules = " AND ".join(
        f"({by[m]}) {op} {v!r}" for _, m, lo, hi in RULES
        for op, v in ((">=", lo), ("<=", hi)) if v is not None)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
      FROM (SELECT doc_id, i, unnest([0, 1, 2, 3, 4]) AS k FROM d) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words,
             length(regexp_replace(text, '{_SPACE}', '', 'g')) AS word_chars,
             len(text) - len(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines,
             len(list_filter(ws, lambda x: list_contains([{_text(dict.fromkeys(f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())))}], x))) AS n_stop_words,
             coalesce(list_max(list_transform(ws, lambda x: len(x))), 0) AS longest_word
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {rules} AS kept, n_lines, n_stop_words, longest_word FROM b"""


def license_sql() -> str:
    import math

    from linewise.llm.licenses import PHRASES, REACH, TEMPLATES, THRESHOLD, template_words

    def words(text: str) -> str:
        return (f"list_filter(regexp_split_to_array({text}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), "
                "lambda x: x <> '')")
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    rows = ", ".join(
        f"('{label}', {len(template_words(t))}, [{_text(sorted(set(template_words(t))))}], "
        f"{max(1, math.ceil(THRESHOLD * len(set(template_words(t))) - 1e-9))})"
        for label, t in TEMPLATES.items())
    return rf"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p(phrase, label, n) AS (VALUES {phrases}),
k(label, n, ws, need) AS (VALUES {rows}),
w AS (SELECT doc_id, {words("text")} AS ws FROM t),
a AS (SELECT doc_id, ws, unnest(range(0, len(ws))) AS i FROM w),
h AS (SELECT doc_id, i, label FROM a JOIN p ON array_to_string(ws[i + 1:i + n], ' ') = phrase
      WHERE i + n <= len(ws)),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
             list(DISTINCT label) AS labels FROM h GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
lw AS (SELECT doc_id, list_distinct({words("line")}) AS ws FROM ln),
m AS (SELECT doc_id, label, len(list_intersect(lw.ws, k.ws)) / len(k.ws) AS c FROM lw, k
      WHERE len(list_intersect(lw.ws, k.ws)) >= need),
ls AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda line: {words("line")}) AS lw FROM t),
li AS (SELECT ls.doc_id, label, n, k.ws, need, unnest(range(1, len(lw))) AS i, lw FROM ls, k
       WHERE len(list_intersect(list_distinct(flatten(lw)), k.ws)) >= need),
lr AS (SELECT doc_id, label, ws, need, lw[i][greatest(1, len(lw[i]) - n + 2):] AS head, lw[i] AS line, n,
              lw[i + 1:coalesce(list_position(list_transform(lw[i + 1:], lambda x: len(x) = 0), true) + i - 1,
                                len(lw))] AS after FROM li),
rr AS (SELECT doc_id, label, ws, need, list_concat(CASE WHEN n > 1 THEN head ELSE [] END,
              coalesce(flatten(after)[1:{REACH} * (n - 1)], [])) AS run FROM lr WHERE len(list_intersect(line, ws)) > 0),
mr AS (SELECT doc_id, label, max(len(list_intersect(list_distinct(run), ws)) / len(ws)) AS c FROM rr
       WHERE len(list_intersect(list_distinct(run), ws)) >= need GROUP BY ALL),
mb AS (SELECT doc_id, label, coalesce(l.c, mr.c) AS c FROM (SELECT doc_id, label, max(c) AS c FROM m GROUP BY ALL) l
       FULL JOIN mr USING (doc_id, label)),
mm AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS best FROM mb GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []),
                coalesce(mm.labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN mm USING (doc_id)"""


def sharding_sql(n: int = 8) -> str:
    """All columns but text_crc32, which DuckDB has no function for (the tests compare it)."""
    from linewise.llm.sharding import SALTS, tree

    def table(name: str, shards) -> str:
        rows = ", ".join(f"({s.region}, {s.rack}, {s.shard}, {s.weight})" for s in shards)
        return f"{name}(region, rack, shard, weight) AS (VALUES {rows})"

    def chosen(level: str, t: str, above: str) -> str:
        other = {"region": "", "rack": "AND t.region = d.region", "shard": "AND t.rack = d.rack"}[level]
        return (f"SELECT d.*, t.{level} AS {level} FROM {above} d JOIN (SELECT DISTINCT "
                f"{'region' if level == 'region' else 'region, rack' if level == 'rack' else 'region, rack, shard'}, "
                f"sum(weight) OVER (PARTITION BY {level}) AS weight FROM {t}) t ON true {other} "
                f"QUALIFY row_number() OVER (PARTITION BY d.doc_id ORDER BY ln((('0x' || "
                f"substr(md5(d.doc_id::VARCHAR || ':{level}:' || t.{level}), 1, 13))::BIGINT + 0.5) "
                f"/ 4503599627370496.0) / t.weight DESC) = 1")
    return f"""
WITH {table('a', tree(n))}, {table('b', tree(n + 1))},
k AS (SELECT doc_id FROM documents),
a1 AS ({chosen('region', 'a', 'k')}), a2 AS ({chosen('rack', 'a', 'a1')}), a3 AS ({chosen('shard', 'a', 'a2')}),
b1 AS ({chosen('region', 'b', 'k')}), b2 AS ({chosen('rack', 'b', 'b1')}), b3 AS ({chosen('shard', 'b', 'b2')}),
s AS (SELECT a3.doc_id, a3.shard, b3.shard AS grown_shard,
             ('0x' || substr(md5(a3.doc_id::VARCHAR), 1, 6))::BIGINT % {SALTS} AS salt
      FROM a3 JOIN b3 USING (doc_id))
SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, shard, grown_shard, 'key' AS law,
       row_number() OVER (PARTITION BY shard ORDER BY salt, doc_id) - 1 AS slot
FROM s JOIN documents USING (doc_id)"""


def line_dedup_sql() -> str:
    from linewise.llm.lines import MIN_SITES

    return rf"""
WITH p AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, source, unnest(parts) AS raw, unnest(range(len(parts))) AS pos FROM p),
n AS (SELECT doc_id, source, pos, raw, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l),
b AS (SELECT line, min((doc_id, pos)) AS first FROM n WHERE line <> '' GROUP BY line
      HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (SELECT n.*, b.line IS NOT NULL AND (doc_id, pos) <> b.first AS gone FROM n LEFT JOIN b USING (line))
SELECT doc_id, count(*) FILTER (WHERE line <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE gone IS NOT TRUE), '') AS text
FROM m GROUP BY doc_id"""


def infill_sql() -> str:
    """The cut texts by code points; the restored text is the document's own."""
    return r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
                  sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, length(text) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1,
             ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3,
             ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>')
                       OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                     WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
             least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM u),
p AS (SELECT *, left(text, a) AS pre, substring(text, a + 1, b - a) AS mid,
             substring(text, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
                        ELSE text END) AS output_sha256, sha256(text) AS restored_sha256
FROM p"""


def mixing_sql() -> str:
    """Targets by one scan over the sources in the order in which they reach their most."""
    from linewise.llm.mixing import MOST, SHARE, WEIGHTS

    weights = f"[{', '.join(map(str, WEIGHTS))}]"
    return rf"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'),
                  lambda x: x <> '')) AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, {MOST} * source_size AS most, {weights}[(row_number() OVER (ORDER BY source NULLS LAST) - 1)
             % {len(WEIGHTS)} + 1] AS w FROM s),
o AS (SELECT *, coalesce(sum(most) OVER b, 0)::BIGINT AS spent, sum(w) OVER (ORDER BY most / w DESC, source DESC
             NULLS FIRST)::BIGINT AS open, (SELECT sum(source_size) FROM s)::BIGINT * {SHARE}::DOUBLE AS budget
      FROM r WINDOW b AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((budget - spent) / open) AS level FROM o WHERE most / w > (budget - spent) / open),
t AS (SELECT source, source_size, CASE WHEN most <= level * w THEN most::DOUBLE ELSE level * w END AS target, budget
      FROM o, (SELECT coalesce((SELECT level FROM l), 1e300) AS level)),
q AS (SELECT doc_id, d.source, size, source_size, target, budget, e AS epoch,
             e * source_size + sum(size) OVER (PARTITION BY d.source, e ORDER BY h)::BIGINT - size AS first
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, (SELECT unnest(range({MOST})) AS e)),
g AS (SELECT *, CASE WHEN target > 0 THEN (first + size) / target END AS finish,
             greatest(0, least(size, ceil(target)::BIGINT - first)) AS offered FROM q),
p AS (SELECT *, sum(offered) OVER (ORDER BY finish NULLS LAST, source NULLS LAST, doc_id, epoch
             ROWS UNBOUNDED PRECEDING)::BIGINT - offered AS position FROM g)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       sum(greatest(0, least(offered, floor(budget)::BIGINT - position)))::BIGINT AS taken
FROM p GROUP BY doc_id"""


def trie_sql() -> str:
    """Nodes as lists of (role, text); crc32 is worked out bit by bit."""
    return rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS own FROM t GROUP BY conv_id),
c AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
             string_split(conv_id::VARCHAR, ''), lambda ch: list_transform(range(8), lambda k: ((ascii(ch) >> k) & 1)::BIGINT)))),
             lambda x, y: xor(x >> 1, CASE WHEN (xor(x, y) & 1) = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)),
             4294967295::BIGINT) % 4 AS h FROM o),
r AS (SELECT o.conv_id, list_concat(coalesce(b.head, [])[1:h], o.own[h + 1:]) AS turns
      FROM (SELECT o.conv_id, o.own, c.h FROM o JOIN c USING (conv_id)) o
      LEFT JOIN (SELECT conv_id AS base, own FROM o) b(base, head) ON b.base = o.conv_id - o.conv_id % 20),
e AS (SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM r),
k AS (SELECT conv_id, depth, turns[1:depth] AS path, len(turns) = depth AS ends,
             CASE WHEN depth > 0 THEN len(list_filter(regexp_split_to_array(turns[depth].text, '{_SPACE}+'),
                  lambda x: x <> '')) ELSE 0 END AS words FROM e),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256,
             count(*) FILTER (WHERE ends) AS n_ends FROM k GROUP BY depth, path),
u AS (SELECT v.depth, v.path, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens,
             count(*) FILTER (WHERE n.n_ends = n.n_convs) AS n_leaves
      FROM n JOIN k ON k.conv_id = n.conv_id AND k.depth <= n.depth
      JOIN n v ON v.depth = k.depth AND v.path = k.path GROUP BY v.depth, v.path),
f AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN u USING (depth, path) LEFT JOIN f USING (depth, path)
LEFT JOIN n p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]"""
