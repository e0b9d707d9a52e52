"""Reference-path scalar functions (D1-D9), all plain Column expressions (JVM side).

A path is a reference such as ``a``, ``a.b.c``, ``m[0][1]``, ``df['c2'].apply(f(x)).y``. It
splits into segments: a leading identifier, then ``.name``, ``[...]`` or ``(...)`` parts.
Brackets nest to any depth, quotes inside them hide brackets, identifiers are Unicode
letters, digits and ``_``. Prefixes are taken on segment boundaries, so ``a.b`` is a prefix
of ``a.b.c`` but not of ``a.bc``. Names used *inside* brackets (the ``i`` of ``d[i]``) are not
prefixes. A text that is no path (blanks or operators outside brackets, unbalanced
brackets, an open quote) has NULL segments, hence NULL prefixes, base, parent and depth.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = r"[\p{L}_][\p{L}\p{M}\p{N}_]*+"
_FLAT = r"[^\[\](){}'\"]++"
_QUOTED = r"'(?:[^'\\]|\\.)*+'|\"(?:[^\"\\]|\\.)*+\""
_NESTING = 4


def _brackets(opening: str, depth: int) -> str:
    """A balanced bracket that holds up to ``depth`` levels of others; quotes hide brackets.
    All repeats are possessive, so matching is linear and needs no stack."""
    inner = f"|{_brackets('[({]', depth - 1)}" if depth else ""
    return rf"{opening.replace('[(', r'[\[(', 1)}(?:{_FLAT}|{_QUOTED}{inner})*+[\])}}]"


#: Paths with brackets nested up to ``_NESTING`` deep: a regular expression splits them.
_SEGMENT = rf"{_NAME}|\.{_NAME}|{_brackets('[(]', _NESTING - 1)}"
_PLAIN = rf"(?s)^{_NAME}(?:\.{_NAME}|{_brackets('[(]', _NESTING - 1)})*+\z"
_PLAIN_SEGMENT = rf"(?s){_SEGMENT}"
#: What a scan step takes: a run of characters that mean nothing to it, or one that does.
_STEP = r"(?s)[^\[\](){}'\"\\.]++|."


def _c(p) -> Column:
    return F.col(p) if isinstance(p, str) else p


def _scan_segments(path: Column) -> Column:
    """Segments by a scan over the characters (runs of those without meaning at once) that
    tracks bracket depth and quotes: for any nesting."""
    text, quote, ok = "text", "quote", "ok"

    def state(segs, cur, depth, q, esc, good):
        return F.struct(segs.alias("segs"), cur.alias(text), depth.cast("int").alias("depth"),
                        q.alias(quote), esc.alias("esc"), good.alias(ok))

    def flushed(s):
        return F.when(s[text] != "", F.concat(s["segs"], F.array(s[text]))).otherwise(s["segs"])

    def step(s, ch):
        cur, depth = s[text], s["depth"]
        add = F.concat(cur, ch)
        in_quote = s[quote] != ""
        opens, closes = ch.isin("[", "(", "{"), ch.isin("]", ")", "}")
        is_quote = ch.isin("'", '"')
        ends = in_quote & (ch == s[quote]) & ~s["esc"]
        top = ~in_quote & (depth == 0)
        new_seg = top & (opens | (ch == "."))
        close_seg = ~in_quote & closes & (depth == 1)
        name = ch.rlike(r"^[\p{L}\p{M}\p{N}_]++\z")
        good = s[ok] & F.when(~top, F.lit(True)).when(closes | is_quote | (ch == "{"), F.lit(False)) \
            .when(opens, (cur != "") | (F.size(s["segs"]) > 0)) \
            .when(ch == ".", (cur != "") | (F.size(s["segs"]) > 0)) \
            .otherwise(name & ((cur != "") | (F.size(s["segs"]) == 0)))
        return state(
            F.when(new_seg, flushed(s)).when(close_seg, F.concat(s["segs"], F.array(add))).otherwise(s["segs"]),
            F.when(new_seg, ch).when(close_seg, F.lit("")).otherwise(add),
            depth + F.when(in_quote, 0).when(opens, 1).when(closes, -1).otherwise(0),
            F.when(ends, F.lit("")).when(~in_quote & is_quote, ch).otherwise(s[quote]),
            in_quote & (ch == "\\") & ~s["esc"], good)

    def finish(s):
        segs = flushed(s)
        names = F.forall(segs, lambda x: x.rlike(rf"^(\.?{_NAME}|[\[(].*)$") | x.rlike(r"(?s)^[\[(]"))
        return F.when(s[ok] & (s["depth"] == 0) & (s[quote] == "") & (F.size(segs) > 0) & names, segs)

    zero = state(F.array().cast("array<string>"), F.lit(""), F.lit(0), F.lit(""), F.lit(False), F.lit(True))
    return F.aggregate(F.regexp_extract_all(path, F.lit(_STEP), 0), zero, step, finish)


def path_segments(p) -> Column:
    path = _c(p)
    return F.when(path.rlike(_PLAIN), F.regexp_extract_all(path, F.lit(_PLAIN_SEGMENT), 0)) \
        .when(path.isNotNull(), _scan_segments(path))


def _segments(p, segments=None) -> Column:
    return path_segments(p) if segments is None else _c(segments)


def path_prefixes(p, exclude_full: bool = False, segments=None) -> Column:
    """All prefixes, shortest first (the full path last unless excluded). ``segments``,
    here and below: a column that holds ``path_segments(p)``, so that several functions of
    one path split it once."""
    segs = _segments(p, segments)
    keep = F.size(segs) - 1 if exclude_full else F.size(segs)
    return F.transform(F.slice(segs, 1, keep), lambda _, i: F.array_join(F.slice(segs, 1, i + 1), ""))


def path_base(p, segments=None) -> Column:
    """Leading identifier."""
    return F.get(_segments(p, segments), 0)


def path_prefixes_with_depth(p) -> Column:
    """D3: array<struct<prefix, depth>>, depth = distance from the full path (0 = full)."""
    pre = path_prefixes(p)
    n = F.size(pre)
    return F.transform(pre, lambda x, i: F.struct(x.alias("prefix"), (n - 1 - i).cast("int").alias("depth")))


def path_parent(p, segments=None) -> Column:
    """The longest proper prefix, NULL for a bare name."""
    segs = _segments(p, segments)
    return F.when(F.size(segs) > 1, F.array_join(F.slice(segs, 1, F.size(segs) - 1), ""))


def path_depth(p, segments=None) -> Column:
    """Number of segments."""
    return F.size(_segments(p, segments))


def is_prefix_of(p, q) -> Column:
    """P is a prefix of q on segment boundaries (a path is a prefix of itself)."""
    return F.array_contains(path_prefixes(q), _c(p))


_TOKEN = (r"(?s)'(?:[^'\\]|\\.)*'" r'|"(?:[^"\\]|\\.)*"' r"|\s+|[\p{L}\p{M}\p{N}_]+|.")


def canonical_ref(text) -> Column:
    """The tokens of a statement without the blanks between them. A blank between two
    words (``a in b``, ``not x``) stays as one blank; quoted text keeps its blanks."""
    tokens = F.regexp_extract_all(F.trim(_c(text)), F.lit(_TOKEN), 0)
    word = r"^[\p{L}\p{M}\p{N}_]"
    return F.array_join(F.transform(tokens, lambda t, i: F.when(
        t.rlike(r"^\s+$"),
        F.when(F.get(tokens, i - 1).rlike(word) & F.get(tokens, i + 1).rlike(word), F.lit(" ")).otherwise(F.lit("")))
        .otherwise(t)), "")


def imported_name(name, alias) -> Column:
    """The name an import binds: the alias if given, else the module path."""
    return F.coalesce(_c(alias), _c(name))


def _prefixes_or_self(p, exclude_full: bool = False) -> Column:
    """Prefixes of a path; of a text that is no path, the text itself (or nothing)."""
    whole = F.array().cast("array<string>") if exclude_full else F.array(_c(p))
    return F.coalesce(path_prefixes(p, exclude_full), whole)


def _list(c) -> Column:
    return F.coalesce(_c(c), F.array().cast("array<string>"))


def statement_reads(targets, rhs_refs, is_augmented=None) -> Column:
    """D8 (+E10): reads of an assignment: the right-hand references with their
    prefixes, the proper prefixes of every target, and the full target when augmented."""
    rhs = F.flatten(F.transform(_list(rhs_refs), lambda r: _prefixes_or_self(r)))
    lhs = F.flatten(F.transform(_list(targets), lambda t: _prefixes_or_self(t, exclude_full=True)))
    out = F.concat(rhs, lhs)
    if is_augmented is not None:
        out = F.concat(out, F.when(_c(is_augmented), _list(targets)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(out)


def statement_writes(targets) -> Column:
    """Writing a path writes all its prefixes; sorted, distinct."""
    return F.sort_array(F.array_distinct(F.flatten(F.transform(_list(targets), lambda t: _prefixes_or_self(t)))))
