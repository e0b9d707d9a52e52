"""Path functions (D1-D9) on the reference's parameter tables (FIXTURES §3)."""

import pytest
from pyspark.sql import functions as F

from linewise.functions import paths as P

# Statement, targets, right-hand references, reads.
READS = [
    ("a = 10", ["a"], [], []),
    ("a = x * 10", ["a"], ["x"], ["x"]),
    ("a = a.b * 10", ["a"], ["a.b"], ["a", "a.b"]),
    ("a = b[0] * 10", ["a"], ["b[0]"], ["b", "b[0]"]),
    ("a = b[0][1] * 10", ["a"], ["b[0][1]"], ["b", "b[0]", "b[0][1]"]),
    ("a = b[1:2] * 10", ["a"], ["b[1:2]"], ["b", "b[1:2]"]),
    ("a.b.c = x * 10", ["a.b.c"], ["x"], ["x", "a", "a.b"]),
    ("a[0][1] = c.d[0]", ["a[0][1]"], ["c.d[0]"], ["a", "a[0]", "c", "c.d", "c.d[0]"]),
    ("a.b.c[0] = 10", ["a.b.c[0]"], [], ["a", "a.b", "a.b.c"]),
    ("x = {a:1, b.c:2}", ["x"], ["a", "b.c"], ["a", "b", "b.c"]),
]


def test_prefixes(spark):
    df = spark.createDataFrame([("a",), ("a.b.c",), ("m[0][1]",), ("df['c2'].apply",)], "p string")
    got = {r.p: (r.full, r.proper) for r in df.select(
        "p", P.path_prefixes("p").alias("full"), P.path_prefixes("p", exclude_full=True).alias("proper")).collect()}
    assert got["a"] == (["a"], [])
    assert got["a.b.c"] == (["a", "a.b", "a.b.c"], ["a", "a.b"])
    assert got["m[0][1]"] == (["m", "m[0]", "m[0][1]"], ["m", "m[0]"])
    assert got["df['c2'].apply"] == (["df", "df['c2']", "df['c2'].apply"], ["df", "df['c2']"])


@pytest.mark.parametrize("stmt,targets,rhs,expected", READS)
def test_statement_reads(spark, stmt, targets, rhs, expected):
    df = spark.createDataFrame([(targets, rhs)], "targets array<string>, rhs_refs array<string>")
    got = df.select(P.statement_reads("targets", "rhs_refs").alias("r")).first().r
    assert set(got) == set(expected), stmt


def test_statement_writes_and_base(spark):
    df = spark.createDataFrame([(["x"],), (["d[1]"],), (["np"],), (["sklearn.preprocessing"],), (["lm"],)],
                               "targets array<string>")
    got = [r.w for r in df.select(P.statement_writes("targets").alias("w")).collect()]
    assert got == [["x"], ["d", "d[1]"], ["np"], ["sklearn", "sklearn.preprocessing"], ["lm"]]
    row = spark.createDataFrame([("a.b[0].c", "a.bc", "a.b")], "p string, q string, r string").select(
        P.path_base("p").alias("base"), P.path_depth("p").alias("depth"), P.path_parent("p").alias("parent"),
        P.is_prefix_of("r", "p").alias("yes"), P.is_prefix_of("r", "q").alias("no")).first()
    assert (row.base, row.depth, row.parent, row.yes, row.no) == ("a", 4, "a.b[0]", True, False)


def test_canonical_and_import(spark):
    row = spark.createDataFrame([("  df [ 'a b' ] . x ", None, "numpy", "np")],
                                "t string, a1 string, n2 string, a2 string").select(
        P.canonical_ref("t").alias("c"), P.imported_name(F.lit("os"), "a1").alias("i1"),
        P.imported_name("n2", "a2").alias("i2")).first()
    assert (row.c, row.i1, row.i2) == ("df['a b'].x", "os", "np")


HARD = {
    "df.groupby(x).c": ["df", ".groupby", "(x)", ".c"],
    "a[b[c[0]]].d": ["a", "[b[c[0]]]", ".d"],
    "df['a]b'].x": ["df", "['a]b']", ".x"],
    "é.b": ["é", ".b"],
    "f(g(h(1), ']'))[\"x)\"].y": ["f", "(g(h(1), ']'))", "[\"x)\"]", ".y"],
    "a['it\\'s [']": ["a", "['it\\'s [']"],
    "a[i][j]": ["a", "[i]", "[j]"],
    "名.x1": ["名", ".x1"],
    "f()": ["f", "()"],
    "a": ["a"],
    "a b": None, "a + b": None, "a[": None, "a]": None, ".a": None, "a..b": None, "a.": None, "": None,
    "[1]": None, "a['x": None, "a[0]b": None, "1a": None, "'s'": None, "a.(b)": None, None: None,
}


def test_segments_of_real_references(spark):
    df = spark.createDataFrame([(k,) for k in HARD], "p string")
    got = {r.p: r for r in df.select("p", P.path_segments("p").alias("s"), P.path_prefixes("p").alias("x"),
                                     P.path_base("p").alias("b"), P.path_parent("p").alias("u"),
                                     P.path_depth("p").alias("d")).collect()}
    for p, segs in HARD.items():
        assert got[p].s == segs, p
        if segs is None:
            assert got[p].x is None and got[p].b is None and got[p].u is None
        else:
            assert got[p].x == ["".join(segs[:i + 1]) for i in range(len(segs))]
            assert got[p].b == segs[0] and got[p].d == len(segs)
            assert got[p].u == ("".join(segs[:-1]) if len(segs) > 1 else None)


def test_canonical_keeps_words_apart(spark):
    cases = {"a in b": "a in b", "ainb": "ainb", "not  x": "not x", " x  =  y + 1 ": "x=y+1",
             "x = \"it's\" + y": "x=\"it's\"+y", "f( 'a  b' , c )": "f('a  b',c)", "é in ü": "é in ü",
             "x\t=\n1": "x=1", "": "", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.c for r in df.select("t", P.canonical_ref("t").alias("c")).collect()} == cases


def test_text_that_is_no_path_counts_as_itself(spark):
    df = spark.createDataFrame([(["a.b", "x + y"], ["m[0]", "1 + z"])], "t array<string>, r array<string>")
    got = df.select(P.statement_reads("t", "r").alias("r"), P.statement_writes("t").alias("w")).first()
    assert sorted(got.r) == ["1 + z", "a", "m", "m[0]"] and got.w == ["a", "a.b", "x + y"]


def test_nested_paths_are_split_without_a_scan(spark):
    """Brackets up to four deep, with quotes, take the regular expression; it gives what the
    scan gives, which stays for deeper ones. A long path needs no stack."""
    nested = ["c7[\"1-URGENT\"][i[3]].f2(a, ']('  , [12]).é_O", "a[b(c[{1}])]", "größe[i[0]]", "数['x\\'y']", "a[b)", "a[]()"]
    odd = ["a[b[c[d[e[0]]]]].x", "", "a..b", "a[", "a]", "'a'", "a b", "1a", "a[']", "a{b}", ".a", "a[0]b", "a\n", "a[\n'\\\n']"]
    got = spark.createDataFrame([(t,) for t in nested + odd], "p string").select(
        "p", F.col("p").rlike(P._PLAIN).alias("plain"), P.path_segments("p").alias("s"),
        P._scan_segments(F.col("p")).alias("scan")).collect()
    assert all(r.s == r.scan for r in got)
    assert all(r.plain for r in got if r.p in nested)
    assert [len(r.s) for r in got if r.p == odd[0]] == [3]
    long = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(".b[0]"), 20000)).alias("p"))
    assert long.select(P.path_depth("p").alias("n")).first().n == 40001
