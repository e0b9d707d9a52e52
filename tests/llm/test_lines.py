import pytest
from pyspark.sql import functions as F

from linewise.llm.lines import _lines, boilerplate, drop_boilerplate, normal_line


def table(spark, n_sites, extra=()):
    rows = [(i, f"own line {i}\n  Share this  \nend {i}", f"s{i % n_sites}") for i in range(40)]
    return spark.createDataFrame([*rows, *extra], "doc_id bigint, text string, source string")


@pytest.mark.parametrize("n_sites,gone", [(4, 0), (5, 39), (6, 39), (12, 39)])
def test_threshold_is_exact(spark, n_sites, gone):
    out = drop_boilerplate(table(spark, n_sites))
    assert out.agg(F.sum("_n_removed")).first()[0] == gone
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[0] == "own line 0\n  Share this  \nend 0"  # the first place stays, as it was
    assert text[7] == ("own line 7\nend 7" if gone else "own line 7\n  Share this  \nend 7")


@pytest.mark.parametrize("log2_k", [4, 12])
def test_sketch_size_changes_nothing(spark, log2_k):
    rows = [(100 * n + i, f"line of {n}", f"s{i}") for n in range(1, 40) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    bad = boilerplate(_lines(df), 15, log2_k)
    assert bad.count() == 25  # the lines on 15 to 39 sites


def test_hot_line_and_null_sites(spark):
    rows = [(i, "everywhere", None if i % 3 else f"s{i % 9}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert drop_boilerplate(df).agg(F.sum("_n_removed")).first()[0] == 0  # three sites and null
    more = df.unionByName(spark.createDataFrame([(900 + i, "everywhere", f"t{i}") for i in range(2)], df.schema))
    assert drop_boilerplate(more).agg(F.sum("_n_removed")).first()[0] == 301


def test_odd_rows(odd, empty):
    out = drop_boilerplate(odd, min_sites=2)
    assert out.count() == odd.count()
    assert out.columns == [*odd.columns, "_n_lines", "_n_removed"]
    got = [(r.doc_id, r.text, r._n_removed) for r in out.collect()]
    assert sum(n for _, _, n in got) == 1  # doc 6 loses the line of docs 5
    assert [t for d, t, _ in got if d == 6] == [""]
    assert [t for d, t, _ in got if d == 1] == [None] and [t for d, t, _ in got if d == 2] == [""]
    assert drop_boilerplate(empty).collect() == []


def test_blanks_inside_and_unusual_line_ends(spark):
    import time

    lines = ["a" + " " * 1_000_000 + "b", "abc \u0085", "abc \u2028", "\t abc \x0b\x0c\r", "\u00a0x\u00a0", " ", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    began = time.time()
    got = [r.n for r in df.select("i", normal_line(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [ln.strip(" \t\n\x0b\x0c\r") for ln in lines] and time.time() - began < 20
    # two lines that differ behind the last line separator are two lines
    rows = [(i, f"own {i}\nabc \u0085" if i % 2 else f"own {i}\nabc\u0085", f"s{i % 4}") for i in range(16)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert drop_boilerplate(docs, min_sites=3).agg(F.sum("_n_removed")).first()[0] == 0


def test_clashing_count_names(spark):
    df = table(spark, 12).withColumns({"_n_lines": F.lit("mine"), "_N_removed": F.lit("own"), "_lw_drop": F.lit(7)})
    out = drop_boilerplate(df)
    assert out.columns == [*df.columns, "__n_lines", "__n_removed"]
    rows = out.collect()
    assert {(r._n_lines, r._N_removed, r._lw_drop) for r in rows} == {("mine", "own", 7)}
    assert sum(r["__n_removed"] for r in rows) == 39


def test_frequent_lines_are_decided_where_they_lie(spark, monkeypatch):
    from linewise.llm import ordered

    monkeypatch.setattr(ordered, "LEAST_FREQUENT", 10)
    rows = [(i, f"hot line\nnear line\nown {i}" if i % 2 else "hot line\nonly here", f"s{i % 4}" if i % 9 else None)
            for i in range(200)] + [(1000 + i, "hot line", f"t{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for sites, gone in ((2, 208 + 99 + 99), (4, 208), (5, 208), (14, 0)):
        assert drop_boilerplate(df, min_sites=sites).agg(F.sum("_n_removed")).first()[0] == gone
