import hashlib
import re

import pytest

from linewise.llm.decontaminate import Searcher, drop_contaminated, hits, scan, searchers, strings_of, windows_of
from llm_cases import SF


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, size=10):
    wins = {}
    for item, text in items:
        w = words(text)
        m = min(size, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            wins.setdefault(tuple(w[i:i + m]), set()).add(str(item))
    out = []
    for d, text in docs:
        w, hit, got = words(text), set(), set()
        for m in {len(k) for k in wins}:
            for i in range(len(w) - m + 1):
                if (k := tuple(w[i:i + m])) in wins:
                    hit.update(range(i, i + m))
                    got |= wins[k]
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def result(df):
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 30_000])
def test_equals_brute_force(spark, docs, rows, block_bytes):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = brute(rows, items)
    assert sum(w[-1] for w in want) > 0
    assert result(hits(docs, bench, block_bytes=block_bytes)) == want
    kept = {r.doc_id for r in drop_contaminated(docs, bench, block_bytes=block_bytes).collect()}
    assert kept == {w[0] for w in want if not w[-1]}


@pytest.mark.parametrize("window", [1, 2, 3, 10])
def test_short_and_overlapping_windows(spark, window):
    texts = [(1, "a b a b a b c"), (2, "A-B, c! d"), (3, "b"), (4, ""), (5, None), (6, "c c c c"), (7, "x " * 50 + "a b c")]
    items = [(10, "a b"), (9, "a b a"), (11, "c"), (12, ""), (13, None), (14, "b a b a"), (10, "c d"), (None, "d")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    named = [("null" if i is None else i, t) for i, t in items]
    assert result(hits(docs, bench, window)) == brute(texts, named, window)
    assert result(hits(docs, bench, window, block_bytes=40)) == brute(texts, named, window)


def test_shift_skips_and_buckets():
    s = Searcher(4)
    for t in ("a b c d", "x b c d", "c d e f"):
        s.strings[tuple(w.encode() for w in t.split())].append(t)
    s.build()
    assert s.shift[(b"c", b"d")] == 0 and s.shift[(b"b", b"c")] == 1
    assert len(s.bucket[(b"c", b"d")]) == 2
    found = list(s.search(b"q q q q a b c d e f x b c d".split()))
    assert [i for i, _ in found] == [4, 6, 10]


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "short text stands here"), (2, None), (3, "w5x5 w6x6 w7x7")],
                                  "item_id bigint, text string")
    got = hits(odd, bench).collect()
    assert len(got) == odd.count()
    assert {r.doc_id for r in got if r.contaminated} == {4, 5, 6}
    assert all(r.n_words == 0 for r in got if r.doc_id in (1, 2, 3))
    assert drop_contaminated(odd, bench).columns == odd.columns
    assert hits(empty, bench).collect() == []
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r.contaminated for r in hits(odd, none).collect())


def test_spans():
    own = searchers([(w, "i") for w in windows_of("a b c", 2)])
    assert scan("a b c x a b", own) == (6, [0, 4], [2, 5], ["i"])


def test_a_long_item_is_split_over_blocks(spark):
    text = " ".join(f"w{i}" for i in range(3000))
    bench = spark.createDataFrame([(1, text), (2, "é " * 9 + "à"), (3, "w5 w6")], "item_id bigint, text string")
    strings = strings_of(bench, block_bytes=30_000)
    sizes = strings.selectExpr("block", "octet_length(string) + octet_length(item_id) AS n").groupBy("block").sum("n").collect()
    assert len(sizes) > 3 and max(r[1] for r in sizes) < 30_000 + 100
    docs = spark.createDataFrame([(1, text[:9000]), (2, "x " + text[-300:]), (3, "w5 w6 w7"), (4, "é " * 9 + "à")], "doc_id bigint, text string")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert result(hits(docs, bench, block_bytes=30_000)) == want
    left = drop_contaminated(docs, bench, block_bytes=30_000)
    assert left.collect() == []
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 1  # one block's filter, whatever their number
