import sys
import tempfile
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
from llm_cases import SF
from test_decontaminate import brute as brute_windows
from test_simhash import brute_groups, brute_print

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

from linewise.llm import toxicity  # noqa: E402
from linewise.llm.simhash import near_duplicates  # noqa: E402
from linewise.llm.tokens import PieceEncoder  # noqa: E402


def test_stages(spark, docs):
    kept, tables = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF)
        if name != "best_fit_packing":
            assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
            kept = corpus_pipeline.cut(kept)
            assert kept.count() == kept.select("doc_id").distinct().count()
        tables[name] = kept
    n = [docs.count()] + [tables[k].count() for k, _ in corpus_pipeline.STAGES[:-1]]
    assert n[0] > n[1] == n[2] > n[3] > n[4] > 0.5 * n[0]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in tables["toxicity"].collect()}
    assert all(labels.get(d) != 0 for d in {r.doc_id for r in docs.collect()} - left)  # no clean one goes
    again = near_duplicates(tables["simhash_near_dedup"])
    assert again.where("doc_id <> component_id").count() == 0
    packed = tables["best_fit_packing"]
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in tables["benchmark_decontamination"].collect()}


def test_run_and_odd_rows(spark, odd, empty):
    assert corpus_pipeline.run(spark, SF).count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() > 0
        assert stage(spark, empty, SF).count() == 0


def brute_lines(rows, min_sites=5):
    """doc_id -> text without lines of ``min_sites`` sites, but for their first place; rows:
    (doc_id, source, text)."""
    sites, first = defaultdict(set), {}
    for d, source, text in sorted(rows, key=lambda r: r[0]):
        for i, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\n\x0b\x0c\r")
            first.setdefault(line, (d, i))
            sites[line] |= {source} - {None}
    out = {}
    for d, _, text in rows:
        stays = []
        for i, line in enumerate((text or "").split("\n")):
            key = line.strip(" \t\n\x0b\x0c\r")
            if not key or len(sites[key]) < min_sites or first[key] == (d, i):
                stays.append(line)
        out[d] = None if text is None else "\n".join(stays)
    return out


def test_run_equals_brute_force(spark, docs):
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    items = [(r.item_id, r.text) for r in bench.collect()]
    passage = next(t for _, t in items if t and len(t.split()) > 20)
    known = max((r.text for r in docs.collect() if r.text), key=len)
    planted = [(10_000 + i, f"Opening words of page {i} {'abc' * i}\n  One notice for every page of all sites\n"
                            f"closing words with number {i * 7919} here", "en", f"site{i}", 1) for i in range(7)]
    planted += [(20_000, f"Some words before it. {passage} And some words after it.", "en", "site1", 1),
                (30_000, known, "en", "site2", 1), (30_001, known + " added", None, None, None),
                (30_002, "", "en", "site3", 0), (30_003, None, None, "site3", None)]
    whole = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    folder = tempfile.mkdtemp(prefix="linewise-test-", dir="/tmp")
    for name, df in (("documents", whole), ("labels", labels), ("benchmark", bench)):
        df.repartition(3).write.parquet(f"{folder}/{name}.parquet")

    toxic = {r.doc_id for r in toxicity.score(whole, toxicity.fit(whole, labels)).where("predicted = 1").collect()}
    left = [(r.doc_id, r.source, r.text) for r in whole.collect() if r.doc_id not in toxic]
    texts = brute_lines(left)
    assert sum(t != texts[d] for d, _, t in left) >= 6
    groups = brute_groups({d: brute_print(t) for d, t in texts.items()})
    one = {d: t for d, t in texts.items() if groups[d] == d}
    assert {30_000, 30_001} & set(one) == set() and len(one) < len(texts)
    clean = {d: t for d, t in one.items()
             if d not in {w[0] for w in brute_windows(list(one.items()), items) if w[-1]}}
    assert 20_000 not in clean and len(clean) > 0.5 * whole.count()
    tok, want = PieceEncoder().tok, set()
    for d, t in clean.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want |= {(d, at // 2048, at, len(ids[at:at + 2048]), zlib.crc32(ids[at:at + 2048].tobytes()))
                 for at in range(0, len(ids), 2048)}
    got = corpus_pipeline.run(spark, folder).collect()
    assert len(got) == len(want)
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for spans in filled.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
        assert sum(n for _, n in spans) <= 2048
    assert len(filled) <= -(-sum(r.length for r in got) // 2048) * 1.02 + 1
