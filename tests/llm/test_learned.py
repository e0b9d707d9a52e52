"""Language ID and toxicity: brute force on small cases, held-out accuracy, odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import linewise.llm.language as language
import linewise.llm.toxicity as toxicity
from llm_cases import SF


def brute_grams(text):
    out = Counter()
    word = ""
    for ch in (text or "").lower() + " ":
        if ch.isalpha():
            word += ch
        elif word:
            padded = " " + word + " "
            out.update(word)
            out.update(padded[i:i + 2] for i in range(len(padded) - 1))
            out.update(padded[i:i + 3] for i in range(len(padded) - 2))
            word = ""
    return out


def code(gram):
    n = 0
    for ch in gram:
        n = n << 21 | (1 if ch == " " else ord(ch))
    return n


@pytest.mark.parametrize("text", ["", None, "123 !!", "a", "Ab, cdE fg-h", "Été naïve 中文", "x" * 40])
def test_grams(text, monkeypatch):
    want = Counter()
    for g, n in brute_grams(text).items():
        want[code(g)] += n
    for piece in (1 << 20, 3):
        monkeypatch.setattr(language, "_PIECE", piece)
        codes, counts = language.grams(text)
        assert dict(zip(codes.tolist(), counts.tolist())) == dict(want)


def test_out_of_place_distance():
    rows = [("aa", i, code(g)) for i, g in enumerate("xyz")] + [("bb", i, code(g)) for i, g in enumerate("zyx")]
    ranker = language.Ranker(rows, size=3)
    assert ranker.predict("xxx xx yy z", 1)[0] == "aa"
    assert ranker.predict("z z z y y x", 1) == ("bb", 1.0)
    assert ranker.predict("123", 1) == ("und", 0.0) and ranker.predict(None, 1) == ("und", 0.0)


def test_language_profiles_equal_brute_force(spark, docs):
    got = {}
    for r in language.profiles(docs, size=50).collect():
        got.setdefault(r.lang, []).append((r.rank, r.gram))
    counts = {}
    for r in docs.collect():
        counts.setdefault(r.lang, Counter()).update(
            {code(g): n for g, n in brute_grams(r.text).items()})
    for lang, c in counts.items():
        want = sorted(c, key=lambda g: (-c[g], g))[:50]
        assert [g for _, g in sorted(got[lang])] == want


def test_language_held_out(spark):
    got = language.op8_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    rows = got.where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in got.collect())


def test_language_odd_rows(odd, empty):
    profile = language.profiles(odd)
    got = language.identify(odd, profile).collect()
    assert len(got) == odd.count()
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    none = language.profiles(empty)
    assert {r.lang_pred for r in language.identify(odd, none).collect()} == {"und"}
    assert language.identify(empty, profile).collect() == []


def test_word_hashes(monkeypatch):
    h = toxicity.word_hashes("The cat, the CAT; été x1")
    assert len(h) == 6 and h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 4
    text = " ".join(f"w{i}" for i in range(3000))
    whole = toxicity.word_hashes(text)
    monkeypatch.setattr(toxicity, "_SLICE", 100)
    assert np.array_equal(toxicity.word_hashes(text), whole)
    assert len(set(whole.tolist())) == 3000
    assert len(toxicity.word_hashes("")) == len(toxicity.word_hashes(None)) == 0


def test_counts_equal_brute_force(spark, docs):
    df = docs.select((F.col("doc_id") % 2).cast("int").alias("cls"), "text")
    got = {(r.v, r.w): (r.t, r.o, r.dt, r.do) for r in toxicity._counted(df).collect()}
    n, held = [{0: Counter(), 1: Counter()} for _ in range(2)]
    for r in docs.collect():
        h = toxicity.word_hashes(r.text).view(np.int64).tolist()
        seen = [*zip([0, *h[:-1]], h), *((None, w) for w in h)]
        n[r.doc_id % 2].update(seen)
        held[r.doc_id % 2].update(set(seen))
    assert got == {k: (n[1][k], n[0][k], held[1][k], held[0][k]) for k in {*n[0], *n[1]}}


def test_shared_counts(spark, docs):
    texts = [toxicity.word_hashes(r.text) for r in docs.collect()]
    words = np.unique(toxicity.word_hashes(docs.first().text))
    pairs = np.unique(toxicity.pair_hashes(toxicity.word_hashes(docs.first().text)))
    got_words, got_pairs, total = toxicity._shared_counts(docs, words, pairs)
    held = [set(t.tolist()) for t in texts]
    held_pairs = [set(toxicity.pair_hashes(t).tolist()) if len(t) else set() for t in texts]
    assert got_words.tolist() == [sum(k in ws for ws in held) for k in words.tolist()]
    assert got_pairs.tolist() == [sum(k in ps for ps in held_pairs) for k in pairs.tolist()]
    assert total == sum(map(len, held))


def brute_model(sample, corpus):
    """word -> ratio and (v, w) -> ratio, from the definitions; sample: (class, words)."""
    from math import log

    docs_of = {c: [ws for k, ws in sample if k == c] for c in (1, 0)}
    n = {c: Counter(p for ws in docs_of[c] for p in zip([None, *ws], ws)) for c in (1, 0)}
    held = {c: Counter(x for ws in docs_of[c] for x in {*ws, *zip([None, *ws], ws)}) for c in (1, 0)}
    vocab, pairs = {w for p in n.values() for _, w in p}, {*n[0], *n[1]}

    def apart(x, tried):
        def best(k, m):
            return sum(y * log(y / m) for y in (k, m - k) if y)
        a, b, m, o = held[1][x], held[0][x], len(docs_of[1]), len(docs_of[0])
        return 2 * (best(a, m) + best(b, o) - best(a + b, m + o)) > log(tried)

    def discount(values):
        one, two = values.count(1), values.count(2)
        return one / (one + 2 * two) if one and two else 0.75

    follows = {c: Counter(w for _, w in n[c]) for c in n}
    d1 = discount([follows[1][w] + follows[0][w] for w in vocab])
    d2 = discount([n[1][p] + n[0][p] for p in pairs])
    hold = Counter(w for ws in corpus for w in set(ws))
    hold_pair = Counter(p for ws in corpus for p in set(zip(ws, ws[1:])))
    shared = {w: (hold[w] + 0.5) / (sum(hold.values()) + 0.5 * (len(vocab) + 1)) for w in vocab}

    def uni(w, c):
        mass = max(sum(follows[c].values()), 1)
        return max(follows[c][w] - d1, 0) / mass + d1 * len(follows[c]) / mass * shared[w]

    word = {w: log(uni(w, 1) / uni(w, 0)) for w in vocab if apart(w, len(vocab))}
    pair = {}
    for v, w in pairs:
        if v is None or not apart((v, w), len(pairs) ** 2):
            continue
        prob = {}
        for c in (1, 0):
            ctx = sum(k for (a, _), k in n[c].items() if a == v)
            kinds = sum(1 for a, _ in n[c] if a == v)
            back = (hold_pair[v, w] + 0.5) / (hold[v] + 1) * 2 * uni(w, c) / (uni(w, 1) + uni(w, 0))
            prob[c] = (max(n[c][v, w] - d2, 0) + d2 * kinds * back) / ctx if ctx else back
        pair[v, w] = log(prob[1] / prob[0]) - word.get(w, 0.0)
    return word, pair


def test_model_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    sample, corpus = [], []
    for i in range(300):
        words = [f"w{int(x)}" for x in rng.zipf(1.4, 30) if x < 200]
        if i % 3 == 0:
            words[3:3] = ["you", "vile", "thing"] if i % 2 else ["vile", "foul"]
        elif i % 4 == 0:
            words[2:2] = ["thing", "you"]
        (sample if i % 5 else corpus).append((int(i % 3 == 0), words))
    whole = [ws for _, ws in sample + corpus]
    rows = spark.createDataFrame([(c, " ".join(ws)) for c, ws in sample], "cls int, text string")
    docs = spark.createDataFrame([(" ".join(ws),) for ws in whole], "text string")
    model, (word, pair) = toxicity.build(rows, docs), brute_model(sample, whole)
    hashed = lambda *ws: toxicity.word_hashes(" ".join(ws))
    assert word and pair and any(p[1] not in word for p in pair) | any(p[1] in word for p in pair)
    want = {int(hashed(w)[0]): x for w, x in word.items()}
    assert dict(zip(model.words.tolist(), model.word_llr.tolist())) == pytest.approx(want)
    want = {int(toxicity.pair_hashes(hashed(v, w))[0]): x for (v, w), x in pair.items()}
    assert dict(zip(model.pairs.tolist(), model.pair_llr.tolist())) == pytest.approx(want)
    text = "w1 you vile thing, w2 unheard-of vile foul"
    ws = [w.decode() for w in text.encode().translate(toxicity.FOLD).split()]
    assert model.ratio(text) == pytest.approx(
        (sum(word.get(w, 0) for w in ws) + sum(pair.get(p, 0) for p in zip(ws, ws[1:]))) / len(ws))
    assert model.ratio("") == model.ratio(None) == 0.0


def test_toxicity_separates(spark):
    rng = np.random.default_rng(7)
    plain = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(600):
        words = rng.choice(plain, 80).tolist()
        if d % 5 == 0:
            for at in rng.choice(80, 4, replace=False):
                words[at] = rng.choice(["vile", "foul", "nasty"])
        rows.append((d, " ".join(words), int(d % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert all(got[d].predicted == y for d, _, y in rows)
    assert toxicity.drop_toxic(df, model).count() == 480


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (5, 0), (4, 0), (None, 1), (6, None), (77, 1)], "doc_id bigint, toxic int")
    for model in (toxicity.fit(odd, labels), toxicity.fit(odd, labels.where("doc_id IS NULL")),
                  toxicity.fit(empty, labels)):
        got = toxicity.score(odd, model).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        assert toxicity.drop_toxic(odd, model).columns == odd.columns
        assert toxicity.score(empty, model).collect() == []


def test_toxicity_ignores_labels_of_the_held_out_fold(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic"))
                               .otherwise(F.col("toxic")))
    a, b = (sorted(tuple(r) for r in toxicity.score(docs, toxicity.fit(docs, x)).collect()) for x in (labels, turned))
    assert a == b


def test_toxicity_counts_all_labelled_documents(spark, monkeypatch):
    """More than 3,000 documents of a class: all but the quarter for the curve are counted."""
    n = 4500
    docs = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.concat(
        F.when(F.col("id") % 2 == 0, "vile word w").otherwise("kind word w"), F.col("id")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic")) \
        .where((F.pmod(toxicity.crc32_of_id(F.col("doc_id")), F.lit(5)) != 0))
    counted, build = [], toxicity.build
    monkeypatch.setattr(toxicity, "build", lambda rows, whole: counted.append(rows.count()) or build(rows, whole))
    model = toxicity.fit(docs, labels)
    curve = labels.where(F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4)) == 0).count()
    assert counted == [labels.count() - curve]
    assert toxicity.score(docs, model).where("predicted <> CAST(doc_id % 2 = 0 AS INT)").count() == 0


def test_pairs_left_out_cannot_tell_the_classes_apart(spark, monkeypatch):
    """Whatever number of documents a kept pair must have, the model is the same."""
    rows = spark.createDataFrame([(i % 2, f"vile thing{i % 3} word{i} of w{i % 7}" if i % 2 else f"kind thing{i % 3} word{i} of w{i % 5}")
                                  for i in range(60)], "cls int, text string")
    models = []
    for least in (1, 4, 50):
        monkeypatch.setattr(toxicity, "LEAST", least)
        models.append(toxicity.build(rows, rows))
    for m in models[1:]:
        assert len(m.pairs) and m.pairs.tolist() == models[0].pairs.tolist()
        assert m.pair_llr.tolist() == models[0].pair_llr.tolist() and m.word_llr.tolist() == models[0].word_llr.tolist()


def test_batches_count_alike(spark, docs, monkeypatch):
    df = docs.select((F.col("doc_id") % 2).cast("int").alias("cls"), "text")
    whole = sorted(map(str, toxicity._counted(df).collect()))
    monkeypatch.setattr(toxicity, "_AT_ONCE", 50)
    assert sorted(map(str, toxicity._counted(df).collect())) == whole


def test_marked_ids(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    ids = df.where("doc_id % 10 = 3")
    got = toxicity._marked(df, ids, 2000)
    assert got.columns == ["doc_id", "may"] and got.count() == 20000
    assert got.where("doc_id % 10 = 3 AND NOT may").count() == 0
    assert got.where("doc_id % 10 <> 3 AND may").count() < 18000 / 8
    assert toxicity._marked(df, ids.limit(0), 0).where("may").count() == 0


def test_common_words_say_nothing_in_classes_of_unequal_size(spark):
    """Ordinary text has nine times the documents: its common words have met nearly all
    their neighbours, those of toxic text have not, which must not make them toxic."""
    rng = np.random.default_rng(3)
    rows = []
    for d in range(3000):
        toxic = d % 10 == 0
        words = [f"w{int(x)}" for x in rng.zipf(1.2, 120 if toxic else 60) if x < 3000]
        if toxic:
            words[5:5] = ["vile"]
        rows.append((int(toxic), " ".join(words)))
    df = spark.createDataFrame(rows, "cls int, text string")
    share = F.when(F.col("cls") == 0, 1 / 9).otherwise(1.0).alias("share")
    llr = lambda m: dict(zip(m.words.tolist(), m.word_llr))
    own, raw = llr(toxicity.build(df.select("cls", "text", share), df)), llr(toxicity.build(df, df))
    vile, common = int(toxicity.word_hashes("vile")[0]), [int(h) for h in toxicity.word_hashes("w1 w2 w3 w4 w5") if int(h) in raw]

    assert own[vile] > 3 and max(abs(own[h]) for h in common) < 0.7 * max(abs(raw[h]) for h in common)
