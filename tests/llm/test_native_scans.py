"""Quality rules and license scans on odd rows, long texts and small cases."""

import re

from linewise.llm.licenses import TEMPLATES, matches, scan, template_words
from linewise.llm.quality import quality


def brute_repeats(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = [tuple(w[i:i + size]) for i in range(len(w) - size + 1)]
    many = {x for x in wins if wins.count(x) > 1} if len(wins) < 3000 else None
    if many is None:
        from collections import Counter
        c = Counter(wins)
        many = {x for x in wins if c[x] > 1}
    return len({i + k for i, x in enumerate(wins) if x in many for k in range(size)})


def test_repeats(spark):
    texts = ["a b c d e", "a b c d e a b c d e", "a a a a a a", "a a a a a", "a b c d e f a b c d e f g", "",
             "x " * 300, " ".join("abcdefg"[i * i % 7] for i in range(200)), "a b c d e q a b c d e r b c d e q"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality(df).collect()}
    assert got == {i: brute_repeats(t) for i, t in enumerate(texts)}


def test_quality_odd_rows(odd, empty):
    rows = quality(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    for d in (1, 2, 3):
        assert by[d].n_words == 0 and by[d].base_failed and not by[d].kept
    assert by[4].n_words == 120_000
    assert by[5].kept and not by[-8].kept
    assert quality(empty).collect() == []


def test_no_python_in_plans(spark, docs):
    for df in (quality(docs), scan(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_license_cases(spark):
    texts = [TEMPLATES["mit"], "RELEASED under the Mit license.", "released under the license", "cc-by cc by CC\nBY",
             "All Rights Reserved. all rights\nreserved", None, "", "x\n" + TEMPLATES["apache-2.0"] + " and more words",
             "general public licenses", "a " * 5 + TEMPLATES["cc-by-nc-4.0"]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in scan(df).collect()}
    assert got[0].labels == got[1].labels == "mit" and got[0].n_base == 0 and got[0].score == 1.0
    assert got[2].labels == "" and got[2].score == 0.0
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].base_labels) == (3, 0, 4, "cc-by")
    assert (got[4].n_base, got[4].first_word, got[4].last_word, got[4].labels) == (2, 0, 3, "reserved")
    assert got[5].n_words == 0 and got[6].first_word is None
    assert got[7].labels == "apache-2.0" and got[8].n_base == 0
    assert got[9].labels == "cc-by,cc-by-nc-4.0"


def wrapped():
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy\n"
           "of this software and associated documentation files (the \"Software\"), to deal\n"
           "in the Software without restriction")
    bsd = ("// Redistribution and use in source and binary forms, with or without\n"
           "// modification, are permitted provided that the following conditions are\n// met:")
    gpl = (" * This program is free software: you can redistribute it and/or modify\n"
           " * it under the terms of the GNU General Public License as published by\n"
           " * the Free Software Foundation, either version 3 of the License, or")
    mpl = ("# This Source Code Form is subject to the terms of the Mozilla Public\n"
           "# License, v. 2.0. If a copy of the MPL was not distributed with this")
    ends = ("w " * 200 + TEMPLATES["mpl-2.0"]).replace("the Mozilla", "the\nMozilla") + " w" * 200
    texts = [mit, bsd, gpl, mpl, "x y\n\n" + mpl.replace("\n", "\r\n"), ends, mit.replace("\n", "\n\n"),
             mpl.replace("\n", "\n" + "w " * 40 + "\n"), TEMPLATES["mpl-2.0"].replace("subject", "") + "\nsubject to",
             "\n".join(TEMPLATES["gpl-text"].split()), TEMPLATES["mit"].replace(" ", "\n")]
    return texts


def test_wrapped_notices(spark):
    df = spark.createDataFrame(list(enumerate(wrapped())), "doc_id bigint, text string")
    got = {r.doc_id: r for r in scan(df).collect()}
    assert [got[i].labels for i in range(11)] == [
        "mit-text", "bsd-text", "gpl,gpl-text", "mpl-2.0", "mpl-2.0", "mpl-2.0", "", "", "mpl-2.0", "gpl,gpl-text", "mit"]
    assert got[0].score == got[1].score == got[5].score == 1.0 and got[6].score == 0.0
    assert got[8].score == 15 / 16  # the line alone matches


def test_join_equals_brute_force(spark):
    import random

    rnd = random.Random(3)
    vocab = [f"v{i}" for i in range(30)]
    templates = {f"t{i}": rnd.sample(vocab, rnd.randint(1, 12)) for i in range(25)}
    blocks = [(i, rnd.sample(vocab, rnd.randint(1, 25))) for i in range(150)]
    df = spark.createDataFrame(blocks, "row bigint, words array<string>")
    for threshold in (0.5, 0.8, 1.0):
        got = {(r.row, r.label) for r in matches(df, templates, threshold).collect()}
        assert got == {(i, t) for i, b in blocks for t, ws in templates.items()
                       if len(set(b) & set(ws)) >= threshold * len(set(ws)) - 1e-9}


def test_license_odd_rows(odd, empty):
    assert scan(odd).count() == odd.count()
    assert scan(odd, templates={}).count() == odd.count()
    assert scan(empty).collect() == []
    assert template_words("CC BY-NC 4.0") == ["cc", "by", "nc", "4", "0"]


PROSE = ["The quick team released a new song\nunder grey skies\nhe went to mit and then\ndrove with no license at all\nto the sea",
         "released\nwords go on and on and on under\nthe mit license", "the\nlicense\nmit\nunder\nreleased",
         "under the work\u212a license mit released", "RELEASED UNDER THE MIT LICEN\u017fE", "Released under the\nM\u0130T License"]


def test_a_short_template_needs_its_words_close_by(spark):
    df = spark.createDataFrame(list(enumerate(PROSE)), "doc_id bigint, text string")
    got = {r.doc_id: (r.labels, r.score) for r in scan(df).collect()}
    assert got == {0: ("", 0.0), 1: ("", 0.0), 2: ("mit", 1.0), 3: ("mit", 1.0), 4: ("", 0.0), 5: ("", 0.0)}
    # letters outside A-Z are not folded: the Kelvin sign is no k
    kelvin = scan(spark.createDataFrame([(1, "wor\u212a")], "doc_id bigint, text string"), {}, {"t": "work"})
    assert kelvin.first().labels == ""


def test_sql_finds_wrapped_notices_too(spark):
    import duckdb
    import pandas as pd
    from linewise.llm.oracle import license_sql

    texts = [*wrapped(), *PROSE, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = scan(df)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({license_sql()})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
