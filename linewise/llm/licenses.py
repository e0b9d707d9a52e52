"""License scans: fixed phrases, and an exact set-similarity join with notice templates.

Text blocks are lines and, for notices that are wrapped, runs of consecutive lines. A run
belongs to one template of ``n`` words: from a line break it takes the last ``n - 1`` words of
the line before and at most ``REACH`` (2) times ``n - 1`` words of the lines after, up to a
line without words (a paragraph's end). So it has fewer than three times the template's own
words, whatever other templates there are. A run counts only for its template, and only if no
single line of the text matches that. A template matches a block when at
least ``threshold`` of the template's distinct words are in the block (containment). Only
words of the (fixed, small) template vocabulary can overlap, so a block is the set of those
among its words. Words are lower-cased in A-Z only.
The join is exact and uses built-in functions only:

* words are ordered by their frequency over all blocks, the rarest first;
* prefix filter: with a least overlap of ``need`` words, a matching pair shares a word
  among the first ``|T| - need + 1`` of the template and the first ``|B| - need + 1`` of
  the block, so only those words are joined;
* length filter: a block with fewer than ``need`` words cannot match (a text without ``need``
  of a template's words has no run for it);
* positional filter: a pair that meets at positions i and j can still reach at most
  ``1 + min(|T| - i - 1, |B| - j - 1)``;
* survivors are verified by their whole intersection.

Each document's text is read once, in one projection; what the join moves is the rare
blocks that pass the filters. Templates are a parameter; their table is sent to all tasks
and must hold at most ``MAX_TEMPLATES`` rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.llm.common import cut, documents, let, lower_ascii

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.9
MAX_TEMPLATES = 10_000
REACH = 2

#: Fixed values of the query: phrase and label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public license notices: label and text.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "mit": "Released under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
                "software and associated documentation files",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms "
                "of the GNU General Public License as published by the Free Software Foundation",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are "
                "permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


def template_words(text: str) -> list[str]:
    return [w for w in re.split(WORD_GAP, "".join(c.lower() if c.isascii() else c for c in text)) if w]


def _phrase_starts(words: Column, phrase: str) -> Column:
    """Positions where the phrase's words stand consecutively."""
    parts = phrase.split()
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    here = lambda i: F.lit(True) if not parts else _all(
        [F.get(words, i + k) == F.lit(p) for k, p in enumerate(parts)])
    found = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)
    return F.when((F.size(words) >= len(parts)) & joined.contains(f" {phrase} "), found) \
        .otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _runs(lines: Column, vocab: Column, templates: Column) -> Column:
    """only (a label) and words (the template's words in the run) of every run of ``lines`` (word
    arrays) that has the least number of its template's words; ``vocab``: all vocabulary words
    of the text."""
    def of(t: Column) -> Column:
        def more(run: Column, ws: Column) -> Column:
            goes = run["open"] & (F.size(ws) > 0) & (run["left"] > 0)
            return F.struct(
                F.when(goes, run["left"] - F.size(ws)).otherwise(run["left"]).alias("left"), goes.alias("open"),
                F.when(goes, F.concat(run["words"], F.slice(ws, F.lit(1), F.greatest(run["left"], F.lit(0)))))
                .otherwise(run["words"]).alias("words"))

        def from_line(ws: Column, i: Column) -> Column:
            side = F.least(F.size(ws), t["n"] - 1)
            start = F.struct((t["n"] * REACH - REACH).alias("left"), F.lit(True).alias("open"),
                             F.slice(ws, F.size(ws) - side + 1, side).alias("words"))
            run = F.aggregate(F.slice(lines, i + 2, F.greatest(t["n"] * REACH - REACH, F.lit(0))), start, more)["words"]
            # a line without the template's words starts no run: the notice starts later
            return F.when(F.size(F.array_intersect(t["words"], ws)) > 0, let(
                F.array_intersect(t["words"], run), lambda b: F.when(F.size(b) >= t["need"], b)))

        return F.transform(F.filter(F.transform(lines, from_line), lambda b: b.isNotNull()),
                           lambda b: F.struct(t["label"].alias("only"), b.alias("words")))

    able = F.filter(templates, lambda t: F.size(F.array_intersect(t["words"], vocab)) >= t["need"])
    return F.flatten(F.transform(able, of))


def _scanned(docs: DataFrame, phrases: Mapping[str, str], vocabulary: list[str], templates: Column) -> DataFrame:
    """doc_id, n_words, base (label and starts of every phrase), blocks (the vocabulary words
    of every line that has any) and runs (see :func:`_runs`)."""
    text = lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit("")))
    lines = F.transform(F.split(text, "\n"),
                        lambda ln: F.filter(F.split(ln, WORD_GAP), lambda w: w != ""))
    vocab = F.array(*[F.lit(w) for w in vocabulary]) if vocabulary else F.array().cast("array<string>")

    def of(by_line: Column) -> Column:
        return F.struct(
            let(F.flatten(by_line), lambda words: F.struct(
                F.size(words).cast("bigint").alias("n_words"),
                F.array(*[F.struct(F.lit(label).alias("label"), _phrase_starts(words, p).alias("starts"))
                          for p, label in phrases.items()])
                .cast("array<struct<label:string,starts:array<int>>>").alias("base"),
                let(F.array_intersect(vocab, words), lambda own: _runs(by_line, own, templates)).alias("runs"))).alias("own"),
            F.filter(F.transform(by_line, lambda ws: F.array_intersect(vocab, ws)), lambda b: F.size(b) > 0).alias("blocks"))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), let(lines, of).alias("s")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "s.own.n_words", "s.own.base", "s.blocks", "s.own.runs")


def _template_array(templates: Mapping[str, list[str]], threshold: float) -> Column:
    """label, n (words), words (distinct) and need of every template with words."""
    rows = [F.struct(F.lit(label).alias("label"), F.lit(len(ws)).alias("n"),
                     F.array(*[F.lit(w) for w in sorted(set(ws))]).alias("words"),
                     F.lit(_need(ws, threshold)).alias("need")) for label, ws in templates.items() if ws]
    return F.array(*rows) if rows else F.array().cast("array<struct<label:string,n:int,words:array<string>,need:int>>")


def _need(words: list[str], threshold: float) -> int:
    """The least number of distinct words in common."""
    return max(1, math.ceil(threshold * len(set(words)) - 1e-9))


def _templates(spark: SparkSession, templates: Mapping[str, list[str]], order: list[str],
               threshold: float) -> DataFrame:
    """label, words (rarest first), need: one row per template with words."""
    rank = {w: i for i, w in enumerate(order)}
    rows = [F.struct(F.lit(label).alias("label"),
                     F.array(*[F.lit(w) for w in sorted(set(ws), key=rank.__getitem__)]).alias("t_words"),
                     F.lit(_need(ws, threshold)).alias("need"))
            for label, ws in templates.items() if ws]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def matches(blocks: DataFrame, templates: Mapping[str, list[str]], threshold: float = THRESHOLD) -> DataFrame:
    """The set-similarity join: ``blocks`` (row, words, and ``only``, the one label that the
    block is compared with, null for all) to row, label, containment for every pair that
    reaches the threshold (one row per block and template)."""
    spark = blocks.sparkSession
    if "only" not in blocks.columns:
        blocks = blocks.withColumn("only", F.lit(None).cast("string"))
    counted = blocks.select(F.explode("words").alias("w")).groupBy("w").count()
    frequency = {r.w: r["count"] for r in counted.collect()}  # at most the vocabulary
    order = sorted({w for ws in templates.values() for w in ws}, key=lambda w: (frequency.get(w, 0), w))
    table = F.broadcast(_templates(spark, templates, order, threshold))  # at most MAX_TEMPLATES rows
    least = min(_need(ws, threshold) for ws in templates.values() if ws)
    ordered = F.array_intersect(F.array(*[F.lit(w) for w in order]), F.col("words"))
    sides = (blocks.where(F.size("words") >= least)
             .select("row", "only", F.monotonically_increasing_id().alias("block"), ordered.alias("words"))
             .select("row", "only", "block", "words", F.posexplode("words").alias("j", "w")))
    prefixes = table.select("label", "t_words", "need", F.posexplode("t_words").alias("i", "w")) \
        .where(F.col("i") <= F.size("t_words") - F.col("need"))
    reach = 1 + F.least(F.size("t_words") - F.col("i"), F.size("words") - F.col("j")) - 1
    met = sides.join(prefixes, "w").where(
        (F.col("only").isNull() | (F.col("only") == F.col("label")))
        & (F.size("words") >= F.col("need")) & (F.col("j") <= F.size("words") - F.col("need"))
        & (reach >= F.col("need")))
    overlap = F.size(F.array_intersect("words", "t_words"))
    return (met.withColumn("overlap", overlap).where(F.col("overlap") >= F.col("need"))
            .groupBy("row", "block", "label").agg(F.max(F.col("overlap") / F.size("t_words")).alias("containment"))
            .drop("block"))


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES,
         templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """License findings per row: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score (1 with a base phrase, else the best containment that reached the
    threshold, else 0).

    Null or empty texts have no words and no findings; repeated rows give repeated rows;
    no template or no document gives no labels of the join. Columns other than doc_id and
    text are ignored.
    """
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    words = {label: template_words(t) for label, t in templates.items()}
    vocabulary = sorted({w for ws in words.values() for w in ws})
    rows = cut(_scanned(docs, phrases, vocabulary, _template_array(words, threshold)), "license-rows")
    starts = F.flatten(F.transform("base", lambda b: b["starts"]))
    base_labels = F.array_sort(F.array_distinct(F.transform(
        F.filter("base", lambda b: F.size(b["starts"]) > 0), lambda b: b["label"])))
    base = rows.select(
        "row", "doc_id", "n_words", F.size(starts).cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"), base_labels.alias("b"))
    if vocabulary:
        one = rows.select(F.struct("row", F.lit(False).alias("run")).alias("row"), F.explode("blocks").alias("words"),
                          F.lit(None).cast("string").alias("only"))
        run = rows.select(F.struct("row", F.lit(True).alias("run")).alias("row"), F.explode("runs").alias("r")) \
            .select("row", "r.words", "r.only")
        best = lambda by_run: F.max(F.when(F.col("row.run") == by_run, F.col("containment")))
        found = matches(one.unionByName(run), words, threshold) \
            .groupBy(F.col("row.row").alias("row"), "label").agg(F.coalesce(best(False), best(True)).alias("containment")) \
            .groupBy("row").agg(F.collect_set("label").alias("m"), F.max("containment").alias("best"))
        base = base.join(found, "row", "left")
    else:
        base = base.withColumns({"m": F.lit(None).cast("array<string>"), "best": F.lit(None).cast("double")})
    both = F.array_sort(F.array_union("b", F.coalesce("m", F.array().cast("array<string>"))))
    return base.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("b", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
