"""Line dedup by distinct-site spread.

A line that stands on many sites (sources) is boilerplate. For every line hash one
HyperLogLog sketch of its sites is built by aggregation (sketches merge map-side first, so
a line that a third of all documents share is no hot group; joins with the verdicts decide
such a line's rows where they lie). A line whose estimate is
clear of the threshold by more than the sketch's error is decided at once; lines near it
get their exact distinct count. Boilerplate is removed everywhere but at its first place
(the least doc_id and position), so no text is lost altogether.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.llm.common import ASCII_SPACE, cut, documents, free_name
from linewise.llm.ordered import join_spread

MIN_SITES = 5
LOG2_K = 12


def normal_line(line: Column) -> Column:
    """A line as compared: without white space at its ends."""
    return F.btrim(line, F.lit(ASCII_SPACE))


def _lines(docs: DataFrame) -> DataFrame:
    """doc (the row's identity), source, pos and the 128-bit hash of every line with a word."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"))
    split = docs.select(doc.alias("doc"), F.col("source").cast("string").alias("source"),
                        F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    line = split.withColumn("line", normal_line(F.col("line"))).where("line <> ''")
    return line.select("doc", "source", "pos", F.xxhash64("line").alias("h1"),
                       F.xxhash64(F.lit("second"), "line").alias("h2"))


def judged(lines: DataFrame, min_sites: int = MIN_SITES, log2_k: int = LOG2_K) -> DataFrame:
    """h1, h2, n (places), first (doc, pos) and bad (on at least ``min_sites`` distinct sites;
    null sites do not count) of every line that stands in several places."""
    key = ["h1", "h2"]
    sketched = cut(lines.groupBy(*key).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("source", log2_k)).alias("sites"),
        F.min(F.struct("doc", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1"), "line-sketches")
    # three standard errors of a merged sketch, and at least one site
    band = max(1, math.ceil(3 * 1.04 / math.sqrt(1 << log2_k) * min_sites))
    near = F.coalesce(F.col("sites").between(min_sites - band, min_sites + band), F.lit(False))
    exact = (join_spread(lines.select(*key, "source"), key, sketched, "n", near)
             .where("source IS NOT NULL").distinct()
             .groupBy(*key).agg(F.count("*").alias("exact")).where(F.col("exact") >= min_sites))
    clear = F.coalesce(F.col("sites") > min_sites + band, F.lit(False))
    return cut(sketched.join(exact, key, "left").select(
        *key, "n", "first", (clear | F.col("exact").isNotNull()).alias("bad")), "line-verdicts")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, log2_k: int = LOG2_K) -> DataFrame:
    """h1, h2 and first (doc, pos) of the lines on at least ``min_sites`` distinct sites."""
    return judged(lines, min_sites, log2_k).where("bad").select("h1", "h2", "first")


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, log2_k: int = LOG2_K) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``; all other columns and all rows
    stay, and the counts ``_n_lines`` and ``_n_removed`` are added last (with more underscores
    in front where ``docs`` has columns of these names).

    Blank lines are not lines and stay; a null text stays null, an empty one empty; a row
    without a source keeps its lines unless other sites make them boilerplate. Repeated rows
    (equal doc_id and text) count as one place, so all of them keep a first occurrence. Texts
    of any length are split whole; an empty table gives an empty one."""
    lines = cut(_lines(docs), "lines")  # texts are split once; hashes and places are read again
    verdicts = judged(lines, min_sites, log2_k)
    drops = (join_spread(lines.select("h1", "h2", "doc", "pos"), ["h1", "h2"], verdicts, "n", F.col("bad"), ("first",))
             .where(~(F.struct("doc", "pos").eqNullSafe(F.col("first"))))
             .groupBy(F.col("doc").alias("of")).agg(F.collect_set("pos").alias("drop")))
    text = F.col("text").cast("string")
    doc, of, drop = (free_name(docs, n) for n in ("_lw_doc", "_lw_of", "_lw_drop"))
    key = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"),
                   F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"))
    out = docs.withColumn(doc, key).join(drops.select(F.col("of").alias(of), F.col("drop").alias(drop)),
                                         F.col(doc).eqNullSafe(F.col(of)), "left")
    parts = F.split(text, "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(drop)),
                       lambda i: F.get(parts, i))
    n_lines = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"),
                              lambda ln: ln.rlike(r"[^\x20\x09-\x0D]"))).cast("bigint")
    counts = n_lines.alias(free_name(docs, "_n_lines")), \
        F.coalesce(F.size(F.col(drop)), F.lit(0)).cast("bigint").alias(free_name(docs, "_n_removed"))
    left = F.when(F.col(drop).isNull(), text).otherwise(F.array_join(kept, "\n")).alias("text")
    return out.select(*[left if c == "text" else F.col(f"`{c}`") for c in docs.columns], *counts)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines (with a word), n_removed, and the text that is left."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return drop_boilerplate(docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), "text")
