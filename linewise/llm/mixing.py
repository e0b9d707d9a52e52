"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order (by a hash of the document),
repeated in epochs as far as its target needs. A document's virtual finish time is the
source's cumulative tokens, the document included, divided by the source's target weight.
All queues merged by finish time are the mix: the documents are range-sorted by it over the
whole table and the running total is truncated at the budget.

The weight of a source is its target, so the budget is spent at virtual time 1 exactly. Of
the documents then in service (begun before, finishing later; one per source at most) the
part up to that time is taken. Each source thus comes within one word of its target
whatever the length of its documents.

Targets: the budget is shared by the sources' weights; a target over ``most`` times the
source's size stops there and its excess is shared again among the others, by weight,
until none is above. Each round is one aggregate over the table of sources; one row of it
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.llm.common import cut, documents
from linewise.llm.ordered import before, ordered

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` (null: 0)."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            most: int = MOST) -> DataFrame:
    """source, source_size, sid (number of the source by code point, null last) and target
    (double), from the sources and their sizes. A source without words has the target 0."""
    order = [F.col("source").isNull(), F.col("source")]
    ranked = ordered(sizes, order, "mix-sources")
    ranked = before(ranked, [], order, F.lit(1), "sid").drop("part")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = cut(ranked.withColumn("w", F.element_at(cycle, (F.col("sid") % len(weights) + 1).cast("int")))
                 .withColumn("most", F.col("source_size") * most), "mix-ranked")
    budget = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, None  # words per unit of weight; weight of the sources at their most
    while True:
        got = ranked.agg(*[F.sum(F.when(at_most, c)).alias(name)
                           for at_most, c, name in ((_full(level), F.col("most"), "spent"),
                                                    (_full(level), F.col("w"), "done"),
                                                    (~_full(level), F.col("w"), "open"))]).first()
        done = got["done"] or 0
        if got["open"] is None or done == full:
            break
        level, full = (budget - (got["spent"] or 0)) / got["open"], done
    target = F.when(_full(level), F.col("most").cast("double")).otherwise(F.lit(level) * F.col("w"))
    return ranked.select("source", "source_size", "sid", target.alias("target"))


def _full(level: float) -> Column:
    """Does the source reach its most at ``level`` words per unit of weight?"""
    return F.col("most") <= F.lit(level) * F.col("w")


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS,
        share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """The mix: one row per service of a document, with uid (the row of ``docs``), doc_id,
    source, size, source_size, target, epoch (from 0), finish (virtual time), taken (words)
    and position (words of the mix before it). A document that is not taken has one row
    with taken 0 and no position.

    ``size`` is an expression over ``docs`` (the number of words unless given). A null text
    or source is a text without words and a source of its own; repeated rows are served one
    by one; an empty table gives an empty mix. Other columns are ignored. Reruns agree: the
    shuffled order is by md5 of seed and doc_id, then by hashes of the text and the source;
    rows that agree in all of these are interchangeable."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = n_words(F.col("text")) if size is None else size
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                           F.col("source").cast("string").alias("source"), size.cast("bigint").alias("size"),
                           F.substring(key, 1, 16).alias("at"), F.xxhash64(text).alias("tie")), "mix-sizes")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    sources = cut(sources, "mix-targets")
    named = sources.withColumnRenamed("source", "_source")
    known = rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # the last key tells equal rows apart, so that many of them do not meet in one range
    order = [F.col(c) for c in ("sid", "at", "tie", "uid")]
    queues = ordered(known.withColumn("uid", F.monotonically_increasing_id()), order, "mix-queues")
    queues = before(queues, ["sid"], order, F.col("size"), "earlier").drop("part", "at", "tie")
    served = queues.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    begin = F.col("epoch") * F.col("source_size") + F.col("earlier")
    offered = F.greatest(F.lit(0), F.least(F.col("size"), F.ceil("target") - begin)).cast("bigint")
    finish = F.when(F.col("target") > 0, (begin + F.col("size")) / F.col("target")).otherwise(F.lit(float("inf")))
    served = (served.withColumn("offered", offered).withColumn("finish", finish).drop("earlier")
              .where("epoch = 0 OR offered > 0"))
    order = [F.col(c) for c in ("finish", "sid", "uid", "epoch")]
    queue = before(ordered(served, order, "mix-order"), [], order, F.col("offered"), "position")
    budget = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    taken = F.greatest(F.lit(0), F.least(F.col("offered"), F.floor(F.lit(float(budget))) - F.col("position")))
    return (queue.withColumn("taken", taken.cast("bigint"))
            .withColumn("position", F.when(F.col("taken") > 0, F.col("position")))
            .select("uid", "doc_id", "source", "size", "source_size", "target", "epoch", "finish", "taken", "position"))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, over all epochs."""
    return (mix(documents(spark, sf_dir)).groupBy("uid", "doc_id", "size", "source_size", "target")
            .agg(F.sum("taken").alias("taken")).drop("uid"))
