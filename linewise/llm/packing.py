"""Best-fit packing of documents into token sequences of fixed capacity.

Bulk-synchronous best-fit. Documents are cut into pieces of at most ``capacity`` tokens.
A piece longer than half the capacity opens a sequence of its own (no two such pieces can
share one); its free tail is a *gap*. Then supersteps run until every piece has a place:

1. all unplaced pieces and all gaps are range-sorted by size, largest first, gaps before
   pieces of equal size;
2. a successor sweep gives every piece the smallest gap that is still free and large
   enough. Read in that order, gaps and pieces are opening and closing brackets, and the
   wanted gap of a piece is its matching bracket, so the sweep is a clamped running count
   (local counts in every range partition, one summary row per partition carried over). A gap
   of size ``g`` opens ``g // s`` brackets, ``s`` being the largest piece that waits (one, if
   that is larger): so many pieces fit into it whatever their sizes, and short pieces need no
   more steps than long ones;
3. conflicts are resolved by rank: the count is the rank of a bracket on the stack of free
   ones, and the bracket and the piece that meet at one rank are paired. A rank sees at most
   one bracket and one piece of each size, so no group exceeds twice the capacity. The pieces
   of one gap, fewer than the capacity, are laid one after the other;
4. gaps shrink by what they took, gaps too small for any piece left are closed, and the next
   step runs. New sequences are opened for what exceeds the free space or fits into no gap any
   more, as few as that total needs.

Each step's state is a written table in the shared checkpoint folder, so a lost executor
costs only the current step; the driver sees a few totals per step.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewise.llm.common import crc32, cut, documents, ship_package
from linewise.llm.tokens import encoder

CAPACITY = 2048
END_ID = 0

PIECE_SCHEMA = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
                "ids binary")


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID,
                 tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece of each document's ids (``end_id`` appended).

    Columns: doc_id, piece (from 0), start (ids of the document before it), length,
    ids_crc32 (of the little-endian uint32 ids) and ids (those bytes; null when
    ``with_ids`` is false). A null or empty text is the single id ``end_id``. Repeated
    rows give repeated pieces. Columns of ``docs`` other than doc_id and text are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        width = 4 * capacity
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # a bounded number of texts at once
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc_id, ids in zip(part.column(0).to_pylist(),
                                       enc.encode(part.column(1).to_pylist())):
                    ids += end
                    for n, lo in enumerate(range(0, len(ids), width)):
                        own = ids[lo:lo + width]
                        rows.append((doc_id, n, lo // 4, len(own) // 4, crc32(own),
                                     own if with_ids else None))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE_SCHEMA)


def _swept(state: DataFrame) -> DataFrame:
    """Range-sort and number: adds ``pid`` and the bracket count before each row within its
    partition (``ex``) with its least value so far (``low``). ``open`` is the number of brackets
    that a gap opens (a piece: 0)."""
    names = ["kind", "id", "size", "open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, total, least = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            step = batch.column(3).to_numpy() - batch.column(0).to_numpy()  # gap +open, piece -1
            ex = total + np.cumsum(step) - step
            low = np.minimum.accumulate(np.concatenate([[least], ex]))[1:]
            total, least = int(ex[-1] + step[-1]), int(low[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ex), pid, np.int64)), *[batch.column(i) for i in range(4)],
                 pa.array(ex), pa.array(low)], names=["pid", *names, "ex", "low"])

    order = [F.col("size").desc(), F.col("kind"), F.xxhash64("id"), F.col("id")]
    return (state.select(*names).repartitionByRange(*order).sortWithinPartitions(*order)
            .mapInArrow(run, "pid bigint, kind int, id bigint, size bigint, open bigint, ex bigint, low bigint"))


def _matched(state: DataFrame) -> DataFrame:
    """One superstep: ``state`` (kind 0 gap / 1 piece, id, size, open) with, for a piece that
    found a place, ``with_id`` and ``offset`` (the gap, and the tokens of the same step before
    it), for a gap ``took`` (tokens)."""
    rows = cut(_swept(state), "pack-sweep")
    # one row per partition (its number is bounded by the shuffle partitions)
    part = rows.groupBy("pid").agg(F.sum(F.col("open") - F.col("kind")).alias("total"), F.min("low").alias("least"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = (part.withColumn("off", F.coalesce(F.sum("total").over(before), F.lit(0)))
             .withColumn("floor", F.min(F.col("off") + F.col("least")).over(before))
             .select("pid", "off", "floor"))
    level = F.col("off") + F.col("ex") - F.least(
        F.lit(0), F.col("off") + F.col("low"), F.coalesce("floor", F.lit(0)))
    ranks = F.when(F.col("kind") == 0, F.sequence(level + 1, level + F.col("open"))).otherwise(F.array(level))
    ranked = rows.join(F.broadcast(carry), "pid").select("kind", "id", "size", F.explode(ranks).alias("rank"))
    at = Window.partitionBy("rank").orderBy(F.desc("size"), "kind")
    near = F.lag(F.struct("kind", "id", "size")).over(at)
    # a piece that finds no free gap has no rank: it does not take part in the pairing
    met = cut(ranked.where("rank > 0").withColumn("near", near).where("kind = 1 AND near.kind = 0").select(
        "id", "size", F.col("near.id").alias("with_id"), F.col("near.size").alias("with_size"), "rank"), "pack-pairs")
    beside = Window.partitionBy("with_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    put = met.select("id", "with_id", (F.coalesce(F.sum("size").over(beside), F.lit(0)) - F.col("with_size")).alias("offset"))
    took = met.groupBy(F.col("with_id").alias("id")).agg(F.sum("size").alias("took")).withColumn("kind", F.lit(0))
    told = put.withColumn("kind", F.lit(1)).unionByName(took, allowMissingColumns=True)
    return cut(rows.select("kind", "id", "size").join(told, ["kind", "id"], "left"), "pack-match")


def _lacking(gaps: dict[int, int], items: dict[int, int]) -> int:
    """Tokens for which new sequences are needed now: what exceeds all the free space, or
    the pieces that after the coming sweep fit into no gap, if that is more (at least; a gap that
    takes several counts as if it took one). Both tables count rows by size, so they are bounded
    by the capacity."""
    most = max(items)
    total = sum(size * n for size, n in items.items())
    space = sum(size * n for size, n in gaps.items())
    stack, after, left = [], 0, {}
    for size in sorted({*gaps, *items}, reverse=True):
        if size in gaps:
            stack.append([size, gaps[size] * max(1, size // most)])
        n = items.get(size, 0)
        while n and stack:
            took = min(n, stack[-1][1])
            n -= took
            stack[-1][1] -= took
            after = max(after, stack[-1][0] - size)
            if not stack[-1][1]:
                stack.pop()
        if n:
            left[size] = n
    after = max([after, *(size for size, _ in stack)])
    unfit = sum(size * n for size, n in left.items() if size > after)
    return max(total - space, unfit, 0)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Places for pieces (id unique, size from 1 to ``capacity``): id, sequence_id, offset.

    Within a sequence the pieces lie gaplessly from offset 0. An empty table gives an
    empty result.
    """
    spark = pieces.sparkSession
    big = 2 * F.col("size") > capacity
    placed = [pieces.where(big).select("id", F.col("id").alias("sequence_id"),
                                       F.lit(0).cast("bigint").alias("offset"))]
    gaps = pieces.where(big & (F.col("size") < capacity)).select(
        F.lit(0).alias("kind"), "id", (F.lit(capacity) - F.col("size")).alias("size"))
    items = pieces.where(~big).select("id", F.col("size").cast("bigint").alias("size"))

    state = items.select(F.lit(1).alias("kind"), "id", "size").unionByName(gaps)
    put, opened = [], 0
    while True:
        # sizes are at most the capacity, so this table is bounded by it, not by the data
        count = {(r.kind, r.size): r.n for r in
                 state.groupBy("kind", "size").agg(F.count("*").alias("n")).collect()}
        waiting = {size: n for (kind, size), n in count.items() if kind}
        if not waiting:
            break
        least, most = min(waiting), max(waiting)
        gaps = {size: n for (kind, size), n in count.items() if not kind and size >= least}
        new = -(-_lacking(gaps, waiting) // capacity)
        state = state.where((F.col("kind") == 1) | (F.col("size") >= least))
        if new:
            state = state.unionByName(spark.range(opened + 1, opened + new + 1).select(
                F.lit(0).alias("kind"), (-F.col("id")).alias("id"),
                F.lit(capacity).cast("bigint").alias("size")))
            opened += new
        brackets = F.when(F.col("kind") == 0, F.greatest(F.lit(1), F.floor(F.col("size") / most))).otherwise(0)
        done = _matched(state.withColumn("open", brackets.cast("bigint")))
        put.append(done.where("kind = 1 AND with_id IS NOT NULL").select(
            "id", F.col("with_id").alias("sequence_id"), (F.lit(capacity) + F.col("offset")).alias("offset")))
        state = done.where("kind = 0 OR with_id IS NULL").select(
            "kind", "id", (F.col("size") - F.coalesce("took", F.lit(0))).alias("size")).where("size > 0")
    return reduce(DataFrame.unionByName, placed + put)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID,
         tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pack whole documents into sequences: the columns of :func:`token_pieces` with
    sequence_id and offset. Every piece of every row is placed exactly once. Null and empty
    texts are one piece, the end id alone; repeated rows are placed each for itself; an empty
    table gives no sequence."""
    pieces = cut(token_pieces(docs, capacity, end_id, tokenizer, with_ids)
                 .withColumn("_id", F.monotonically_increasing_id()), "pack-pieces")
    spots = place(pieces.select(F.col("_id").alias("id"), F.col("length").alias("size")), capacity)
    out = pieces.join(spots, pieces["_id"] == spots["id"]).drop("_id", "id")
    return out if with_ids else out.drop("ids")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves (from ``pack(..., with_ids=True)``): sequence_id,
    n_tokens, ids (little-endian uint32 bytes) and the pieces as (doc_id, piece, offset).
    A sequence holds at most its capacity, so its group is bounded."""
    one = F.struct("offset", "doc_id", "piece", "length", "ids")
    return (packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(one)).alias("_p"))
            .select("sequence_id",
                    F.aggregate("_p", F.lit(0).cast("bigint"), lambda a, p: a + p["length"]).alias("n_tokens"),
                    F.expr("unhex(array_join(transform(_p, p -> hex(p.ids)), ''))").alias("ids"),
                    F.transform("_p", lambda p: F.struct(
                        p["doc_id"].alias("doc_id"), p["piece"].alias("piece"),
                        p["offset"].alias("offset"))).alias("pieces")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of packing all documents; contract columns of the query."""
    return pack(documents(spark, sf_dir)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
