"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are the benchmark items' windows of ``window`` consecutive words (an item of
fewer words is one window). For each window length m there is one searcher. Its alphabet
is words, its block two words (one word when m is 1):

* the shift table maps a block to how far the search may jump when the block ends at the
  current position: the least distance of the block from the end of any test string, and
  m - 1 for a block that is in none;
* where the shift is 0, the block is some test string's last one, and the suffix bucket of
  that block lists the test strings that end so;
* each string of the bucket is compared word by word with the document.

The distinct test strings are a written table with numbered blocks: a running total of their
bytes in one global order, divided by ``block_bytes``. A long item's strings lie in as many
blocks as they need, so no block exceeds the bound by more than one string. One block is read
and sent to every task at a time; documents are scanned once per block and each block's result
is written, so plans don't grow and a benchmark of any size works. Usually there is one block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.llm.common import cut, documents, ship_package, split_words_bytes, table
from linewise.llm.ordered import before, ordered
from linewise.plans.materialize import new_folder

WINDOW = 10
BLOCK_BYTES = 4 << 20


class Searcher:
    """Wu-Manber search for strings of ``m`` words each."""

    def __init__(self, m: int):
        self.m = m
        self.block = 2 if m > 1 else 1
        self.strings: dict[tuple[bytes, ...], list[str]] = defaultdict(list)
        self.shift: dict = {}
        self.bucket: dict = {}

    def build(self) -> None:
        """Fill the shift and suffix tables from the strings."""
        for s in self.strings:
            for end in range(self.block, self.m + 1):
                b = s[end - 2:end] if self.block == 2 else s[0]
                if self.m - end < self.shift.get(b, self.m):
                    self.shift[b] = self.m - end
            self.bucket.setdefault(s[-2:] if self.block == 2 else s[0], []).append(s)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(first word, item ids) of every occurrence."""
        m, n, shift, bucket = self.m, len(words), self.shift.get, self.bucket
        if self.block == 1:
            for i, w in enumerate(words):
                if w in bucket:
                    yield i, self.strings[(w,)]
            return
        most, i = m - 1, m - 1
        while i < n:
            b = (words[i - 1], words[i])
            jump = shift(b, most)
            if jump:
                i += jump
                continue
            first = i - m + 1
            here = tuple(words[first:i + 1])
            for s in bucket[b]:
                if s == here:
                    yield first, self.strings[s]
                    break
            i += 1


def windows_of(text: str | None, window: int = WINDOW) -> set[bytes]:
    """The distinct test strings of an item, words joined by a blank."""
    words = split_words_bytes(text)
    m = min(window, len(words))
    return {b" ".join(words[i:i + m]) for i in range(len(words) - m + 1)} if m else set()


def searchers(strings: list[tuple[bytes, str]]) -> list[Searcher]:
    """Searchers by window length for (test string, item id) pairs."""
    by_length: dict[int, Searcher] = {}
    one: dict[bytes, bytes] = {}  # equal words are held once
    for string, item_id in strings:
        words = tuple(one.setdefault(w, w) for w in string.split(b" "))
        by_length.setdefault(len(words), Searcher(len(words))).strings[words].append(item_id)
    for s in by_length.values():
        s.build()
    return list(by_length.values())


def scan(text: str | None, own: list[Searcher]) -> tuple[int, list[int], list[int], list[str]]:
    """Number of words, first and last words of the merged hit spans, item ids found."""
    words = split_words_bytes(text)
    spans, found = [], set()
    for s in own:
        for first, ids in s.search(words):
            spans.append((first, first + s.m - 1))
            found.update(ids)
    return len(words), *_joined(sorted(spans)), sorted(found)


def found_in(text: str | None, own: list[Searcher]) -> bool:
    words = split_words_bytes(text)
    return any(True for s in own for _ in s.search(words))


def _joined(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """First and last words of sorted spans after joining those that touch or overlap."""
    firsts: list[int] = []
    lasts: list[int] = []
    for first, last in spans:
        if lasts and first <= lasts[-1] + 1:
            lasts[-1] = max(lasts[-1], last)
        else:
            firsts.append(first)
            lasts.append(last)
    return firsts, lasts


def strings_of(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The written table of distinct test strings: string (binary), item_id, block."""
    ship_package(benchmark.sparkSession)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"),
                             F.col("text").cast("string").alias("text")).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                strings = list(windows_of(text.as_py(), window))
                for lo in range(0, len(strings), 10_000):
                    part = strings[lo:lo + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([item_id] * len(part))],
                                                     names=["string", "item_id"])

    # equal strings of many items lie apart too: the order is by both
    order = [F.xxhash64("string", "item_id"), F.col("string"), F.col("item_id")]
    rows = ordered(items.mapInArrow(run, "string binary, item_id string").distinct(), order, "bench-strings")
    size = F.octet_length("string") + F.octet_length("item_id")
    return cut(before(rows, [], order, size, "bytes").select(
        "string", "item_id", F.floor(F.col("bytes") / block_bytes).cast("int").alias("block")), "bench-blocks")


def _blocks(strings: DataFrame) -> Iterator[list[tuple[bytes, str]]]:
    """The blocks of test strings, one at a time; at least one, which may be empty."""
    for b in range((strings.agg(F.max("block")).first()[0] or 0) + 1):
        rows = strings.where(F.col("block") == b).select("string", "item_id").toArrow()
        yield list(zip(rows["string"].to_pylist(), rows["item_id"].to_pylist()))


def _scan_block(docs: DataFrame, block: list[tuple[bytes, str]]) -> DataFrame:
    """Scan all rows of ``docs`` (row, doc_id, text) for one block of the test strings."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, longs = searchers(shared.value), pa.list_(pa.int64())
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, firsts, lasts, found = zip(*(scan(t, own) for t in part.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()),
                     pa.array(firsts, longs), pa.array(lasts, longs),
                     pa.array(found, pa.list_(pa.string()))],
                    names=["row", "doc_id", "n_words", "firsts", "lasts", "items"])

    return docs.select("row", "doc_id", "text").mapInArrow(
        run, "row bigint, doc_id bigint, n_words bigint, firsts array<bigint>, "
             "lasts array<bigint>, items array<string>")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Contamination of whole documents: doc_id, n_words, n_hit (words inside any
    occurrence), n_items, items_sha256 (of the found item_ids, sorted as strings and
    comma-joined; of the empty text if none), contaminated, and the hit spans (firsts and
    lasts: word positions).

    Null or empty texts have no words; null items are skipped, an item with a null
    item_id has the id ``null``; repeated items count once; repeated documents give
    repeated rows; an empty benchmark contaminates nothing.
    """
    ship_package(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                      F.col("text").cast("string").alias("text"))
    strings = strings_of(benchmark, window, block_bytes)
    if strings.where("block > 0").isEmpty():
        found = _scan_block(own.select(F.lit(0).cast("bigint").alias("row"), "*"), next(_blocks(strings)))
    else:
        own = cut(own.withColumn("row", F.monotonically_increasing_id()), "bench-docs")
        folder = new_folder(docs.sparkSession, "bench-hits")
        for b, block in enumerate(_blocks(strings)):  # of a block, only its finds are kept, and once all rows
            one = _scan_block(own, block)
            (one if b == 0 else one.where(F.size("items") > 0)).write.parquet(f"{folder}/block={b}")
        found = docs.sparkSession.read.schema(one.schema).option("recursiveFileLookup", "true").parquet(folder)
        spans = F.flatten(F.collect_list(F.arrays_zip("firsts", "lasts")))
        found = _merge_spans(found.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            F.array_sort(spans).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    n_hit = F.aggregate(F.arrays_zip("firsts", "lasts"), F.lit(0).cast("bigint"),
                        lambda n, s: n + s["lasts"] - s["firsts"] + 1)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("firsts") > 0).alias("contaminated"), "firsts", "lasts")


def _merge_spans(rows: DataFrame) -> DataFrame:
    """Join touching and overlapping spans (sorted ``spans`` of each row) in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            both = [_joined([(s["firsts"], s["lasts"]) for s in spans])
                    for spans in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a for a, _ in both], longs),
                 pa.array([b for _, b in both], longs), batch.column(3)],
                names=["doc_id", "n_words", "firsts", "lasts", "items"])

    return rows.select("doc_id", "n_words", "spans", "items").mapInArrow(
        run, "doc_id bigint, n_words bigint, firsts array<bigint>, lasts array<bigint>, "
             "items array<string>")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of the benchmark occurs. Null
    and empty texts have no words and stay, so do repeated rows; null items and an empty
    benchmark take nothing away; an empty table stays empty. What one block of the test
    strings leaves is written before the next block is searched."""
    ship_package(docs.sparkSession)
    strings = strings_of(benchmark, window, block_bytes)
    for b, block in enumerate(_blocks(strings)):
        docs = (cut(docs, "bench-left") if b else docs).where(_free_of(block, docs))
    return docs


def _free_of(block: list[tuple[bytes, str]], docs: DataFrame) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    @F.pandas_udf("boolean")
    def free(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = searchers(shared.value)
        for texts in batches:
            yield pd.Series([not found_in(t, own) for t in texts], dtype="bool")

    return free(F.col("text").cast("string"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
