"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (one to three letters, words
padded with a blank), most frequent first. A language's profile is counted over all its
training documents; a document's profile over its whole text. The out-of-place distance
adds, for each n-gram of the document's profile, how far its rank is from its rank in the
language's profile (``size`` if it is not there). The nearest language wins.

Profiles hold ``size`` n-grams per language, so the table sent to the tasks grows with the
number of languages only (checked against ``MAX_LANGS``). N-grams are integers: three
code points of 21 bits each.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewise.llm.common import crc32_of_id, cut, documents, ship_package

SIZE = 300
ORDERS = 3
MAX_LANGS = 2000
FOLDS, HELD_OUT = 4, 2
_BITS = 21
_BLANK = 1  # a code point that is no letter
_PIECE = 1 << 20
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point: is it a letter?"""
    if not _LETTERS:
        table = np.zeros(0x110000, bool)
        table[[i for i in range(0x110000) if unicodedata.category(chr(i))[0] == "L"]] = True
        _LETTERS.append(table)
    return _LETTERS[0]


def grams(text: str | None, orders: int = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (up to ``orders``, at most 3, letters) of a whole text and their
    counts; none if it has no letter.

    Long texts are counted piece by piece, so memory follows the distinct n-grams.
    """
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lowered = text.lower()
    if len(lowered) <= _PIECE:
        return _grams(lowered, orders)
    parts, at = [], 0
    while at < len(lowered):  # pieces end where a word ends
        to = at + _PIECE
        while to < len(lowered) and lowered[to].isalpha():
            to += 1
        parts.append(_grams(lowered[at:to], orders))
        at = to
    return _summed(parts)


def _summed(parts) -> tuple[np.ndarray, np.ndarray]:
    codes, inverse = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return codes, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def _grams(lowered: str, orders: int) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(lowered.encode("utf-32-le", "replace"), np.uint32)
    x = np.full(len(points) + 2, _BLANK, np.int64)
    x[1:-1] = np.where(_letters()[points], points, _BLANK)
    blank = x == _BLANK
    if blank.all():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = x[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]  # one blank between words
    found = [x[x != _BLANK]]
    if orders > 1:
        found.append((x[:-1] << _BITS) | x[1:])
    if orders > 2:  # a blank in the middle would join two words
        three = (found[1][:-1] << _BITS) | x[2:]
        found.append(three[x[1:-1] != _BLANK])
    flat = np.sort(np.concatenate(found))
    edge = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    return flat[edge], np.diff(np.append(edge, len(flat)))


def top(codes: np.ndarray, counts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:size]


def profiles(training: DataFrame, size: int = SIZE, orders: int = ORDERS) -> DataFrame:
    """lang, rank, gram: the profile of each language, counted over all ``training`` rows
    (text, lang). Counts are added within every task first, then over tasks."""
    ship_package(training.sparkSession)
    limit = 1_000_000  # distinct (language, n-gram) counts a task holds before it sends them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        n = 0

        def send():
            for lang, parts in held.items():
                codes, counts = _summed(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts)],
                    names=["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes, counts = grams(text, orders)
                if len(codes):
                    held.setdefault(lang, []).append((codes, counts))
                    n += len(codes)
                if n > limit:
                    held = {k: [_summed(v)] for k, v in held.items()}
                    n = sum(len(v[0][0]) for v in held.values())
                    if n > limit // 2:
                        yield from send()
                        held, n = {}, 0
        yield from send()

    counted = training.select(F.col("lang").cast("string").alias("lang"),
                              F.col("text").cast("string").alias("text")).where("lang IS NOT NULL") \
        .mapInArrow(run, "lang string, gram bigint, n bigint") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the top of each language within salted parts first, then over the parts' tops
    part = F.pmod(F.xxhash64("gram"), F.lit(64))
    order = [F.desc("n"), F.col("gram")]
    tops = counted.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= size)
    return cut(tops.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(*order)) - 1).where(F.col("rank") < size)
        .select("lang", "rank", "gram"), "language-profiles")


class Ranker:
    """Distances of documents to language profiles."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = SIZE):
        self.size = size
        self.langs = sorted({lang for lang, _, _ in rows})
        self.codes = np.unique(np.array([g for _, _, g in rows], np.int64))
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int32)
        index = {lang: i for i, lang in enumerate(self.langs)}
        for lang, rank, gram in rows:
            self.ranks[index[lang], np.searchsorted(self.codes, gram)] = rank

    def predict(self, text: str | None, orders: int = ORDERS) -> tuple[str, float]:
        """The nearest language (ties: the first in alphabetical order) and a score, one
        minus its distance over the largest possible one."""
        own = top(*grams(text, orders), self.size)
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = len(self.codes) - 1
        at = np.where(self.codes[at] == own, at, len(self.codes))
        ranks = self.ranks[:, at]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))))
        total = apart.sum(axis=1)
        best = int(total.argmin())
        return self.langs[best], float(1 - total[best] / (self.size * len(own)))


def identify(docs: DataFrame, profile: DataFrame, size: int = SIZE, orders: int = ORDERS) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs`` (doc_id, text).

    ``und`` with score 0 if the text is null or has no letter, or if no language was
    learned. Repeated rows give repeated rows; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    n = profile.select("lang").distinct().count()
    if n > MAX_LANGS:
        raise ValueError(f"{n} languages; profiles are sent to all tasks, at most {MAX_LANGS}")
    rows = [(r.lang, r.rank, r.gram) for r in profile.collect()]  # size x languages
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(shared.value, size)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [ranker.predict(t, orders) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([f[0] for f in found], pa.string()),
                     pa.array([f[1] for f in found], pa.float64())],
                    names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.pmod(crc32_of_id(doc_id), F.lit(FOLDS)) == HELD_OUT


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profile = profiles(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, profile).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
