"""Fill-in-middle transformation over a Roaring-style boundary set.

The places where a text may be cut (byte offsets of the starts of its units, and its end)
form a :class:`BoundarySet`: one container for every 2**16 bytes, an array, a bitmap or a
list of runs, whichever is smallest, with cumulative cardinalities over the containers. A
cut after ``k`` units is the set's member of rank ``k``: the cumulative cardinalities name
the container, a local select inside it gives the offset. Both cuts of a text come from
two such lookups, and the three parts are slices of its UTF-8 bytes; the text is never
held as a list of characters. The set of a text without non-ASCII characters is one run
per container.

Each document is worked out alone (no shuffle). Batches handed back to Spark are bounded
in bytes, so a task holds one text, its set and one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.llm.common import documents, ship_package

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BITS = 16
BATCH_BYTES = 16 << 20
SCHEMA = "doc_id bigint, n bigint, form string, prefix_units bigint, middle_units bigint, output string"


@dataclass
class Runs:
    """Runs of consecutive members: their starts and the members before each run."""

    starts: np.ndarray
    before: np.ndarray

    def select(self, k: int) -> int:
        i = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[i]) + k - int(self.before[i])


@dataclass
class Array:
    """The members themselves."""

    values: np.ndarray

    def select(self, k: int) -> int:
        return int(self.values[k])


@dataclass
class Bitmap:
    """One bit per possible member, in 64-bit words."""

    words: np.ndarray

    def select(self, k: int) -> int:
        upto = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)
        i = int(np.searchsorted(upto, k, "right"))
        left = k - (int(upto[i - 1]) if i else 0)
        word = int(self.words[i])
        for _ in range(left):
            word &= word - 1
        return 64 * i + (word & -word).bit_length() - 1


def container(mask: np.ndarray) -> Runs | Array | Bitmap:
    """The smallest container for the set places of ``mask`` (at most 2**16, one at least)."""
    values = np.flatnonzero(mask)
    heads = np.flatnonzero(np.diff(values, prepend=-2) > 1)
    array, runs, bitmap = 2 * len(values), 2 + 4 * len(heads), (1 << BITS) // 8
    if runs < min(array, bitmap):
        return Runs(values[heads].astype(np.uint16), heads.astype(np.uint32))
    if array <= bitmap:
        return Array(values.astype(np.uint16))
    bits = np.zeros(1 << BITS, bool)
    bits[:len(mask)] = mask
    return Bitmap(np.packbits(bits, bitorder="little").view("<u8"))


class BoundarySet:
    """Sorted byte offsets; ``len`` is the number of members, ``select(k)`` the member of
    rank ``k`` (from 0)."""

    def __init__(self, masks: Iterator[np.ndarray]):
        self.keys, self.containers, total = [], [], [0]
        for key, mask in enumerate(masks):
            n = int(np.count_nonzero(mask))
            if n:
                self.keys.append(key)
                self.containers.append(container(mask))
                total.append(total[-1] + n)
        self.total = np.array(total, np.int64)

    def __len__(self) -> int:
        return int(self.total[-1])

    def select(self, k: int) -> int:
        if not 0 <= k < len(self):
            raise IndexError(k)
        i = int(np.searchsorted(self.total, k, "right")) - 1
        return (self.keys[i] << BITS) + self.containers[i].select(k - int(self.total[i]))


def boundaries(data: bytes, unit: str = "char") -> BoundarySet:
    """Starts of the units of a UTF-8 text, and its end.

    ``char``: every code point is a unit. ``word``: a unit begins at the first character
    of every word (maximal run without ASCII white space); white space before the first
    word belongs to the first unit, an all-blank text is one unit."""
    raw = np.frombuffer(data, np.uint8)

    def masks() -> Iterator[np.ndarray]:
        size = 1 << BITS
        for lo in range(0, len(raw) + 1, size):
            part = raw[lo:lo + size]
            if unit == "char":
                mask = (part & 0xC0) != 0x80
            elif unit == "word":
                blank = (part == 32) | ((part >= 9) & (part <= 13))
                earlier = np.empty(len(part), bool)
                earlier[1:] = blank[:-1]
                if len(part):
                    earlier[0] = lo > 0 and raw[lo - 1] in b" \t\n\x0b\x0c\r"
                mask = ~blank & earlier
                if lo == 0 and len(part):
                    first = np.flatnonzero(~blank)  # blanks at the head go with the first word
                    mask[:first[0] + 1 if len(first) else len(part)] = False
                    mask[0] = True
            else:
                raise ValueError(f"unknown unit {unit!r}")
            if lo + size > len(raw):  # the end of the text lies in this container
                mask = np.append(mask, True)
            yield mask

    return BoundarySet(masks())


def draws(doc_id: int | None, seed: str) -> tuple[int, ...]:
    """Four unsigned 32-bit draws of a document (a null id counts as the empty text)."""
    key = f"{seed}:{'' if doc_id is None else doc_id}"
    digest = hashlib.sha256(key.encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4))


def rearrange(doc_id: int | None, text: bytes, seed: str, plain_from: int, spm_below: int,
              unit: str) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, units of the prefix, units of the middle, output) of one text."""
    cuts = boundaries(text, unit)
    n = len(cuts) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not text or any(m in text for m in marks) or h3 % 100 >= plain_from:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = cuts.select(first), cuts.select(second)
    prefix, middle, suffix = marks[0] + text[:a], marks[2] + text[a:b], marks[1] + text[b:]
    if h4 % 100 < spm_below:
        return n, "spm", first, second - first, suffix + prefix + middle
    return n, "psm", first, second - first, prefix + suffix + middle


def fill_in_middle(docs: DataFrame, seed: str = "1", plain_from: int = 90, spm_below: int = 20,
                   unit: str = "char") -> DataFrame:
    """One row per row of ``docs``: doc_id, n (units of the text), form (``plain``, ``psm``
    or ``spm``), prefix_units, middle_units (null if plain) and the output text.

    A null text is the empty text, and the empty text is plain; a text that holds one of
    the three markers is plain, so an output can always be taken apart again. A null
    doc_id draws like the empty text; repeated rows give equal rows; an empty table gives
    none. Columns other than doc_id and text are ignored, so their names clash with
    nothing."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                row = rearrange(doc_id, (text.as_py() or "").encode("utf-8", "replace"),
                                seed, plain_from, spm_below, unit)
                rows.append((doc_id, *row))
                held += len(row[-1])
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def restored(output="output", form="form"):
    """The text that an output was made of, from the output and its form. An arranged
    output holds each marker exactly once, so it splits into its three parts."""
    parts = F.split(F.col(output), "<[PSM]>", -1)
    return (F.when(F.col(form) == "psm", F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2)))
            .when(F.col(form) == "spm", F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1)))
            .otherwise(F.col(output)))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arranged; digests of the outputs and of the texts rebuilt from them."""
    return fill_in_middle(documents(spark, sf_dir)).select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored().cast("binary"), 256).alias("restored_sha256"))
