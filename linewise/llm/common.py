"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.plans.materialize import cut
from linewise.session import ship_package

__all__ = ["cut", "documents", "table", "let", "crc32_of_id", "words_of", "lower_ascii",
           "ASCII_SPACE", "ship_package", "split_words_bytes", "FOLD", "crc32", "free_name"]

#: The white space of the word pattern ``[^\x20\x09-\x0D]+``.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so (Spark
    takes no notice of case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once per row, however often ``body`` uses it.

    Spark inlines a projected column into the lambda that reads it, which would compute
    it again for every element; a lambda variable over a one-element array is bound once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null or empty text."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def crc32(data) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


#: Byte table of the word pattern ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256))


def split_words_bytes(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of digits, letters and non-ASCII characters, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []
