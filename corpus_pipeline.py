"""The corpus pipeline: from raw documents to packed training sequences.

Each stage works on all that the one before kept, and its result is written and read back
before the next (a lost executor costs at most the running stage). All stages but the
last return the columns of ``documents``, further columns included, whatever their names.

Every stage takes texts of any length whole and gives an empty result for an empty table.
Null and empty texts score as texts that say nothing, have no lines and no windows, and
share fingerprint zero, so one of them stays. Repeated rows fare alike until the
near-duplicate stage keeps one; a row with a null doc_id stays there only if its group has
no other id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.llm.common import cut, documents, table
from linewise.llm.decontaminate import drop_contaminated
from linewise.llm.lines import drop_boilerplate
from linewise.llm.packing import pack
from linewise.llm.simhash import keep_one
from linewise.llm.toxicity import drop_toxic, fit

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites go, but for their first place; every document stays."""
    out = drop_boilerplate(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents that are left."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: SQL cannot express a language model, SimHash components or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
