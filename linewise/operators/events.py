"""A: routing, flattening, accesses, rendering, run status, numbering, column usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewise.plans.scan import DEFAULT_CHUNK_BITS, chunk_of, running_sum


def of_kind(trace: DataFrame, *kinds: str) -> DataFrame:
    """A3: route by event kind (a filter Catalyst pushes into the Parquet scan)."""
    return trace.filter(F.col("kind").isin(*kinds))


def event_fields(trace: DataFrame) -> DataFrame:
    """A4: flatten the call details next to the event fields."""
    return trace.select("*", "call.*").drop("call")


def accesses(trace: DataFrame, which: str = "both") -> DataFrame:
    """One row per distinct (name, id) read by an ``exec`` or written by an
    ``update``; duplicates inside one event collapse in the array (no shuffle)."""
    def side(kind: str, field: str, label: str) -> DataFrame:
        ids = F.array_distinct(F.transform(field, lambda v: F.struct(v["name"].alias("name"), v["id"].alias("id"))))
        return (trace.filter(F.col("kind") == kind)
                     .select("run_id", "event_id", F.lit(label).alias("access"), F.explode(ids).alias("v"))
                     .select("run_id", "event_id", "access", F.col("v.name").alias("name"), F.col("v.id").alias("id")))
    if which == "uses":
        return side("exec", "uses", "read")
    if which == "defs":
        return side("update", "defs", "write")
    return side("exec", "uses", "read").unionByName(side("update", "defs", "write"))


def _var_text(v: Column) -> Column:
    return F.concat(v["name"], F.lit(": "), F.coalesce(v["type"], F.lit("None")), F.lit(" @ "),
                    F.coalesce(v["id"].cast("string"), F.lit("None")))


def render(trace: DataFrame) -> DataFrame:
    """The human-readable text of every event."""
    # The event text formats.
    lineno = F.coalesce(F.col("lineno").cast("string"), F.lit("None"))
    line = F.coalesce(F.col("line"), F.lit("None"))
    defs = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("defs", F.array()), _var_text), ", "), F.lit("]"))
    text = (F.when(F.col("kind") == "exec", F.concat(F.lit("exec line: "), line, F.lit(" (line="), lineno, F.lit(")")))
             .when(F.col("kind") == "update", F.concat(F.lit("mem-update("), defs, F.lit(")")))
             .when(F.col("kind") == "enter", F.concat(F.lit("enter call: "), line, F.lit(" (line="), lineno, F.lit(")")))
             .when(F.col("kind") == "exit", F.concat(F.lit("exit call: "), line, F.lit(" (line="), lineno, F.lit(")")))
             .when(F.col("kind") == "exception", F.lit("abnormal exit (exception)"))
             .otherwise(F.concat(F.col("kind"), F.lit("("), F.coalesce("loop_name", F.lit("")), F.lit(")"))))
    return trace.select("run_id", "event_id", "kind", text.alias("text"))


def run_status(trace: DataFrame) -> DataFrame:
    """Per run, whether it ended abnormally and the last exception message.
    Later events are kept; only the run is flagged. Partial aggregation, no collect."""
    exc = F.col("kind") == "exception"
    return trace.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.max(exc.cast("int")).cast("boolean").alias("abnormal"),
        F.sum(exc.cast("int")).cast("bigint").alias("n_exceptions"),
        F.max_by(F.col("msg"), F.when(exc, F.col("event_id"))).alias("last_msg"))


def number_events(trace: DataFrame, out: str = "seq", chunk_bits: int = DEFAULT_CHUNK_BITS) -> DataFrame:
    """Dense per-run numbering in event order (a chunked running count)."""
    return running_sum(trace, ["run_id"], ["event_id"], F.lit(1), out, chunk_of("event_id", chunk_bits))


def column_reads(trace: DataFrame) -> DataFrame:
    """A10: the columns of tabular values that each statement reads: one row per (run,
    event, line, value name, column)."""
    return (trace.filter(F.col("kind") == "exec")
                 .select("run_id", "event_id", "lineno", F.explode("uses").alias("v"))
                 .select("run_id", "event_id", "lineno", F.col("v.name").alias("name"),
                         F.explode(F.array_distinct("v.columns")).alias("column_name")).distinct())


def column_usage(trace: DataFrame) -> DataFrame:
    """A10: which columns of tabular values statements read: per (value name, column),
    how many reads and in how many runs (map-side partial aggregation)."""
    reads = (trace.filter(F.col("kind") == "exec")
                  .select("run_id", F.explode("uses").alias("v"))
                  .select("run_id", F.col("v.name").alias("name"), F.explode("v.columns").alias("column_name")))
    return reads.groupBy("name", "column_name").agg(
        F.count(F.lit(1)).alias("n_reads"), F.countDistinct("run_id").alias("n_runs"))
