"""G: live lineage over a streaming trace (Structured Streaming).

G1  ``live_graph`` folds every micro-batch into a :class:`~linewise.operators.growing.GrowingGraph`
    (``foreachBatch``). State is kept per (run, location), per (run, line) and as one row per
    run, and each batch is resolved by the chunked as-of scans of the batch build, so one run
    with most of the events is spread over many tasks. A batch is folded once: its number is
    the stream's batch id, and a batch that is replayed after a failure starts over or, if it
    was complete, does nothing.
G2  ``Release`` puts a disordered stream into order: in ``foreachBatch`` the events wait in a
    written table, held by (run, range of event ids), until the watermark has passed them: the
    latest time seen less a delay. A batch reads what still waits and its own events, in Spark
    alone. Events that come after the watermark go to a side table and are not folded. A gap
    in event ids is never waited on.
G3  ``live_run_status``: abnormal ends, a stateless filter.

A stream has no end-of-stream watermark: a finite source ends with one ``flush`` row whose time lies beyond all events by more than the delay (``with_flush``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from linewise.operators.growing import GrowingGraph
from linewise.plans.materialize import new_folder

RELEASE_BITS = 12
BATCHES = 3
_PAYLOAD = ["run_id", "event_id", "kind", "lineno", "line", "uses", "defs"]


class Release:
    """The events of a stream's micro-batches (TRACE columns and ``ts``) as the watermark,
    which is ``delay`` behind the latest time seen (in ms), passes them: a batch releases what
    waited and its own events before the new watermark. Events before the watermark of the
    batches so far, or without time or id, go to ``folder``/behind. Of events that wait under
    one run and id the last to come counts. Between micro-batches times ascend. A batch's
    ``mark`` is written last: one that broke off starts over."""

    def __init__(self, spark: SparkSession, folder: str, delay: str = "0 seconds"):
        self.spark, self.folder, self.delay = spark, folder, delay

    def _at(self, table: str, number: int) -> str:
        return f"{self.folder}/{table}/{number:09d}"

    def _before(self, number: int) -> tuple[int, int | None] | None:
        """The last complete batch before ``number`` and its watermark."""
        marks = f"{self.folder}/mark"
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(marks)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return None
        last = self.spark.read.schema("number bigint, passed bigint").option("recursiveFileLookup", "true") \
            .parquet(marks).where(F.col("number") < number).orderBy(F.desc("number")).first()
        return last and (last.number, last.passed)

    def append(self, batch: DataFrame, number: int) -> DataFrame:
        """Take the micro-batch ``number``; returns the events it releases."""
        # a stream's batch is read once
        come = batch.select(*_PAYLOAD, F.col("ts").cast("timestamp").alias("ts")).select(
            *_PAYLOAD, F.unix_millis("ts").alias("at"),
            F.unix_millis(F.col("ts") - F.expr(f"INTERVAL {self.delay}")).alias("mark"), F.lit(number).alias("came"))
        come.write.mode("overwrite").parquet(self._at("come", number))
        come = self.spark.read.schema(come.schema).parquet(self._at("come", number))
        before = self._before(number)
        seen = before[1] if before else None
        late = F.col("at").isNull() | F.col("event_id").isNull()
        if seen is not None:
            late = late | (F.col("at") < seen)
        events = come.where(~F.coalesce(F.col("kind") == "flush", F.lit(False))).drop("mark")
        events.where(late).select("run_id", "event_id").write.mode("overwrite").parquet(self._at("behind", number))
        held = events.where(~late)
        if before:
            waited = self.spark.read.schema(held.schema).parquet(self._at("held", before[0]))
            held = held.unionByName(waited if seen is None else waited.where(F.col("at") >= seen))
        key = ["run_id", "range", "event_id"]
        rest = [c for c in held.columns if c not in key]
        held = held.withColumn("range", F.shiftright("event_id", RELEASE_BITS)).repartition("run_id", "range") \
            .groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("came", "at")).alias("r")).select(*key, "r.*").drop("range")
        held.write.mode("overwrite").parquet(self._at("held", number))
        top = come.agg(F.max("mark")).first()[0]
        passed = max((m for m in (top, seen) if m is not None), default=None)
        self.spark.range(1).select(F.lit(number).cast("bigint").alias("number"),
                                   F.lit(passed).cast("bigint").alias("passed")) \
            .write.mode("overwrite").parquet(self._at("mark", number))
        held = self.spark.read.schema(held.schema).parquet(self._at("held", number))
        return held.where(F.lit(False) if passed is None else F.col("at") < passed).select(*_PAYLOAD)


def live_graph(stream: DataFrame, folder: str, ordered: bool = False, delay: str = "0 seconds",
               **options) -> DataStreamWriter:
    """G1 (and G2 with ``ordered``): a stream writer that folds every micro-batch into the
    :class:`GrowingGraph` of ``folder``; ``options`` are the graph's. Late events are in its
    ``late`` table (and, of the release, in ``folder``/behind)."""
    graph = GrowingGraph(stream.sparkSession, f"{folder}/graph", **options)
    waiting = Release(stream.sparkSession, folder, delay) if ordered else None

    def fold(batch: DataFrame, number: int) -> None:
        graph.append(waiting.append(batch, number) if waiting else batch, number)

    return (stream.writeStream.foreachBatch(fold).outputMode("append")
            .option("checkpointLocation", f"{folder}/checkpoint"))


def behind(spark: SparkSession, folder: str) -> DataFrame:
    """run_id and event_id of the events that came after the watermark."""
    return (spark.read.schema("run_id bigint, event_id bigint").option("recursiveFileLookup", "true")
            .parquet(f"{folder}/behind"))


def live_run_status(stream: DataFrame) -> DataFrame:
    """Abnormal ends as they happen."""
    return stream.filter(F.col("kind") == "exception").select("run_id", "event_id", "msg")


def land(spark: SparkSession, trace: DataFrame, folder: str, batches: int = BATCHES) -> DataFrame:
    """Write ``trace`` as files in event order, as many as Spark has shuffle partitions, and
    read them as a stream: the files of each of ``batches`` micro-batches are a range of
    event ids. The file source takes files by modification time, so times follow ranges."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    trace.repartitionByRange(n, "event_id").sortWithinPartitions("event_id").write.parquet(folder)
    _in_order(spark, folder)
    return (spark.readStream.schema(trace.schema).option("maxFilesPerTrigger", -(-n // batches)).parquet(folder))


def _in_order(spark: SparkSession, folder: str) -> None:
    """Give the part files modification times in the order of their names (their ranges)."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((str(f.getPath().toString()), f) for f in fs.listStatus(where)
                   if f.getPath().getName().startswith("part-"))
    first = max((f.getModificationTime() for _, f in found), default=0) - 1000 * len(found)
    for i, (_, f) in enumerate(found):
        fs.setTimes(f.getPath(), first + 1000 * i, -1)


def finish(spark: SparkSession, writer: Callable[[], DataStreamWriter]) -> None:
    """Run a stream writer over all that is there."""
    writer().trigger(availableNow=True).start().awaitTermination()


def run_status(spark: SparkSession, trace: DataFrame, batches: int = BATCHES) -> DataFrame:
    """G3 over a landed trace, through a Parquet sink."""
    base = new_folder(spark, "live-status")
    out = live_run_status(land(spark, trace, f"{base}/source", batches))
    finish(spark, lambda: out.writeStream.format("parquet").outputMode("append")
           .option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/sink"))
    return spark.read.schema(out.schema).parquet(f"{base}/sink")


def run_lineage(spark: SparkSession, trace: DataFrame, ordered: bool = False, delay: str = "0 seconds",
                batches: int = BATCHES, **options) -> DataFrame:
    """G1 / G2 over a landed trace: the edges of the finished graph. Events that came too late
    were not folded; if there are any the graph is incomplete, so this raises."""
    base = new_folder(spark, "live-lineage")
    stream = land(spark, with_flush(trace, delay) if ordered else trace, f"{base}/source", batches)
    finish(spark, lambda: live_graph(stream, base, ordered, delay, **options))
    return edges_of(spark, base)


def edges_of(spark: SparkSession, folder: str) -> DataFrame:
    """The edges of a finished live graph; raises if events came too late."""
    graph = GrowingGraph(spark, f"{folder}/graph")
    where, fs = graph._fs(f"{folder}/behind")
    late = graph.late.count() + (behind(spark, folder).count() if fs.exists(where) else 0)
    if late:
        raise RuntimeError(f"{late} events came after later events of their run; use ordered=True with a longer delay")
    return graph.edges


def with_flush(trace: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """End a finite trace: one ``flush`` row, after all events and later than they are by more
    than ``delay``, takes the watermark past them."""
    end = trace.agg(F.max("event_id").alias("_e"), F.max(F.col("ts").cast("timestamp")).alias("_t"))
    mark = end.where("_t IS NOT NULL").select(
        F.lit(None).cast("bigint").alias("run_id"), (F.col("_e") + 1).alias("event_id"), F.lit("flush").alias("kind"),
        (F.col("_t") + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 2 seconds")).alias("ts"))
    return trace.withColumn("ts", F.col("ts").cast("timestamp")).unionByName(mark, allowMissingColumns=True)
