"""C on a growing trace: appended events resolve without reading the old ones again.

A :class:`GrowingGraph` is a folder. Every append writes the edges of the new events and
what later events need to know, as small tables of changes:

    writers  run_id, id, event_id, lineno    the last write of a location
    lines    run_id, lineno, event_id, node_id   the last node of a line
    calls    run_id, event_id, depth, n_nodes    how far a run has come

The next append reads these as if they were events: a kept write or node stands at its own
event id, before all new ones, and joins the same chunked as-of scans as the batch build
(``lineage``), keyed by (run, location) and (run, line); the call depth comes in as one row
that raises the level. No step is keyed by the run alone but the scan's chunk summaries, so
a run that holds most of the events is spread like any other.

Changes are only added, never rewritten: a reader takes the latest per key (the as-of scan
does so by itself). Every ``COMPACT_EVERY`` appends the changes are merged. An append has a
number; it writes ``calls`` last, and without that it never happened: a repeated append of
a number that is complete does nothing, one that broke off starts over.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.operators.lineage import Lineage
from linewise.operators.scope import call_delta, top_level
from linewise.plans.scan import DEFAULT_CHUNK_BITS, clamped_level_and_count

COMPACT_EVERY = 8
KINDS = ("exec", "update", "enter", "exit")
WRITERS = "run_id bigint, id bigint, event_id bigint, lineno bigint"
LINES = "run_id bigint, lineno bigint, event_id bigint, node_id bigint"
CALLS = "run_id bigint, event_id bigint, depth bigint, n_nodes bigint"
EDGES = "run_id bigint, src bigint, dst bigint"
KEYS = {"writers": ["run_id", "id"], "lines": ["run_id", "lineno"], "calls": ["run_id"]}
SCHEMAS = {"writers": WRITERS, "lines": LINES, "calls": CALLS}


class _Appended(Lineage):
    """The graph of new events that know what was kept of the earlier ones."""

    def __init__(self, numbered: DataFrame, writers: DataFrame, lines: DataFrame, *options):
        super().__init__(numbered, *options)
        self.writers, self.lines = writers, lines

    @cached_property
    def trace(self) -> DataFrame:
        return top_level(self._src).select(
            "run_id", "event_id", "kind", "lineno", "line", "uses", "defs",
            F.when(F.col("kind") == "exec", F.col("node_id")).alias("node_id"))

    def _write_rows(self) -> DataFrame:
        kept = self.writers.withColumn("name", F.lit(None).cast("string"))
        return super()._write_rows().unionByName(kept)

    def _node_rows(self) -> DataFrame:
        return super()._node_rows().unionByName(self.lines)


def _latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the greatest event_id per key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("event_id")).alias("_r")).select(*keys, "_r.*")


class GrowingGraph:
    """A lineage graph that grows by appended parts of a trace (TRACE columns). In each run
    the events of a part come after those of all parts before; events that don't are not
    folded but counted (``late``)."""

    def __init__(self, spark: SparkSession, folder: str, refinement: str = "include_all",
                 ignore_unknown: bool = False, chunk_bits: int = DEFAULT_CHUNK_BITS,
                 compact_every: int = COMPACT_EVERY):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.options = refinement, ignore_unknown, chunk_bits
        self.compact_every = compact_every

    # ---- files -------------------------------------------------------------------------

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, prefix: str) -> list[int]:
        """Numbers of the complete parts (``part``) or merged states (``state``)."""
        where, fs = self._fs(self.folder)
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        found = sorted(int(n.split("-")[1]) for n in names if n.startswith(f"{prefix}-"))
        return [n for n in found if self._complete(f"{self._at(prefix, n)}/calls")]

    def _complete(self, path: str) -> bool:
        where, fs = self._fs(f"{path}/_SUCCESS")
        return fs.exists(where)

    def _at(self, prefix: str, number: int) -> str:
        return f"{self.folder}/{prefix}-{number:09d}"

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _kept(self, table: str, below: int) -> DataFrame:
        """Changes to a table by all parts before ``below``, older ones merged."""
        merged = [n for n in self._numbers("state") if n <= below]
        first = merged[-1] if merged else -1
        paths = [f"{self._at('part', n)}/{table}" for n in self._numbers("part") if first <= n < below]
        return self._read(([f"{self._at('state', first)}/{table}"] if merged else []) + paths, SCHEMAS[table])

    def compact(self, below: int) -> None:
        """Merge the changes of all parts before ``below``: one row per key."""
        for table in ("writers", "lines", "calls"):
            (_latest(self._kept(table, below), KEYS[table])
             .write.mode("overwrite").parquet(f"{self._at('state', below)}/{table}"))

    # ---- appending ---------------------------------------------------------------------

    def append(self, part: DataFrame, number: int | None = None) -> None:
        """Fold the events of ``part``; ``number`` (default: the next) names the part."""
        done = self._numbers("part")
        number = (done[-1] + 1 if done else 0) if number is None else number
        if number in done:
            return
        at = self._at("part", number)
        # what comes in is read several times: written first, as a stream's batch is read once
        (part.where(F.col("kind").isin(*KINDS))
         .select("run_id", "event_id", "kind", "lineno", "line", "uses", "defs")
         .write.mode("overwrite").parquet(f"{at}/events"))
        events = self.spark.read.schema(part.schema).parquet(f"{at}/events") \
            .select("run_id", "event_id", "kind", "lineno", "line", "uses", "defs")
        since = [n for n in done if n >= max(self._numbers("state"), default=0)]
        if len(since) >= self.compact_every:
            self.compact(number)
        calls = _latest(self._kept("calls", number), KEYS["calls"])
        numbered = self._numbered(events, calls, at)
        runs = numbered.select("run_id").distinct()
        graph = _Appended(numbered, self._kept("writers", number).join(runs, "run_id", "left_semi"),
                          self._kept("lines", number).join(runs, "run_id", "left_semi"), *self.options)
        graph.edges.write.mode("overwrite").parquet(f"{at}/edges")
        writes = graph.writes.select("run_id", "id", "event_id", "lineno")
        _latest(writes, KEYS["writers"]).write.mode("overwrite").parquet(f"{at}/writers")
        nodes = graph.nodes.select("run_id", "lineno", "event_id", "node_id")
        _latest(nodes, KEYS["lines"]).write.mode("overwrite").parquet(f"{at}/lines")
        after = F.greatest(F.lit(0), F.col("depth") + F.col("delta"))
        (numbered.groupBy("run_id").agg(F.max_by(F.struct(F.col("event_id"), after.alias("depth")), F.col("event_id"))
                                        .alias("_r"), F.max("node_id").alias("n_nodes"))
         .select("run_id", "_r.*", "n_nodes").write.mode("overwrite").parquet(f"{at}/calls"))

    def _numbered(self, events: DataFrame, calls: DataFrame, at: str) -> DataFrame:
        """The new events in time with depth and node number, written; the others, counted."""
        known = calls.select("run_id", F.col("event_id").alias("seen"), "depth", F.col("n_nodes").alias("before"))
        told = events.join(known.select("run_id", "seen", "before"), "run_id", "left")
        late = F.coalesce(F.col("event_id") <= F.col("seen"), F.lit(False))
        told.where(late).select("run_id", "event_id").write.mode("overwrite").parquet(f"{at}/late")
        fresh = told.where(~late).select(*events.columns, F.coalesce("before", F.lit(0)).alias("before"),
                                         call_delta().cast("bigint").alias("delta"))
        inside = known.where("depth > 0").join(events.select("run_id").distinct(), "run_id", "left_semi").select(
            "run_id", F.col("seen").alias("event_id"), F.lit("inside").alias("kind"), "before",
            F.col("depth").alias("delta"))
        rows = fresh.unionByName(inside, allowMissingColumns=True)
        chunk = F.shiftright("event_id", self.options[2])
        out = clamped_level_and_count(rows, ["run_id"], ["event_id"], F.col("delta"),
                                      lambda depth: (depth == 0) & (F.col("kind") == "exec"), "depth", "node_id", chunk)
        out.where("kind <> 'inside'").withColumn("node_id", F.col("node_id") + F.col("before")) \
           .write.mode("overwrite").parquet(f"{at}/numbered")
        return self.spark.read.schema(out.schema).parquet(f"{at}/numbered")

    # ---- reading -----------------------------------------------------------------------

    @property
    def edges(self) -> DataFrame:
        """All edges so far, distinct: a part's edges end in nodes of its own."""
        return self._read([f"{self._at('part', n)}/edges" for n in self._numbers("part")], EDGES)

    @property
    def late(self) -> DataFrame:
        """run_id and event_id of the events that came too late to be folded."""
        return self._read([f"{self._at('part', n)}/late" for n in self._numbers("part")],
                          "run_id bigint, event_id bigint")
