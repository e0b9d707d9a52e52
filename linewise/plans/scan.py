"""Ordered scans ("as of", running sums, clamped depth) that survive hot keys.

A plain ``Window.partitionBy(run_id).orderBy(event_id)`` sends a whole run to one
task; one run (or one hot address) can hold a third of all rows. Every ordered scan
in this package therefore counts the rows of its keys first (a narrow aggregate). Keys of
at most ``HOT_ROWS`` rows take one local window each; those of more, if there are any, are
scanned in two levels:

1. rows are hash-partitioned by ``(key, chunk)``, where ``chunk`` is a coarse column
   that is monotone in the scan order (by default ``event_id >> chunk_bits``), and the
   scan runs locally inside each chunk with a window;
2. one summary row per ``(key, chunk)`` is scanned across chunks (a tiny window per
   key: a hot key with 10^11 rows has ~10^5 chunks), giving the carry-in of each chunk,
   which is joined back on ``(key, chunk)``.

The rows of hot keys are read once more for the chunk summary (order and value columns,
aggregated map-side); without hot keys there is one exchange and no summary.
Keys are packed into a struct, which makes NULL a real, null-safe key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewise.plans.materialize import cut

DEFAULT_CHUNK_BITS = 20
HOT_ROWS = 1 << DEFAULT_CHUNK_BITS

_UNB = Window.unboundedPreceding


def _cols(xs: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def chunk_of(order_col: str | Column, chunk_bits: int = DEFAULT_CHUNK_BITS) -> Column:
    """Coarse bucket of an integer order column (floor division by 2**chunk_bits)."""
    c = F.col(order_col) if isinstance(order_col, str) else order_col
    return F.shiftright(c.cast("bigint"), chunk_bits)


def _prepare(df: DataFrame, keys, chunk: Column) -> tuple[DataFrame, DataFrame | None]:
    """Rows with key ``_k`` and chunk ``_c``, dealt by both, and those of hot keys (NULL: no
    key is hot). Only hot keys have chunks."""
    key = F.struct(*_cols(keys))
    counts = df.select(key.alias("_k")).groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    if (counts.agg(F.max("_n")).first()[0] or 0) <= HOT_ROWS:
        if len(keys) == 1:   # no join follows, and a plain column sorts faster than a struct
            key, = _cols(keys)
        return df.withColumn("_k", key).withColumn("_c", F.lit(0)).repartition("_k"), None
    hot = cut(counts.where(F.col("_n") > HOT_ROWS).select("_k", F.lit(True).alias("_h")), "hot_keys")
    d = df.withColumn("_k", key).withColumn("_ch", chunk).join(F.broadcast(hot), "_k", "left")
    d = d.withColumn("_c", F.when(F.col("_h"), F.col("_ch"))).drop("_ch").repartition("_k", "_c")
    return d.drop("_h"), d.where("_h").drop("_h")


def _with_carry(local: DataFrame, carry: Callable[[], DataFrame], hot: DataFrame | None,
                none: dict[str, Column]) -> DataFrame:
    """``local`` with what earlier chunks carry into each; ``none`` where nothing does."""
    if hot is None:
        return local.withColumns(none)
    return local.join(carry(), ["_k", "_c"], "left")


def last_before(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column],
                src: Column, value: Column, out: str, chunk: Column,
                inclusive: bool = False, descending: bool = False) -> DataFrame:
    """Add ``out``: ``value`` of the latest row with ``src`` true, with the same ``keys``,
    strictly before each row in ``order`` (at or before it when ``inclusive``).

    ``order`` must be a total order inside a key for the rows that matter; put a
    tie-breaker last so that sources sort after targets of equal time when the bound is
    strict. ``chunk`` must be non-decreasing along ``order``. NULL values of a source
    row are kept (the value is wrapped in a struct). With ``descending`` the scan runs
    backwards: the earliest source row *after* each row.
    """
    order = _cols(order)
    d, hot = _prepare(df.withColumn("_v", F.when(src, F.struct(value.alias("v")))), keys, chunk)
    sort = [o.desc() for o in order] if descending else order
    w_local = (Window.partitionBy("_k", "_c").orderBy(*sort)
               .rowsBetween(_UNB, 0 if inclusive else -1))
    local = d.withColumn("_loc", F.last("_v", ignorenulls=True).over(w_local))
    pick = F.min_by if descending else F.max_by
    w_chunks = (Window.partitionBy("_k").orderBy(F.col("_c").desc() if descending else F.col("_c"))
                .rowsBetween(_UNB, -1))

    def carry() -> DataFrame:
        ends = hot.groupBy("_k", "_c").agg(
            pick("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_end"))
        return ends.select("_k", "_c", F.last("_end", ignorenulls=True).over(w_chunks).alias("_in"))

    return (_with_carry(local, carry, hot, {"_in": F.lit(None).cast(d.schema["_v"].dataType)})
                 .withColumn(out, F.coalesce("_loc", "_in").getField("v"))
                 .drop("_k", "_c", "_v", "_loc", "_in"))


def first_after(df: DataFrame, keys, order: Sequence[str | Column], src: Column, value: Column,
                out: str, chunk: Column, inclusive: bool = False) -> DataFrame:
    """Mirror of :func:`last_before`: ``value`` of the earliest ``src`` row after each row."""
    return last_before(df, keys, order, src, value, out, chunk, inclusive, descending=True)


def running_sum(df: DataFrame, keys, order: Sequence[str | Column], value: Column, out: str,
                chunk: Column, inclusive: bool = True) -> DataFrame:
    """Add ``out``: sum of ``value`` over rows of the same key up to each row (BIGINT)."""
    order = _cols(order)
    d, hot = _prepare(df.withColumn("_v", value.cast("bigint")), keys, chunk)
    w_local = (Window.partitionBy("_k", "_c").orderBy(*order)
               .rowsBetween(_UNB, 0 if inclusive else -1))
    local = d.withColumn("_loc", F.coalesce(F.sum("_v").over(w_local), F.lit(0)))
    w_chunks = Window.partitionBy("_k").orderBy("_c").rowsBetween(_UNB, -1)

    def carry() -> DataFrame:
        totals = hot.groupBy("_k", "_c").agg(F.sum("_v").alias("_t"))
        return totals.select("_k", "_c", F.coalesce(F.sum("_t").over(w_chunks), F.lit(0)).alias("_in"))

    return (_with_carry(local, carry, hot, {"_in": F.lit(0)})
                 .withColumn(out, (F.col("_loc") + F.coalesce("_in", F.lit(0))).cast("bigint"))
                 .drop("_k", "_c", "_v", "_loc", "_in"))


def clamped_level(df: DataFrame, keys, order: Sequence[str | Column], delta: Column, out: str,
                  chunk: Column) -> DataFrame:
    """Add ``out``: the level *before* each row of a counter that moves by ``delta``
    (+1 / -1 / 0) and never drops below zero (extra -1 steps count for nothing).

    With ``e`` the exclusive prefix sum, the clamped level is ``e - least(0, min e so far)``.
    Both the sum and the running minimum are carried across chunks.
    """
    order = _cols(order)
    d, hot = _prepare(df.withColumn("_v", delta.cast("bigint")).withColumn("_timed", chunk.isNotNull()), keys, chunk)
    w_ex = Window.partitionBy("_k", "_c").orderBy(*order).rowsBetween(_UNB, -1)
    w_in = Window.partitionBy("_k", "_c").orderBy(*order).rowsBetween(_UNB, 0)
    local = (d.withColumn("_e", F.coalesce(F.sum("_v").over(w_ex), F.lit(0)))
              .withColumn("_m", F.min("_e").over(w_in)))
    return (_with_level(local, hot, w_ex, out)
                 .drop("_k", "_c", "_v", "_timed", "_e", "_m", "_off", "_g"))


def _with_level(local: DataFrame, hot: DataFrame | None, w_ex, out: str) -> DataFrame:
    """The clamped level of rows with their chunk's prefix sum ``_e`` and its minimum ``_m``.
    A row without a chunk (a NULL order) has none."""
    w_chunks = Window.partitionBy("_k").orderBy("_c").rowsBetween(_UNB, -1)

    def carry() -> DataFrame:
        summ = hot.withColumn("_e", F.coalesce(F.sum("_v").over(w_ex), F.lit(0))) \
            .groupBy("_k", "_c").agg(F.sum("_v").alias("_t"), F.min("_e").alias("_lm"))
        return (summ.withColumn("_off", F.coalesce(F.sum("_t").over(w_chunks), F.lit(0)))
                    .withColumn("_g", F.min(F.col("_off") + F.col("_lm")).over(w_chunks))
                    .select("_k", "_c", "_off", "_g"))

    off = F.coalesce("_off", F.lit(0))
    run_min = F.least(off + F.col("_m"), F.coalesce("_g", off + F.col("_m")))
    level = (off + F.col("_e") - F.least(F.lit(0), run_min)).cast("bigint")
    return (_with_carry(local, carry, hot, {"_off": F.lit(0), "_g": F.lit(None).cast("bigint")})
            .withColumn(out, F.when(F.col("_timed"), level)))


def clamped_level_and_count(df: DataFrame, keys, order: Sequence[str | Column], delta: Column,
                            counted, level_out: str, count_out: str, chunk: Column) -> DataFrame:
    """:func:`clamped_level` and, in the same pass, a running count (inclusive) of the rows
    for which ``counted(level_column)`` holds. After the level carry is joined back the
    rows are still partitioned by ``(key, chunk)``, so the count's local window needs no
    new exchange: one wide shuffle for both scans."""
    order = _cols(order)
    d, hot = _prepare(df.withColumn("_v", delta.cast("bigint")).withColumn("_timed", chunk.isNotNull()), keys, chunk)
    w_ex = Window.partitionBy("_k", "_c").orderBy(*order).rowsBetween(_UNB, -1)
    w_in = Window.partitionBy("_k", "_c").orderBy(*order).rowsBetween(_UNB, 0)
    w_chunks = Window.partitionBy("_k").orderBy("_c").rowsBetween(_UNB, -1)
    local = (d.withColumn("_e", F.coalesce(F.sum("_v").over(w_ex), F.lit(0)))
              .withColumn("_m", F.min("_e").over(w_in)))
    lvl = _with_level(local, hot, w_ex, level_out)
    lvl = lvl.withColumn("_cv", F.when(counted(F.col(level_out)), 1).otherwise(0).cast("bigint"))
    lvl = lvl.withColumn("_lc", F.sum("_cv").over(w_in))

    def carry() -> DataFrame:
        return (lvl.where(F.col("_c").isNotNull()).groupBy("_k", "_c").agg(F.sum("_cv").alias("_t2"))
                   .select("_k", "_c", F.coalesce(F.sum("_t2").over(w_chunks), F.lit(0)).alias("_in2")))

    return (_with_carry(lvl, carry, hot, {"_in2": F.lit(0)})
               .withColumn(count_out, (F.col("_lc") + F.coalesce("_in2", F.lit(0))).cast("bigint"))
               .drop("_k", "_c", "_v", "_timed", "_e", "_m", "_off", "_g", "_cv", "_lc", "_in2"))


def count_and_last(df: DataFrame, keys, order: Sequence[str | Column], counted: Column, src: Column,
                   value: Column, count_out: str, last_out: str, chunk: Column) -> DataFrame:
    """One pass for two scans: ``count_out`` = running count (inclusive) of ``counted``
    rows, and ``last_out`` = the latest ``src`` row at or before each row, as
    ``struct(v, n)`` with its ``value`` and the running count at that row."""
    order = _cols(order)
    d, hot = _prepare(df.withColumn("_v", counted.cast("bigint")).withColumn("_s", src), keys, chunk)
    w_in = Window.partitionBy("_k", "_c").orderBy(*order).rowsBetween(_UNB, 0)
    w_chunks = Window.partitionBy("_k").orderBy("_c").rowsBetween(_UNB, -1)
    local = d.withColumn("_ln", F.sum("_v").over(w_in))
    local = local.withColumn("_ll", F.last(F.when(F.col("_s"), F.struct(value.alias("v"), F.col("_ln").alias("n"))),
                                           ignorenulls=True).over(w_in))

    def carry() -> DataFrame:
        summ = hot.withColumn("_ln", F.sum("_v").over(w_in)).groupBy("_k", "_c").agg(
            F.sum("_v").alias("_t"),
            F.max_by(F.struct(value.alias("v"), F.col("_ln").alias("n")),
                     F.when(F.col("_s"), F.struct(*order))).alias("_lk"))
        summ = summ.withColumn("_off", F.coalesce(F.sum("_t").over(w_chunks), F.lit(0)))
        summ = summ.withColumn("_lkg", F.when(F.col("_lk").isNotNull(), F.struct(
            F.col("_lk.v").alias("v"), (F.col("_lk.n") + F.col("_off")).alias("n"))))
        return summ.select("_k", "_c", "_off", F.last("_lkg", ignorenulls=True).over(w_chunks).alias("_in"))

    out = _with_carry(local, carry, hot, {"_off": F.lit(0), "_in": F.lit(None).cast(local.schema["_ll"].dataType)})
    out = out.withColumn("_off", F.coalesce("_off", F.lit(0)))
    return (out.withColumn(count_out, (F.col("_ln") + F.col("_off")).cast("bigint"))
               .withColumn(last_out, F.coalesce(
                   F.when(F.col("_ll").isNotNull(), F.struct(F.col("_ll.v").alias("v"),
                                                             (F.col("_ll.n") + F.col("_off")).cast("bigint").alias("n"))),
                   F.struct(F.col("_in.v").alias("v"), F.col("_in.n").cast("bigint").alias("n"))))
               .withColumn(last_out, F.when(F.col(last_out)["n"].isNotNull(), F.col(last_out)))
               .drop("_k", "_c", "_v", "_s", "_ln", "_ll", "_off", "_in"))


def running_sums(df: DataFrame, keys, order: Sequence[str | Column], values: dict[str, Column],
                 chunk: Column, inclusive: bool = True) -> DataFrame:
    """Several running sums over the same key and order in one pass (one shuffle, one
    chunk summary): ``{out: value}``, each BIGINT."""
    order = _cols(order)
    names = list(values)
    d, hot = _prepare(df.select("*", *[values[n].cast("bigint").alias(f"_v{i}") for i, n in enumerate(names)]),
                 keys, chunk)
    w_local = (Window.partitionBy("_k", "_c").orderBy(*order)
               .rowsBetween(_UNB, 0 if inclusive else -1))
    w_chunks = Window.partitionBy("_k").orderBy("_c").rowsBetween(_UNB, -1)
    local = d.select("*", *[F.coalesce(F.sum(f"_v{i}").over(w_local), F.lit(0)).alias(f"_l{i}")
                            for i in range(len(names))])

    def carry() -> DataFrame:
        totals = hot.groupBy("_k", "_c").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(names))])
        return totals.select("_k", "_c", *[F.coalesce(F.sum(f"_t{i}").over(w_chunks), F.lit(0)).alias(f"_i{i}")
                                           for i in range(len(names))])

    out = _with_carry(local, carry, hot, {f"_i{i}": F.lit(0) for i in range(len(names))})
    out = out.select("*", *[(F.col(f"_l{i}") + F.coalesce(f"_i{i}", F.lit(0))).cast("bigint").alias(n)
                            for i, n in enumerate(names)])
    drop = ["_k", "_c"] + [f"_{p}{i}" for p in "vli" for i in range(len(names))]
    return out.drop(*drop)
