"""Rows in one global order, numbered and summed without bringing a key's rows together.

``ordered`` range-partitions the rows by the whole sort key, so rows that share the head of
the key (a source with a third of all documents, one very long conversation) are spread
too, and writes them with the number of their range (``part``). Running sums are then local
to (keys, part); the totals of the parts before are added to them. There is one total per
key and part that the key lies in, not one per row. ``join_spread`` joins rows with facts
about their keys where some keys have very many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewise.llm.common import cut

#: A key with over one part in so many of all rows is frequent; there are fewer such keys.
FREQUENT = 5000
LEAST_FREQUENT = 1000


def ordered(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``df``, written in ascending ``order`` over all partitions, with ``part`` added."""
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order)
               .withColumn("part", F.spark_partition_id()), label)


def before(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same ``keys`` (not null) that
    come before, for a table of :func:`ordered`."""
    upto = Window.unboundedPreceding, -1
    local = F.sum(value).over(Window.partitionBy("part", *keys).orderBy(*order).rowsBetween(*upto))
    totals = df.groupBy(*keys, "part").agg(F.sum(value).alias("_total"))
    # without keys: one row per part
    carried = totals.select(*keys, "part", F.coalesce(F.sum("_total").over(
        Window.partitionBy(*keys).orderBy("part").rowsBetween(*upto)), F.lit(0)).alias("_carried"))
    return (df.withColumn(name, F.coalesce(local, F.lit(0))).join(carried, [*keys, "part"])
            .withColumn(name, F.col(name) + F.col("_carried")).drop("_carried"))


def join_spread(rows: DataFrame, keys: list[str], stats: DataFrame, n: str, wanted: Column,
                payload: tuple[str, ...] = (), least: int | None = None) -> DataFrame:
    """Rows of ``rows`` whose key is ``wanted``, with ``payload`` of ``stats``, without
    bringing the rows of a frequent key together.

    ``stats`` has one row per key of ``rows`` (not null) and the key's number of rows ``n``.
    Keys with at least one in ``FREQUENT`` of all rows are fewer than that many, whatever
    the input, and are broadcast, wanted or not: their rows are decided where they lie. Only
    the rows of other keys are shuffled."""
    total = stats.agg(F.sum(n)).first()[0] or 0
    bound = max(LEAST_FREQUENT if least is None else least, total // FREQUENT)
    named = stats.select(*keys, F.col(n).alias("_n"), wanted.alias("_wanted"), *payload)
    hot = F.broadcast(named.where(F.col("_n") >= bound).drop("_n"))
    tagged = rows.join(hot, keys, "left")
    there = tagged.where("_wanted").select(*rows.columns, *payload)
    cold = named.where((F.col("_n") < bound) & F.col("_wanted")).drop("_n", "_wanted")
    return there.unionByName(tagged.where("_wanted IS NULL").select(*rows.columns).join(cold, keys)
                             .select(*rows.columns, *payload))
