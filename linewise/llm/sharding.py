"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each level every child draws
``ln(u) / weight`` with ``u`` in (0, 1) from a hash of the document's id and the child's
name, and the largest draw wins, so a child gets its share of the weight. A child's draw
depends on itself alone: when a weight changes, only documents that enter or leave that
subtree move. A new shard opens a region of its own, hence takes documents only into
itself. Everything is decided by doc_id and the tree (law ``key``), with built-in
functions; no data is moved to decide.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewise.llm.common import documents

#: Hash classes that slots are numbered in; each is one window group of a shard.
SALTS = 4096
_HEX = 13  # 52 bits


@dataclass(frozen=True)
class Shard:
    shard: int
    rack: int
    region: int
    weight: float = 1.0


def tree(n: int, base: int = 8) -> list[Shard]:
    """``n`` shards: racks of two and regions of four up to ``base``, then one region for
    each further shard."""
    full = [Shard(s, s // 2, s // 4) for s in range(min(n, base))]
    more = [Shard(s, (base + 1) // 2 + s - base, (base + 3) // 4 + s - base) for s in range(base, n)]
    return full + more


def hash_bits(text: Column, digits: int = _HEX) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("bigint")


def _pick(key: Column, level: str, weights: dict[int, float]) -> Column:
    """The child with the largest weighted draw."""
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    def draw(child, weight):
        u = (hash_bits(F.concat(key, F.lit(f":{level}:{child}"))) + 0.5) / float(16 ** _HEX)
        return F.struct((F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(child).alias("child"))
    return F.array_max(F.array(*[draw(c, w) for c, w in weights.items()]))["child"]


def shard_of(doc_id: Column, shards: list[Shard]) -> Column:
    """The shard of a document (a null id is the key ``null``)."""
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))

    def sums(of, members):
        out: dict[int, float] = {}
        for m in members:
            out[of(m)] = out.get(of(m), 0.0) + m.weight
        return out

    def by(chosen: Column, options: dict[int, Column]) -> Column:
        out = None
        for value, then in options.items():
            out = F.when(chosen == value, then) if out is None else out.when(chosen == value, then)
        return out

    live = [s for s in shards if s.weight > 0]
    region = _pick(key, "region", sums(lambda m: m.region, live))
    rack = by(region, {r: _pick(key, "rack", sums(lambda m: m.rack, [m for m in live if m.region == r]))
                       for r in dict.fromkeys(m.region for m in live)})
    return by(rack, {k: _pick(key, "shard", sums(lambda m: m.shard, [m for m in live if m.rack == k]))
                     for k in dict.fromkeys(m.rack for m in live)}).cast("int")


def numbered(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """Add ``slot``: gapless numbers from 0 in each shard, in the order of (hash class of
    doc_id, doc_id, text_crc32). Numbers are local to (shard, hash class); the classes'
    counts, a table of at most shards x ``salts`` rows, give each its first number."""
    salt = hash_bits(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), 6) % salts
    rows = rows.withColumn("_salt", salt)
    counts = rows.groupBy("shard", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    local = Window.partitionBy("shard", "_salt").orderBy("doc_id", "text_crc32")
    return (rows.withColumn("_at", F.row_number().over(local) - 1)
            .join(F.broadcast(first), ["shard", "_salt"])  # at most shards x salts rows
            .withColumn("slot", (F.col("_first") + F.col("_at")).cast("bigint"))
            .drop("_salt", "_at", "_first"))


def assign(docs: DataFrame, n_shards: int = 8, shards: list[Shard] | None = None,
           grown: list[Shard] | None = None) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot, grown_shard (with
    one more shard). Null and empty texts have size 1; repeated rows get a slot each; a
    null doc_id is a key like any other. Columns other than doc_id and text are ignored."""
    shards = shards or tree(n_shards)
    grown = grown or tree(n_shards + 1)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), shards).alias("shard"),
        shard_of(F.col("doc_id"), grown).alias("grown_shard"))
    return numbered(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir))
