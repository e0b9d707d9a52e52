"""Prefix trie of rebuilt conversations by composable monoid fingerprints.

A turn is an affine map ``x -> a x + b`` modulo the prime 2**61 - 1, drawn from hashes of
its role and text; a sequence of turns is the composition of their maps, so the
fingerprints (a, b) form a monoid (a group, in fact, since no a is zero). A rebuilt
conversation is the head of its base conversation and a suffix of its own turns. Its
prefixes are never written as texts: with P(j) for the product of a conversation's first j
turns, the prefix that ends at own turn j has the fingerprint

    P_own(j) . P_own(h)^-1 . P_base(h')

and keeps a reference to the stored turn that is its last.

Steps, every one a Spark job over tables whose rows are turns or nodes:

1. turns are range-sorted by (conversation, turn); every task multiplies along its range,
   and the one conversation that a range shares with the range before takes over that
   range's product (one carried product per range);
2. entries: one row (conversation, depth) per prefix of a rebuilt conversation;
3. nodes: entries grouped by (depth, fingerprint), a partial aggregate;
4. equality of each group is verified through the stored turns: all entries must name one
   parent, and where they refer to different stored turns, those turns' roles and texts
   must be equal. A collision makes the whole build start again with other hashes;
5. subtree sums without walking the tree: every node is owned by its smallest member. A
   node's subtree is all that its members own at its depth and below. So the sum over the
   subtree is the sum over its members of what they own, less what its owner owns above
   it: one aggregate over the entries and one running sum per owner (in pieces of depths).

The SHA-256 of the members that end in a node needs their ids in order; ids are first
joined in blocks of 4,096 consecutive ids, then each node's blocks stream through one hash
state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewise.llm.common import cut, ship_package, table
from linewise.llm.mixing import n_words
from linewise.llm.ordered import before, join_spread

PRIME = (1 << 61) - 1
GROUP, MAX_HEAD = 20, 3
BLOCK_BITS, PIECE_BITS, ROW_BITS = 12, 16, 40
KEY = ["depth", "a", "b"]
TURN = "conv_id bigint, pos bigint, ref bigint, words bigint, a bigint, b bigint, pa bigint, pb bigint"


def then(f: tuple[int, int], g: tuple[int, int], p: int) -> tuple[int, int]:
    """The fingerprint of a sequence ``f`` followed by a sequence ``g``."""
    return g[0] * f[0] % p, (g[0] * f[1] + g[1]) % p


def inverse(f: tuple[int, int], p: int) -> tuple[int, int]:
    a = pow(f[0], -1, p)
    return a, -a * f[1] % p


def element(h1: int, h2: int, p: int) -> tuple[int, int]:
    """The map of a turn; ``a`` is never zero."""
    return 1 + h1 % (p - 1), h2 % p


def stored(conversations: DataFrame, seed: int, p: int) -> DataFrame:
    """The turns in order, written once: conv_id, role, text, words, ref (range and row, the
    address of the stored turn), and within the part of the conversation that lies in the
    range: pos (from 1), the product up to the turn (a, b) and before it (pa, pb). ``last``
    marks a range's last row."""
    blank = F.lit("")
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"))
    rows = rows.withColumns({
        "h1": F.xxhash64(F.lit(seed), "role", "text"), "h2": F.xxhash64(F.lit(~seed), "text", "role"),
        "words": n_words(F.col("text")), "tie": F.xxhash64("role", "text"),
        "uid": F.monotonically_increasing_id()})  # equal rows may be told apart at will
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("tie"), F.col("uid")]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref, conv, pos, f, held = TaskContext.get().partitionId() << ROW_BITS, None, 0, (1, 0), None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held:
                yield _with_last(held, False)
            out = []
            for c, h1, h2 in zip(*(batch.column(i).to_pylist() for i in (0, 4, 5))):
                if c != conv:
                    conv, pos, f = c, 0, (1, 0)
                pos, ref, earlier = pos + 1, ref + 1, f
                f = then(f, element(h1, h2, p), p)
                out.append((ref, pos, *f, *earlier))
            held = batch.columns[:4] + [pa.array(col, pa.int64()) for col in zip(*out)]
        if held:
            yield _with_last(held, True)

    schema = ("conv_id bigint, role string, text string, words bigint, ref bigint, pos bigint, "
              "a bigint, b bigint, pa bigint, pb bigint, last boolean")
    return cut(rows.repartitionByRange(*order).sortWithinPartitions(*order)
               .select("conv_id", "role", "text", "words", "h1", "h2").mapInArrow(multiply, schema), "trie-turns")


def _with_last(columns: list[pa.Array], last: bool) -> pa.RecordBatch:
    flags = [False] * len(columns[0])
    flags[-1] = last
    return pa.RecordBatch.from_arrays([*columns, pa.array(flags)], names=[
        "conv_id", "role", "text", "words", "ref", "pos", "a", "b", "pa", "pb", "last"])


def products(turns: DataFrame, p: int) -> DataFrame:
    """Position and prefix product of every stored turn within its whole conversation: what
    a range's first conversation has in earlier ranges is composed in front."""
    # one row per range reaches the driver
    ends = turns.where("last").select((F.shiftright("ref", ROW_BITS)).alias("part"), "conv_id", "pos", "a", "b")
    carried, so_far = {}, None
    for r in sorted(ends.collect(), key=lambda r: r.part):
        n, f = r.pos, (r.a, r.b)
        if so_far and so_far[0] == r.conv_id:
            n, f = so_far[1] + n, then(so_far[2], f, p)
        if so_far:
            carried[r.part] = so_far
        so_far = r.conv_id, n, f

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, pos, ref, words, a, b, pa_, pb in zip(*(col.to_pylist() for col in batch.columns)):
                more = carried.get(ref >> ROW_BITS)
                if more and more[0] == c:
                    _, n, f = more
                    pos, (a, b), (pa_, pb) = pos + n, then(f, (a, b), p), then(f, (pa_, pb), p)
                out.append((c, pos, ref, words, a, b, pa_, pb))
            yield _batch(out)

    names = [c.split()[0] for c in TURN.split(", ")]
    return cut(turns.select(*names).mapInArrow(join_up, TURN), "trie-products")


def _batch(rows: list[tuple], names: tuple[str, ...] = tuple(c.split()[0] for c in TURN.split(", "))) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=list(names))


def head_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % (MAX_HEAD + 1)


def links(placed: DataFrame) -> DataFrame:
    """One row per conversation: its id, n turns, the head length h asked for, and of its
    own and its base conversation's first turns the products and references."""
    first = [F.max(F.when(F.col("pos") == k, F.col(c))).alias(f"{c}{k}")
             for k in range(1, MAX_HEAD + 1) for c in ("a", "b", "ref", "words")]
    convs = cut(placed.groupBy("conv_id").agg(F.max("pos").alias("n"), *first), "trie-heads")
    base = convs.select([F.col(c).alias(f"base_{c}") for c in convs.columns])
    own = convs.select("conv_id", "n", *[c for k in range(1, MAX_HEAD + 1) for c in (f"a{k}", f"b{k}")])
    h = head_length(F.col("conv_id"))
    return cut(own.withColumn("h", h).join(base, F.col("conv_id") - F.col("conv_id") % GROUP
                                           == F.col("base_conv_id"), "left")
               .withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
               .withColumn("end", F.col("head") + F.greatest(F.lit(0), F.col("n") - F.col("h"))), "trie-links")


def _at(name: str, k: Column, none: int) -> Column:
    """Column ``name`` + k of a row, for k from 1 (``none`` at 0)."""
    out = F.when(k == 1, F.col(f"{name}1"))
    for i in range(2, MAX_HEAD + 1):
        out = out.when(k == i, F.col(f"{name}{i}"))
    return out.otherwise(F.lit(none)).cast("bigint")


ENTRY = "conv_id bigint, depth bigint, a bigint, b bigint, pa bigint, pb bigint, ref bigint, words bigint, ends int"


def entries(placed: DataFrame, linked: DataFrame, p: int) -> DataFrame:
    """One row per prefix of every rebuilt conversation: conv_id, depth, fingerprint (a, b),
    the parent's (pa, pb), the stored turn it ends with (ref; the root: -1), that turn's
    words, and ends (1 at the conversation's full length)."""
    d = F.col("depth")
    heads = linked.withColumn("depth", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("head").cast("bigint")))).select(
        "conv_id", "depth", _at("base_a", d, 1).alias("a"), _at("base_b", d, 0).alias("b"),
        F.when(d > 0, _at("base_a", d - 1, 1)).alias("pa"), F.when(d > 0, _at("base_b", d - 1, 0)).alias("pb"),
        _at("base_ref", d, -1).alias("ref"), _at("base_words", d, 0).alias("words"),
        (d == F.col("end")).cast("int").alias("ends"))
    own = placed.join(linked.where("n > h").select(
        "conv_id", "h", "head", "end", _at("a", F.col("h"), 1).alias("ha"), _at("b", F.col("h"), 0).alias("hb"),
        _at("base_a", F.col("head"), 1).alias("ga"), _at("base_b", F.col("head"), 0).alias("gb")), "conv_id")
    own = own.where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("depth"), "a", "b", "pa", "pb", "ref", "words",
        "end", "ha", "hb", "ga", "gb")

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, front = None, (1, 0)
        names = tuple(c.split()[0] for c in ENTRY.split(", "))
        for batch in batches:
            out = []
            for c, depth, a, b, pa_, pb, ref, words, end, ha, hb, ga, gb in zip(*(x.to_pylist() for x in batch.columns)):
                if c != conv:
                    conv, front = c, then((ga, gb), inverse((ha, hb), p), p)
                out.append((c, depth, *then(front, (a, b), p), *then(front, (pa_, pb), p), ref, words,
                            int(depth == end)))
            yield _batch(out, names).cast(pa.schema(
                [(n, pa.int32() if n == "ends" else pa.int64()) for n in names]))

    return cut(heads.unionByName(own.mapInArrow(rebuilt, ENTRY)), "trie-entries")


def nodes_of(entry: DataFrame) -> DataFrame:
    """Entries by (depth, fingerprint): the members, and what their equality is judged by."""
    ends = {f"{m}_{c}": f(c) for c in ("pa", "pb", "ref") for m, f in (("min", F.min), ("max", F.max))}
    return cut(entry.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("ends").alias("n_ends"),
        F.max("words").alias("words"), *[c.alias(n) for n, c in ends.items()]), "trie-nodes")


def collisions(entry: DataFrame, nodes: DataFrame, turns: DataFrame) -> int:
    """Nodes whose entries aren't one sequence of turns: another parent, or another last
    turn. Entries that refer to the same stored turn need no comparison; of the others, the
    distinct turns of a node are read back and compared whole."""
    parents = nodes.where("min_pa <> max_pa OR min_pb <> max_pb").count()
    refs = join_spread(entry.select(*KEY, "ref"), KEY, nodes, "n_convs", F.expr("min_ref <> max_ref")).distinct()
    turn = F.struct("role", "text")
    told = (refs.join(turns.select("ref", "role", "text"), "ref").groupBy(*KEY)
            .agg(F.min(turn).alias("least"), F.max(turn).alias("most")))
    return parents + told.where("least <> most").count()


def member_digests(entry: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ids, ascending, of the conversations that end in a node."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = (entry.where("ends = 1").withColumn("block", F.shiftright("conv_id", BLOCK_BITS))
              .groupBy(*KEY, "block").agg(ids.alias("ids")))  # at most 4,096 ids each

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        names, kinds = [*KEY, "ends_sha256"], [pa.int64()] * 3 + [pa.string()]
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key == node:
                    state.update(b"," + ids.encode())
                    continue
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        if node:
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], k) for c, k in zip((*node, state.hexdigest()), kinds)], names=names)

    return (blocks.repartition(*[F.col(c) for c in KEY]).sortWithinPartitions(*KEY, "block")
            .select(*KEY, "ids").mapInArrow(digest, "depth bigint, a bigint, b bigint, ends_sha256 string"))


def subtree_sums(entry: DataFrame, nodes: DataFrame) -> DataFrame:
    """depth, a, b, n_leaves and saved_tokens of every node."""
    value = (F.col("n_convs") - 1) * F.col("words")
    owned = nodes.groupBy("conv_id").agg(
        F.sum(value).alias("owned"), F.max((F.col("n_convs") == F.col("n_ends")).cast("int")).alias("leaf"))
    members = (entry.select("conv_id", *KEY).join(owned, "conv_id").groupBy(*KEY)
               .agg(F.sum("leaf").cast("bigint").alias("n_leaves"), F.sum("owned").alias("all_owned")))
    shared = (nodes.where("n_convs > 1").select("conv_id", *KEY, value.alias("value"))
              .withColumn("part", F.shiftright("depth", PIECE_BITS)))  # an owner's nodes, in pieces of depths
    above = before(shared, ["conv_id"], [F.col("depth")], F.col("value"), "above").select(*KEY, "above")
    return (members.join(above, KEY, "left")
            .select(*KEY, "n_leaves", F.when(F.col("above").isNull(), F.lit(0)).otherwise(
                F.col("all_owned") - F.col("above")).alias("saved_tokens")))


def prefix_trie(conversations: DataFrame, primes: tuple[int, ...] = (PRIME, PRIME, PRIME)) -> DataFrame:
    """The nodes of the trie over the rebuilt conversations: conv_id (smallest member),
    depth, parent_conv_id (root: null), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and ref, the stored turn that the node ends with (root: -1).

    Every conv_id c is rebuilt from the first h = crc32(c) mod 4 turns of conversation
    c - c % 20 (the remainder has the sign of c) and its own turns after its first h. Turns
    are in ascending order, null first; turns of equal number by a hash of role and text,
    and equal rows are turns each. A null role or text is the empty text. Rows without a
    conv_id belong to no conversation and are left out; an empty table has no node, not
    even a root. Other columns are ignored.

    ``primes`` are the moduli of the attempts: if groups don't stand up to the comparison
    of their turns, the next attempt draws other hashes."""
    ship_package(conversations.sparkSession)
    for seed, p in enumerate(primes):
        turns = stored(conversations, seed, p)
        placed = products(turns, p)
        entry = entries(placed, links(placed), p)
        nodes = nodes_of(entry)
        if not collisions(entry, nodes, turns):
            break
    else:
        raise RuntimeError(f"fingerprints collided in {len(primes)} attempts")
    children = (nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("min_pa").alias("a"),
                                                 F.col("min_pb").alias("b")).agg(F.count("*").alias("n_children")))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("min_pa"),
                           F.col("b").alias("min_pb"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return (nodes.join(children, KEY, "left").join(subtree_sums(entry, nodes), KEY)
            .join(member_digests(entry), KEY, "left").join(parents, ["depth", "min_pa", "min_pb"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs",
                    F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), "n_leaves",
                    "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
                    F.col("min_ref").alias("ref")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("ref")
