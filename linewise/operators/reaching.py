"""E: reaching writers over statement facts (static def/use analysis, branch aware).

Input: a facts table (``linewise.sources.schema.FACTS``), one row per statement in text
order per unit; ``scope_id`` isolates functions / classes (E8), ``branch_path`` lists the
enclosing (test, arm) pairs outermost first (E14).

* E1 straight-line reaching writer and E9 undefined reads are as-of lookups (chunked
  scans keyed by (unit, scope, key)).
* E2/E3 try the most specific prefix that has a writer; stores may imply their prefixes.
* E4/E5 branch isolation and sound merges: per context and key, the writes after the last
  killing item before a read, by number; only output pairs form. Units are dealt over the
  tasks once; those too large for a task are resolved level by level in chunked scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewise.functions.paths import imported_name, path_prefixes_with_depth, statement_writes
from linewise.plans.materialize import cut
from linewise.plans.scan import count_and_last, last_before

KEYS = ["unit_id", "scope_id", "key"]
UNIT_ROWS = 1 << 20   # a unit of more accesses, counted once per level, is no task's alone


def _chunk(seq: str = "seq", bits: int = 20) -> Column:
    return F.shiftright(F.col(seq).cast("bigint"), bits)


def with_accesses(facts: DataFrame) -> DataFrame:
    """Fill ``loads`` and ``stores`` from the statement's own fields: an assignment stores its
    targets, an augmented one reads them too (E10), an import stores the name it binds
    (E11, D7: ``targets`` holds the alias if any, ``rhs_refs`` the module), a ``with`` item
    stores the name it binds its value to (E15), every other statement only reads (E12)."""
    none = F.array().cast("array<string>")
    targets, refs = F.coalesce("targets", none), F.coalesce("rhs_refs", none)
    bound = F.array(imported_name(F.get(refs, 0), F.get(targets, 0)))
    kind = F.col("kind")
    return facts.withColumns({
        "loads": F.when(kind == "import", none).when(
            (kind == "assign") & F.coalesce("is_augmented", F.lit(False)), F.array_union(refs, targets)).otherwise(refs),
        "stores": F.when(kind == "import", bound).when(kind.isin("assign", "with"), targets).otherwise(none)})


def _stores(facts: DataFrame, over_approximate: bool = False, mutating_calls: bool = False) -> Column:
    st = F.coalesce("stores", F.array().cast("array<string>"))
    if mutating_calls:   # E13: a bare call counts as writing what it names
        st = F.concat(st, F.when(F.col("kind") == "call", F.coalesce("loads", F.array().cast("array<string>")))
                           .otherwise(F.array().cast("array<string>")))
    if over_approximate:  # E3: writing a.b.c also writes a.b and a
        st = statement_writes(st)
    return F.array_distinct(st)


def accesses(facts: DataFrame, over_approximate: bool = False, mutating_calls: bool = False) -> DataFrame:
    base = ["unit_id", "scope_id", "seq", "stmt_id", "branch_path"]
    reads = facts.select(*base, F.explode(F.array_distinct("loads")).alias("key"), F.lit(False).alias("_w"))
    writes = facts.select(*base, F.explode(_stores(facts, over_approximate, mutating_calls)).alias("key"),
                          F.lit(True).alias("_w"))
    return reads.unionByName(writes)


def reaching(facts: DataFrame, over_approximate: bool = False, mutating_calls: bool = False) -> DataFrame:
    """E1 (+E8, E10-E12): for every read, the last writer of the same key in the same
    unit and scope strictly before it; ``src`` is NULL when there is none."""
    acc = accesses(facts, over_approximate, mutating_calls)
    res = last_before(acc, KEYS, ["seq", F.col("_w").cast("int")], F.col("_w"), F.col("stmt_id"), "src",
                      _chunk())
    return res.filter(~F.col("_w")).select("unit_id", "scope_id", "key", F.col("stmt_id").alias("dst"),
                                           "seq", "src")


def reaching_edges(facts: DataFrame, **kw) -> DataFrame:
    return (reaching(facts, **kw).filter(F.col("src").isNotNull())
            .select("unit_id", "src", "dst", "key").distinct())


def undefined_reads(facts: DataFrame) -> DataFrame:
    """A read with no writer allocates a source node at the first such read of the
    key; later undefined reads of the key share it."""
    r = reaching(facts).filter(F.col("src").isNull())
    return r.groupBy("unit_id", "scope_id", "key").agg(
        F.min("seq").alias("source_seq"), F.count(F.lit(1)).alias("n_reads"))


def reaching_specific(facts: DataFrame, over_approximate: bool = True) -> DataFrame:
    """E2 (+E3): for a read of ``a.b.c`` use the writer of ``a.b.c`` if any, else of
    ``a.b``, else of ``a``. One group per read, bounded by the path length."""
    base = ["unit_id", "scope_id", "seq", "stmt_id"]
    reads = (facts.select(*base, F.explode(F.array_distinct("loads")).alias("path"))
                  .select(*base, "path", F.explode(path_prefixes_with_depth("path")).alias("p"))
                  .select(*base, "path", F.col("p.prefix").alias("key"), F.col("p.depth").alias("depth"),
                          F.lit(False).alias("_w")))
    writes = facts.select(*base, F.explode(_stores(facts, over_approximate)).alias("key")).select(
        *base, F.lit(None).cast("string").alias("path"), "key", F.lit(None).cast("int").alias("depth"),
        F.lit(True).alias("_w"))
    res = last_before(reads.unionByName(writes), KEYS, ["seq", F.col("_w").cast("int")], F.col("_w"),
                      F.col("stmt_id"), "src", _chunk())
    hit = res.filter(~F.col("_w") & F.col("src").isNotNull())
    best = hit.groupBy("unit_id", "scope_id", "stmt_id", "path").agg(
        F.min_by(F.struct("src", "key"), F.col("depth")).alias("b"))
    return best.select("unit_id", F.col("b.src").alias("src"), F.col("stmt_id").alias("dst"), "path",
                       F.col("b.key").alias("via"))


def must_writes(facts: DataFrame, writes: DataFrame, max_depth: int) -> DataFrame:
    """E5 step 1: a pseudo-write at the end of every block where both arms must write a
    key (directly in the arm, or through a nested block's pseudo-write), bottom-up."""
    stmts = facts.select("unit_id", "scope_id", "seq", F.coalesce("branch_path", F.array()).alias("bp"))
    cur = writes.select("unit_id", "scope_id", "key", "seq", "bp")
    pseudo_all = None
    for level in range(max_depth, 0, -1):
        # a loop body may run no time: loops merge, they never kill
        at = cur.filter((F.size("bp") == level)
                        & (F.coalesce(F.element_at("bp", level)["kind"], F.lit("if")) != "loop")).select(
            "unit_id", "scope_id", "key", F.slice("bp", 1, level - 1).alias("parent"),
            F.element_at("bp", level)["ctl_id"].alias("ctl"), F.element_at("bp", level)["arm"].alias("arm"))
        both = at.groupBy("unit_id", "scope_id", "parent", "ctl", "key").agg(
            F.countDistinct("arm").alias("n_arms")).filter(F.col("n_arms") == 2)
        ends = (stmts.filter(F.size("bp") >= level)
                     .select("unit_id", "scope_id", F.slice("bp", 1, level - 1).alias("parent"),
                             F.element_at("bp", level)["ctl_id"].alias("ctl"), "seq")
                     .groupBy("unit_id", "scope_id", "parent", "ctl").agg(F.max("seq").alias("end_seq")))
        pseudo = both.join(ends, ["unit_id", "scope_id", "parent", "ctl"]).select(
            "unit_id", "scope_id", "key", F.col("end_seq").alias("seq"),
            F.col("parent").alias("bp"), F.col("ctl").alias("block_ctl"))
        pseudo = cut(pseudo, "must_writes")
        pseudo_all = pseudo if pseudo_all is None else pseudo_all.unionByName(pseudo)
        cur = cur.unionByName(pseudo.select("unit_id", "scope_id", "key", "seq", "bp"))
    return pseudo_all


def control_edges(facts: DataFrame) -> DataFrame:
    """Each statement depends on the test of its innermost enclosing block."""
    bp = F.coalesce("branch_path", F.array())
    return (facts.filter(F.size(bp) > 0)
                 .select("unit_id", F.element_at(bp, -1)["ctl_id"].alias("ctl_id"),
                         F.element_at(bp, -1)["arm"].alias("arm"), "stmt_id"))


# positions of the output-sensitive form are (seq, rank) pairs, exact for any seq:
# statements have rank 0; a block's end item comes just after its last statement, an
# arm-end query after that, a block-start query just before its first statement
_START, _AT, _END, _ARM_END = -1, 0, 1, 2
_PART_BITS = 16   # numbers of blocks are expanded in parts of 2**16


def _pos(seq: Column, rank: int) -> Column:
    return F.struct(seq.alias("seq"), F.lit(rank).alias("rank"))


def _with_path(facts: DataFrame) -> DataFrame:
    bp_t = facts.schema["branch_path"].dataType
    return cut(facts.select("unit_id", "scope_id", "seq", "stmt_id", "kind", "loads", "stores",
                            F.coalesce("branch_path", F.array().cast(bp_t)).alias("bp")), "facts")


def _statements(f: DataFrame, loads: Column) -> DataFrame:
    """The statements ``f`` at their positions with what they read and write."""
    return f.select("unit_id", "scope_id", "seq", F.lit(_AT).alias("rank"), "bp", "stmt_id",
                    loads.cast("array<string>").alias("loads"), "stores")


def reaching_branches(facts: DataFrame) -> DataFrame:
    """Branch-aware reaching writers of every read, ``(unit_id, src, dst, key)``."""
    f = _with_path(facts)
    return _resolve(f, _statements(f, F.col("loads")))


def _resolve(f: DataFrame, rows: DataFrame) -> DataFrame:
    """Branch-aware reaching writers of the reads among ``rows``: the statements ``f`` and what
    else reads, at position (seq, rank) on the path bp of an arm that has statements. Units
    of more than ``UNIT_ROWS`` accesses, if there are any, are resolved in chunks."""
    n_keys = F.coalesce(F.size("loads"), F.lit(0)) + F.coalesce(F.size("stores"), F.lit(0))
    sizes = rows.groupBy("unit_id").agg(F.sum(1 + n_keys * (F.size("bp") + 1)).alias("n"),
                                        F.max(F.size("bp")).alias("depth"))
    most, depth = sizes.agg(F.max("n"), F.max("depth")).first()
    if (most or 0) <= UNIT_ROWS:
        return _resolve_units(rows, depth or 0)
    hot = cut(sizes.where(F.col("n") > UNIT_ROWS).select(F.col("unit_id").alias("_hot")), "hot_units")

    def of_hot(df: DataFrame, how: str) -> DataFrame:
        return df.join(F.broadcast(hot), F.col("unit_id").eqNullSafe(F.col("_hot")), how)

    reads = of_hot(rows, "left_semi").select("unit_id", "scope_id", F.explode(F.array_distinct("loads")).alias("key"),
                                             "seq", "rank", "bp", F.col("stmt_id").alias("dst"))
    return _resolve_units(of_hot(rows, "left_anti"), depth).unionByName(
        _resolve_chunked(cut(of_hot(f, "left_semi"), "facts"), reads))


def _with_blocks(rows: DataFrame, max_depth: int) -> DataFrame:
    """Per level d the test and arm of its block (``c``, ``x``; a loop's body may run no time, so
    it counts as no arm), the first statement of the arm, which names it (``a``), and the
    first and last of the block (``f``, ``l``). The columns that name a block begin with those
    of the block around it, so that one sort serves the windows of all levels."""
    named, arms, blocks = [F.size("bp").alias("n")], [], []
    path = []
    for d in range(1, max_depth + 1):
        part = F.get("bp", d - 1)
        named += [(F.size("bp") >= d).alias(f"in{d}"), part["ctl_id"].alias(f"c{d}"), part["arm"].alias(f"x{d}"),
                  part["kind"].alias(f"t{d}")]
        blocks.append([*path, f"in{d}", f"c{d}"])
        path = [*blocks[-1], f"x{d}", f"t{d}"]
        arms.append(path)
    rows = rows.select("*", *named).drop("bp")
    for d in range(max_depth, 0, -1):
        arm = Window.partitionBy("unit_id", "scope_id", *arms[d - 1])
        block = Window.partitionBy("unit_id", "scope_id", *blocks[d - 1])
        rows = rows.withColumn(f"a{d}", F.min("seq").over(arm)).withColumns(
            {f"f{d}": F.min("seq").over(block), f"l{d}": F.max("seq").over(block)})
    return rows.withColumns({f"x{d}": F.when(F.coalesce(f"t{d}", F.lit("if")) != "loop", F.col(f"x{d}"))
                             for d in range(1, max_depth + 1)})


def _keys(keys: str, w: bool) -> Column:
    keys = F.coalesce(F.array_distinct(keys), F.array().cast("array<string>"))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(w).alias("w")))


def _resolve_units(rows: DataFrame, max_depth: int) -> DataFrame:
    """The writers that reach, unit by unit: one exchange, and windows inside the units.

    An access on a path of n arms has a place in each of the n + 1 contexts around it: its
    own in the innermost, in the others that of the block that holds it (a write's at the
    block's end, a read's at its start). A write kills in its own context; a block kills,
    at its end, when both arms must write the key. A write leaves a context if no place
    after its own kills, a read looks out of a context if none before its own does: so each
    access counts in the contexts from ``floor`` to n. In one context a read takes the writes
    before it back to the last killing place: it asks for the numbers 1 to ``idx`` of that
    segment, and a window per number hands out the write.
    """
    levels = range(max_depth + 1)
    n, w = F.col("n"), F.col("w")
    acc = _with_blocks(rows.repartition("unit_id"), max_depth)
    acc = acc.select("*", F.inline(F.concat(_keys("loads", False), _keys("stores", True)))).drop("loads", "stores")
    acc = acc.withColumns({"a0": F.lit(0).cast("bigint"),
                           **{f"e{d}": F.when(w, F.col(f"l{d}")).otherwise(F.col(f"f{d}")) for d in levels[1:]}})
    # as in a join, a NULL unit, scope, key or test equals no other: such blocks give and end nothing
    placed = F.col("unit_id").isNotNull() & F.col("scope_id").isNotNull()
    whole = placed & F.col("key").isNotNull()
    for d in reversed(levels[1:]):
        writes = n == d if d == max_depth else (n == d) | ((n > d) & F.col(f"both{d + 1}"))
        block = [*KEYS, "in1", "c1", *[c for b in levels[2:d + 1] for c in (f"a{b - 1}", f"in{b}", f"c{b}")]]
        arms = F.collect_set(F.when(w & writes, F.col(f"x{d}"))).over(Window.partitionBy(*block))
        acc = acc.withColumn(f"both{d}", whole & F.col(f"c{d}").isNotNull() & (F.size(arms) == 2))

    def place(d: int) -> list[Column]:
        if d == max_depth:
            return [F.col("seq").alias("p"), (2 * F.col("rank") + w.cast("int")).alias("q")]
        rank = F.when(n == d, F.col("rank")).when(w, _END).otherwise(_START)
        return [F.when(n == d, F.col("seq")).otherwise(F.col(f"e{d + 1}")).alias("p"),
                (2 * rank + w.cast("int")).alias("q")]

    shut = F.lit(0)   # the innermost level of a block with a NULL test
    for d in levels[1:]:
        shut = F.when((n >= d) & F.col(f"c{d}").isNull(), d).otherwise(shut)
    acc = acc.withColumn("shut", shut)
    floor = F.lit(0)
    for d in levels:
        kills = F.when(w & (n == d if d == max_depth else (n == d) | ((n > d) & F.col(f"both{d + 1}"))), 1)
        ctx = Window.partitionBy(*KEYS, n >= d, f"a{d}").orderBy(*place(d))
        acc = acc.withColumns({f"s{d}": F.count(kills).over(ctx), f"all{d}": F.count(kills).over(
            ctx.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
        stops = F.when(w, F.col(f"s{d}") < F.col(f"all{d}")).otherwise(F.col(f"s{d}") > 0)
        floor = F.when((n >= d) & stops, d).otherwise(floor)
        acc = acc.withColumn("floor", floor).drop(f"all{d}")
        floor = F.col("floor")
    same = Window.partitionBy(*KEYS, "w", "stmt_id")   # the reads of one statement stop together
    floor = F.when(w, floor).otherwise(F.max("floor").over(same))
    acc = acc.withColumn("floor", F.when(whole, F.greatest("shut", floor)).when(~w & placed, F.col("shut")).otherwise(n))
    floor = F.col("floor")
    places = F.array(*[F.struct(F.lit(d).alias("lvl"), F.col(f"a{d}").alias("ctx"), F.col(f"s{d}").alias("seg"),
                                *place(d)) for d in levels])
    seg = [*KEYS, "lvl", "ctx", "seg"]
    at = acc.select(*KEYS, "w", "stmt_id", F.inline(F.slice(places, floor + 1, n - floor + 1)))
    at = at.withColumn("idx", F.count(F.when(w, 1)).over(
        Window.partitionBy(*seg).orderBy("p", "q").rowsBetween(Window.unboundedPreceding, 0))).where("idx > 0")
    ask = at.select(*seg, "w", "stmt_id", F.explode(
        F.when(w, F.array("idx")).otherwise(F.sequence(F.lit(1).cast("bigint"), "idx"))).alias("idx"))
    given = ask.withColumn("src", F.max(F.when(w, F.col("stmt_id"))).over(Window.partitionBy(*seg, "idx")))
    return given.where("NOT w AND src IS NOT NULL AND stmt_id IS NOT NULL").select("unit_id", "src", F.col("stmt_id").alias("dst"), "key").distinct()


def _resolve_chunked(f: DataFrame, reads: DataFrame) -> DataFrame:
    """Branch-aware reaching writers of ``reads`` (at position (seq, rank) of the path bp)
    among the statements ``f``, forming only output pairs.

    Per context (the path of an arm; [] at top level) the items are the real writes
    directly in it (they kill everything earlier) and the nested blocks, placed at their
    end, which contribute their *exit set* (writes inside that survive to the block's
    end) and kill too when both arms must write the key. A query (a read, or the end of
    an arm) takes the last killing item before it plus every non-killing block after
    that item: segments are running counts of killing items, non-killing blocks are
    numbered inside their segment, and a query with ``m`` of them explodes
    ``sequence(1, m)`` and equi-joins on the number. Exit sets are built bottom-up by
    depth; a read whose own context has no killing item continues at the start of its
    enclosing block one level out.
    """
    bp_t = f.schema["bp"].dataType
    max_depth = f.agg(F.max(F.size("bp"))).first()[0] or 0
    writes = accesses(f.withColumnRenamed("bp", "branch_path")).filter(F.col("_w")).select(
        "unit_id", "scope_id", "key", "seq", F.col("branch_path").alias("bp"), "stmt_id")
    stmts = f.select("unit_id", "scope_id", "seq", "bp")
    # blocks: (unit, scope, parent context, ctl) with first / last statement
    blocks = None
    for d in range(1, max_depth + 1):
        b = (stmts.filter(F.size("bp") >= d)
                  .select("unit_id", "scope_id", F.slice("bp", 1, d - 1).alias("ctx"),
                          F.element_at("bp", d)["ctl_id"].alias("ctl"), "seq")
                  .groupBy("unit_id", "scope_id", "ctx", "ctl")
                  .agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
                  .withColumn("depth", F.lit(d)))
        blocks = b if blocks is None else blocks.unionByName(b)
    if blocks is not None:
        blocks = cut(blocks, "reaching_blocks")
        pseudo = must_writes(f.withColumnRenamed("bp", "branch_path"), writes, max_depth)
        kills = pseudo.select("unit_id", "scope_id", "key", F.col("bp").alias("ctx"),
                              F.col("block_ctl").alias("ctl"), F.lit(True).alias("both"))
    # read queries at every level: level n at the read, level l < n at the start of the
    # enclosing block of depth l + 1
    levels = reads.select("*", F.explode(F.sequence(F.lit(0), F.size("bp"))).alias("lvl"))
    levels = levels.select("unit_id", "scope_id", "key", "dst", F.struct("seq", "rank").alias("own"), "lvl",
                           F.slice("bp", 1, "lvl").alias("ctx"),
                           F.when(F.col("lvl") < F.size("bp"), F.element_at("bp", F.col("lvl") + 1)["ctl_id"])
                            .alias("inner_ctl"), F.size("bp").alias("n"))
    if blocks is not None:
        starts = blocks.select("unit_id", "scope_id", "ctx", F.col("ctl").alias("inner_ctl"),
                               _pos(F.col("first"), _START).alias("start"))
        levels = levels.join(starts, ["unit_id", "scope_id", "ctx", "inner_ctl"], "left")
        levels = levels.withColumn("pos", F.when(F.col("lvl") == F.col("n"), F.col("own")).otherwise(F.col("start")))
    else:
        levels = levels.withColumn("pos", F.col("own"))
    levels = cut(levels.select("unit_id", "scope_id", "key", "dst", "lvl", "ctx", "pos"), "reaching_levels")

    exits = None      # (unit, scope, key, ctx=parent, ctl) -> src  (exit set of a block)
    found = []        # per level: (unit, scope, key, dst, lvl, has_kill, src)
    for d in range(max_depth, -1, -1):
        items = writes.filter(F.size("bp") == d).select(
            "unit_id", "scope_id", "key", F.col("bp").alias("ctx"), _pos(F.col("seq"), _AT).alias("pos"),
            F.lit(True).alias("kill"), F.col("stmt_id").alias("w"), F.lit(None).cast("bigint").alias("ctl"))
        if exits is not None:
            child = (exits.select("unit_id", "scope_id", "key", "ctx", "ctl").distinct()
                          .join(blocks.filter(F.col("depth") == d + 1)
                                      .select("unit_id", "scope_id", "ctx", "ctl", "last"),
                                ["unit_id", "scope_id", "ctx", "ctl"]))
            child = child.join(kills, ["unit_id", "scope_id", "key", "ctx", "ctl"], "left")
            items = items.unionByName(child.select(
                "unit_id", "scope_id", "key", "ctx", _pos(F.col("last"), _END).alias("pos"),
                F.coalesce("both", F.lit(False)).alias("kill"), F.lit(None).cast("bigint").alias("w"), "ctl"))
        queries = levels.filter(F.col("lvl") == d).select(
            "unit_id", "scope_id", "key", "ctx", "pos", F.col("dst").alias("q_dst"),
            F.lit(None).cast("bigint").alias("q_ctl"), F.lit(None).cast(bp_t).alias("q_parent"))
        if d >= 1:
            # arm-end queries of the blocks of depth d: one per (arm, key) with items
            arm_keys = items.select("unit_id", "scope_id", "key", "ctx").distinct()
            ends = blocks.filter(F.col("depth") == d).select(
                "unit_id", "scope_id", F.col("ctx").alias("q_parent"), F.col("ctl").alias("q_ctl"), "last")
            arm_q = (arm_keys.withColumn("q_parent", F.slice("ctx", 1, d - 1))
                             .withColumn("q_ctl", F.element_at("ctx", d)["ctl_id"])
                             .join(ends, ["unit_id", "scope_id", "q_parent", "q_ctl"])
                             .select("unit_id", "scope_id", "key", "ctx", _pos(F.col("last"), _ARM_END).alias("pos"),
                                     F.lit(None).cast("bigint").alias("q_dst"), "q_ctl", "q_parent"))
            queries = queries.unionByName(arm_q)
        rows = (items.select("unit_id", "scope_id", "key", "ctx", "pos", F.lit(1).alias("_t"), "kill", "w", "ctl",
                             F.lit(None).cast("bigint").alias("q_dst"), F.lit(None).cast("bigint").alias("q_ctl"),
                             F.lit(None).cast(bp_t).alias("q_parent"))
                     .unionByName(queries.select("unit_id", "scope_id", "key", "ctx", "pos", F.lit(0).alias("_t"),
                                                 F.lit(False).alias("kill"), F.lit(None).cast("bigint").alias("w"),
                                                 F.lit(None).cast("bigint").alias("ctl"), "q_dst", "q_ctl", "q_parent")))
        ckeys = ["unit_id", "scope_id", "key", "ctx"]
        order = ["pos", "_t"]
        chunk = _chunk("pos.seq")
        is_item, is_kill = F.col("_t") == 1, (F.col("_t") == 1) & F.col("kill")
        # nk numbers the non-killing blocks of a context; the killer carries the nk at
        # its own position, so a query's blocks are exactly killer.nk + 1 .. nk
        rows = count_and_last(rows, ckeys, order, (is_item & ~F.col("kill")).cast("int"), is_kill,
                              F.struct("w", "ctl"), "nk", "killer", chunk)
        rows = cut(rows, f"reaching_level_{d}")
        nonkill = rows.filter((F.col("_t") == 1) & ~F.col("kill")).select(*ckeys, F.col("nk").alias("idx"), "ctl")
        q = (rows.filter(F.col("_t") == 0)
                 .withColumn("seg", F.col("killer").isNotNull().cast("int"))
                 .withColumn("lo", F.coalesce(F.col("killer.n"), F.lit(0)) + 1))
        # contributions: the killer (a write or a both-write block), then blocks lo..nk
        by_kill = q.filter(F.col("seg") > 0).select(
            "unit_id", "scope_id", "key", "ctx", "q_dst", "q_ctl", "q_parent",
            F.col("killer.v.w").alias("w"), F.col("killer.v.ctl").alias("ctl"))
        by_block = (q.filter(F.col("nk") >= F.col("lo"))
                     .select(*ckeys, "q_dst", "q_ctl", "q_parent", "lo", "nk",
                             F.explode(F.sequence(F.shiftright("lo", _PART_BITS),
                                                  F.shiftright("nk", _PART_BITS))).alias("part"))
                     .select(*ckeys, "q_dst", "q_ctl", "q_parent", F.explode(F.sequence(
                         F.greatest("lo", F.shiftleft("part", _PART_BITS)),
                         F.least("nk", F.shiftleft(F.col("part") + 1, _PART_BITS) - 1))).alias("idx"))
                     .join(nonkill, ckeys + ["idx"])
                     .select("unit_id", "scope_id", "key", "ctx", "q_dst", "q_ctl", "q_parent",
                             F.lit(None).cast("bigint").alias("w"), "ctl"))
        contrib = by_kill.unionByName(by_block)
        direct = contrib.filter(F.col("w").isNotNull()).select(
            "unit_id", "scope_id", "key", "q_dst", "q_ctl", "q_parent", F.col("w").alias("src"))
        if exits is not None:
            via = (contrib.filter(F.col("ctl").isNotNull())
                          .join(exits, ["unit_id", "scope_id", "key", "ctx", "ctl"])
                          .select("unit_id", "scope_id", "key", "q_dst", "q_ctl", "q_parent", "src"))
            direct = direct.unionByName(via)
        got = cut(direct.distinct(), f"reaching_contrib_{d}")
        # reads: contributions at this level, and whether this level had a killer
        found.append(got.filter(F.col("q_dst").isNotNull()).select(
            "unit_id", "scope_id", "key", F.col("q_dst").alias("dst"), F.lit(d).alias("lvl"), "src"))
        found.append(q.filter(F.col("q_dst").isNotNull() & (F.col("seg") > 0)).select(
            "unit_id", "scope_id", "key", F.col("q_dst").alias("dst"), F.lit(d).alias("lvl"),
            F.lit(None).cast("bigint").alias("src")))
        if d >= 1:
            new_exits = got.filter(F.col("q_dst").isNull()).select(
                "unit_id", "scope_id", "key", F.col("q_parent").alias("ctx"), F.col("q_ctl").alias("ctl"), "src")
            exits = new_exits.distinct()
    allf = found[0]
    for x in found[1:]:
        allf = allf.unionByName(x)
    # a read stops at the innermost level that has a killer
    read = ["unit_id", "scope_id", "key", "dst"]
    allf = cut(allf, "reaching_found")
    stops = allf.filter(F.col("src").isNull()).groupBy(*read).agg(F.max("lvl").alias("stop"))
    return (allf.filter(F.col("src").isNotNull()).join(stops, read, "left")
                .filter(F.col("stop").isNull() | (F.col("lvl") >= F.col("stop")))
                .select("unit_id", "src", "dst", "key").distinct())


def loop_edges(facts: DataFrame) -> DataFrame:
    """Back-edges of loops. The test of a loop (block kind ``loop``; the statement whose
    stmt_id is the block's ctl_id) runs again after the body, so it also depends on the
    writers of the keys it reads that reach the body's end from inside the body. Plain
    ``if`` blocks have none."""
    f = _with_path(facts)
    inside = f.select("unit_id", "scope_id", "seq", "bp", F.posexplode("bp").alias("d", "block")) \
        .where("block.kind = 'loop' AND block.arm = 'T'")
    ends = inside.groupBy("unit_id", "scope_id", F.col("block.ctl_id").alias("dst"),
                          F.slice("bp", 1, F.col("d") + 1).alias("bp")).agg(F.max("seq").alias("seq"))
    tests = f.select("unit_id", "scope_id", F.col("stmt_id").alias("dst"),
                     F.explode(F.array_distinct("loads")).alias("key"))
    again = ends.join(tests, ["unit_id", "scope_id", "dst"]).select(
        "unit_id", "scope_id", "key", "seq", F.lit(_ARM_END).alias("rank"), "bp", "dst")
    body = f.select("unit_id", F.col("stmt_id").alias("src"), F.explode("bp").alias("block")).select(
        "unit_id", "src", F.col("block.ctl_id").alias("dst")).distinct()
    again = again.withColumns({"loads": F.array("key"), "stores": F.lit(None).cast("array<string>")})
    rows = _statements(f, F.lit(None)).unionByName(again.withColumnRenamed("dst", "stmt_id").drop("key"))
    return (_resolve(f, rows).join(body, ["unit_id", "src", "dst"], "left_semi")
            .select("unit_id", F.col("dst").alias("ctl_id"), "src", "key"))
