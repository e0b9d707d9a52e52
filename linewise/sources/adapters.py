"""Views of the driver tables in the trace / facts model (FIXTURES §5). No new data:
every row here is derived by Spark from the given tables, so the work grows with them.

events  -> trace      run = user_id, k = props.k; each source event gives at most two
                      trace rows, at event ids 2*event_id and 2*event_id + 1
lineitem -> trace     run = supplier, location = part bucket, R rows write
lineitem -> facts     unit = supplier and year, blocks three deep: half, quarter, month
orders   -> names     references with nested and quoted brackets, calls, other alphabets
orders  -> facts      unit = customer, key = priority, block = (year, status)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.operators.reaching import with_accesses
from linewise.plans.materialize import cut
from linewise.plans.scan import running_sum
from linewise.sources.schema import BRANCH, TRACE

# Fixed values of the events adapter.
LINE_MOD = 10            # lineno = k % 10
ENTER_BELOW = 25         # signup with k < 25 enters a call
EXIT_BELOW = 75          # error with k < 75 leaves a call
EXCEPTION_BELOW = 90     # error with 75 <= k < 90 is an abnormal end
LOOP_INIT_FROM = 75      # signup with k >= 75 opens a loop
LOOP_CLEAR_FROM = 90     # error with k >= 90 clears a loop
PART_BUCKETS = 50        # lineitem location = l_partkey % 50
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")



def _no_vars() -> Column:
    return F.lit(None).cast(TRACE["uses"].dataType)


def _empty_vars() -> Column:
    return F.array().cast(TRACE["uses"].dataType)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _var(name: Column, vid: Column, vtype: Column, columns: Column | None = None) -> Column:
    if columns is None:
        columns = F.lit(None).cast("array<string>")
    return F.struct(name.alias("name"), vid.cast("bigint").alias("id"),
                    vtype.alias("type"), columns.alias("columns"))


def _s(x) -> Column:
    return (F.lit(x) if not isinstance(x, Column) else x).cast("string")


def event_vars(k: Column) -> dict[str, Column]:
    """The locations an event with parameter k touches."""
    v = k % 4
    i = k % 3
    f = F.floor(k / 12) % 2
    vtype = F.when(v == 0, F.lit("DataFrame")).otherwise(F.lit("list"))
    cols = F.when(v == 0, F.array(F.concat(F.lit("c"), _s(i)), F.concat(F.lit("c"), _s(i + 1))))
    n0 = _var(F.concat(F.lit("v"), _s(v)), v, vtype, cols)
    n1 = _var(F.concat(F.lit("v"), _s(v), F.lit("["), _s(i), F.lit("]")), 100 + k % 12, F.lit("list"))
    n2 = _var(F.concat(F.lit("v"), _s(v), F.lit("["), _s(i), F.lit("].f"), _s(f)),
              200 + (k % 12) * 2 + f, F.lit("int"))
    b = (k + 1) % 4
    base = _var(F.concat(F.lit("v"), _s(b)), b,
                F.when(b == 0, F.lit("DataFrame")).otherwise(F.lit("list")))
    return {"n0": n0, "n1": n1, "n2": n2, "base": base}


def _call_enter(k: Column, vs: dict[str, Column]) -> Column:
    name = F.concat(F.lit("f"), _s(k % 7))
    return F.struct(
        (k % 5 == 0).alias("is_method"), name.alias("co_name"), name.alias("qualname"),
        F.concat(F.lit("m"), _s(k % 3)).alias("module"),
        F.array(vs["n0"], vs["n1"]).alias("args"),
        (k % 4).cast("bigint").alias("func_id"),   # address of the receiver v{k%4}
        F.lit(True).alias("called_by_user"), (k % 2 == 0).alias("defined_by_user"))


def _call_exit(k: Column) -> Column:
    return F.struct(
        F.lit(None).cast("boolean").alias("is_method"),
        F.concat(F.lit("f"), _s(k % 7)).alias("co_name"),
        F.lit(None).cast("string").alias("qualname"), F.lit(None).cast("string").alias("module"),
        _no_vars().alias("args"), F.lit(None).cast("bigint").alias("func_id"),
        F.lit(True).alias("called_by_user"), (k % 2 == 0).alias("defined_by_user"))


def _row(kind, eid, lineno, line, uses, defs, call, loop_name, msg) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(kind).alias("kind"), eid.cast("bigint").alias("event_id"),
        (lineno if lineno is not None else none).cast("bigint").alias("lineno"),
        (line if line is not None else none).cast("string").alias("line"),
        (uses if uses is not None else _no_vars()).alias("uses"),
        (defs if defs is not None else _no_vars()).alias("defs"),
        (call if call is not None else none.cast(TRACE["call"].dataType)).alias("call"),
        (loop_name if loop_name is not None else none).cast("string").alias("loop_name"),
        (msg if msg is not None else none).cast("string").alias("msg"))


def events_trace(spark: SparkSession, sf_dir: str, with_time: bool = False) -> DataFrame:
    """The trace adapter over ``events`` (one scan, one generate; no shuffle), a plan that
    prunes to the columns its reader asks for; ``stored_events_trace`` is for several readers.

    Each event first expands into at most two (kind, offset) pairs; every field is then
    one flat expression of (kind, event_type, k), which keeps the generated code small.
    """
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "props", "ts").select(
        F.col("user_id").alias("run_id"), "event_id", "event_type", "ts",
        F.get_json_object("props", "$.k").cast("int").alias("k"))
    k, et = F.col("k"), F.col("event_type")
    primary = (F.when(et.isin("click", "view", "purchase"), F.lit("exec"))
                .when((et == "signup") & (k < ENTER_BELOW), F.lit("enter"))
                .when((et == "error") & (k < EXIT_BELOW), F.lit("exit"))
                .when((et == "error") & (k < EXCEPTION_BELOW), F.lit("exception")))
    secondary = (F.when(et == "purchase", F.lit("update"))
                  .when((et == "signup") & (k >= LOOP_INIT_FROM), F.lit("loop_init"))
                  .when((et == "view") & (k % 4 == 0), F.lit("loop_iter"))
                  .when((et == "error") & (k >= LOOP_CLEAR_FROM), F.lit("loop_clear")))
    pairs = F.array(F.struct(primary.alias("kind"), F.lit(0).alias("off")),
                    F.struct(secondary.alias("kind"), F.lit(1).alias("off")))
    x = ev.select("run_id", "event_id", "event_type", "k", "ts", F.explode(pairs).alias("p")) \
          .select("run_id", "event_id", "event_type", "k", "ts", F.col("p.kind").alias("kind"),
                  F.col("p.off").alias("off")) \
          .filter(F.col("kind").isNotNull())
    kind = F.col("kind")
    vs = event_vars(k)
    lineno = F.when(kind != "exception", k % LINE_MOD).cast("bigint")
    line = F.when(kind.isin("exec", "enter", "exit"),
                  F.concat(et, F.lit("("), _s(k % LINE_MOD), F.lit(")")))
    uses = (F.when(kind == "exec",
                   F.when(et == "click", F.array(vs["n0"], vs["n1"], vs["n2"]))
                    .when(et == "view", F.array(vs["n0"], vs["n1"]))
                    .otherwise(F.array(vs["base"])))
             .when(kind == "update", _empty_vars()))
    defs = (F.when(kind == "update", F.array(vs["n0"], vs["n1"], vs["n2"]))
             .when(kind == "exec", _empty_vars()))
    call = (F.when(kind == "enter", _call_enter(k, vs))
             .when(kind == "exit", _call_exit(k)))
    loop_name = F.when(kind.startswith("loop_"), F.concat(F.lit("loop"), _s(k % 2)))
    msg = F.when(kind == "exception", F.concat(F.lit("error k="), _s(k)))
    cols = ["run_id", (2 * F.col("event_id") + F.col("off")).cast("bigint").alias("event_id"), "kind",
            lineno.alias("lineno"), line.alias("line"), uses.alias("uses"), defs.alias("defs"),
            call.alias("call"), loop_name.alias("loop_name"), msg.alias("msg")]
    return x.select(*cols, "ts") if with_time else x.select(*cols)


def stored_events_trace(spark: SparkSession, sf_dir: str, with_time: bool = False) -> DataFrame:
    """``events_trace`` written once, for operators that read their trace more than once."""
    return cut(events_trace(spark, sf_dir, with_time), "events_table")


LINEITEM_ORDER = ["l_shipdate", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
                  "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def lineitem_chunk() -> Column:
    """Scan chunk of a line item; non-decreasing along ``LINEITEM_ORDER``."""
    return F.struct(F.col("l_shipdate").alias("d"), F.shiftright("l_orderkey", 24).alias("o"))


def lineitem_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage at scale: run = supplier, statement = line item in ship order,
    location = part bucket; returned items (R) write it, the others read it.

    The per-supplier position is a chunked running count (a hot supplier is split by
    ship date and, within a date, by order-key range: the chunk never decreases along the
    order), not a per-supplier window.
    """
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", *LINEITEM_ORDER)
    pos = running_sum(li, ["l_suppkey"], LINEITEM_ORDER, F.lit(1), "pos", chunk=lineitem_chunk())
    loc = F.col("l_partkey") % PART_BUCKETS
    var = _var(F.concat(F.lit("p"), _s(loc)), loc, F.lit("part"))
    writes = F.col("l_returnflag") == "R"
    line = F.concat(F.lit("item("), _s(F.col("l_linenumber")), F.lit(")"))
    rows = F.array(
        _row("exec", 2 * F.col("pos"), F.col("l_linenumber"), line,
             F.when(writes, _empty_vars()).otherwise(F.array(var)), _empty_vars(), None, None, None),
        F.when(writes, _row("update", 2 * F.col("pos") + 1, F.col("l_linenumber"), None,
                            _empty_vars(), F.array(var), None, None, None)))
    return cut(pos.select(F.col("l_suppkey").cast("bigint").alias("run_id"), F.explode(rows).alias("r"))
               .filter(F.col("r").isNotNull())
               .select("run_id", "r.event_id", "r.kind", "r.lineno", "r.line", "r.uses", "r.defs",
                       "r.call", "r.loop_name", "r.msg"), "lineitem_table")


ORDERS_ORDER = ["_year", "_rank", "o_orderdate", "o_orderkey"]


def orders_chunk() -> Column:
    """Scan chunk of an order; non-decreasing along ``ORDERS_ORDER``."""
    return F.struct("_year", "_rank", "o_orderdate", F.shiftright("o_orderkey", 24).alias("o"))


def ranked_orders(orders: DataFrame) -> DataFrame:
    """Orders with the columns that lead their order: per customer and year the status-O
    orders, the test, then the block (for an even year, a loop, in date order)."""
    year = F.year("o_orderdate").cast("bigint")
    rank = (F.when(F.col("o_orderstatus") == "O", 0)
             .when((F.col("o_orderstatus") == "F") | (year % 2 == 0), 2).otherwise(3))
    return orders.withColumn("_year", year).withColumn("_rank", rank)


def orders_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement facts over ``orders``: unit = customer, statement = order, one key (the
    priority). Statements are assignments (some augmented), imports, calls and
    expressions by the order's key; a tenth stand in a scope of their own. A block per
    (customer, year) holds the orders of status F and P: in odd years an ``if`` with arms
    F (true) and P (false), in even years a loop with both in its body; a test statement
    (id = minus the year) stands before it and reads one priority."""
    o = ranked_orders(table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority"))
    tests = (o.where("o_orderstatus <> 'O'").select("o_custkey", "_year").distinct()
             .select("o_custkey", (-F.col("_year")).alias("o_orderkey"), F.lit("T").alias("o_orderstatus"),
                     F.lit(None).cast(o.schema["o_orderdate"].dataType).alias("o_orderdate"),
                     F.get(F.array(*[F.lit(p) for p in PRIORITIES]), (F.col("_year") % 5).cast("int"))
                     .alias("o_orderpriority"), "_year", F.lit(1).alias("_rank")))
    seq = running_sum(o.unionByName(tests), ["o_custkey"], ORDERS_ORDER, F.lit(1), "seq", chunk=orders_chunk())
    k, status, year = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("_year")
    in_block = status.isin("F", "P")
    loop = year % 2 == 0
    arm = F.when(in_block, F.when(loop | (status == "F"), "T").otherwise("F"))
    kind = (F.when(status == "T", "test").when(k % 3 == 0, "assign")
             .when((k % 3 == 2) & (k % 5 == 0), "import").when((k % 3 == 2) & (k % 5 == 1), "call").otherwise("expr"))
    key, empty = F.array(F.col("o_orderpriority")), F.array().cast("array<string>")
    writes = kind.isin("assign", "import")
    rows = seq.select(
        F.col("o_custkey").cast("bigint").alias("unit_id"),
        F.when((status != "T") & (k % 10 == 0), 1).otherwise(0).cast("bigint").alias("scope_id"),
        F.col("seq"), k.cast("bigint").alias("stmt_id"), kind.alias("kind"),
        F.when(in_block, -year).alias("ctl_id"), arm.alias("arm"),
        F.when(in_block, F.array(F.struct((-year).alias("ctl_id"), arm.alias("arm"),
                                          F.when(loop, "loop").otherwise("if").alias("kind"))))
         .otherwise(F.array().cast(BRANCH)).alias("branch_path"),
        F.when(writes, key).otherwise(empty).alias("targets"),
        F.when(kind == "import", F.array(F.lit("pkg.mod"))).when(writes, empty).otherwise(key).alias("rhs_refs"),
        ((kind == "assign") & (k % 2 == 0)).alias("is_augmented"))
    return cut(with_accesses(rows), "orders_table")


NESTED_ORDER = ["_f0", "_half", "_f1", "_quarter", "_f2", "_first", *LINEITEM_ORDER]


def lineitem_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement facts with blocks three deep: unit = supplier and ship year, statement = line
    item. Line number 7 stands outside all blocks, 1 in an arm of the half-year block (arms:
    halves), 2 in an arm of that half's quarter block, the others in an arm of the quarter's
    month block (first month or later); in each arm the plain statements come first. Key =
    l_partkey % 3. Returned items (R) are assignments to the key, or with items for even order
    keys; N items import it (a module without alias for line number 3), A items read it and a
    second key. A plan that prunes to the columns its reader asks for; ``stored_lineitem_facts``
    is for several readers."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", *LINEITEM_ORDER)
    month, n = F.month("l_shipdate"), F.col("l_linenumber")
    half, quarter = (month > 6).cast("int"), F.quarter("l_shipdate")
    depth = F.when(n == 7, 0).when(n == 1, 1).when(n == 2, 2).otherwise(3)
    li = li.withColumns({
        "unit_id": (F.col("l_suppkey") * 10 + F.year("l_shipdate") - 1992).cast("bigint"), "_depth": depth,
        "_f0": (depth > 0).cast("int"), "_half": F.when(depth > 0, half).otherwise(0), "_f1": (depth > 1).cast("int"),
        "_quarter": F.when(depth > 1, quarter).otherwise(0), "_f2": (depth > 2).cast("int"),
        "_first": F.when((depth > 2) & (month % 3 != 1), 1).otherwise(0)})
    seq = running_sum(li, ["unit_id"], NESTED_ORDER, F.lit(1), "seq", chunk=F.struct("_f0", "_half"))
    block = lambda ctl, arm: F.struct(F.lit(ctl).cast("bigint").alias("ctl_id") if isinstance(ctl, int)
                                      else ctl.cast("bigint").alias("ctl_id"),
                                      F.when(arm, "T").otherwise("F").alias("arm"), F.lit("if").alias("kind"))
    path = F.slice(F.array(block(1, half == 0), block(10 + half, quarter % 2 == 1), block(100 + quarter, month % 3 == 1)),
                   F.lit(1), F.col("_depth"))
    key = F.concat(F.lit("k"), _s(F.col("l_partkey") % 3))
    other = F.concat(F.lit("k"), _s((F.col("l_partkey") + 1) % 3))
    flag, empty = F.col("l_returnflag"), F.array().cast("array<string>")
    kind = (F.when((flag == "R") & (F.col("l_orderkey") % 2 == 0), "with").when(flag == "R", "assign")
             .when(flag == "N", "import").otherwise("expr"))
    rows = seq.select(
        "unit_id", F.lit(0).cast("bigint").alias("scope_id"), "seq", F.col("seq").alias("stmt_id"), kind.alias("kind"),
        F.try_element_at(path, F.lit(-1))["ctl_id"].alias("ctl_id"),
        F.try_element_at(path, F.lit(-1))["arm"].alias("arm"), path.cast(BRANCH).alias("branch_path"),
        F.when(flag == "R", F.array(key)).when((flag == "N") & (n != 3), F.array(key)).otherwise(empty).alias("targets"),
        F.when(kind == "import", F.array(F.when(n == 3, F.concat(key, F.lit(".sub"))).otherwise(F.lit("pkg.mod"))))
         .when(kind == "expr", F.array(key, other)).otherwise(empty).alias("rhs_refs"),
        F.lit(False).alias("is_augmented"))
    return with_accesses(rows)


def stored_lineitem_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem_facts`` written once, for operators that read their facts more than once."""
    return cut(lineitem_facts(spark, sf_dir), "nested_facts")


def order_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct references ``name`` made of the orders' values: a base in one of three
    alphabets, a quoted subscript, a nested one, a field, a call with brackets in quotes, a
    field with an accent; two to six segments by the order key."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    segments = F.array(
        F.concat(F.get(F.array(F.lit("c"), F.lit("größe"), F.lit("数")), (k % 3).cast("int")), _s(F.col("o_custkey"))),
        F.concat(F.lit('["'), F.col("o_orderpriority"), F.lit('"]')), F.concat(F.lit("[i["), _s(k % 7), F.lit("]]")),
        F.concat(F.lit(".f"), _s(k % 11)), F.concat(F.lit("(a, ']('  , ["), _s(k), F.lit("])")),
        F.concat(F.lit(".é_"), F.col("o_orderstatus")))
    return o.select(F.array_join(F.slice(segments, F.lit(1), (k % 5 + 2).cast("int")), "").alias("name")).distinct()
