"""Fixed schemas of the trace, graph and facts tables (no inference anywhere)."""

from pyspark.sql import types as T

# A value touched by a statement: name, address, type name, and the column names
# when the value is tabular (NULL otherwise). Identity is (name, id) only.
VAR = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("columns", T.ArrayType(T.StringType())),
])

VARS = T.ArrayType(VAR)

CALL = T.StructType([
    T.StructField("is_method", T.BooleanType()),
    T.StructField("co_name", T.StringType()),
    T.StructField("qualname", T.StringType()),
    T.StructField("module", T.StringType()),
    T.StructField("args", VARS),
    T.StructField("func_id", T.LongType()),
    T.StructField("called_by_user", T.BooleanType()),
    T.StructField("defined_by_user", T.BooleanType()),
])

# One row per event of one run; (run_id, event_id) is the key and event_id order is
# time order inside a run. event_id has gaps, so neighbours are found by order only.
TRACE = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("lineno", T.LongType()),
    T.StructField("line", T.StringType()),
    T.StructField("uses", VARS),
    T.StructField("defs", VARS),
    T.StructField("call", CALL),
    T.StructField("loop_name", T.StringType()),
    T.StructField("msg", T.StringType()),
])

KINDS = ("exec", "update", "enter", "exit", "exception",
         "loop_init", "loop_iter", "loop_clear")

EDGES = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("src", T.LongType()),
    T.StructField("dst", T.LongType()),
])

BRANCH = T.ArrayType(T.StructType([
    T.StructField("ctl_id", T.LongType()),
    T.StructField("arm", T.StringType()),
    T.StructField("kind", T.StringType()),   # if / loop
]))

# Statement facts for the static (reaching-writer) analysis: one row per statement
# in text order. branch_path lists the enclosing (test, arm) pairs, outermost first.
FACTS = T.StructType([
    T.StructField("unit_id", T.LongType()),
    T.StructField("scope_id", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("stmt_id", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("ctl_id", T.LongType()),
    T.StructField("arm", T.StringType()),
    T.StructField("branch_path", BRANCH),
    T.StructField("targets", T.ArrayType(T.StringType())),
    T.StructField("rhs_refs", T.ArrayType(T.StringType())),
    T.StructField("is_augmented", T.BooleanType()),
    T.StructField("loads", T.ArrayType(T.StringType())),
    T.StructField("stores", T.ArrayType(T.StringType())),
])
