"""Branch-aware reaching writers by candidates minus killers: a cross-check that forms every
(write, read) pair of a segment, so for small inputs only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewise.operators.reaching import KEYS, accesses, must_writes
from linewise.plans.materialize import cut
from linewise.plans.scan import running_sum


def _is_prefix(a: Column, b: Column) -> Column:
    return (F.size(a) <= F.size(b)) & (F.slice(b, 1, F.size(a)) == a)


def _siblings(wp: Column, rp: Column) -> Column:
    """Some block holds w in one arm and r in the other."""
    n = F.least(F.size(wp), F.size(rp))
    return F.when(n == 0, F.lit(False)).otherwise(F.exists(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: (F.element_at(wp, i)["ctl_id"] == F.element_at(rp, i)["ctl_id"])
                  & (F.element_at(wp, i)["arm"] != F.element_at(rp, i)["arm"])
                  & (F.slice(wp, 1, i - 1) == F.slice(rp, 1, i - 1))))


def reaching_branches_by_pairs(facts: DataFrame) -> DataFrame:
    """E4/E5 by candidates minus killers (the recipe of the survey). Correct, but the
    candidate join forms every (write, read) pair of a segment; kept as a cross-check
    for :func:`reaching_branches`, which forms output pairs only."""
    # the facts feed the depth probe, the must-write rounds and the accesses: write once
    f = cut(facts.withColumn("bp", F.coalesce("branch_path", F.array().cast(facts.schema["branch_path"].dataType))),
            "facts")
    max_depth = f.agg(F.max(F.size("bp"))).first()[0] or 0
    acc = accesses(f.drop("branch_path").withColumnRenamed("bp", "branch_path")) \
        .withColumnRenamed("branch_path", "bp").withColumn("seq", F.col("seq").cast("double"))
    writes = acc.filter(F.col("_w"))
    pseudo = must_writes(f, writes, max_depth) if max_depth > 0 else None
    kill_rows = writes.select("unit_id", "scope_id", "key", "seq", "bp", "stmt_id",
                              F.lit(None).cast("bigint").alias("block_ctl"))
    if pseudo is not None:
        kill_rows = kill_rows.unionByName(pseudo.withColumn("seq", F.col("seq") + 0.5).withColumn("stmt_id", F.lit(None).cast("bigint")))
    # segment = number of unconditional real writes so far (inclusive for the write itself)
    opens = ((F.size("bp") == 0) & F.col("stmt_id").isNotNull() & F.col("_w")).cast("int")
    rows = (acc.select("unit_id", "scope_id", "key", "seq", "bp", "stmt_id", "_w",
                       F.lit(None).cast("bigint").alias("block_ctl"))
               .unionByName(kill_rows.filter(F.col("stmt_id").isNull())
                                     .withColumn("_w", F.lit(True))))
    rows = running_sum(rows, KEYS, ["seq", F.col("_w").cast("int")], opens, "seg",
                       F.floor(F.col("seq") / (1 << 20)).cast("bigint"))
    rows = cut(rows, "reaching_rows")
    r = rows.filter(~F.col("_w")).select(*KEYS, "seg", F.col("seq").alias("r_seq"), F.col("bp").alias("r_bp"),
                                         F.col("stmt_id").alias("dst"))
    w = rows.filter(F.col("_w") & F.col("stmt_id").isNotNull()).select(
        *KEYS, "seg", F.col("seq").alias("w_seq"), F.col("bp").alias("w_bp"), F.col("stmt_id").alias("src"))
    k = rows.filter(F.col("_w")).select(*KEYS, "seg", F.col("seq").alias("k_seq"), F.col("bp").alias("k_bp"),
                                        "block_ctl")
    cand = (r.join(w, KEYS + ["seg"])
             .filter((F.col("w_seq") < F.col("r_seq")) & ~_siblings(F.col("w_bp"), F.col("r_bp"))))
    inside_own_block = (F.col("block_ctl").isNotNull() & (F.size("w_bp") > F.size("k_bp"))
                        & _is_prefix(F.col("k_bp"), F.col("w_bp"))
                        & (F.element_at("w_bp", F.size("k_bp") + 1)["ctl_id"] == F.col("block_ctl")))
    killed = (cand.alias("c").join(k.alias("k"), KEYS + ["seg"])
                  .filter((F.col("k_seq") > F.col("w_seq")) & (F.col("k_seq") < F.col("r_seq"))
                          & (_is_prefix(F.col("k_bp"), F.col("r_bp")) | _is_prefix(F.col("k_bp"), F.col("w_bp")))
                          & ~inside_own_block)
                  .select(*KEYS, "dst", "src", "r_seq", "w_seq"))
    live = cand.join(killed, KEYS + ["dst", "src", "r_seq", "w_seq"], "left_anti")
    return live.select("unit_id", "src", "dst", "key").distinct()
