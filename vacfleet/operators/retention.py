"""Storage budget, self health, audit retention and the shedding plan.

These are planners over inventories: they compute what a retention or shedding run
would remove, per cluster, and delete nothing themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacfleet import params as P
from vacfleet.functions import exprs as X
from vacfleet.session import store

RAW_RELATION = "relation_samples"
FINE_RELATIONS = ("rollup_1m",)
COARSE_RELATIONS = ("rollup_1h", "rollup_1d")


def storage_budget(inventory: DataFrame) -> DataFrame:
    """A8 (U2, J13): bytes and dead tuples per logical table (partitions folded into
    their parent), with per-schema and per-cluster subtotals from one ROLLUP."""
    g = inventory.rollup("cluster_id", "schema_name", "relation").agg(
        F.sum("bytes").alias("bytes"), F.sum("dead_tuples").alias("dead_tuples"),
        F.count("*").alias("partitions"))
    return g.filter(F.col("cluster_id").isNotNull()).select(
        "cluster_id", "schema_name", "relation",
        F.when(F.col("relation").isNotNull(), F.lit("relation"))
         .when(F.col("schema_name").isNotNull(), F.lit("schema"))
         .otherwise(F.lit("cluster")).alias("level"),
        F.coalesce(F.col("bytes"), F.lit(0)).cast("long").alias("bytes"),
        F.coalesce(F.col("dead_tuples"), F.lit(0)).cast("long").alias("dead_tuples"),
        "partitions")


def self_health(inventory: DataFrame, budget_bytes: int | None) -> DataFrame:
    """Per cluster total footprint, partition counts, oldest raw data, budget flag."""
    raw = F.col("relation") == RAW_RELATION
    rollup = F.col("relation").isin(*FINE_RELATIONS, *COARSE_RELATIONS)
    g = inventory.groupBy("cluster_id").agg(
        F.sum("bytes").cast("long").alias("total_bytes"),
        F.sum("dead_tuples").cast("long").alias("total_dead_tuples"),
        F.count_if(raw).alias("raw_partitions"),
        F.count_if(rollup).alias("rollup_partitions"),
        F.min(F.when(raw, F.col("range_start"))).alias("oldest_raw_partition"))
    b = F.lit(budget_bytes).cast("long")
    return g.select("*", b.alias("budget_bytes"), (b - F.col("total_bytes")).alias("bytes_under_budget"),
                    (b.isNotNull() & (F.col("total_bytes") > b)).alias("over_budget"))


def audit_retention(actions: DataFrame, decisions: DataFrame, ticks: DataFrame,
                    diagnostics: DataFrame, as_of,
                    keep_actions_d: int = P.KEEP_ACTIONS_DAYS,
                    keep_decisions_d: int = P.KEEP_DECISIONS_DAYS,
                    keep_ticks_d: int = P.KEEP_TICKS_DAYS,
                    keep_diag_d: int = P.KEEP_DIAGNOSTICS_DAYS,
                    transitions: DataFrame | None = None,
                    keep_transitions_d: int = P.KEEP_TRANSITIONS_DAYS) -> DataFrame:
    """Rows each audit table would drop and keep. A decision stays while a retained
    action refers to it; unresolved diagnostics always stay. ``transitions`` is the audit of
    health-state changes, where it is kept."""
    now = X.col(as_of)

    def cut(days):
        return now - F.make_dt_interval(days=F.lit(days))

    a = actions.withColumn("_drop", F.col("applied_at") < cut(keep_actions_d))
    d = _unreferenced(decisions, a.filter(~F.col("_drop")),
                      F.col("created_at") < cut(keep_decisions_d))
    t = ticks.withColumn("_drop", F.col("started_at") < cut(keep_ticks_d))
    g = diagnostics.withColumn("_drop", F.col("resolved_at").isNotNull()
                               & (F.col("detected_at") < cut(keep_diag_d)))

    def summary(df, name):
        return df.groupBy("cluster_id").agg(
            F.count_if(F.col("_drop")).alias("deleted"),
            F.count_if(~F.col("_drop")).alias("kept")).withColumn("relation", F.lit(name))

    out = (summary(a, "action_history").unionByName(summary(d, "decision_log"))
           .unionByName(summary(t, "tick_log")).unionByName(summary(g, "diagnostics")))
    if transitions is not None:
        x = transitions.withColumn("_drop", F.col("transitioned_at") < cut(keep_transitions_d))
        out = out.unionByName(summary(x, "state_transitions"))
    return out.select("cluster_id", "relation", "deleted", "kept")


def _unreferenced(decisions: DataFrame, kept_actions: DataFrame, old) -> DataFrame:
    """Add ``_drop``: the decision is ``old`` and no kept action refers to it."""
    refs = kept_actions.select("cluster_id", "decision_id").distinct().withColumn("_ref", F.lit(True))
    return (decisions.join(refs, ["cluster_id", "decision_id"], "left")
            .withColumn("_drop", old & F.col("_ref").isNull()).drop("_ref"))


LEVELS = ("raw", "rollups_fine", "rollups_coarse", "diagnostics", "actions", "policy")


def shedding_plan(inventory: DataFrame, diagnostics: DataFrame, actions: DataFrame,
                  as_of, budget_bytes: int, row_bytes: int = 200,
                  keep_raw_d: int = P.RAW_KEEP_DAYS, keep_fine_d: int = 2,
                  keep_coarse_d: int = 30, keep_diag_d: int = 30,
                  keep_actions_d: int = 30, decisions: DataFrame | None = None,
                  ticks: DataFrame | None = None) -> DataFrame:
    """The ordered shedding plan until under budget. A level is pruned only when the
    total *after the previous levels* is still over budget; policy is always preserved.
    Level ``actions`` covers actions, ``decisions`` (kept while a kept action refers to
    them) and ``ticks``. Audit-table bytes are estimated as rows x ``row_bytes``."""
    now = X.col(as_of)

    def older(col, days):
        return F.col(col) <= now - F.make_dt_interval(days=F.lit(days))

    rel = F.col("relation")
    inv = inventory.groupBy("cluster_id").agg(
        F.sum("bytes").alias("_inv_total"),
        F.sum(F.when((rel == RAW_RELATION) & older("range_end", keep_raw_d), F.col("bytes")))
         .alias("raw"),
        F.sum(F.when(rel.isin(*FINE_RELATIONS) & older("range_end", keep_fine_d), F.col("bytes")))
         .alias("rollups_fine"),
        F.sum(F.when(rel.isin(*COARSE_RELATIONS) & older("range_end", keep_coarse_d),
                     F.col("bytes"))).alias("rollups_coarse"))
    dg = diagnostics.groupBy("cluster_id").agg(
        (F.count("*") * row_bytes).alias("_diag_total"),
        (F.count_if(F.col("resolved_at").isNotNull() & older("detected_at", keep_diag_d))
         * row_bytes).alias("diagnostics"))
    acts = actions.withColumn("_drop", older("applied_at", keep_actions_d))
    audit = [acts]
    if decisions is not None:
        audit.append(_unreferenced(decisions, acts.filter(~F.col("_drop")),
                                   older("created_at", keep_actions_d)))
    if ticks is not None:
        audit.append(ticks.withColumn("_drop", older("started_at", keep_actions_d)))
    per_table = [x.groupBy("cluster_id").agg(F.count("*").alias("n"), F.count_if("_drop").alias("old"))
                 for x in audit]
    rows_of = per_table[0]
    for x in per_table[1:]:
        rows_of = rows_of.unionByName(x)
    ac = rows_of.groupBy("cluster_id").agg((F.sum("n") * row_bytes).alias("_act_total"),
                                           (F.sum("old") * row_bytes).alias("actions"))
    j = inv.join(dg, "cluster_id", "full").join(ac, "cluster_id", "full")
    total = (F.coalesce(F.col("_inv_total"), F.lit(0)) + F.coalesce(F.col("_diag_total"), F.lit(0))
             + F.coalesce(F.col("_act_total"), F.lit(0)))
    steps = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(lv).alias("level"),
                               (F.coalesce(F.col(lv), F.lit(0)) if lv != "policy" else F.lit(0))
                               .cast("long").alias("reclaim")) for i, lv in enumerate(LEVELS)])
    rows = j.select("cluster_id", total.cast("long").alias("total_bytes"), F.inline(steps))
    w = W.partitionBy("cluster_id").orderBy("step")
    before = F.col("total_bytes") - F.coalesce(
        F.sum("reclaim").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("bytes_before", before)
    over = F.col("bytes_before") > budget_bytes
    action = (F.when(F.col("level") == "policy", F.lit("preserved"))
              .when(over & (F.col("level") == "raw"), F.lit("swept"))
              .when(over, F.lit("pruned")).otherwise(F.lit("skipped:under_budget")))
    after = F.when(over & (F.col("level") != "policy"),
                   F.col("bytes_before") - F.col("reclaim")).otherwise(F.col("bytes_before"))
    # once under budget every later level is skipped, so bytes stay at the first
    # under-budget total: the executed levels are exactly a prefix of the order
    rows = rows.withColumn("_exec", over & (F.col("level") != "policy"))
    first_skip = F.min(F.when(~F.col("_exec") & (F.col("level") != "policy"), F.col("step"))).over(
        W.partitionBy("cluster_id"))
    executed = F.col("_exec") & (first_skip.isNull() | (F.col("step") < first_skip))
    frozen = F.min(F.when(F.col("step") == first_skip, F.col("bytes_before"))).over(
        W.partitionBy("cluster_id"))
    return rows.select(
        "cluster_id", "step", "level",
        F.when(F.col("level") == "policy", F.lit("preserved"))
         .when(executed, action).otherwise(F.lit("skipped:under_budget")).alias("action"),
        F.when(executed, after).when(first_skip.isNotNull() & (F.col("step") >= first_skip), frozen)
         .otherwise(after).cast("long").alias("bytes_after"))


#: Doublings of the closure: a tree deeper than 2^30 levels is a cycle.
MAX_DOUBLINGS = 30


def top_of(tree: DataFrame) -> DataFrame:
    """The topmost ancestor (``top``) of every child of a forest (cluster_id, parent, child).

    Pointer doubling: each round joins every pointer with the pointer of the node it points to, so
    k rounds cover 2^k levels; each is a stored table, and only a count comes to the driver. A tree
    with a cycle raises."""
    up = store(tree.select("cluster_id", "child", F.col("parent").alias("top")).distinct(), "tree_top")
    for _ in range(MAX_DOUBLINGS):
        above = up.select("cluster_id", F.col("child").alias("top"), F.col("top").alias("_above"))
        if above.join(up, ["cluster_id", "top"], "left_semi").isEmpty():
            return up
        if not up.filter("child = top").isEmpty():
            break
        up = store(up.join(above, ["cluster_id", "top"], "left").select(
            "cluster_id", "child", F.coalesce("_above", "top").alias("top")), "tree_top")
    raise ValueError("the partition tree has a cycle")


def fold_to_parent(sizes: DataFrame, tree: DataFrame) -> DataFrame:
    """U3 + J13: bytes and dead tuples per logical relation with all its descendants folded in.
    Members of a top-level relation are itself plus every partition below it, on any level of the
    partition tree (cluster_id, parent, child)."""
    tops = sizes.join(tree.select("cluster_id", F.col("child").alias("name")),
                      ["cluster_id", "name"], "left_anti").select("cluster_id", "name")
    below = top_of(tree).withColumnRenamed("child", "member")
    members = (tops.distinct().select("cluster_id", F.col("name").alias("top"), F.col("name").alias("member"))
               .unionByName(below.join(tops.withColumnRenamed("name", "top"), ["cluster_id", "top"], "left_semi")))
    j = members.join(sizes.withColumnRenamed("name", "member"), ["cluster_id", "member"], "left")
    return j.groupBy("cluster_id", "top").agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"),
        F.coalesce(F.sum("dead_tuples"), F.lit(0)).cast("long").alias("dead_tuples"),
        F.count("*").alias("members")).withColumnRenamed("top", "relation")
