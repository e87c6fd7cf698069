"""Set-based admission of proposed changes and the actuator-state fold.

The reference applies changes one by one in a loop; here every check is a column or a
keyed join, and the caps are running counts over the rows that passed every earlier
check, so the result does not depend on execution order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacfleet import params as P
from vacfleet.functions import exprs as X
from vacfleet.operators.classify import active_policy
from vacfleet.operators.plan import VAC_SF
from vacfleet.operators.sequence import running

KEY = ["cluster_id", "relid"]
BLOCKED_STATES = ("diagnostic", "emergency", "disabled")


def fold_actions(actions: DataFrame) -> DataFrame:
    """Per (relation, actuator) over applied actions: the first-touch baseline
    (value before the governor's first change), the current value (newest change) and
    the revert: SET the baseline back, or RESET when there was none."""
    a = actions.filter(F.col("status") == "applied")
    order = F.struct("applied_at", "action_id")
    g = a.groupBy(*KEY, "actuator").agg(
        F.min_by("old_value", order).alias("baseline_value"),
        F.max_by("new_value", order).alias("current_value"),
        F.count("*").alias("n_applied"),
        F.max("applied_at").alias("set_at"))
    explicit = F.col("baseline_value").isNotNull()
    return g.select(*KEY, "actuator", "current_value", explicit.alias("baseline_explicit"),
                    "baseline_value", "n_applied", "set_at",
                    F.when(explicit, F.lit("SET")).otherwise(F.lit("RESET")).alias("revert_kind"))


#: Decision ids that one task ranks.
RANK_BLOCK = 100_000


def admit_actions(decisions: DataFrame, live: DataFrame, actuator_state: DataFrame,
                  actions: DataFrame, governor_state: DataFrame, policy: DataFrame | None,
                  clock: str | Column = "tick_now", tick_id_col: str = "tick_id",
                  params: P.Params = P.DEFAULT) -> DataFrame:
    """Which 'adjust' decisions may go out, with the first failed check, for one tick or many.

    Checks in order: authority, vanished, no-op, parse and range, ownership, per-relation interval,
    per-cycle cap, per-day cap. Only the newest decision per (tick, relation) is considered; a
    refused row never consumes a cap. ``clock`` is each tick's time (a column of the decisions, or one
    expression for all): the per-relation interval looks at applied actions in (now - interval,
    now], the daily budget at those in (now - 1 day, now], the cycle cap at actions of the same tick.

    The time windows are equi joins on the relation (interval) or on the cluster and the
    day (budget, two candidate days per tick) with the exact range as a residual, so no
    join pairs a tick with more than one relation's or two days' actions.
    """
    decisions, clock = decisions.withColumn("_clock", X.col(clock)), "_clock"
    newest = (decisions.filter(F.col("actuator") == VAC_SF)
              .groupBy("cluster_id", tick_id_col, "relid")
              .agg(F.max_by(F.struct("decision_id", "decision", "proposed_value", clock),
                            "decision_id").alias("_d")))
    d = newest.select("cluster_id", tick_id_col, "relid", "_d.*").filter(
        F.col("decision") == "adjust")
    if policy is not None:
        pol = active_policy(policy).select("cluster_id", "min_interval",
                                           "global_max_changes_per_cycle",
                                           "daily_mutation_budget", "manage_user_owned")
        d = d.join(F.broadcast(pol), "cluster_id", "left")
    else:
        for c, t in (("min_interval", "interval day to second"),
                     ("global_max_changes_per_cycle", "int"), ("daily_mutation_budget", "int"),
                     ("manage_user_owned", "boolean")):
            d = d.withColumn(c, F.lit(None).cast(t))
    interval_s = (F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp")
                                + F.col("min_interval")) / 1000000)
    d = d.withColumn("_min_s", F.coalesce(interval_s, F.lit(float(params.min_interval_s))))
    cap = F.coalesce(F.col("global_max_changes_per_cycle"), F.lit(params.max_changes_per_cycle))
    budget = F.coalesce(F.col("daily_mutation_budget"), F.lit(params.daily_mutation_budget))
    manage = F.coalesce(F.col("manage_user_owned"), F.lit(params.manage_user_owned))
    now = F.col(clock)

    applied = actions.filter(F.col("status") == "applied").select(
        "cluster_id", "relid", "decision_id", "applied_at")
    # per-relation interval: the relation's applied actions inside (now - interval, now]
    hit = (d.select("decision_id", "cluster_id", tick_id_col, "relid", clock, "_min_s")
           .join(applied.select("cluster_id", "relid", "applied_at"), ["cluster_id", "relid"])
           .filter((F.col("applied_at") > now - F.make_dt_interval(secs=F.col("_min_s")))
                   & (F.col("applied_at") <= now))
           .select("cluster_id", tick_id_col, "decision_id").distinct().withColumn("_interval_hit", F.lit(True)))
    # daily budget: applied actions of the cluster inside (now - 1 day, now]
    ticks = d.select("cluster_id", tick_id_col, clock).distinct()
    tday = ticks.withColumn("_day", F.explode(F.array(X.epoch_day(now) - 1, X.epoch_day(now))))
    day_used = (tday.join(applied.withColumn("_day", X.epoch_day("applied_at")),
                          ["cluster_id", "_day"])
                .filter(X.within_last("applied_at", now, 86400) & (F.col("applied_at") <= now))
                .groupBy("cluster_id", tick_id_col).agg(F.count("*").alias("_day_used")))
    tick_used = (applied.join(decisions.select("cluster_id", "decision_id", tick_id_col), ["cluster_id", "decision_id"])
                 .groupBy("cluster_id", tick_id_col).agg(F.count("*").alias("_tick_used")))
    gs = governor_state.select("cluster_id", F.col("state").alias("gov_state"))
    lv = live.select(*KEY, F.lit(True).alias("_live"),
                     X.reloption("reloptions", VAC_SF).alias("live_value"))
    ast = actuator_state.filter(F.col("actuator") == VAC_SF).select(
        *KEY, F.lit(True).alias("_have_state"), F.col("baseline_explicit").alias("_bexp"),
        F.col("current_value").alias("_gov_value"))
    j = (d.join(F.broadcast(gs), "cluster_id", "left").join(lv, KEY, "left")
          .join(ast, KEY, "left").join(hit, ["cluster_id", tick_id_col, "decision_id"], "left")
          .join(day_used, ["cluster_id", tick_id_col], "left")
          .join(tick_used, ["cluster_id", tick_id_col], "left"))
    owned_by_gov = (F.coalesce(F.col("_have_state"), F.lit(False)) & ~F.col("_bexp")
                    & F.col("live_value").eqNullSafe(F.col("_gov_value")))
    pre = (F.when(F.col("gov_state").isin(*BLOCKED_STATES), F.lit("authority"))
           .when(F.col("_live").isNull(), F.lit("vanished"))
           .when(F.col("live_value").eqNullSafe(F.col("proposed_value")), F.lit("noop"))
           .when(~X.parse_in_range("proposed_value", params.sf_min, params.sf_max),
                 F.lit("invalid_value"))
           .when(~manage & F.col("live_value").isNotNull() & ~F.coalesce(owned_by_gov, F.lit(False)),
                 F.lit("user_owned"))
           .when(F.coalesce(F.col("_interval_hit"), F.lit(False)), F.lit("min_interval")))
    j = j.withColumn("_pre", pre)
    ok = F.col("_pre").isNull()
    # the place of each passing row in its (cluster, tick), counted in blocks of decisions with a
    # carry: a cluster with a third of all relations is never one task's sort
    passing = j.filter(ok).select("cluster_id", tick_id_col, "decision_id")
    ranked = running(passing, ["cluster_id", tick_id_col], ["decision_id"], F.floor(F.col("decision_id") / RANK_BLOCK),
                     {"_rank": ("sum", F.lit(1))})
    j = j.join(ranked, ["cluster_id", tick_id_col, "decision_id"], "left")
    reason = (F.when(~ok, F.col("_pre"))
              .when(F.coalesce(F.col("_tick_used"), F.lit(0)) + F.col("_rank") > cap,
                    F.lit("cycle_cap"))
              .when(F.coalesce(F.col("_day_used"), F.lit(0)) + F.col("_rank") > budget,
                    F.lit("daily_budget")))
    return j.select("cluster_id", tick_id_col, "decision_id", "relid", "proposed_value",
                    reason.isNull().alias("admitted"), reason.alias("refusal_reason"))
