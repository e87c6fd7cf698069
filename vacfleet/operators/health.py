"""Control-loop self-monitoring and the health-state machine.

Every metric is one row per cluster. The windowed counts are one conditional
aggregation per source table (instead of one scan per count), and the cluster list is
the left side of every join so a cluster with no actions or ticks still gets a row
(counts 0, freshness NULL).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacfleet import params as P
from vacfleet.functions import exprs as X
from vacfleet.operators.classify import active_policy
from vacfleet.operators.sequence import previous_row, running

HOUR, DAY = 3600, 86400

# FIXED VALUES: reason and detail texts of the health evaluator and failure taxonomy
# (printf-style; lags are printed in whole seconds).
REASON = {
    "baseline": "all self-monitoring signals within bounds",
    "observation_lag": "observation lag %ss — telemetry is stale",
    "control_lag": "control loop lag %ss — no successful control cycle",
    "failed": "%s failed actions in the last hour",
    "lock_timeouts": "%s lock timeouts in the last hour",
    "over_budget": "governor storage footprint over budget",
    "budget_spent": "daily mutation budget spent (%s applied in the last day)",
    "oscillating": "%s relation(s) oscillating — control is flapping",
    "load_shed": "connection pressure %s%% (%s/%s client backends) — shedding load, actuation suspended",
    "forced": "operator-forced %s: %s",
    "no_reason": "(no reason given)",
}
DETAIL = {
    "observation_fresh": "telemetry fresh",
    "cycles_errored": "%s control cycle(s) errored in the last day",
    "loop_stalled": "no successful control cycle in %ss — the control loop is stalled",
    "no_cycle_errors": "no cycle errors",
    "failed_actions": "%s failed action(s) in the last hour, %s in the last day",
    "no_failed_actions": "no failed actions",
    "over_budget": "governor storage footprint over budget (%s bytes)",
    "within_budget": "within storage budget",
    "no_safety": "no safety-class failures",
}


def clusters(*frames: DataFrame) -> DataFrame:
    out = None
    for f in frames:
        k = f.select("cluster_id")
        out = k if out is None else out.unionByName(k)
    return out.distinct()


def governor_metrics(actions: DataFrame, snapshots: DataFrame, ticks: DataFrame,
                     self_health: DataFrame | None, oscillating: DataFrame | None,
                     as_of) -> DataFrame:
    """One-row-per-cluster substrate of the health evaluator."""
    now = X.col(as_of)
    a = actions.groupBy("cluster_id").agg(
        F.count_if((F.col("status") == "applied") & X.within_last("applied_at", now, HOUR))
         .alias("applied_actions_last_hour"),
        F.count_if((F.col("status") == "applied") & X.within_last("applied_at", now, DAY))
         .alias("applied_actions_last_day"),
        F.count_if((F.col("status") == "failed") & X.within_last("applied_at", now, HOUR))
         .alias("failed_actions_last_hour"),
        F.count_if((F.col("status") == "failed") & X.within_last("applied_at", now, DAY))
         .alias("failed_actions_last_day"),
        F.count_if((F.col("failure_reason") == "lock_timeout") & X.within_last("applied_at", now, HOUR))
         .alias("lock_timeouts_last_hour"),
        F.count_if((F.col("failure_reason") == "lock_timeout") & X.within_last("applied_at", now, DAY))
         .alias("lock_timeouts_last_day"),
        F.min("applied_at").alias("oldest_action_at"))
    s = snapshots.groupBy("cluster_id").agg(
        F.max("collected_at").alias("newest_snapshot_at"),
        F.max_by(F.struct("client_backends", "max_connections"), "snapshot_id").alias("_n"))
    s = s.select("cluster_id", "newest_snapshot_at",
                 F.col("_n.client_backends").alias("client_backends"),
                 F.col("_n.max_connections").alias("max_connections"),
                 X.safe_div("_n.client_backends", "_n.max_connections").alias("connection_pressure"))
    s = s.withColumn("connection_pressure_pct", X.percent("connection_pressure"))
    dur = X.seconds_between("finished_at", "started_at")
    t = ticks.groupBy("cluster_id").agg(
        F.max_by(F.struct("started_at", "finished_at", dur.alias("d")), "tick_id").alias("_l"),
        F.max(F.when(X.within_last("started_at", now, DAY), dur)).alias("max_tick_duration_last_day_s"),
        F.count_if(F.col("error").isNotNull() & X.within_last("started_at", now, DAY))
         .alias("tick_errors_last_day"),
        F.max("finished_at").alias("last_successful_tick_at"))
    t = t.select("cluster_id", F.col("_l.started_at").alias("last_tick_started_at"),
                 F.col("_l.finished_at").alias("last_tick_finished_at"),
                 F.col("_l.d").alias("last_tick_duration_s"), "max_tick_duration_last_day_s",
                 "tick_errors_last_day", "last_successful_tick_at")
    k = clusters(actions, snapshots, ticks)
    if self_health is not None:
        sh = self_health.select("cluster_id", F.col("total_bytes").alias("storage_bytes"),
                                "over_budget")
        k = k.join(F.broadcast(sh), "cluster_id", "left")
    else:
        k = (k.withColumn("storage_bytes", F.lit(None).cast("long"))
              .withColumn("over_budget", F.lit(None).cast("boolean")))
    if oscillating is not None:
        o = oscillating.groupBy("cluster_id").agg(F.count("*").alias("_osc"))
        k = k.join(o, "cluster_id", "left")
    else:
        k = k.withColumn("_osc", F.lit(None).cast("long"))
    m = k.join(a, "cluster_id", "left").join(s, "cluster_id", "left").join(t, "cluster_id", "left")
    zero = ["applied_actions_last_hour", "applied_actions_last_day", "failed_actions_last_hour",
            "failed_actions_last_day", "lock_timeouts_last_hour", "lock_timeouts_last_day",
            "tick_errors_last_day"]
    for c in zero:
        m = m.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long"))
    return (m.withColumn("oscillating_relations", F.coalesce(F.col("_osc"), F.lit(0)).cast("long"))
             .drop("_osc")
             .withColumn("observation_lag_s", X.seconds_between(now, "newest_snapshot_at"))
             .withColumn("control_loop_lag_s", X.seconds_between(now, "last_successful_tick_at")))


def _cand(state, reason, ordinal):
    return F.struct(X.health_ordinal(state).alias("o"), reason.isNotNull().alias("said"),
                    F.lit(-ordinal).alias("early"), state.alias("state"), reason.alias("reason"))


def with_budget(df: DataFrame, policy: DataFrame | None, params: P.Params = P.DEFAULT) -> DataFrame:
    """Add the active policy's daily mutation budget, or the default (``_budget``)."""
    if policy is not None:
        pol = active_policy(policy).select("cluster_id", "daily_mutation_budget")
        df = df.join(F.broadcast(pol), "cluster_id", "left")     # one row per cluster
    else:
        df = df.withColumn("daily_mutation_budget", F.lit(None).cast("int"))
    return df.withColumn("_budget", F.coalesce(F.col("daily_mutation_budget"),
                                               F.lit(params.daily_mutation_budget))).drop("daily_mutation_budget")


def worst_candidate(params: P.Params = P.DEFAULT) -> Column:
    """D23 (T2): the worst of the nine (state, reason) candidates, a baseline and eight signals;
    among equals a non-NULL reason, then the earlier signal."""
    budget = F.col("_budget")
    lag, clag = F.col("observation_lag_s"), F.col("control_loop_lag_s")
    fmt = lambda s, *c: F.format_string(s, *c)
    n = lambda c: F.col(c)
    cands = [
        _cand(F.lit("normal"), F.lit(REASON["baseline"]), 0),
        _cand(F.when(lag > P.HEALTH_LAG_EMERGENCY_SECS, F.lit("emergency"))
              .when(lag > P.HEALTH_LAG_DEGRADED_SECS, F.lit("degraded")).otherwise(F.lit("normal")),
              F.when(lag > P.HEALTH_LAG_DEGRADED_SECS,
                     fmt(REASON["observation_lag"], F.round(lag, 0).cast("long"))), 1),
        _cand(F.when(clag > P.HEALTH_CONTROL_LAG_EMERGENCY_SECS, F.lit("emergency"))
              .when(clag > P.HEALTH_CONTROL_LAG_DEGRADED_SECS, F.lit("degraded"))
              .otherwise(F.lit("normal")),
              F.when(clag > P.HEALTH_CONTROL_LAG_DEGRADED_SECS,
                     fmt(REASON["control_lag"], F.round(clag, 0).cast("long"))), 2),
        _cand(F.when(n("failed_actions_last_hour") > P.HEALTH_FAILED_DIAGNOSTIC, F.lit("diagnostic"))
              .when(n("failed_actions_last_hour") > P.HEALTH_FAILED_DEGRADED, F.lit("degraded"))
              .otherwise(F.lit("normal")),
              F.when(n("failed_actions_last_hour") > P.HEALTH_FAILED_DEGRADED,
                     fmt(REASON["failed"], n("failed_actions_last_hour"))), 3),
        _cand(F.when(n("lock_timeouts_last_hour") > P.HEALTH_LOCK_TIMEOUTS_DIAGNOSTIC,
                     F.lit("diagnostic")).otherwise(F.lit("normal")),
              F.when(n("lock_timeouts_last_hour") > P.HEALTH_LOCK_TIMEOUTS_DIAGNOSTIC,
                     fmt(REASON["lock_timeouts"], n("lock_timeouts_last_hour"))), 4),
        _cand(F.when(n("over_budget"), F.lit("degraded")).otherwise(F.lit("normal")),
              F.when(n("over_budget"), F.lit(REASON["over_budget"])), 5),
        _cand(F.when(n("applied_actions_last_day") >= budget, F.lit("degraded"))
              .otherwise(F.lit("normal")),
              F.when(n("applied_actions_last_day") >= budget,
                     fmt(REASON["budget_spent"], n("applied_actions_last_day"))), 6),
        _cand(F.when(n("oscillating_relations") > 0, F.lit("diagnostic")).otherwise(F.lit("normal")),
              F.when(n("oscillating_relations") > 0,
                     fmt(REASON["oscillating"], n("oscillating_relations"))), 7),
        _cand(F.when(n("connection_pressure") >= params.load_shed_pct, F.lit("diagnostic"))
              .otherwise(F.lit("normal")),
              F.when(n("connection_pressure") >= params.load_shed_pct,
                     fmt(REASON["load_shed"], n("connection_pressure_pct").cast("long"),
                         n("client_backends"), n("max_connections"))), 8),
    ]
    return F.array_max(F.array(*cands))


def evaluate_health(metrics: DataFrame, policy: DataFrame | None = None,
                    params: P.Params = P.DEFAULT) -> DataFrame:
    """The state and its reason per cluster."""
    worst = worst_candidate(params)
    return with_budget(metrics, policy, params).select(
        "cluster_id", worst.getField("state").alias("state"), worst.getField("reason").alias("reason"))


def override_floor(computed: DataFrame, override_events: DataFrame) -> DataFrame:
    """The latest force/clear event per cluster; a forced state at least as severe
    as the computed one binds ('normal' cannot be forced)."""
    ev = (override_events.groupBy("cluster_id")
          .agg(F.max_by(F.struct("action", "forced_state", "forced_reason"),
                        F.struct("event_at", "action", "forced_state", "forced_reason"))
               .alias("_e")))
    return floored(computed.join(ev, "cluster_id", "left"), "_e").select(
        "cluster_id", "computed_state", "forced", "state", "reason")


def floored(df: DataFrame, event: str) -> DataFrame:
    """Raise ``state`` (and its ``reason``) to the forced state of ``event`` where that binds."""
    get = F.col(event).getField
    forced = F.when((get("action") == "force") & (get("forced_state") != "normal"), get("forced_state"))
    binds = F.col("forced").isNotNull() & (X.health_ordinal("forced") >= X.health_ordinal("computed_state"))
    return (df.withColumnRenamed("state", "computed_state").withColumn("forced", forced)
            .withColumn("state", F.when(binds, F.col("forced")).otherwise(F.col("computed_state")))
            .withColumn("reason", F.when(binds, F.format_string(
                REASON["forced"], F.col("forced"), F.coalesce(get("forced_reason"), F.lit(REASON["no_reason"]))))
                .otherwise(F.col("reason"))))


def _later(ts: Column, seconds: int) -> Column:
    return ts + F.make_dt_interval(secs=F.lit(float(seconds)))


def _log(df: DataFrame, at: Column, **values: Column) -> DataFrame:
    return df.select("cluster_id", at.alias("at"), *[v.alias(k) for k, v in values.items()]).filter("at is not null")


def action_steps(actions: DataFrame) -> DataFrame:
    """What each action adds to the windowed counts when it enters the last hour and the last day,
    and takes away when it leaves them, summed by cluster and moment."""
    at, one = F.col("applied_at"), lambda cond: F.coalesce(cond, F.lit(False)).cast("long")
    failed, lock = one(F.col("status") == "failed"), one(F.col("failure_reason") == "lock_timeout")
    applied, none = one(F.col("status") == "applied"), F.lit(0).cast("long")
    steps = F.array(*[F.struct(when.alias("at"), f.alias("failed"), k.alias("locks"), a.alias("applied")) for when, f, k, a in (
        (at, failed, lock, applied), (_later(at, HOUR), -failed, -lock, none), (_later(at, DAY), none, none, -applied))])
    return (actions.select("cluster_id", F.inline(steps)).filter("at is not null").groupBy("cluster_id", "at")
            .agg(*[F.sum(c).alias(c) for c in ("failed", "locks", "applied")]))


def oscillation_steps(actions: DataFrame, window_s: int, min_reversals: int,
                      actuator: str = P.ACTUATOR_SF) -> DataFrame:
    """When a cluster's number of oscillating relations steps up or down (D16 at every moment).

    A reversal is three consecutive changes; it counts from the third until the first leaves the
    window. The relation oscillates while ``min_reversals`` of its reversals count."""
    key = ["cluster_id", "relid"]
    seq = (actions.filter((F.col("status") == "applied") & (F.col("actuator") == actuator) & (F.col("relid") != 0)
                          & F.col("applied_at").isNotNull())
           .select(*key, "action_id", "applied_at", F.col("new_value").try_cast("double").alias("v")))
    order, day = ["applied_at", "action_id"], X.epoch_day("applied_at")
    one = previous_row(seq, key, order, day, ["v", "applied_at"]).withColumn("d", F.signum(F.col("v") - F.col("prev_v")))
    one = one.select(*key, *order, "d", F.col("prev_applied_at").alias("from"))
    two = previous_row(one, key, order, day, ["d", "from"])
    ends = _later(F.col("prev_from"), window_s)
    rev = two.filter((F.col("d") != 0) & (F.col("prev_d") != 0) & (F.col("d") != F.col("prev_d")) & (ends > F.col("applied_at")))
    steps = rev.select(*key, F.inline(F.array(F.struct(F.col("applied_at").alias("at"), F.lit(1).alias("step")),
                                              F.struct(ends.alias("at"), F.lit(-1).alias("step")))))
    steps = steps.groupBy(*key, "at").agg(F.sum("step").alias("step"))
    n = running(steps, key, ["at"], X.epoch_day("at"), {"n": ("sum", F.col("step"))})
    change = (F.col("n") >= min_reversals).cast("long") - ((F.col("n") - F.col("step")) >= min_reversals).cast("long")
    return n.groupBy("cluster_id", "at").agg(F.sum(change).alias("oscillating")).filter("oscillating <> 0")


def health_series(snapshots: DataFrame, actions: DataFrame, ticks: DataFrame, inventory: DataFrame | None = None,
                  override_events: DataFrame | None = None, budget_bytes: int | None = None,
                  policy: DataFrame | None = None, params: P.Params = P.DEFAULT) -> DataFrame:
    """The health state at every evaluation of the history: after each snapshot, at the start of
    each control tick and at each operator event, from all signals as they stood then.

    One sweep over the merged logs: windowed counts are running sums of steps, "newest so far" is a
    running maximum, both carried from day to day (``sequence.running``), so a task holds one cluster's
    day. At one moment everything that happened comes before the evaluation. A partition of the
    inventory counts with its bytes from the start of its range; the policy is the active one."""
    logs = [action_steps(actions),
            oscillation_steps(actions, params.oscillation_window_s, params.oscillation_min_reversals),
            _log(snapshots, F.col("collected_at"), seen=F.col("collected_at"),
                 head=F.struct("collected_at", "snapshot_id", "client_backends", "max_connections")),
            _log(ticks, F.col("finished_at"), done=F.col("finished_at"))]
    if inventory is not None:
        logs.append(_log(inventory, F.col("range_start"), bytes=F.col("bytes"))
                    .groupBy("cluster_id", "at").agg(F.sum("bytes").alias("bytes")))
    moments = [_log(snapshots, F.col("collected_at")), _log(ticks, F.col("started_at"))]
    if override_events is not None:
        logs.append(_log(override_events, F.col("event_at"),
                         force=F.struct("event_at", "action", "forced_state", "forced_reason")))
        moments.append(_log(override_events, F.col("event_at")))
    merged, asked = logs[0], moments[0]
    for x in logs[1:]:
        merged = merged.unionByName(x, allowMissingColumns=True)
    for x in moments[1:]:
        asked = asked.unionByName(x)
    merged = merged.withColumn("asked", F.lit(0)).unionByName(
        asked.distinct().withColumn("asked", F.lit(1)), allowMissingColumns=True)
    for c, t in (("bytes", "long"), ("force", "struct<event_at: timestamp_ntz, action: string, forced_state: string, forced_reason: string>")):
        if c not in merged.columns:
            merged = merged.withColumn(c, F.lit(None).cast(t))
    totals = {c: ("sum", F.col(c)) for c in ("failed", "locks", "applied", "oscillating", "bytes")}
    totals |= {c: ("max", F.col(c)) for c in ("seen", "done", "head", "force")}
    swept = running(merged.select("cluster_id", "at", "asked", *totals), ["cluster_id"], ["at", "asked"], X.epoch_day("at"),
                    {f"{c}_now": v for c, v in totals.items()}).filter("asked = 1")
    pressure = X.safe_div("head_now.client_backends", "head_now.max_connections")
    m = swept.select(
        "cluster_id", F.col("at").alias("evaluated_at"), F.col("force_now").alias("force"),
        X.seconds_between("at", "seen_now").alias("observation_lag_s"),
        X.seconds_between("at", "done_now").alias("control_loop_lag_s"),
        F.col("failed_now").alias("failed_actions_last_hour"), F.col("locks_now").alias("lock_timeouts_last_hour"),
        (F.lit(budget_bytes).cast("long").isNotNull() & (F.col("bytes_now") > F.lit(budget_bytes).cast("long"))).alias("over_budget"),
        F.col("applied_now").alias("applied_actions_last_day"), F.col("oscillating_now").alias("oscillating_relations"),
        pressure.alias("connection_pressure"), X.percent(pressure).alias("connection_pressure_pct"),
        F.col("head_now.client_backends").alias("client_backends"), F.col("head_now.max_connections").alias("max_connections"))
    worst = worst_candidate(params)
    m = with_budget(m, policy, params).select("cluster_id", "evaluated_at", "force", worst.alias("_w"))
    m = m.select("cluster_id", "evaluated_at", "force", F.col("_w.state").alias("state"), F.col("_w.reason").alias("reason"))
    return floored(m, "force").select("cluster_id", "evaluated_at", "state", "reason")


def state_transitions(series: DataFrame) -> DataFrame:
    """Rows only where the state changes (the first evaluation counts as a change
    from NULL); ``series`` has one row per cluster and ``evaluated_at``."""
    s = previous_row(series, ["cluster_id"], ["evaluated_at"], X.epoch_day("evaluated_at"), ["state"])
    return s.filter(~F.col("state").eqNullSafe(F.col("prev_state"))).select(
        "cluster_id", F.col("prev_state").alias("from_state"), F.col("state").alias("to_state"), "reason",
        F.col("evaluated_at").alias("transitioned_at"))


def failure_taxonomy(metrics: DataFrame, actions: DataFrame, as_of) -> DataFrame:
    """All five categories per cluster, the live condition and recorded failures."""
    now = X.col(as_of)
    rec = (actions.filter((F.col("status") == "failed") & F.col("failure_class").isNotNull()
                          & X.within_last("applied_at", now, DAY))
           .groupBy("cluster_id", "failure_class").agg(F.count("*").alias("n")))
    m = metrics
    obs = F.coalesce(F.col("observation_lag_s") > P.HEALTH_LAG_DEGRADED_SECS, F.lit(False))
    ctl = F.coalesce(F.col("control_loop_lag_s") > P.HEALTH_CONTROL_LAG_DEGRADED_SECS, F.lit(False))
    def row(cls, cond, detail):
        return F.struct(F.lit(cls).alias("failure_class"), cond.alias("condition_present"),
                        detail.alias("detail"))

    rows = F.array(
        row("observation", obs,
                 F.when(obs, F.format_string(REASON["observation_lag"],
                                             F.round("observation_lag_s", 0).cast("long")))
                 .otherwise(F.lit(DETAIL["observation_fresh"]))),
        row("decision", (F.col("tick_errors_last_day") > 0) | ctl,
                 F.when(F.col("tick_errors_last_day") > 0,
                        F.format_string(DETAIL["cycles_errored"],
                                        F.col("tick_errors_last_day")))
                 .when(ctl, F.format_string(DETAIL["loop_stalled"],
                                            F.round("control_loop_lag_s", 0).cast("long")))
                 .otherwise(F.lit(DETAIL["no_cycle_errors"]))),
        row("actuation", F.col("failed_actions_last_hour") > 0,
                 F.when(F.col("failed_actions_last_day") > 0,
                        F.format_string(DETAIL["failed_actions"],
                                        F.col("failed_actions_last_hour"),
                                        F.col("failed_actions_last_day")))
                 .otherwise(F.lit(DETAIL["no_failed_actions"]))),
        row("resource", F.coalesce(F.col("over_budget"), F.lit(False)),
                 F.when(F.coalesce(F.col("over_budget"), F.lit(False)),
                        F.format_string(DETAIL["over_budget"],
                                        F.col("storage_bytes")))
                 .otherwise(F.lit(DETAIL["within_budget"]))),
        row("safety", F.col("oscillating_relations") > 0,
                 F.when(F.col("oscillating_relations") > 0,
                        F.format_string(REASON["oscillating"], F.col("oscillating_relations")))
                 .otherwise(F.lit(DETAIL["no_safety"]))))
    cat = m.select("cluster_id", F.inline(rows))
    return (cat.join(rec, ["cluster_id", "failure_class"], "left")
            .select("cluster_id", "failure_class", "condition_present",
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("recorded_failures_last_day"),
                    "detail"))


def catalog_health(actions: DataFrame, snapshots: DataFrame, as_of) -> DataFrame:
    """The governor's own change footprint plus the newest header's catalog stats."""
    now = X.col(as_of)
    ap = F.col("status") == "applied"
    a = actions.groupBy("cluster_id").agg(
        F.count_if(ap & X.within_last("applied_at", now, HOUR)).alias("mutations_last_hour"),
        F.count_if(ap & X.within_last("applied_at", now, DAY)).alias("mutations_last_day"),
        F.count_if((F.col("status") == "failed") & X.within_last("applied_at", now, DAY))
         .alias("failed_last_day"),
        F.count_distinct(F.when(ap & X.within_last("applied_at", now, DAY), F.col("relid")))
         .alias("relations_changed_last_day"))
    cols = ["pg_class_size_bytes", "pg_class_n_dead_tup", "pg_class_n_live_tup",
            "pg_class_last_autovacuum", "collected_at"]
    s = snapshots.groupBy("cluster_id").agg(F.max_by(F.struct(*cols), "snapshot_id").alias("_s"))
    j = s.join(a, "cluster_id", "left")
    return j.select("cluster_id",
                    *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                      for c in ("mutations_last_hour", "mutations_last_day", "failed_last_day",
                                "relations_changed_last_day")],
                    *[F.col("_s").getField(c).alias(c) for c in cols])


def active_diagnostics(diagnostics: DataFrame) -> DataFrame:
    """D21 (T4): unresolved findings, critical first, newest first."""
    return (diagnostics.filter(F.col("resolved_at").isNull())
            .select("cluster_id", "diagnostic_id", "detected_at", "severity", "relid",
                    "inhibitor_class")
            .orderBy((F.col("severity") == "critical").desc(), F.col("detected_at").desc(),
                     "diagnostic_id"))


def governor_status(classes: DataFrame, estimates: DataFrame, decisions: DataFrame,
                    actuator_state: DataFrame, policy: DataFrame | None,
                    params: P.Params = P.DEFAULT) -> DataFrame:
    """Per relation class, target, debt, saturation, newest decision and setting."""
    key = ["cluster_id", "relid"]
    if policy is not None:
        pol = active_policy(policy).select("cluster_id", "aggressiveness")
        c = classes.join(F.broadcast(pol), "cluster_id", "left")
    else:
        c = classes.withColumn("aggressiveness", F.lit(None).cast("double"))
    aggr = X.guarded_positive("aggressiveness", params.aggressiveness)
    tgt = X.clamp(X.class_target("kind", params.class_targets) / aggr,
                  F.lit(params.sf_min), F.lit(params.sf_max))
    last = (decisions.groupBy(*key).agg(F.max_by(F.struct("decision", "proposed_value",
                                                          "applied", "created_at"),
                                                 "decision_id").alias("_d")))
    ast = actuator_state.filter(F.col("actuator") == P.ACTUATOR_SF).select(
        *key, F.col("current_value").alias("current_scale_factor"))
    e = estimates.select(*key, F.col("f_trigger_ewma").alias("observed_dead_fraction"),
                         "vacuum_debt_ratio", "freeze_debt", "saturation_cause")
    j = c.join(e, key, "left").join(last, key, "left").join(ast, key, "left")
    return j.select(*key, "schemaname", "relname", "kind", "observed_dead_fraction",
                    tgt.alias("target_dead_fraction"), "vacuum_debt_ratio", "freeze_debt",
                    "saturation_cause", F.col("_d.decision").alias("decision"),
                    F.col("_d.proposed_value").alias("proposed_value"),
                    F.col("_d.applied").alias("applied"),
                    F.col("_d.created_at").alias("last_decision_at"), "current_scale_factor")


def failures_by_class(actions: DataFrame, as_of) -> DataFrame:
    """Failed actions per failure category in the last day."""
    now = X.col(as_of)
    return (actions.filter((F.col("status") == "failed") & X.within_last("applied_at", now, DAY))
            .groupBy("cluster_id", "failure_class").agg(F.count("*").alias("failures")))
