"""Decisions, findings and control oscillation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacfleet import params as P
from vacfleet.functions import exprs as X
from vacfleet.operators import asof
from vacfleet.operators.classify import active_policy
from vacfleet.operators.sequence import previous_row, running

KEY = ["cluster_id", "relid"]
VAC_SF, VAC_THR = "autovacuum_vacuum_scale_factor", "autovacuum_vacuum_threshold"

# FIXED VALUES: the advice texts of a finding, worded as the controller words them.
ADVICE_IO_LIMITED = ("Vacuum runs but cannot keep up (I/O-bound). More aggressive settings "
                     "will not help; consider cost limits / more workers (Phase 3).")
ADVICE_NOT_RUNNING = ("Debt is high but autovacuum has not run. Check that autovacuum is "
                      "enabled and keeping up; lowering thresholds will not help an "
                      "already-overdue table.")
ADVICE_BLOCKED = ("Cleanup blocked by %s (%s); clear it -- more vacuuming cannot advance past a "
                  "pinned xmin horizon.")
DECISION_COLS = ["cluster_id", "tick_id", "relid", "actuator", "decision", "proposed_value",
                 "policy_rule", "estimated_benefit", "observation", "prev_state",
                 "desired_state"]


def _policy_cols(policy: DataFrame | None, params: P.Params) -> DataFrame | None:
    if policy is None:
        return None
    return active_policy(policy).select("cluster_id", "aggressiveness", "manage_user_owned")


def user_owned(explicit, base_explicit, gov_value) -> F.Column:
    """An explicit value the governor did not itself introduce and keep."""
    governor_owns = (base_explicit.isNotNull() & ~base_explicit
                     & explicit.eqNullSafe(gov_value))
    return explicit.isNotNull() & ~governor_owns


def plan_calc(classes: DataFrame, estimates: DataFrame, samples: DataFrame,
              snapshots: DataFrame, actuator_state: DataFrame | None,
              policy: DataFrame | None, tick_id: int, as_of=None,
              params: P.Params = P.DEFAULT, state: DataFrame | None = None) -> DataFrame:
    """All columns of one plan() tick. ``state`` may carry the tick's current rows (from
    ``asof.tick_state``); by default they are reconstructed from the stored history."""
    tgt = asof.target_snapshot(snapshots, as_of)
    hdr = asof.header_at(snapshots, tgt).select(
        "cluster_id", "def_vac_scale_factor", "def_vac_threshold", "oldest_xmin_owner",
        "oldest_xmin_owner_detail")
    st = (state if state is not None else asof.state_and_previous(samples, snapshots, tgt)
          ).select(*KEY, "reltuples", "reloptions")
    est = estimates.select(*KEY, "saturation_cause", "freeze_debt", "mxid_freeze_debt",
                           "vacuum_debt_ratio", "effectiveness")
    b = (classes.select(*KEY, "kind").join(est, KEY).join(st, KEY)
         .join(F.broadcast(hdr), "cluster_id"))
    if actuator_state is not None:
        ast = actuator_state.filter(F.col("actuator") == VAC_SF).select(
            *KEY, F.col("baseline_explicit").alias("ast_baseline_explicit"),
            F.col("current_value").alias("ast_current_value"))
        b = b.join(ast, KEY, "left")
    else:
        b = (b.withColumn("ast_baseline_explicit", F.lit(None).cast("boolean"))
              .withColumn("ast_current_value", F.lit(None).cast("string")))
    pol = _policy_cols(policy, params)
    if pol is not None:
        b = b.join(F.broadcast(pol), "cluster_id", "left")
    else:
        b = (b.withColumn("aggressiveness", F.lit(None).cast("double"))
              .withColumn("manage_user_owned", F.lit(None).cast("boolean")))
    aggr = X.guarded_positive("aggressiveness", params.aggressiveness)
    manage = F.coalesce(F.col("manage_user_owned"), F.lit(params.manage_user_owned))
    explicit = X.reloption("reloptions", VAC_SF)
    b = (b.withColumn("f_template", X.class_target("kind", params.class_targets))
          .withColumn("cur_sf", X.effective_setting("reloptions", VAC_SF, "def_vac_scale_factor"))
          .withColumn("cur_base", X.effective_setting("reloptions", VAC_THR, "def_vac_threshold",
                                                      "bigint"))
          .withColumn("sf_user_set", user_owned(explicit, F.col("ast_baseline_explicit"),
                                                F.col("ast_current_value")))
          .withColumn("freeze_stress", (F.col("freeze_debt") > params.freeze_thr)
                      | (F.coalesce(F.col("mxid_freeze_debt"), F.lit(0.0)) > params.freeze_thr))
          .withColumn("horizon_pinned", F.col("oldest_xmin_owner").isNotNull()
                      & (F.col("oldest_xmin_owner") != "none")))
    b = b.withColumn("eff_f", F.when(F.col("freeze_stress"), F.lit(params.sf_min)).otherwise(
        X.clamp(F.col("f_template") / aggr, F.lit(params.sf_min), F.lit(params.sf_max))))
    cont = X.clamp(F.col("eff_f") - F.col("cur_base").cast("double")
                   / F.greatest(F.col("reltuples").cast("double"), F.lit(1.0)),
                   F.lit(params.sf_min), F.lit(params.sf_max))
    b = b.withColumn("sf_target", X.snap_to_grid(cont, params.sf_grid))
    owner = F.coalesce(F.col("oldest_xmin_owner"), F.lit("unknown"))
    fs, sc = F.col("freeze_stress"), F.col("saturation_cause")
    same = F.col("sf_target") == F.col("cur_sf")
    decision = (F.when(fs & F.col("horizon_pinned"), F.concat(F.lit("escalate:inhibited:"), owner))
                .when(fs & same, F.lit("hold"))
                .when(fs, F.lit("adjust"))
                .when(sc == "inhibited", F.concat(F.lit("escalate:inhibited:"), owner))
                .when(sc == "io_limited", F.lit("escalate:io_limited"))
                .when(sc == "config", F.lit("suppressed:not_firing"))
                .when(~manage & F.col("sf_user_set"), F.lit("suppressed:user_owned"))
                .when(same, F.lit("hold"))
                .otherwise(F.lit("adjust")))
    return (b.withColumn("decision", decision)
             .withColumn("tick_id", F.lit(tick_id).cast("long"))
             .withColumn("actuator", F.lit(VAC_SF))
             .withColumn("proposed_value", F.col("sf_target").cast("string"))
             .withColumn("policy_rule", F.concat(F.lit("class="), F.col("kind"), F.lit(" f*="),
                                                 F.col("f_template").cast("string")))
             .withColumn("estimated_benefit", F.when(F.col("decision") == "adjust",
                                                     F.col("cur_sf") - F.col("sf_target")))
             .withColumn("observation", X.evidence_json(
                 vacuum_debt_ratio="vacuum_debt_ratio", effectiveness="effectiveness",
                 reltuples="reltuples", cur_sf="cur_sf"))
             .withColumn("prev_state", X.evidence_json(
                 saturation_cause="saturation_cause", freeze_debt="freeze_debt",
                 horizon_owner="oldest_xmin_owner"))
             .withColumn("desired_state", X.evidence_json(
                 f_template="f_template", eff_f="eff_f", sf_target="sf_target")))


def plan_decisions(*args, **kw) -> DataFrame:
    """One decision per relation with precedence freeze > saturation > ownership."""
    return plan_calc(*args, **kw).select(*DECISION_COLS)


def findings(estimates: DataFrame, samples: DataFrame, snapshots: DataFrame, as_of=None,
             params: P.Params = P.DEFAULT) -> DataFrame:
    """Saturated or freeze-pinned relations of the snapshot, with severity and advice."""
    tgt = asof.target_snapshot(snapshots, as_of)
    live = asof.known_relations(samples, tgt)
    return findings_of(estimates.join(live, KEY, "left_semi"), asof.header_at(snapshots, tgt), params)


def findings_of(estimates: DataFrame, headers: DataFrame, params: P.Params = P.DEFAULT) -> DataFrame:
    """D14 for estimate rows and their snapshot's header (one row per cluster)."""
    hdr = headers.select("cluster_id", "oldest_xmin_owner", "oldest_xmin_owner_detail", "oldest_xmin_age")
    e = estimates.join(F.broadcast(hdr), "cluster_id")
    thr = params.freeze_thr
    frz = (F.col("freeze_debt") > thr) | (F.coalesce(F.col("mxid_freeze_debt"), F.lit(0.0)) > thr)
    owner = F.col("oldest_xmin_owner")
    sc = F.col("saturation_cause")
    e = e.filter(sc.isin("inhibited", "io_limited", "config") | (frz & (owner != "none")))
    cls = (F.when(sc == "io_limited", F.lit("io_limited"))
           .when(sc == "config", F.lit("autovacuum_not_running")).otherwise(owner))
    sev = (F.when(frz & (owner != "none"), F.lit("critical"))
           .when(sc == "inhibited", F.lit("critical")).otherwise(F.lit("warning")))
    rec = (F.when(sc == "io_limited", F.lit(ADVICE_IO_LIMITED))
           .when(sc == "config", F.lit(ADVICE_NOT_RUNNING))
           .when(owner.isNotNull(), F.format_string(
               ADVICE_BLOCKED, owner, F.coalesce(F.col("oldest_xmin_owner_detail"), F.lit("?")))))
    return e.select(*KEY, cls.alias("inhibitor_class"), sev.alias("severity"),
                    rec.alias("recommendation"),
                    X.evidence_json(saturation_cause="saturation_cause",
                                    vacuum_debt_ratio="vacuum_debt_ratio",
                                    effectiveness="effectiveness", freeze_debt="freeze_debt",
                                    horizon_owner="oldest_xmin_owner",
                                    horizon_age="oldest_xmin_age").alias("evidence"))


def reconcile(found: DataFrame, diagnostics: DataFrame, live: DataFrame) -> DataFrame:
    """One full outer join on (cluster, relid, class) classifies every pair:
    'open' (new finding), 'keep' (still open), 'resolve' (open, cleared, relation live and
    not an oscillation finding). NULL classes match each other."""
    openr = diagnostics.filter(F.col("resolved_at").isNull()).select(
        F.col("cluster_id").alias("d_cluster"), F.col("relid").alias("d_relid"),
        F.col("inhibitor_class").alias("d_class"), "diagnostic_id", "severity")
    f = found.select(*KEY, "inhibitor_class", F.col("severity").alias("f_severity"))
    j = f.join(openr, (f.cluster_id == openr.d_cluster) & (f.relid == openr.d_relid)
               & f.inhibitor_class.eqNullSafe(openr.d_class), "full_outer")
    lv = live.select(F.col("cluster_id").alias("l_cluster"), F.col("relid").alias("l_relid"),
                     F.lit(True).alias("_live"))
    j = j.join(lv, (F.col("d_cluster") == F.col("l_cluster")) & (F.col("d_relid") == F.col("l_relid")),
               "left")
    action = (F.when(F.col("d_relid").isNull(), F.lit("open"))
              .when(F.col("relid").isNotNull(), F.lit("keep"))
              .when(F.coalesce(F.col("_live"), F.lit(False))
                    & ~F.col("d_class").eqNullSafe(F.lit("control_oscillation")), F.lit("resolve")))
    return j.select(F.coalesce("cluster_id", "d_cluster").alias("cluster_id"),
                    F.coalesce("relid", "d_relid").alias("relid"),
                    F.when(F.col("relid").isNotNull(), F.col("inhibitor_class"))
                     .otherwise(F.col("d_class")).alias("inhibitor_class"),
                    "diagnostic_id", action.alias("action")).filter(F.col("action").isNotNull())


OSCILLATION_CLASS = "control_oscillation"


def reconcile_oscillation(oscillating: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """D15 for control oscillation: each flapping relation (``oscillation``) has one open
    critical finding. 'open' where it has none, 'keep' where it has one, 'resolve' an open
    finding of a relation that stopped flapping (also of one that is gone). One full outer
    join on (cluster, relid); several open findings of a relation are all kept or resolved."""
    d = diagnostics.filter(F.col("resolved_at").isNull()
                           & (F.col("inhibitor_class") == OSCILLATION_CLASS)).select(*KEY, "diagnostic_id")
    o = oscillating.select(*KEY, "reversals", "n_changes", "first_at", "last_at")
    j = o.join(d, KEY, "full_outer")
    action = (F.when(F.col("reversals").isNull(), F.lit("resolve"))
              .when(F.col("diagnostic_id").isNull(), F.lit("open")).otherwise(F.lit("keep")))
    return j.select(*KEY, F.lit(OSCILLATION_CLASS).alias("inhibitor_class"),
                    F.lit("critical").alias("severity"), "diagnostic_id", "reversals", "n_changes",
                    "first_at", "last_at", action.alias("action"))


def oscillation(actions: DataFrame, as_of, window_s: int, min_reversals: int,
                actuator: str = VAC_SF, values: bool = True) -> DataFrame:
    """D16 (W1, W2, A6, A7): relations whose applied values reverse direction at least
    ``min_reversals`` times inside the window. Both lags use the skew-safe previous-row
    lookup (per relation and day, with a cross-day carry). ``values`` adds the applied
    values in their order."""
    seq = (actions.filter((F.col("status") == "applied") & (F.col("actuator") == actuator)
                          & (F.col("relid") != 0) & X.within_last("applied_at", as_of, window_s))
           .select(*KEY, "relname", "action_id", "applied_at",
                   F.col("new_value").try_cast("double").alias("v")))
    day = X.epoch_day("applied_at")
    d1 = previous_row(seq, KEY, ["applied_at", "action_id"], day, ["v"])
    d1 = d1.withColumn("d", F.signum(F.col("v") - F.col("prev_v"))).drop("prev_v", "prev_exists")
    d2 = previous_row(d1, KEY, ["applied_at", "action_id"], day, ["d"])
    rev = (F.col("d") != 0) & (F.col("prev_d") != 0) & (F.col("d") != F.col("prev_d"))
    g = d2.groupBy(*KEY).agg(
        F.max("relname").alias("relname"),
        F.count_if(F.coalesce(rev, F.lit(False))).alias("reversals"),
        F.count("*").alias("n_changes"),
        F.min("applied_at").alias("first_at"), F.max("applied_at").alias("last_at")).filter(
        F.col("reversals") >= min_reversals)
    if not values:
        return g
    # the values of relations that flap only: one ordered list each, of the window's changes
    recent = seq.join(g.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("applied_at", "action_id", "v"))),
                    lambda x: x.getField("v").cast("string")).alias("recent_values"))
    return g.join(recent, KEY)


def tick_summary(decisions: DataFrame) -> DataFrame:
    """Per control cycle the decisions, distinct relations and applied count."""
    return decisions.groupBy("cluster_id", "tick_id").agg(
        F.count("*").alias("n_decisions"),
        F.count_distinct("relid").alias("n_relations"),
        F.count_if(F.col("applied")).alias("n_applied"),
        F.count_if(F.col("decision") == "adjust").alias("n_adjust"))


# FIXED VALUES: the expert-static arm's scale factor per class and its threshold cap.
STATIC_SF = {"oltp": 0.02, "queue": 0.005, "delete_heavy": 0.01, "mixed": 0.05,
             "append_only": 0.20, "archive": 0.20}


def static_settings(classes: DataFrame, state: DataFrame) -> DataFrame:
    """The rule-based baseline setting per class, plus a threshold cap for very
    large tables (>= 1e8 rows)."""
    m = F.create_map(*[e for k, v in STATIC_SF.items() for e in (F.lit(k), F.lit(v))])
    j = classes.select(*KEY, "kind").join(state.select(*KEY, "reltuples"), KEY)
    return j.select(*KEY, "kind", F.try_element_at(m, F.col("kind")).alias("static_sf"),
                    F.when(F.col("reltuples") >= P.STATIC_LARGE_TABLE_ROWS,
                           F.lit(P.STATIC_LARGE_TABLE_THRESHOLD).cast("long"))
                     .alias("static_threshold"))


#: Ticks of a relation that one task sorts (a week of minutes).
SPAN_TICKS = 10_080


def sustained_deviation(decisions: DataFrame, n_sustain: int = P.CLASS_PERSISTENCE_N_SUSTAIN,
                        grid=P.SF_GRID) -> DataFrame:
    """Per relation and tick, how many consecutive ticks proposed the same grid value
    (gaps and islands), the grid-level distance from the previous run's value, and whether
    the proposal may act: the run is at least n long and a direction reversal against the
    previous move clears two grid levels. Previous rows and running totals are taken over
    ``SPAN_TICKS`` ticks at a time with a carry, so no task holds a relation's whole log."""
    gi = F.array_position(F.array(*[F.lit(float(g)) for g in grid]),
                          F.col("proposed_value").try_cast("double"))
    order, span = ["tick_id", "decision_id"], F.floor(F.col("tick_id") / SPAN_TICKS)
    d = decisions.select(*KEY, *order, gi.cast("int").alias("level"))
    d = previous_row(d, KEY, order, span, ["level"])
    d = d.withColumn("_new", F.coalesce(F.col("level") != F.col("prev_level"), F.lit(True)))
    d = d.drop("prev_level", "prev_exists")
    d = running(d, KEY, order, span, {"run_id": ("sum", F.col("_new").cast("int")), "_at": ("sum", F.lit(1))})
    d = running(d, KEY, order, span, {"_start": ("max", F.when(F.col("_new"), F.col("_at")))})
    d = d.withColumn("run_len", (F.col("_at") - F.col("_start") + 1).cast("int"))
    runs = d.filter(F.col("_new")).select(*KEY, "run_id", F.col("level").alias("run_level"))
    part = F.floor(F.col("run_id") / SPAN_TICKS)
    runs = previous_row(runs, KEY, ["run_id"], part, ["run_level"]).drop("prev_exists")
    runs = runs.withColumnRenamed("prev_run_level", "prev_level")
    runs = previous_row(runs, KEY, ["run_id"], part, ["prev_level"])
    runs = runs.withColumn("prev_dir", F.signum(F.col("prev_level") - F.col("prev_prev_level")))
    j = d.join(runs.select(*KEY, "run_id", "prev_level", "prev_dir"), [*KEY, "run_id"])
    step = F.col("level") - F.col("prev_level")
    reversal = F.coalesce((F.signum(step) * F.col("prev_dir")) < 0, F.lit(False))
    need = F.when(reversal, F.lit(2)).otherwise(F.lit(1))
    return j.select(*KEY, "tick_id", "decision_id", "level", "run_len",
                    F.abs(step).alias("level_distance"), reversal.alias("reversal"),
                    ((F.col("run_len") >= n_sustain)
                     & F.coalesce(F.abs(step) >= need, F.lit(True))).alias("eligible"))


def plannable_snapshot(estimates: DataFrame) -> DataFrame:
    """The snapshot a control cycle plans on: the newest one every estimate row
    describes, per cluster (decisions and estimates then refer to the same snapshot)."""
    return estimates.groupBy("cluster_id").agg(F.max("snapshot_id").alias("plan_snapshot_id"),
                                               F.count("*").alias("estimated_relations"))
