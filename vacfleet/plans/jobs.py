"""The user-level jobs, composed from the operators (survey section 3).

Each returns a dict of named DataFrames (nothing is collected); a caller writes what it
keeps. Inputs are the stored telemetry and audit tables; ``as_of`` is explicit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacfleet import params as P
from vacfleet.functions import exprs as X
from vacfleet.operators import (admit, asof, classify, estimate, experiment, health,
                                plan, retention, rollup, sparse)
from vacfleet.session import store


def observe_tick(dense_at_p: DataFrame, cache: DataFrame, policy: DataFrame,
                 live: DataFrame) -> dict[str, DataFrame]:
    """Fast loop, collection half: filter the catalog scan of snapshot p, log the rows
    that changed, refresh the change-detection cache (vanished relations purged)."""
    collected = sparse.collection_filter(dense_at_p, policy)
    changed = sparse.change_join(collected, cache)
    state = sparse.refresh_state(cache, collected.select(*cache.columns), live)
    return {"collected": collected, "samples": changed, "cache": state}


def state_tick(samples: DataFrame, snapshots: DataFrame, prior_estimate: DataFrame | None,
               prior_class: DataFrame | None, policy: DataFrame | None,
               cache: DataFrame | None = None, as_of=None,
               params: P.Params = P.DEFAULT) -> dict[str, DataFrame]:
    """Fast loop, state half: classify and estimate at snapshot p. With a cache (newest
    stored row per relation before p) the tick reads only the cache and the rows stored
    at p; without one it reconstructs from the stored history."""
    tgt = asof.target_snapshot(snapshots, as_of)
    st_e = st_c = None
    if cache is not None:
        hdr = asof.header_at(snapshots, tgt).select("cluster_id", "snapshot_id", "collected_day")
        new = samples.join(F.broadcast(hdr), ["cluster_id", "snapshot_id", "collected_day"])
        st_e = asof.tick_state(cache, new, tgt, estimate.PREV_COLS)
        st_c = asof.tick_state(cache, new, tgt, classify.PREV_COLS)
    return {
        "estimate": estimate.estimate_tick(samples, snapshots, prior_estimate, tgt, params, st_e),
        "class": classify.classify_tick(samples, snapshots, prior_class, policy, tgt, params, st_c),
    }


def control_tick(classes: DataFrame, estimates: DataFrame, samples: DataFrame,
                 snapshots: DataFrame, actuator_state: DataFrame, actions: DataFrame,
                 ticks: DataFrame, diagnostics: DataFrame, override_events: DataFrame,
                 inventory: DataFrame, policy: DataFrame | None, tick_id: int, now,
                 budget_bytes: int | None = None,
                 params: P.Params = P.DEFAULT) -> dict[str, DataFrame]:
    """Control loop: metrics -> health (with the operator floor) -> decisions -> findings
    and reconcile -> oscillation -> admission of the adjust decisions."""
    osc = plan.oscillation(actions, now, params.oscillation_window_s,
                           params.oscillation_min_reversals)
    sh = retention.self_health(inventory, budget_bytes)
    metrics = health.governor_metrics(actions, snapshots, ticks, sh, osc, now)
    state = health.override_floor(health.evaluate_health(metrics, policy, params), override_events)
    calc = plan.plan_calc(classes, estimates, samples, snapshots, actuator_state, policy,
                          tick_id, None, params)
    # unique over ticks and the same on a replay
    decisions = calc.select(*plan.DECISION_COLS).withColumn("decision_id", F.xxhash64("cluster_id", "tick_id", "relid"))
    found = plan.findings(estimates, samples, snapshots, None, params)
    live = asof.state_as_of(samples, snapshots)
    reconciled = plan.reconcile(found, diagnostics, live.select("cluster_id", "relid"))
    flapping = plan.reconcile_oscillation(osc, diagnostics)
    admitted = admit.admit_actions(decisions, live, actuator_state, actions, state, policy,
                                   clock=X.col(now), params=params)
    return {"metrics": metrics, "governor_state": state, "decisions": decisions,
            "findings": found, "reconcile": reconciled, "oscillating": osc,
            "reconcile_oscillation": flapping,
            "admission": admitted}


def daily_jobs(samples: DataFrame, snapshots: DataFrame, inventory: DataFrame,
               actions: DataFrame, decisions: DataFrame, ticks: DataFrame,
               diagnostics: DataFrame, now, budget_bytes: int,
               lookback_s: float | None = P.ROLLUP_LOOKBACK_SECONDS,
               tier_root: str | None = None,
               transitions: DataFrame | None = None) -> dict[str, DataFrame]:
    """Daily: the rollup cascade over the lookback (upserted into the stored tiers under
    ``tier_root`` when that is given), rollup and raw retention plans, audit retention and
    the storage shedding plan."""
    r1m, r1h, r1d = (rollup.rollup(samples, snapshots, lookback_s) if tier_root is None
                     else rollup.update_tiers(samples, snapshots, tier_root, lookback_s))
    return {"rollup_1m": r1m, "rollup_1h": r1h, "rollup_1d": r1d,
            "rollup_retention": rollup.rollup_retention(inventory, now),
            "raw_retention": rollup.raw_retention(samples),
            "audit_retention": retention.audit_retention(actions, decisions, ticks,
                                                         diagnostics, now, transitions=transitions),
            "shedding_plan": retention.shedding_plan(inventory, diagnostics, actions, now,
                                                     budget_bytes, decisions=decisions,
                                                     ticks=ticks)}


def analysis(tx_log: DataFrame, metrics: DataFrame, run_meta: DataFrame, window_s: int,
             roles: experiment.Roles) -> dict[str, DataFrame]:
    """Experiment analysis over every cell at once: window p95 -> best of sweep -> gap
    closed -> gates -> verdict -> cell verdict."""
    p95 = store(experiment.window_p95(tx_log, window_s), "window_p95")     # every side reads it
    arm = p95.filter(F.col("arm") != roles.oracle).drop("probe_sf")
    best = experiment.best_of_sweep(p95.filter(F.col("arm") == roles.oracle))
    gaps = experiment.gap_closed(arm, best, roles)
    v = experiment.verdict(gaps, experiment.cost_gates(metrics, roles),
                           experiment.safety_floor(metrics, run_meta, roles))
    return {"window_p95": p95, "best_of_sweep": best, "gap_closed": gaps, "verdict": v,
            "cell_verdict": experiment.cell_verdict(v),
            "interval_check": experiment.interval_check(run_meta)}
