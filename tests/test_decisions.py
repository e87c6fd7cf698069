"""Decision routing, literal audit, transitions, shedding plan, policy change log."""

import datetime as dt

from pyspark.sql import functions as F

from frames import sample, snap
from vacfleet.operators import governance, health, plan, retention


def _plan(spark, samples_df, snaps_df, cases, owner="none", manage=None):
    """cases: relid -> (kind, saturation_cause, freeze_debt, reloptions, ast)."""
    s = samples_df([sample(relid=r, reltuples=100000.0, reloptions=c[3]) for r, c in cases.items()])
    snaps = snaps_df([snap(oldest_xmin_owner=owner, oldest_xmin_owner_detail="9")])
    classes = spark.createDataFrame([("c0", r, c[0]) for r, c in cases.items()],
                                    "cluster_id string, relid long, kind string")
    est = spark.createDataFrame([("c0", r, c[1], c[2], None, 1.0, 1.0) for r, c in cases.items()],
                                "cluster_id string, relid long, saturation_cause string, "
                                "freeze_debt double, mxid_freeze_debt double, "
                                "vacuum_debt_ratio double, effectiveness double")
    ast = spark.createDataFrame([("c0", r, "autovacuum_vacuum_scale_factor", c[4][0], c[4][1])
                                 for r, c in cases.items() if c[4]],
                                "cluster_id string, relid long, actuator string, "
                                "baseline_explicit boolean, current_value string")
    pol = None
    if manage is not None:
        pol = spark.createDataFrame([("c0", "p", 1.0, manage, True)],
                                    "cluster_id string, policy_name string, aggressiveness double, "
                                    "manage_user_owned boolean, enabled boolean")
    out = plan.plan_decisions(classes, est, s, snaps, ast, pol, 1)
    return {r.relid: (r.decision, r.proposed_value) for r in out.collect()}


def test_decision_routing(spark, samples_df, snaps_df):
    sf = "autovacuum_vacuum_scale_factor="
    cases = {
        1: ("oltp", None, 0.7, [sf + "0.005"], None),          # freeze stress, target = current
        2: ("oltp", None, 0.7, None, None),                     # freeze stress -> adjust to floor
        3: ("oltp", "inhibited", 0.1, None, None),
        4: ("oltp", "io_limited", 0.1, None, None),
        5: ("oltp", "config", 0.1, None, None),
        6: ("oltp", None, 0.1, [sf + "0.3"], None),             # set by a user first
        7: ("oltp", None, 0.1, [sf + "0.3"], (False, "0.3")),   # set by the governor, unchanged
        8: ("oltp", None, 0.1, [sf + "0.02"], None),            # user value equals the target
        9: ("append_only", None, 0.1, None, None),              # 0.2 target vs 0.2 default
    }
    got = _plan(spark, samples_df, snaps_df, cases)
    assert got[1] == ("hold", "0.005")
    assert got[2] == ("adjust", "0.005")
    assert got[3][0] == "escalate:inhibited:none"
    assert got[4][0] == "escalate:io_limited"
    assert got[5][0] == "suppressed:not_firing"
    assert got[6][0] == "suppressed:user_owned"
    assert got[7] == ("adjust", "0.02")
    assert got[8][0] == "suppressed:user_owned"
    assert got[9] == ("hold", "0.2")


def test_freeze_precedence_over_saturation_with_pinned_horizon(spark, samples_df, snaps_df):
    got = _plan(spark, samples_df, snaps_df, {1: ("oltp", "io_limited", 0.9, None, None)},
                owner="long_running_txn")
    assert got[1][0] == "escalate:inhibited:long_running_txn"


def test_manage_user_owned_policy(spark, samples_df, snaps_df):
    got = _plan(spark, samples_df, snaps_df,
                {6: ("oltp", None, 0.1, ["autovacuum_vacuum_scale_factor=0.3"], None)}, manage=True)
    assert got[6] == ("adjust", "0.02")


def test_literal_audit_rules(spark):
    texts = spark.createDataFrame([
        (1, "x = 42 -- 99 is a comment\ny = '5 minutes' and 'abc 7' z 0 1 3.5 a7"),
        (2, "nothing here 1.0 0.0")], "doc_id long, text string")
    got = {(r.text_id, r.kind, r.literal): r.n
           for r in governance.literal_audit(texts, "doc_id", "text").collect()}
    assert got == {(1, "bare", "42"): 1, (1, "quoted", "'5 minutes'"): 1, (1, "bare", "3.5"): 1}


def test_transitions_only_on_change(spark):
    t = dt.datetime(2024, 1, 1)
    series = spark.createDataFrame(
        [("c0", t + dt.timedelta(minutes=k), s, "why") for k, s in
         enumerate(["normal", "normal", "degraded", "degraded", "normal"])],
        "cluster_id string, evaluated_at timestamp_ntz, state string, reason string")
    rows = [(r.from_state, r.to_state) for r in
            health.state_transitions(series).orderBy("transitioned_at").collect()]
    assert rows == [(None, "normal"), ("normal", "degraded"), ("degraded", "normal")]


def test_shedding_stops_under_budget(spark):
    now = dt.datetime(2024, 6, 1)
    old = now - dt.timedelta(days=60)
    inv = spark.createDataFrame([
        ("c0", "o", "relation_samples", old, 1000), ("c0", "o", "rollup_1m", old, 500),
        ("c0", "o", "rollup_1h", old, 400), ("c0", "o", "rollup_1h", now, 100)],
        "cluster_id string, schema_name string, relation string, range_end timestamp_ntz, bytes long")
    diags = spark.createDataFrame([], "cluster_id string, resolved_at timestamp_ntz, detected_at timestamp_ntz")
    acts = spark.createDataFrame([], "cluster_id string, applied_at timestamp_ntz")
    out = retention.shedding_plan(inv, diags, acts, F.lit(now).cast("timestamp_ntz"), budget_bytes=700)
    got = [(r.level, r.action, r.bytes_after) for r in out.orderBy("step").collect()]
    assert got == [("raw", "swept", 1000), ("rollups_fine", "pruned", 500),
                   ("rollups_coarse", "skipped:under_budget", 500),
                   ("diagnostics", "skipped:under_budget", 500),
                   ("actions", "skipped:under_budget", 500), ("policy", "preserved", 500)]


def test_policy_history_operations(spark):
    cols = ("cluster_id string, policy_name string, description string, aggressiveness double, "
            "io_budget_fraction double, freeze_posture string, min_interval interval day to second, "
            "global_max_changes_per_cycle int, daily_mutation_budget int, n_sustain int, "
            "manage_user_owned boolean, enabled boolean, advisory_only boolean")
    row = lambda n, a: ("c0", n, "d", a, 0.1, "standard", dt.timedelta(hours=1), 50, 500, 3,
                        False, True, True)
    old = spark.createDataFrame([row("a", 1.0), row("b", 1.0), row("c", 1.0)], cols)
    new = spark.createDataFrame([row("a", 1.0), row("b", 2.0), row("d", 1.0)], cols)
    got = {r.policy_name: (r.operation, r.changed_fields)
           for r in governance.policy_history(old, new).collect()}
    assert got == {"b": ("update", "aggressiveness"), "c": ("delete", None), "d": ("insert", None)}


def test_oscillation_findings_open_keep_and_resolve(spark):
    osc = spark.createDataFrame([("n1", 1, 2), ("n1", 2, 3), ("n2", 1, 2)],
                                "cluster_id string, relid bigint, reversals bigint").selectExpr(
        "*", "reversals AS n_changes", "current_timestamp() AS first_at", "current_timestamp() AS last_at")
    diags = spark.createDataFrame(
        [("n1", 1, 7, "control_oscillation", None), ("n1", 3, 8, "control_oscillation", None),
         ("n2", 2, 7, "control_oscillation", dt.datetime(2024, 1, 1)), ("n2", 1, 9, "io_limited", None)],
        "cluster_id string, relid bigint, diagnostic_id bigint, inhibitor_class string, resolved_at timestamp")
    got = {(r.cluster_id, r.relid): (r.action, r.diagnostic_id)
           for r in plan.reconcile_oscillation(osc, diags).collect()}
    assert got == {("n1", 1): ("keep", 7), ("n1", 2): ("open", None), ("n1", 3): ("resolve", 8),
                   ("n2", 1): ("open", None)}


def test_audit_retention_counts_transitions(spark):
    now = dt.datetime(2024, 8, 1)
    rows = [("n1", now - dt.timedelta(days=d)) for d in (1, 179, 181, 400)]
    seen = spark.createDataFrame(rows, "cluster_id string, transitioned_at timestamp_ntz")
    none = {"actions": "decision_id bigint, applied_at timestamp_ntz",
            "decisions": "decision_id bigint, created_at timestamp_ntz", "ticks": "started_at timestamp_ntz",
            "diagnostics": "resolved_at timestamp_ntz, detected_at timestamp_ntz"}
    empty = {k: spark.createDataFrame([], "cluster_id string, " + v) for k, v in none.items()}
    out = retention.audit_retention(**empty, as_of=F.lit(now).cast("timestamp_ntz"), transitions=seen)
    assert [tuple(r) for r in out.collect()] == [("n1", "state_transitions", 2, 2)]
