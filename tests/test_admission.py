"""Admission gates: authority, vanished, no-op, range, ownership, interval, both caps."""

import datetime as dt

import pytest

from vacfleet import params as P
from vacfleet.operators import admit

NOW = dt.datetime(2024, 1, 10, 12, 0)
SF = P.ACTUATOR_SF


def _frames(spark, decisions, live, state=(), actions=(), gov="normal"):
    d = spark.createDataFrame(
        [("c0", 7, did, rel, SF, "adjust", val) for did, rel, val in decisions],
        "cluster_id string, tick_id long, decision_id long, relid long, actuator string, "
        "decision string, proposed_value string")
    lv = spark.createDataFrame([("c0", rel, opts) for rel, opts in live],
                               "cluster_id string, relid long, reloptions array<string>")
    st = spark.createDataFrame([("c0", rel, SF, bexp, cur) for rel, bexp, cur in state],
                               "cluster_id string, relid long, actuator string, "
                               "baseline_explicit boolean, current_value string")
    ac = spark.createDataFrame(
        [("c0", aid, did, rel, SF, "0.1", status, at) for aid, did, rel, status, at in actions],
        "cluster_id string, action_id long, decision_id long, relid long, actuator string, "
        "new_value string, status string, applied_at timestamp_ntz")
    gs = spark.createDataFrame([("c0", gov)], "cluster_id string, state string")
    return d, lv, st, ac, gs


def _policy(spark, cap, budget):
    return spark.createDataFrame(
        [("c0", "p", 1.0, 3600, cap, budget, False, True)],
        "cluster_id string, policy_name string, aggressiveness double, mi int, "
        "global_max_changes_per_cycle int, daily_mutation_budget int, manage_user_owned boolean, "
        "enabled boolean").selectExpr("*", "make_dt_interval(0, 0, 0, mi) AS min_interval")


def _run(spark, frames, policy=None):
    d, lv, st, ac, gs = frames
    from pyspark.sql import functions as F
    out = admit.admit_actions(d, lv, st, ac, gs, policy, clock=F.lit(NOW).cast("timestamp_ntz"))
    return {r.decision_id: r.refusal_reason for r in out.collect()}


def test_each_refusal_reason(spark):
    frames = _frames(
        spark,
        decisions=[(1, 10, "0.05"), (2, 11, "0.05"), (3, 12, "0.9"), (4, 13, "0.05"),
                   (5, 14, "0.05"), (6, 15, "0.05"), (7, 16, "0.02")],
        live=[(10, None), (11, ["autovacuum_vacuum_scale_factor=0.05"]), (12, None),
              (13, ["autovacuum_vacuum_scale_factor=0.2"]), (14, None),
              (15, ["autovacuum_vacuum_scale_factor=0.1"])],
        state=[(15, False, "0.1")],
        actions=[(100, 99, 14, "applied", NOW - dt.timedelta(minutes=20))])
    got = _run(spark, frames)
    assert got == {1: None, 2: "noop", 3: "invalid_value", 4: "user_owned",
                   5: "min_interval", 6: None, 7: "vanished"}


def test_authority_blocks_everything(spark):
    frames = _frames(spark, decisions=[(1, 10, "0.05")], live=[(10, None)], gov="diagnostic")
    assert _run(spark, frames) == {1: "authority"}


def test_cycle_cap_counts_only_passing_rows(spark):
    frames = _frames(spark, decisions=[(1, 10, "0.05"), (2, 11, "0.05"), (3, 12, "0.05"),
                                       (4, 13, "0.05")],
                     live=[(10, None), (11, ["autovacuum_vacuum_scale_factor=0.05"]),
                           (12, None), (13, None)])
    got = _run(spark, frames, _policy(spark, cap=2, budget=500))
    assert got == {1: None, 2: "noop", 3: None, 4: "cycle_cap"}


def test_daily_budget_is_cumulative(spark):
    applied = [(100 + k, 900 + k, 500 + k, "applied", NOW - dt.timedelta(hours=2)) for k in range(3)]
    frames = _frames(spark, decisions=[(1, 10, "0.05"), (2, 11, "0.05")],
                     live=[(10, None), (11, None)], actions=applied)
    got = _run(spark, frames, _policy(spark, cap=50, budget=4))
    assert got == {1: None, 2: "daily_budget"}


@pytest.mark.parametrize("n,cap", [(30, 7)])
def test_cap_with_many_passing_rows(spark, n, cap):
    frames = _frames(spark, decisions=[(k, 100 + k, "0.05") for k in range(1, n + 1)],
                     live=[(100 + k, None) for k in range(1, n + 1)])
    got = _run(spark, frames, _policy(spark, cap=cap, budget=500))
    assert [k for k, v in sorted(got.items()) if v is None] == list(range(1, cap + 1))
    assert all(v == "cycle_cap" for k, v in got.items() if k > cap)


def test_over_ticks_uses_each_ticks_clock(spark):
    t1, t2 = NOW, NOW + dt.timedelta(hours=3)
    d = spark.createDataFrame(
        [("c0", 1, 1, 10, SF, "adjust", "0.05", t1), ("c0", 2, 2, 10, SF, "adjust", "0.05", t2)],
        "cluster_id string, tick_id long, decision_id long, relid long, actuator string, "
        "decision string, proposed_value string, tick_now timestamp_ntz")
    _, lv, st, ac, _ = _frames(spark, decisions=[], live=[(10, None)],
                               actions=[(100, 99, 10, "applied", t1 - dt.timedelta(minutes=30))])
    gs = spark.createDataFrame([], "cluster_id string, state string")
    got = {r.decision_id: r.refusal_reason
           for r in admit.admit_actions(d, lv, st, ac, gs, None).collect()}
    assert got == {1: "min_interval", 2: None}
