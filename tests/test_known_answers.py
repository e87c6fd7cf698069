"""Known answers of the reference's own unit tests, on tiny hand-built frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from frames import T0, sample, snap
from vacfleet import params as P
from vacfleet.operators import asof, classify, debt, estimate, experiment as XP, health, plan
from vacfleet.operators import rollup as R
from vacfleet.operators import sparse


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


# ---- maintenance debt ------------------------------------------------------------------
def test_debt_math(spark, samples_df, snaps_df):
    s = samples_df([sample(n_dead_tup=30, n_mod_since_analyze=10, relfrozenxid_age=100000000)])
    r = one(debt.maintenance_debt(s, snaps_df([snap()])))
    assert r.vacuum_threshold == 250 and r.analyze_threshold == 150
    assert r.dead_tuple_fraction == pytest.approx(0.03)
    assert r.vacuum_debt_ratio == pytest.approx(0.12)
    assert r.analyze_debt_ratio == pytest.approx(0.066667, abs=1e-6)
    assert r.freeze_debt == pytest.approx(0.5)


def test_option_override(spark, samples_df, snaps_df):
    s = samples_df([sample(n_dead_tup=30, reloptions=["autovacuum_vacuum_scale_factor=0.05"])])
    r = one(debt.maintenance_debt(s, snaps_df([snap()])))
    assert r.vacuum_threshold == pytest.approx(100) and r.vacuum_debt_ratio == pytest.approx(0.3)


def test_unknown_row_count(spark, samples_df, snaps_df):
    s = samples_df([sample(n_dead_tup=30, reltuples=-1.0)])
    r = one(debt.maintenance_debt(s, snaps_df([snap()])))
    assert r.dead_tuple_fraction is None and r.vacuum_threshold == 50


# ---- sparse logging and carry forward ----------------------------------------------------
def test_sparse_log_quiet_entities(spark, samples_df):
    rows = [sample(relid=r, snapshot_id=s) for r in range(5) for s in range(1, 6)]
    dense = samples_df(rows).drop("relfrozenxid_age", "relminmxid_age")
    assert sparse.sparse_log(dense).count() == 5


def test_carry_forward(spark, samples_df, snaps_df):
    s = samples_df([sample(snapshot_id=1, n_dead_tup=7)])
    st = one(asof.state_as_of(s, snaps_df([snap(snapshot_id=1), snap(snapshot_id=2)])))
    assert st.snapshot_id == 2 and st.n_dead_tup == 7


# ---- rollups --------------------------------------------------------------------------------
def _ab(samples_df, snaps_df):
    a1 = T0 + dt.timedelta(minutes=10, seconds=10)
    a2 = T0 + dt.timedelta(minutes=10, seconds=40)
    b = T0 + dt.timedelta(minutes=20, seconds=5)
    snaps = snaps_df([snap(snapshot_id=1, collected_at=a1), snap(snapshot_id=2, collected_at=a2),
                      snap(snapshot_id=3, collected_at=b)])
    s = samples_df([sample(snapshot_id=1, n_dead_tup=100), sample(snapshot_id=2, n_dead_tup=200),
                    sample(snapshot_id=3, n_dead_tup=600)])
    return s, snaps, (a1, b)


def test_rollup_minute_and_coarse(spark, samples_df, snaps_df):
    s, snaps, _ = _ab(samples_df, snaps_df)
    r1m, r1h, r1d = R.rollup(s, snaps)
    a = one(r1m.filter(F.col("sample_count") == 2))
    assert (a.avg_dead_tup, a.max_dead_tup) == (150.0, 200)
    h = one(r1h)
    assert h.avg_dead_tup == pytest.approx(300.0) and h.max_dead_tup == 600 and h.sample_count == 3
    assert one(r1d).avg_dead_tup == pytest.approx(300.0)


def test_rollup_rerun_idempotent(spark, samples_df, snaps_df, tmp_path):
    s, snaps, _ = _ab(samples_df, snaps_df)
    path = str(tmp_path / "r1m")
    for _ in range(2):
        R.write_tier(R.rollup(s, snaps)[0], path)
    assert spark.read.parquet(path).count() == 2


def test_tier_as_of(spark, samples_df, snaps_df):
    s, snaps, (a1, b) = _ab(samples_df, snaps_df)
    r1m = R.rollup(s, snaps)[0]
    mid = F.lit(a1 + dt.timedelta(minutes=5)).cast("timestamp_ntz")
    assert one(asof.rollup_as_of(r1m, "1m", mid)).avg_dead_tup == 150.0
    assert one(asof.rollup_as_of(r1m, "1m", F.lit(b).cast("timestamp_ntz"))).avg_dead_tup == 600.0
    with pytest.raises(ValueError):
        asof.rollup_as_of(r1m, "5m", mid)


# ---- estimate ------------------------------------------------------------------------------
def test_rates(spark, samples_df, snaps_df):
    s = samples_df([sample(snapshot_id=1),
                    sample(snapshot_id=2, n_tup_ins=600, n_tup_upd=300, n_tup_del=300)])
    snaps = snaps_df([snap(snapshot_id=1, collected_at=T0),
                      snap(snapshot_id=2, collected_at=T0 + dt.timedelta(seconds=60))])
    assert one(estimate.estimate_tick(s, snaps, None)).churn_rate == pytest.approx(20.0)


def test_cycle_boundary(spark, samples_df, snaps_df):
    s = samples_df([sample(snapshot_id=1, n_dead_tup=100, autovacuum_count=5, relfrozenxid_age=900),
                    sample(snapshot_id=2, n_dead_tup=50, autovacuum_count=6, relfrozenxid_age=100)])
    e = one(estimate.estimate_tick(s, snaps_df([snap(snapshot_id=1), snap(snapshot_id=2)]), None))
    assert e.effectiveness == 1.0 and e.cleanup_per_run == 50
    assert e.f_peak_current == pytest.approx(0.05) and e.freeze_progressing is True


@pytest.mark.parametrize("av_ago,expected", [(dt.timedelta(hours=3), "config"),
                                             (dt.timedelta(minutes=10), "io_limited")])
def test_saturation_candidate(spark, samples_df, snaps_df, av_ago, expected):
    now = T0 + dt.timedelta(hours=5)
    s = samples_df([sample(snapshot_id=1, n_dead_tup=500, last_autovacuum=now - av_ago)])
    e = one(estimate.estimate_tick(s, snaps_df([snap(snapshot_id=1, collected_at=now)]), None))
    assert e.saturation_candidate == expected and e.saturation_cause is None


def test_saturation_streak_inhibited(spark, samples_df, snaps_df):
    snaps = snaps_df([snap(snapshot_id=i, collected_at=T0 + dt.timedelta(minutes=i),
                           oldest_xmin_owner="long_running_txn", oldest_xmin_owner_detail="42")
                      for i in range(1, 5)])
    s = samples_df([sample(snapshot_id=i, n_dead_tup=500, autovacuum_count=i - 1,
                           last_autovacuum=T0 + dt.timedelta(minutes=i) - dt.timedelta(seconds=30)
                           if i > 1 else None) for i in range(1, 5)])
    prior = None
    for p in (2, 3, 4):
        prior = estimate.estimate_tick(s, snaps, prior, p).cache()
    e = one(prior)
    assert (e.saturation_cause, e.saturation_streak) == ("inhibited", 3)


# ---- classify -------------------------------------------------------------------------------
MIXES = {1: (200, 0, 0, 1000.0, "append_only"), 2: (10, 150, 5, 1000.0, "oltp"),
         3: (30, 0, 150, 5000.0, "delete_heavy"), 4: (100, 0, 95, 1000.0, "queue"),
         5: (0, 0, 0, 200000.0, "archive"), 6: (40, 20, 15, 5000.0, "mixed")}


def test_classify_six_mixes(spark, samples_df, snaps_df):
    rows = []
    for rid, (i, u, d, rt, _) in MIXES.items():
        rows.append(sample(relid=rid, snapshot_id=1, reltuples=rt))
        rows.append(sample(relid=rid, snapshot_id=2, n_tup_ins=i, n_tup_upd=u, n_tup_del=d,
                           reltuples=rt))
    c = classify.classify_tick(samples_df(rows), snaps_df([snap(snapshot_id=1), snap(snapshot_id=2)]),
                               None, None)
    got = {r.relid: r.kind for r in c.collect()}
    assert got == {rid: m[4] for rid, m in MIXES.items()}


def test_classify_hysteresis(spark, samples_df, snaps_df):
    rows = [sample(snapshot_id=1), sample(snapshot_id=2, n_tup_ins=10, n_tup_upd=150, n_tup_del=5)]
    ins = 10
    for sid in (3, 4, 5):
        ins += 200
        rows.append(sample(snapshot_id=sid, n_tup_ins=ins, n_tup_upd=150, n_tup_del=5))
    s = samples_df(rows)
    snaps = snaps_df([snap(snapshot_id=i) for i in range(1, 6)])
    kinds, prior = [], None
    for p in (2, 3, 4, 5):
        prior = classify.classify_tick(s, snaps, prior, None, p).cache()
        kinds.append(one(prior).kind)
    assert kinds == ["oltp", "oltp", "oltp", "append_only"]


# ---- oscillation --------------------------------------------------------------------------------
def _actions(spark, values, start):
    rows = [("c0", i + 1, 7, "t", P.ACTUATOR_SF, str(v), "applied", None,
             start + dt.timedelta(hours=2 * i)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "cluster_id string, action_id bigint, relid bigint, "
                                       "relname string, actuator string, new_value string, "
                                       "status string, failure_reason string, "
                                       "applied_at timestamp_ntz")


@pytest.mark.parametrize("values,age_days,flagged", [
    ([0.05, 0.10, 0.05, 0.10], 0, True), ([0.01, 0.02, 0.05, 0.10], 0, False),
    ([0.05, 0.10, 0.05], 0, False), ([0.05, 0.10, 0.05, 0.10], 4, False)])
def test_oscillation(spark, values, age_days, flagged):
    now = dt.datetime(2024, 1, 10)
    start = now - dt.timedelta(days=age_days, hours=7)
    o = plan.oscillation(_actions(spark, values, start), F.lit(now).cast("timestamp_ntz"),
                         P.OSCILLATION_WINDOW_SECONDS, P.OSCILLATION_MIN_REVERSALS).collect()
    assert bool(o) == flagged
    if flagged:
        assert o[0].reversals == 2


# ---- health ---------------------------------------------------------------------------------------
def _metrics(spark, **kw):
    base = dict(cluster_id="c0", observation_lag_s=None, control_loop_lag_s=None,
                failed_actions_last_hour=0, lock_timeouts_last_hour=0, over_budget=None,
                applied_actions_last_day=0, oscillating_relations=0, connection_pressure=None,
                connection_pressure_pct=None, client_backends=None, max_connections=None)
    base.update(kw)
    schema = ("cluster_id string, observation_lag_s double, control_loop_lag_s double, "
              "failed_actions_last_hour bigint, lock_timeouts_last_hour bigint, over_budget boolean, "
              "applied_actions_last_day bigint, oscillating_relations bigint, "
              "connection_pressure double, connection_pressure_pct double, client_backends bigint, "
              "max_connections int")
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(base[n] for n in names)], schema)


@pytest.mark.parametrize("kw,state", [
    ({}, "normal"), ({"failed_actions_last_hour": 4}, "degraded"),
    ({"failed_actions_last_hour": 11}, "diagnostic"),
    ({"connection_pressure": 0.95, "connection_pressure_pct": 95.0, "client_backends": 95,
      "max_connections": 100}, "diagnostic"),
    ({"control_loop_lag_s": 300.0}, "normal"), ({"control_loop_lag_s": 1500.0}, "degraded"),
    ({"control_loop_lag_s": 3900.0}, "emergency")])
def test_health_states(spark, kw, state):
    assert one(health.evaluate_health(_metrics(spark, **kw))).state == state


def test_override_floor_never_lowers(spark):
    comp = spark.createDataFrame([("c0", "diagnostic", "x")], "cluster_id string, state string, reason string")
    ev = spark.createDataFrame([("c0", dt.datetime(2024, 1, 1), "force", "degraded", "hold")],
                               "cluster_id string, event_at timestamp_ntz, action string, "
                               "forced_state string, forced_reason string")
    assert one(health.override_floor(comp, ev)).state == "diagnostic"


# ---- experiment verdicts --------------------------------------------------------------------------------
def _cell(spark, windows):
    p95 = [("events", "s", 1, w, a, v) for w, (e, c, _) in enumerate(windows)
           for a, v in (("expert", e), ("candidate", c))]
    arm = spark.createDataFrame(p95, "fixture string, scenario string, seed int, win bigint, "
                                     "arm string, p95_us bigint")
    best = spark.createDataFrame([("events", "s", 1, w, 0.1, b) for w, (_, _, b) in enumerate(windows)],
                                 "fixture string, scenario string, seed int, win bigint, "
                                 "best_sf double, best_p95_us bigint")
    return XP.gap_closed(arm, best, XP.Roles())


def _verdict(spark, windows):
    g = _cell(spark, windows)
    gates = spark.createDataFrame([("events", "s", 1, False, False, False, 0, 0, 0)],
                                  "fixture string, scenario string, seed int, cost_ceiling_breach boolean, "
                                  "av_ceiling_breach boolean, mutation_ceiling_breach boolean, "
                                  "defaults_av_count long, candidate_av_count long, candidate_applied long")
    safety = spark.createDataFrame([("events", "s", 1, None, 0, False, None)],
                                   "fixture string, scenario string, seed int, freeze_max_age long, "
                                   "worst_xid_age long, safety_floor_evaluated boolean, "
                                   "safety_floor_holds boolean")
    return one(XP.verdict(g, gates, safety))


def test_gap_closed_strong_pass(spark):
    v = _verdict(spark, [(200000, 150000, 100000)] * 5)
    assert v.median_gap_closed == 0.5 and v.verdict == "strong_pass" and v.warmup_discarded == 1


def test_denominator_guard(spark):
    v = _verdict(spark, [(200000, 150000, 100000)] * 5 + [(100000, 90000, 100000)] * 4)
    assert v.windows_dropped_denom == 4 and v.median_gap_closed == 0.5


@pytest.mark.parametrize("cand,verdict", [(175000, "strong_pass"), (200001, "fail")])
def test_boundaries(spark, cand, verdict):
    assert _verdict(spark, [(200000, cand, 100000)] * 5).verdict == verdict


@pytest.mark.parametrize("medians,breach,expected", [
    ([-0.10, 0.30, 0.40], False, (0.30, "strong_pass")), ([0.30, 0.50], False, (0.40, "strong_pass")),
    ([0.30, 0.50], True, (0.40, "fail"))])
def test_cell_verdict(spark, medians, breach, expected):
    rows = [("events", "s", i, m, breach and i == 0, False, False, False, True) for i, m in enumerate(medians)]
    v = spark.createDataFrame(rows, "fixture string, scenario string, seed int, median_gap_closed double, "
                                    "cost_ceiling_breach boolean, av_ceiling_breach boolean, "
                                    "mutation_ceiling_breach boolean, safety_floor_evaluated boolean, "
                                    "safety_floor_holds boolean")
    c = one(XP.cell_verdict(v))
    assert c.median_gap_closed == pytest.approx(expected[0]) and c.cell_verdict == expected[1]
